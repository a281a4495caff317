"""Near-duplicate detection: BagMinHash signatures of word shingles, bands, exact verification.

A document is the multiset of its runs of five words (ASCII letters in lower case, words cut at
ASCII white space); a text of one to four words is one shorter run. Two documents are linked
if the weighted Jaccard similarity of their multisets is at least the threshold; classes are
the connected components, named by their smallest doc_id.

Signatures. Shingle s with multiplicity c stands for the weight interval [0, c) of its own
Poisson process over time; each point also draws one of the m components. A component's value
is the earliest point over all shingles, so two documents agree in it with probability equal to
their weighted Jaccard similarity. Processes are hierarchical: the weights lie in [0, 1), [1, 2),
[2, 4), [4, 8) ..., each a process with one rate; the first point of an interval of more than one
unit falls into one half, the other half goes on behind it, and halves beyond c are dropped. So
a shingle that occurs c times costs about log c steps, and no point later than the time by which
all components are filled is drawn.

Search. 1. Equal multisets collapse (128-bit sums). 2. 24 bands of 4 components: a pair at 0.8
is missed with probability 3e-6. 3. Each document is verified against the smallest document of each
of its band buckets (the members of one with very many are dealt to parts); most classes are complete then. 4. Buckets that still hold documents of
different classes are verified in whole: those outside the bucket's most frequent class are dealt to
blocks of about BLOCK documents or BLOCK_BYTES, so are the others, each block of the former meets each block in one bounded
task, and sends only links that join classes. 5. Components by
alternating large and small stars. Nothing is capped; step 4 is the exact way for large buckets.

Documents are searched by row: each row has a number, its doc_id or, where doc_ids repeat or are null, one that is
written once with the rows; each distinct multiset is searched by its smallest number. So each text is searched
whatever its doc_id is.

Nulls: a null text counts as empty; documents without words form one class. Rows with a null
doc_id are searched too, and come out with a null class_id. Rows that repeat a doc_id are documents of their
own: each has the class of its text (where these classes differ, both may be named by that doc_id). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ByteHash, discard, free, in_batches, map_arrow, mix, numbered, slices, spread, stored, string_buffers, windows, word_bounds

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
#: Members of a block in step 4, and bytes of text, on average.
BLOCK, BLOCK_BYTES = 384, 8 << 20
#: Rows that meet the text of their bucket's smallest document in one part of a join, at least.
LEADER_ROWS = 2048
#: Cells of a presence matrix that a task of step 4 multiplies at once.
CELLS = 1 << 22

_HASH = ByteHash(0xBA6)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def _shingles(raw: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, hash, count of the distinct shingles of some rows, sorted by doc and hash."""
    raw = _LOWER[raw]
    s, e, first = word_bounds(raw, offs)
    h = _HASH.words(raw, s, e)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    full = windows(h, width)
    inside = doc[: len(full)] == doc[width - 1 :] if len(full) else np.zeros(0, bool)
    docs, hashes = [doc[: len(full)][inside]], [full[inside]]
    for k in range(1, width):  # short texts are one run of all their words
        at = first[:-1][n == k]
        if len(at):
            docs.append(doc[at])
            hashes.append(mix(windows(h, k)[at] + _U(k)))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _unit(key: np.ndarray, step: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1] of a counter-based stream."""
    with np.errstate(over="ignore"):
        x = mix(key + np.asarray(step, np.uint64) * _U(0x9E3779B97F4A7C15))
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures (n x m) of the multisets (doc, h, count); rows of empty ones are 0."""
    weight = np.bincount(doc, count, n)
    ids = np.zeros((n, m), np.uint64)
    todo, reach = np.flatnonzero(weight > 0), np.log(m) + 3.0
    while len(todo):
        mine = np.zeros(n, bool)
        mine[todo] = True
        use = mine[doc]
        until = np.zeros(n)
        until[todo] = reach / weight[todo]
        best = np.full(n * m, np.inf)
        _draw(doc[use], h[use], count[use], until, m, best, ids.reshape(-1))
        todo = todo[np.isinf(best.reshape(n, m)[todo]).any(axis=1)]
        reach *= 2
    return ids


def _draw(doc: np.ndarray, h: np.ndarray, count: np.ndarray, until: np.ndarray, m: int, best: np.ndarray, ids: np.ndarray) -> None:
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    size = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
    low = np.where(level > 0, size, 0)
    with np.errstate(over="ignore"):
        key = mix(h[at] + level.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    doc, count = doc[at], count[at]
    u = _unit(key, 0)
    live = u >= np.exp(-until[doc] * m * size)
    doc, count, key, low, size, u = doc[live], count[live], key[live], low[live], size[live], u[live]
    time, step = -np.log(u) / (m * size), np.ones(len(doc), np.int64)
    rounds = 0
    while len(doc):
        wide = size > 1
        if wide.any():  # halves: the one with the point keeps its time
            d, c, k, lo, half, t = doc[wide], count[wide], key[wide], low[wide], size[wide] // 2, time[wide]
            right = _unit(k, 1 << 40) > 0.5
            kids = []
            for side in (0, 1):
                own = right == bool(side)
                k2 = mix(k ^ _U(0x165667B19E3779F9 + side))
                kids.append((d, c, k2, lo + side * half, half, np.where(own, t, t - np.log(_unit(k2, 0)) / (m * half))))
            d, c, k, lo, half, t = (np.concatenate(x) for x in zip(*kids, strict=True))
            ok = (lo < c) & (t <= until[d])
            flat = ~wide
            doc, count, key, low, size, time, step = (np.concatenate([a[flat], b[ok]]) for a, b in zip((doc, count, key, low, size, time, step), (d, c, k, lo, half, t, np.ones(len(d), np.int64)), strict=True))
            continue
        rounds += 1
        many = 1 if rounds < 6 else 32
        steps = step[:, None] + np.arange(many)
        gaps = -np.log(_unit(key[:, None], steps)) / m
        times = np.cumsum(np.concatenate([time[:, None], gaps], axis=1), axis=1)
        point = times[:, :-1]
        ok = point <= until[doc][:, None]
        with np.errstate(over="ignore"):
            mark = mix(key[:, None] ^ (steps.astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
        slot = (doc[:, None] * m + (mark % _U(m)).astype(np.int64))[ok]
        point, mark = point[ok], mark[ok]
        np.minimum.at(best, slot, point)
        won = best[slot] == point
        ids[slot[won]] = mark[won]
        time, step = times[:, -1], step + many
        live = time <= until[doc]
        doc, count, key, low, size, time, step = (a[live] for a in (doc, count, key, low, size, time, step))


def _sketch(bands: int, rows: int, width: int):
    powers = _U(0x9E3779B97F4A7C15)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offs = string_buffers(batch.column("text"))
        for lo, hi in slices(offs):
            n = hi - lo
            doc, h, count = _shingles(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], width)
            ids = signatures(doc, h, count, n, bands * rows)
            key = np.zeros((n, bands), np.uint64)
            sums = np.zeros((2, n), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(rows):
                    key = mix(key * powers + ids[:, r::rows])
                key = mix(key + np.arange(1, bands + 1, dtype=np.uint64))
                for i in range(2):
                    np.add.at(sums[i], doc, mix(h + _U(i + 1)) * count.astype(np.uint64))
            full = np.bincount(doc, minlength=n) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * bands)]), pa.int32()), pa.array(key[full].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(lo, n), batch.column("doc_id").slice(lo, n), *(pa.array(x.view(np.int64)) for x in sums), pa.array(np.diff(offs[lo : hi + 1])), lists], names=["row", "doc_id", "fa", "fb", "size", "bands"]
            )

    return run


def _bags(texts: list[str], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    raw, offs = string_buffers(pa.array(texts, pa.large_string()))
    out = []
    for lo, hi in slices(offs):
        doc, h, count = _shingles(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], width)
        edge = np.searchsorted(doc, np.arange(hi - lo + 1))
        out += [(h[a:b], count[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sorted bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 1.0


def overlaps(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums of smaller counts of all pairs of bags."""
    out = np.zeros((len(bags), len(bags)), np.int64)
    if len(bags) < 12:
        for i in range(len(bags)):
            for j in range(i):
                _, a, b = np.intersect1d(bags[i][0], bags[j][0], assume_unique=True, return_indices=True)
                out[i, j] = out[j, i] = np.minimum(bags[i][1][a], bags[j][1][b]).sum()
        return out
    h, c = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    who = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    level = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)  # the l-th occurrence is an element of its own
    h, who = np.repeat(h, c), np.repeat(who, c)
    with np.errstate(over="ignore"):
        h = np.where(level > 0, mix(h + level.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)), h)
    _, place, many = np.unique(h, return_inverse=True, return_counts=True)
    shared = np.cumsum(many > 1) - 1
    keep = (many > 1)[place]
    place, who = shared[place[keep]], who[keep]
    order = np.argsort(place, kind="stable")
    place, who = place[order], who[order]
    width = max(1, CELLS // len(bags))
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [lo, lo + width])
        x = np.zeros((len(bags), width), np.float32)
        x[who[a:b], place[a:b] - lo] = 1
        out += np.rint(x @ x.T).astype(np.int64)
    return out


def _verify(width: int, threshold: float):
    def run(batches):
        for batch in batches:
            left, right = batch.column("text").to_pylist(), batch.column("leader_text").to_pylist()
            own = dict.fromkeys(right)
            for text, bag in zip(own, _bags(list(own), width), strict=True):
                own[text] = bag
            keep = [similarity(a, own[b]) >= threshold for a, b in zip(_bags(left, width), right, strict=True)]
            yield batch.select(["id", "leader"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(width: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        label, side = table.column("label").to_numpy(), table.column("side").to_numpy()
        bags = _bags(table.column("text").to_pylist(), width)
        total = np.array([int(c.sum()) for _, c in bags])
        both = overlaps(bags)
        union = total[:, None] + total[None, :] - both
        linked = (both >= threshold * union - 1e-9) & (both / np.maximum(union, 1) >= threshold) & (label[:, None] < label[None, :])
        if len(set(side.tolist())) > 1:
            linked &= side[:, None] != side[None, :]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = sorted((find(int(label[i])), find(int(label[j]))))
            if a != b:
                root[b] = a
                out.append((int(label[j]), int(label[i])))
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["id", "leader"])

    return run


def components(links: DataFrame, part: int = 1 << 20) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by alternating large and small stars. links: two bigint columns.

    The links of a hub with more than `part` are dealt to parts; each round is a table of its own, and the one before it is deleted.
    """
    u, v = links.columns
    edges = stored(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), "edges")
    seen, salt, large_at = None, F.xxhash64("v"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, total = now, 2 * now[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = spread(both, low, "u", "n", salt, part=part, total=total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        if total > part:
            large = large_at = stored(large, "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        down = spread(large, small, "u", "n", salt, part=part, total=total).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        after = stored(down.filter("u <> v").distinct(), "edges")
        if large_at is not None:
            discard(large_at)
        discard(edges)
        edges = after


def _classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, fa, fb) of each row of docs (row, doc_id, text), and (fa, fb, root, class_id) of each distinct multiset."""
    docs = docs.select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketch = stored(map_arrow(docs, _sketch(bands, rows, words), "row long, doc_id long, fa long, fb long, size long, bands array<bigint>"), "sketch")
    same = sketch.groupBy("fa", "fb").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"))
    # one row for each distinct multiset
    reps = sketch.select(F.col("row").alias("id"), "size", "bands").join(same.select(F.col("rep").alias("id")), "id", "left_semi")
    keyed = reps.select("id", "size", F.explode("bands").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = stored(spread(keyed, shared, "key", "n", F.xxhash64("id")), "members")
    text = docs.select(F.col("row").alias("id"), "text")
    first = members.filter("leader < id").select("id", "leader").distinct()
    leaders = stored(first.groupBy("leader").agg(F.count(F.lit(1)).alias("n")), "leaders")
    leaders = leaders.join(text.select(F.col("id").alias("leader"), F.col("text").alias("leader_text")), "leader")
    pairs = spread(first.join(text, "id"), leaders, "leader", "n", F.xxhash64("id"), part=LEADER_ROWS).select("id", "leader", "text", "leader_text")
    star = stored(in_batches(pairs).mapInArrow(_verify(words, threshold), "id long, leader long"), "star")
    roots = components(star)
    known = members.join(roots, F.col("id") == F.col("node"), "left").select("id", "key", "size", F.coalesce("root", "id").alias("label"))
    each = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    mixed = each.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("top")).filter("n > top.n")
    blocks = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_BYTES))
    mixed = mixed.select("key", "n", F.col("top.label").alias("top"), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("few"), blocks(F.col("top.n"), F.col("top.size")).alias("many"))
    # blocks 0 .. few-1 are outside the most frequent class, then come its own; tasks (key, i, j) with i < few and i <= j
    h = F.xxhash64("id", "key")
    dealt = spread(known, stored(mixed, "mixed"), "key", "n", F.xxhash64("id")).withColumn("k", F.when(F.col("label") != F.col("top"), F.pmod(h, "few")).otherwise(F.col("few") + F.pmod(h, "many")))
    others = F.when(F.col("k") < F.col("few"), F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1)
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), others)))
    dealt = dealt.select("id", "label", "key", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), F.col("k").alias("side"))
    full = dealt.join(text, "id")
    more = full.groupBy("key", "i", "j").applyInArrow(_block_links(words, threshold), "id long, leader long")
    root = components(star.unionByName(stored(more, "links")))
    label = same.join(root, F.col("rep") == F.col("node"), "left").select("fa", "fb", F.coalesce("root", "rep").alias("root"), "least")
    names = label.groupBy("root").agg(F.min("least").alias("class_id"))
    return sketch.select("row", "doc_id", "fa", "fb"), label.select("fa", "fb", "root").join(names, "root")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id for each row of docs. Options: threshold, words, bands, rows, block."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    told, label = _classes(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "row"), **options)
    out = told.join(label, ["fa", "fb"])
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), F.when(F.col("doc_id").isNotNull(), F.col("class_id")).cast(kind).alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near duplicates: of each class one row with the smallest doc_id, and one of those without doc_id."""
    row = free("row", docs)
    rows = numbered(docs, row)
    told, label = _classes(rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    each = told.join(label.select("fa", "fb", "root"), ["fa", "fb"]).groupBy("root", F.col("doc_id").isNull().alias("none")).agg(F.min(F.struct("doc_id", "row"))["row"].alias(row))
    kept = stored(each.select(row), "kept")
    # numbers are the small side: hashed, so that the texts need no sort
    return rows.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)
