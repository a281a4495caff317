"""Benchmark decontamination with a generalised suffix automaton of the benchmark items.

All items are inserted into one automaton over word ids. A document's words are streamed
through it: the state and the longest matching length at each word tell which item windows
end there. Words that no item has, and word pairs that follow each other in no item, cut
the stream, so that only the runs between them are walked.

The benchmark is cut into shards of at most SHARD_WORDS words (a longer item into pieces that overlap by a window less one
word, so that each window lies in a piece), and each shard's automaton is kept in flat arrays. A benchmark of at most
PASS_WORDS words is broadcast whole, some 100 bytes a word, and documents are read once. A larger one is worked off in
passes of at most PASS_WORDS words: each pass reads the documents, writes what it found for rows that were hit, and
its automata are dropped on the driver and in the workers before the next; at the end each row meets what the passes found for it.

Nulls: a null text has no words; items without words match nothing; a null item_id is
shown as empty text. Repeated rows give repeated rows, equal items both count. Extra
columns of the input are ignored by `contamination` and kept by `remove_spans`. Empty tables on either side are fine.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.llm.common import free, map_arrow, stored

WINDOW = 10
#: Words of one automaton; words of the automata that a worker holds at once.
SHARD_WORDS, PASS_WORDS = 250_000, 1_000_000
#: A-Z to lower case; words are runs of a-z, 0-9 and everything beyond ASCII; the rest splits.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class _Builder:
    """Suffix automaton states while they grow: transitions as dictionaries."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1)
        self.next[new] = dict(self.next[q])
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new


class Automaton:
    """A generalised suffix automaton of the items' words, with the items of each window, in flat arrays.

    The transitions of state v are words[first[v]:first[v + 1]], sorted, to states to[...]; its windows are
    lengths[shown[v]:shown[v + 1]] with items names[who[...]]; up[v] is the nearest state with windows on the way to the root.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        texts = [(name, [self.ids.setdefault(w, len(self.ids)) for w in own]) for name, own in items if own]
        build = _Builder()
        for _, ids in texts:
            last = 0
            for c in ids:
                last = build.extend(last, c)
        self.link, self.length = np.array(build.link, np.int32), np.array(build.length, np.int32)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in build.next])]).astype(np.int32)
        ways = [way for x in build.next for way in sorted(x.items())]
        self.words, self.to = (np.array([way[i] for way in ways], np.int32) for i in (0, 1))
        pairs = {(a, b) for _, ids in texts for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array(sorted(a * len(self.ids) + b for a, b in pairs), np.int64)
        self.least = min([window, *(len(ids) for _, ids in texts)])
        self._fast()
        self._mark(texts, window)

    def _fast(self) -> None:
        """The arrays that single steps read, as views whose elements are plain numbers."""
        self._link, self._length, self._first, self._words, self._to = (memoryview(x) for x in (self.link, self.length, self.first, self.words, self.to))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not isinstance(v, memoryview)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fast()

    def _mark(self, texts: list[tuple[str, list[int]]], window: int) -> None:
        self.names = sorted({name for name, _ in texts})
        place = {name: i for i, name in enumerate(self.names)}
        found = set()
        for name, ids in texts:
            k = min(window, len(ids))
            state = n = 0
            for c in ids:
                state, n = self.step(state, n, c)
                while state and self._length[self._link[state]] >= k:
                    state = self._link[state]
                n = min(n, self._length[state])
                if n >= k:
                    found.add((state, k, place[name]))
        rows = np.array(sorted(found), np.int32).reshape(-1, 3)
        self.shown = np.searchsorted(rows[:, 0], np.arange(len(self.link) + 1)).astype(np.int32)
        self.lengths, self.who = rows[:, 1].copy(), rows[:, 2].copy()
        marked = np.diff(self.shown) > 0
        self.up = np.full(len(self.link), -1, np.int32)
        for v in np.argsort(self.length, kind="stable")[1:].tolist():
            p = self._link[v]
            self.up[v] = v if marked[v] else self.up[p] if p > 0 else -1

    def step(self, state: int, n: int, c: int) -> tuple[int, int]:
        first, known = self._first, self._words
        while True:
            lo, hi = first[state], first[state + 1]
            at = lo if hi - lo < 2 else bisect_left(known, c, lo, hi)
            if at < hi and known[at] == c:
                return self._to[at], n + 1
            if not state:
                return 0, 0
            state = self._link[state]
            n = self._length[state]

    def hits(self, tokens: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """A flag for each word inside a window's occurrence; the items with occurring windows."""
        n = len(tokens)
        found: set[str] = set()
        if n < self.least or not self.ids:
            return np.zeros(n, bool), found
        get, absent = self.ids.get, -1
        ids = np.fromiter((get(t, absent) for t in tokens), np.int64, n)
        known = ids >= 0
        joined = np.zeros(n, bool)  # to the word before
        if n > 1 and len(self.pairs):
            at = np.flatnonzero(known[1:] & known[:-1]) + 1
            key = ids[at - 1] * len(self.ids) + ids[at]
            pos = np.searchsorted(self.pairs, key)
            joined[at] = self.pairs[np.minimum(pos, len(self.pairs) - 1)] == key
        firsts = np.flatnonzero(known & ~joined)
        edge = np.append(firsts, n)
        follow = np.cumsum(joined)
        runs = follow[edge[1:] - 1] - follow[firsts] + 1
        delta = np.zeros(n + 1, np.int64)
        keep = runs >= self.least
        for lo, count in zip(firsts[keep].tolist(), runs[keep].tolist(), strict=True):
            state = length = 0
            for i, c in enumerate(ids[lo : lo + count].tolist(), lo):
                state, length = self.step(state, length, c)
                mark = int(self.up[state])
                while mark > 0:
                    for at in range(self.shown[mark], self.shown[mark + 1]):
                        k = int(self.lengths[at])
                        if k <= length:
                            delta[i - k + 1] += 1
                            delta[i + 1] -= 1
                            found.add(self.names[self.who[at]])
                    mark = int(self.up[self._link[mark]])
        return np.cumsum(delta[:-1]) > 0, found


def _pieces(benchmark: DataFrame, size: int, window: int) -> Iterator[tuple[str, list[bytes]]]:
    """(item, words) of all items; those longer than size in pieces that overlap, none shorter than a window."""
    size = max(size, 2 * window)
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        own = words(row[1])
        for at in range(0, max(1, len(own) - window + 1), size - window + 1):
            yield row[0] or "", own[at : at + size]


def shards(benchmark: DataFrame, shard_words: int = SHARD_WORDS, window: int = WINDOW) -> Iterator[tuple[Automaton, int]]:
    """Automata of the whole benchmark, each of at most shard_words words, and their words; one at a time."""
    held, size = [], 0
    for name, own in _pieces(benchmark, shard_words, window):
        if held and size + len(own) > shard_words:
            yield Automaton(held, window), size
            held, size = [], 0
        held.append((name, own))
        size += len(own)
    if held:
        yield Automaton(held, window), size


def _passes(parts: Iterator[tuple[Automaton, int]], pass_words: int) -> Iterator[list[Automaton]]:
    held, size = [], 0
    for part, n in parts:
        if held and size + n > pass_words:
            yield held
            held, size = [], 0
        held.append(part)
        size += n
    yield held


Finder = Callable[[pa.RecordBatch, int, list[bytes]], tuple[np.ndarray, set[str]]]


def _hits(parts: list[Automaton], tokens: list[bytes]) -> tuple[np.ndarray, set[str]]:
    flags, found = np.zeros(len(tokens), bool), set()
    for part in parts:
        more, names = part.hits(tokens)
        flags |= more
        found |= names
    return flags, found


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int, pass_words: int) -> tuple[DataFrame, list[str], Finder]:
    """docs, perhaps with columns of what passes found; their names; and the function that tells a row's flags and items from a batch."""
    sc = docs.sparkSession.sparkContext
    passes = _passes(shards(benchmark, shard_words, window), pass_words)
    one, two = next(passes), next(passes, None)
    if two is None:
        parts = sc.broadcast(one)
        return docs, [], lambda batch, row, tokens: _hits(parts.value, tokens)
    row, flag, item = (free(f"_{n}", docs) for n in ("row", "flags", "items"))
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = None
    for own in chain([one, two], passes):
        parts = sc.broadcast(own)

        def search(batch: pa.RecordBatch, parts=parts):
            rows, flags, items = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hit, names = _hits(parts.value, words(text))
                if names:
                    rows.append(i)
                    flags.append(np.packbits(hit).tobytes())
                    items.append(sorted(names))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(flags, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["row", "flags", "items"])

        one_pass = stored(map_arrow(docs.select(row, "text"), search, "row long, flags binary, items array<string>"), "hits")
        parts.destroy()
        found = one_pass if found is None else found.unionByName(one_pass)
    each = found.groupBy(F.col("row").alias(row)).agg(F.collect_list("flags").alias(flag), F.flatten(F.collect_list("items")).alias(item))  # one for each pass

    def told(batch: pa.RecordBatch, i: int, tokens: list[bytes]) -> tuple[np.ndarray, set[str]]:
        flags = np.zeros(len(tokens), bool)
        for x in batch.column(flag)[i].as_py() or ():
            flags |= np.unpackbits(np.frombuffer(x, np.uint8), count=len(tokens)).astype(bool)
        return flags, set(batch.column(item)[i].as_py() or ())

    return docs.join(each, row, "left"), [row, flag, item], told


def _digest(found: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shard_words: int = SHARD_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    docs, _, find = _searched(docs.select("doc_id", "text"), benchmark, window, shard_words, pass_words)

    def digest(batch: pa.RecordBatch):
        cols: list[list] = [[], [], [], []]
        for row, text in enumerate(batch.column("text").to_pylist()):
            tokens = words(text)
            flags, found = find(batch, row, tokens)
            for c, v in zip(cols, (len(tokens), int(flags.sum()), len(found), _digest(found)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array([h > 0 for h in cols[1]])],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    return map_arrow(docs, digest, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


#: Words of a text with their places in it; the same words as `words` cuts.
_PLACES = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, *, coverage: float = 0.8, window: int = WINDOW, shard_words: int = SHARD_WORDS, pass_words: int = PASS_WORDS
) -> DataFrame:
    """docs without the spans that benchmark windows cover; a document covered by more than `coverage` of its words goes whole.

    Clean documents stay byte for byte; n_chars follows the text where the column exists.
    """
    columns, place = docs.schema, re.compile(_PLACES)
    docs, _, find = _searched(docs, benchmark, window, shard_words, pass_words)

    def strip(batch: pa.RecordBatch):
        texts, keep = batch.column("text").to_pylist(), []
        for row, text in enumerate(texts):
            tokens = words(text)
            flags = find(batch, row, tokens)[0]
            share = flags.mean() if len(flags) else 0.0
            keep.append(bool(share <= coverage))
            if share and keep[-1]:
                out, at = [], 0
                spans = [m.span() for m in place.finditer(text.translate(_FOLD_TEXT))]
                i = 0
                while i < len(spans):
                    if flags[i]:
                        j = i
                        while j + 1 < len(spans) and flags[j + 1]:
                            j += 1
                        out.append(text[at : spans[i][0]])
                        at, i = spans[j][1], j
                    i += 1
                texts[row] = "".join([*out, text[at:]])
        kept = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in columns]
        yield pa.RecordBatch.from_arrays(kept, names=columns.names).filter(pa.array(keep))

    schema = StructType([StructField("text", StringType()) if f.name == "text" else f for f in columns])
    out = map_arrow(docs, strip, schema)
    return out.withColumn("n_chars", F.length("text").cast(columns["n_chars"].dataType)) if "n_chars" in columns.names else out


_FOLD_TEXT = {i: i + 32 for i in range(65, 91)}
