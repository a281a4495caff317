"""Exact substring dedup: windows of 20 words that also start earlier, by difference-cover anchors.

D = {0, 1, 3, 9} is a difference cover modulo P = 13: for any two starts i and j there is a
shift d < P with (i + d) and (j + d) both at places whose remainder lies in D. So two equal
windows of 20 words share an aligned anchor, a run of 20 - P + 1 = 8 words at a cover place.

1. Anchors only (4 of 13 places) are hashed; each chunk of documents sends its distinct anchor
   hashes, sorted, in one row for each bucket. Buckets answer each chunk with one bit for each
   hash: another chunk sent it too, or the chunk itself holds it twice.
2. Around repeated anchors each chunk extends to whole windows: their 96-bit hashes and first
   places go out the same way; buckets answer with a bit for each that is not the first of all.
3. Each chunk removes the words under the windows that start earlier somewhere.

A hash goes out once for each chunk, however often it occurs, so a hot passage never gathers
its occurrences in one task. Chunks are blocks of documents by a hash of the row's number (doc_id, or where
doc_ids repeat or are null one that is written once with the rows), of bounded size; all three passes read the one exchange that deals documents to chunks. Two windows are
the same if their 96-bit hashes are: at 10**13 windows the chance of any mistake is 6 * 10**-4.

Nulls: a null text has no words; a null doc_id sorts first. Repeated rows of one doc_id are
documents of their own, one after the other in a fixed order (by chunk, then text). Extra columns are ignored. Texts of fewer
than 20 words keep all words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ByteHash, numbered, slices, string_buffers, windows, word_bounds

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of text in a chunk, on average.
CHUNK_BYTES = 4 << 20
#: Anchors that a bucket answers for, on average.
BUCKET_ANCHORS = 1 << 19

_ONE, _TWO = ByteHash(0x51), ByteHash(0xA7)


class _Chunk:
    """The documents of a chunk in order of doc_id, with word hashes."""

    def __init__(self, table: pa.Table, second: bool):
        ids = table.column("doc_id").combine_chunks()
        table = pa.table({"doc_id": ids.fill_null(int(np.iinfo(np.int64).min)), "null": ids.is_null(), "text": table.column("text")}).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids, self.null = (table.column(c).to_numpy() for c in ("doc_id", "null"))
        raw, offs = string_buffers(table.column("text"))
        parts = []
        for lo, hi in slices(offs):
            part = raw[offs[lo] : offs[hi]]
            s, e, first = word_bounds(part, offs[lo : hi + 1] - offs[lo])
            one = _ONE.words(part, s, e)
            parts.append((s + offs[lo], e + offs[lo], np.diff(first), one, _TWO.words(part, s, e) if second else one[:0]))
        self.raw = raw
        self.starts, self.ends, counts, self.one, self.two = (np.concatenate([np.empty(0, p[i].dtype if parts else np.int64) for p in parts[:1]] + [p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(5))
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.doc)) - self.first[self.doc]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Word indexes and hashes of the anchors."""
        width = window - PERIOD + 1
        h = windows(self.one, width)
        at = np.arange(len(h))
        whole = self.doc[: len(h)] == self.doc[width - 1 :] if len(h) else np.zeros(0, bool)
        at = at[whole & np.isin(self.place[: len(h)] % PERIOD, COVER)]
        return at, h[at]

    def candidates(self, window: int, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a repeated anchor."""
        width = window - PERIOD + 1
        at, h = self.anchors(window)
        n = len(self.doc) - window + 1
        if n <= 0 or not len(repeated):
            return np.empty(0, np.int64)
        pos = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
        hit = np.zeros(len(self.doc) + 1, np.int64)
        for a in (at[repeated[pos] == h],):
            np.add.at(hit, np.maximum(a - (window - width), 0), 1)
            np.add.at(hit, a + 1, -1)
        start = np.flatnonzero(np.cumsum(hit)[:n] > 0)
        return start[self.doc[start] == self.doc[start + window - 1]]

    def keys(self, window: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two hashes of the windows at start, and for each whether it is the chunk's first of its kind."""
        a, b = windows(self.one, window)[start], windows(self.two, window, 0xD1B54A32D192ED03)[start]
        order = np.lexsort((start, b, a))
        new = np.ones(len(start), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        first = np.zeros(len(start), bool)
        first[order[new]] = True
        return a, b, first


def _split(key: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that the sorted keys fall into."""
    bucket = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets))), len(key))
    return [(int(bucket[lo]), int(lo), int(hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def _flags(key: np.ndarray, buckets: int, table: pa.Table, column: str) -> np.ndarray:
    """The buckets' answers, one flag for each of the sorted keys."""
    out = np.zeros(len(key), bool)
    bits = {b: x for b, x in zip(table.column("bucket").to_pylist(), table.column(column).to_pylist(), strict=True) if x is not None}
    for bucket, lo, hi in _split(key, buckets):
        if bucket in bits:
            out[lo:hi] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=hi - lo)
    return out


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = [pa.int64() if n in ("chunk", "bucket") else pa.binary() for n in names]
    return pa.table([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for each row of docs."""
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    chunks, buckets = max(1, -(-size // chunk_bytes)), max(1, -(-size // (BUCKET_ANCHORS * 19)))
    dealt = numbered(docs, "row").select("doc_id", "text", F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk")).repartition(chunks, "chunk")

    def anchors(table: pa.Table) -> pa.Table:
        h, n = np.unique(_Chunk(table, False).anchors(window)[1], return_counts=True)
        chunk = table.column("chunk")[0].as_py()
        return _table([(chunk, b, h[lo:hi].tobytes(), np.packbits(n[lo:hi] > 1).tobytes()) for b, lo, hi in _split(h, buckets)], ["chunk", "bucket", "h", "twice"])

    def repeated(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, hs, twice = [], [], []
        for batch in batches:
            chunk += batch.column("chunk").to_pylist()
            hs += [np.frombuffer(x, np.uint64) for x in batch.column("h").to_pylist()]
            twice += batch.column("twice").to_pylist()
        twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(x)).astype(bool) for x, t in zip(hs, twice, strict=True)]
        many = np.sort(np.concatenate(hs), kind="stable")
        many = np.unique(many[1:][many[1:] == many[:-1]])
        rows = []
        for c, x, t in zip(chunk, hs, twice, strict=True):
            if len(many):
                t = t | (many[np.minimum(np.searchsorted(many, x), len(many) - 1)] == x)
            if t.any():
                rows.append((c, key[0].as_py(), np.packbits(t).tobytes()))
        yield from _table(rows, ["chunk", "bucket", "h"]).to_batches()

    def candidates(own: _Chunk, answer: pa.Table) -> np.ndarray:
        """Starts of the windows around the chunk's repeated anchors."""
        h = np.unique(own.anchors(window)[1])
        return own.candidates(window, h[_flags(h, buckets, answer, "h")])

    def firsts(own: _Chunk, start: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the chunk's distinct windows: first starts and both hashes, in order of the first; whether each of start is one of them."""
        a, b, first = own.keys(window, start)
        at = np.flatnonzero(first)
        at = at[np.lexsort((start[at], a[at]))]
        return start[at], a[at], (b[at] >> np.uint64(32)).astype(np.uint32), first

    def extend(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["chunk", "bucket", "a", "b", "ids", "doc", "place"]
        if not left.num_rows or not right.num_rows:
            return _table([], names)
        own = _Chunk(left, True)
        start, a, b, _ = firsts(own, candidates(own, right))
        chunk, doc, place, rows = left.column("chunk")[0].as_py(), own.doc[start], own.place[start].astype(np.int32), []
        for bucket, lo, hi in _split(a, buckets):
            some, at = np.unique(doc[lo:hi], return_inverse=True)
            rows.append((chunk, bucket, a[lo:hi].tobytes(), b[lo:hi].tobytes(), own.ids[some].tobytes(), at.astype(np.uint16 if len(some) < 1 << 16 else np.uint32).tobytes(), place[lo:hi].tobytes()))
        return _table(rows, names)

    def later(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        chunk: list[int] = []
        for batch in batches:
            for r in batch.to_pylist():
                chunk.append(r["chunk"])
                a, ids = np.frombuffer(r["a"], np.uint64), np.frombuffer(r["ids"], np.int64)
                at = np.frombuffer(r["doc"], np.uint16 if len(r["doc"]) == 2 * len(a) else np.uint32)
                for c, x in zip(cols, (a, np.frombuffer(r["b"], np.uint32), ids[at], np.frombuffer(r["place"], np.int32)), strict=True):
                    c.append(x)
        edges = np.concatenate([[0], np.cumsum([len(x) for x in cols[0]])])
        source = np.repeat(np.array(chunk), np.diff(edges))
        a, b, doc, place = (np.concatenate(c) for c in cols)
        order = np.lexsort((source, place, doc, b, a))
        same = np.zeros(len(a), bool)
        same[order[1:]] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        rows = [(c, key[0].as_py(), np.packbits(same[lo:hi]).tobytes()) for c, lo, hi in zip(chunk, edges[:-1], edges[1:], strict=True) if same[lo:hi].any()]
        yield from _table(rows, ["chunk", "bucket", "later"]).to_batches()

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Chunk(left, True) if left.num_rows else None
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")}
        if own is not None:
            gone = np.zeros(len(own.doc) + 1, np.int64)
            start = candidates(own, right.filter(pc.is_valid(right.column("h"))))
            if len(start):
                kept, a, _, first = firsts(own, start)
                drop = np.concatenate([start[~first], kept[_flags(a, buckets, right.filter(pc.is_valid(right.column("later"))), "later")]])
                np.add.at(gone, drop, 1)
                np.add.at(gone, drop + window, -1)
            keep = np.cumsum(gone[:-1]) == 0
            raw = own.raw.tobytes()
            for d in range(len(own.ids)):
                lo, hi = own.first[d], own.first[d + 1]
                k = np.flatnonzero(keep[lo:hi]) + lo
                text = b" ".join([raw[s:e] for s, e in zip(own.starts[k].tolist(), own.ends[k].tolist(), strict=True)])
                for name, v in zip(out, (None if own.null[d] else int(own.ids[d]), int(hi - lo), int(hi - lo - len(k)), hashlib.sha256(text).hexdigest(), text.decode() if keep_text else None), strict=True):
                    out[name].append(v)
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=list(out))

    by_chunk = lambda df: df.repartition(chunks, "chunk").groupBy("chunk")
    sent = dealt.groupBy("chunk").applyInArrow(anchors, "chunk long, bucket long, h binary, twice binary")
    known = sent.groupBy("bucket").applyInArrow(repeated, "chunk long, bucket long, h binary")
    found = dealt.groupBy("chunk").cogroup(by_chunk(known)).applyInArrow(extend, "chunk long, bucket long, a binary, b binary, ids binary, doc binary, place binary")
    earlier = found.groupBy("bucket").applyInArrow(later, "chunk long, bucket long, later binary")
    answer = known.withColumn("later", F.lit(None).cast("binary")).unionByName(earlier.withColumn("h", F.lit(None).cast("binary")))
    out = dealt.groupBy("chunk").cogroup(by_chunk(answer)).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    out = out.withColumn("doc_id", F.col("doc_id").cast(kind))
    return out if keep_text else out.drop("kept_text")
