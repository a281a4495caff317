"""Packing documents into sequences of bounded length by linear grouping and best fit.

Lengths are integers up to the capacity, so the whole input is described by a histogram of
at most `capacity` rows. Pieces as long as the capacity are sequences of their own; the plan for the others is made on that
histogram alone:

1. Lengths above a share of the capacity are large. Sorted downwards they are cut into groups
   of equal cardinality, and each group's lengths are rounded up to its longest.
2. Over the groups' few lengths, configurations (multisets that fit one sequence) are chosen
   by column generation: a simplex over configurations, priced by an unbounded knapsack that gives the best
   configuration around each length at once. Whole parts of the solution open that many sequences.
3. Actual pieces replace the rounded lengths, longest first, so that every slot fits; a configuration's last slot takes the
   longest large piece that fits what the actual pieces before it leave.
4. What is left, small pieces last, goes by best fit into the fullest sequence with room.

How fine the groups and how large the large pieces are is a choice of the scheme; the choices of PLANS are tried, and the plan with the fewest sequences counts.

The plan says for each length which run of its pieces goes where; a piece finds its place by
its rank among the pieces of its length. Each stored piece has a number of its own, by which a length's pieces are dealt to
chunks of about CHUNK_ROWS, as many as the histogram asks for; ranks come from counts per (chunk, length) and their
running sums, so no group of equal lengths or repeated rows meets in one task.

Nulls: a null text counts as empty, so every row, empty ones too, has at least its end id;
a null doc_id is kept. Repeated rows are packed as often as they occur, in any order among themselves. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, stored

CAPACITY = 2048
#: Groups of large lengths, of at least GROUP_PIECES pieces each; lengths above this share of the capacity are large.
GROUPS, GROUP_PIECES, SMALL_SHARE = 96, 16, 1 / 8
#: (groups, share) tried one after the other, until a plan needs no more sequences than the sum of lengths asks for.
PLANS = ((48, 0.3), (96, 0.3), (48, 0.34), (96, 0.34), (96, 0.4), (96, 0.25), (GROUPS, SMALL_SHARE))
#: Configurations that one pricing may add, pricings, and pivots after which the inverse of the basis is computed afresh.
PRICED, PRICINGS, PIVOTS = 48, 200, 500
#: Pieces of one length in a chunk on which ranks are counted, about.
CHUNK_ROWS = 4096

_ENCODERS: dict[str, tuple] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """text -> ids of the tokenizer file.

    tiktoken walks the same merges several times faster where the same vocabulary lies beside
    the file as ranks; a text with one of the file's special tokens goes to the file's own library.
    """
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        special = [t.content for t in own.get_added_tokens_decoder().values()]
        ranks, fast = path.removesuffix(".json") + ".tiktoken", None
        if ranks != path and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        _ENCODERS[path] = own, special, fast
    own, special, fast = _ENCODERS[path]

    def encode(text: str) -> list[int]:
        if fast is None or any(s in text for s in special):
            return own.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut only where longer than capacity."""
    docs, path = docs.select("doc_id", "text"), path or tokenizer_path()

    def cut(batch: pa.RecordBatch):
        encode = encoder(path)
        row, number, start, length, crc = [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            ids = np.array(encode(text or "") + [end_id], "<u4")
            at, head = 0, len(ids) % capacity or capacity
            for k, to in enumerate(range(head, len(ids) + 1, capacity)):
                row.append(i)
                number.append(k)
                start.append(at)
                length.append(to - at)
                crc.append(zlib.crc32(ids[at:to].tobytes()))
                at = to
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return map_arrow(docs, cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class _Knapsack:
    """The most valuable multisets of sizes that fit a room, for all rooms up to the capacity at once."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.rooms = sizes, np.arange(capacity + 1)
        behind = self.rooms[None, :] - sizes[:, None]
        self.fits, self.behind = behind >= 0, np.maximum(behind, 0)
        self.picks: list[np.ndarray] = []

    def solve(self, values: np.ndarray) -> np.ndarray:
        """The best value for each room; one more piece in each round, so a few rounds suffice."""
        best, self.picks = np.zeros(len(self.rooms)), []
        while True:
            gains = np.where(self.fits, best[self.behind] + values[:, None], 0.0)
            pick = gains.argmax(axis=0)
            new = gains[pick, self.rooms]
            better = new > best + 1e-12
            if not better.any():
                return best
            self.picks.append(np.where(better, pick, -1))
            best = np.where(better, new, best)

    def around(self, j: int) -> np.ndarray:
        """The best configuration with at least one piece of size j."""
        config, room = np.bincount([j], minlength=len(self.sizes)), self.rooms[-1] - self.sizes[j]
        for pick in reversed(self.picks):
            if pick[room] >= 0:
                config[pick[room]] += 1
                room -= self.sizes[pick[room]]
        return config


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, pricings: int = PRICINGS) -> list[tuple[np.ndarray, int]]:
    """(configuration, how many sequences): whole parts of a linear programme solved by column generation."""
    m, bag = len(sizes), _Knapsack(sizes, capacity)
    single = capacity // sizes
    columns = [np.bincount([i], minlength=m) * int(single[i]) for i in range(m)]
    basis, inverse, x = list(range(m)), np.diag(1.0 / single), demand / single
    pivots = 0
    for _ in range(pricings):
        duals = np.maximum(inverse.sum(axis=0), 0)
        worth = duals + bag.solve(duals)[capacity - sizes]
        before = pivots
        for j in np.argsort(-worth, kind="stable")[:PRICED]:
            config = bag.around(int(j))
            if worth[j] <= 1 + 1e-6 or inverse.sum(axis=0) @ config <= 1 + 1e-6:
                continue
            way = inverse @ config
            out = int(np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf).argmin())
            if way[out] <= 1e-9:
                continue
            step = max(x[out] / way[out], 0.0)
            x = x - step * way
            x[out] = step
            inverse[out] /= way[out]
            other = np.arange(m) != out
            inverse[other] -= np.outer(way[other], inverse[out])
            columns.append(config)
            basis[out] = len(columns) - 1
            pivots += 1
            if pivots % PIVOTS == 0:
                inverse = np.linalg.inv(np.array([columns[b] for b in basis], float).T)
                x = np.maximum(inverse @ demand, 0)
        if pivots == before:
            break
    return [(columns[b], int(v + 1e-6)) for b, v in zip(basis, x, strict=True) if v >= 1 - 1e-6]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, plans: tuple[tuple[int, float], ...] = PLANS) -> tuple[list[tuple], int]:
    """Runs (length, first rank, last rank + 1, first sequence, pieces in each, offset) and the number of sequences, of the plan with the fewest."""
    least, best = -(-sum(s * n for s, n in histogram.items()) // capacity), None
    for groups, small_share in plans:
        runs, sequences, _ = _plan(histogram, capacity, groups, small_share)
        if best is None or sequences < best[1]:
            best = runs, sequences
        if sequences == least:
            break
    return best


def _plan(histogram: dict[int, int], capacity: int, groups: int, small_share: float) -> tuple[list[tuple], int, int]:
    """The plan, and how many large pieces configurations of several pieces place."""
    left = {s: n for s, n in histogram.items() if n}
    taken: dict[int, int] = dict.fromkeys(left, 0)
    stock = sorted(left)  # lengths with pieces left
    runs: list[tuple] = []
    sequences = together = 0
    bins: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
    rooms: list[int] = []

    def leave(room: int, first: int, many: int) -> None:
        if many:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((first, many))

    def put(size: int, first: int, many: int, each: int, offset: int) -> None:
        runs.append((size, taken[size], taken[size] + many * each, first, each, offset))
        taken[size] += many * each
        left[size] -= many * each
        if not left[size]:
            stock.pop(bisect_left(stock, size))

    large = sorted((s for s in left if capacity * small_share < s < capacity), reverse=True)
    total = sum(left[s] for s in large)
    if total:
        bound, each = [], -(-total // max(1, min(groups, total // GROUP_PIECES)))
        seen = 0
        for s in large:  # a group ends with the length at which its share of the pieces is full
            if not bound or seen >= each * len(bound):
                bound.append([s, []])
            bound[-1][1].append(s)
            seen += left[s]
        bound.reverse()
        sizes, demand = np.array([b for b, _ in bound]), np.array([sum(left[s] for s in own) for _, own in bound], float)
        for config, many in sorted(configurations(sizes, demand, capacity), key=lambda c: -int((c[0] * sizes).sum())):
            slots = [g for g in reversed(range(len(sizes))) for _ in range(config[g])]
            open_ = [(sequences, many, 0)]
            sequences += many
            for k, g in enumerate(slots):
                fill: list[tuple[int, int, int]] = []
                for first, n, offset in open_:
                    while n:
                        if k and k + 1 == len(slots):
                            i = bisect_right(stock, capacity - offset) - 1
                            s = stock[i] if i >= 0 and stock[i] >= large[-1] else 0
                        else:
                            s = next((s for s in bound[g][1] if left[s]), 0)
                        if not s:
                            fill.append((first, n, offset))
                            break
                        some = min(n, left[s])
                        put(s, first, some, 1, offset)
                        together += some * (len(slots) > 1)
                        fill.append((first, some, offset + s))
                        first, n = first + some, n - some
                open_ = fill
            for first, n, offset in open_:
                leave(capacity - offset, first, n)
    for size in sorted(left, reverse=True):
        while left[size]:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                many = max(1, left[size] // each)
                leave(capacity, sequences, many)
                sequences += many
                continue
            room = rooms[i]
            first, many = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(i)
            each = min(room // size, left[size])
            full = min(many, left[size] // each)
            put(size, first, full, each, capacity - room)
            leave(room, first + full, many - full)
            leave(room - each * size, first, full)
    return runs, sequences, together


def _ranked(df: DataFrame, chunks: list[int]) -> DataFrame:
    """df (with _row, a number of each row) with rank (from 0) among the rows of the same length, dealt to chunks[length] chunks."""
    df = df.withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.element_at(F.lit(chunks).cast("array<int>"), F.col("length").cast("int") + 1)))
    inner = Window.partitionBy("length", "_chunk").orderBy("_row")
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = df.withColumn("_rank", F.row_number().over(inner) - 1)
    return local.join(base, ["length", "_chunk"]).withColumn("rank", F.col("_rank") + F.col("_base")).drop("_chunk", "_rank", "_base")


def pack(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, plans: tuple[tuple[int, float], ...] = PLANS) -> DataFrame:
    """Each piece with sequence_id and offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, path=path, capacity=capacity, end_id=end_id).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {int(s): int(n) for s, n in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    histogram.pop(capacity, None)
    runs, sequences = plan(histogram, capacity, plans)
    by: dict[int, list[tuple]] = {}
    for size, lo, hi, first, each, offset in runs:
        by.setdefault(size, []).append((lo, hi, first, each, offset))
    table = spark.sparkContext.broadcast({s: np.array(sorted(r), np.int64) for s, r in by.items()})  # bounded by capacity and groups
    chunks = [max(1, -(-histogram.get(s, 0) // CHUNK_ROWS)) for s in range(capacity + 1)]

    def place(batch: pa.RecordBatch):
        size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        edges = np.flatnonzero(np.diff(size[order])) + 1
        for at in np.split(order, edges):
            r = table.value[int(size[at[0]])]
            own = r[np.searchsorted(r[:, 0], rank[at], "right") - 1]
            n = rank[at] - own[:, 0]
            sequence[at] = own[:, 2] + n // own[:, 3]
            offset[at] = own[:, 4] + n % own[:, 3] * size[at]
        keep = [n for n in batch.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = cut.filter(F.col("length") == capacity).select(*columns, (F.col("_row") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ranked = _ranked(cut.filter(F.col("length") < capacity), chunks).select(*columns, "rank")
    return map_arrow(ranked, place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").unionByName(whole)
