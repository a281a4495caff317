"""Shared pieces of the corpus operators: table access, checkpoints and numpy text kernels.

The kernels work on the raw bytes of an Arrow string column, so a batch of documents is
split into words and hashed without a Python object for each word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; bounds its temporary arrays.
SLICE_BYTES = 1 << 19

_U = np.uint64


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset on a single machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _LOCAL[0]


_LOCAL: list[str] = []


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back, which cuts its lineage; the files go when the session's JVM ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path, fs = _path(spark, at)
    fs.deleteOnExit(path)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    path, fs = _path(df.sparkSession, df._stored_at)
    fs.delete(path, True)


def free(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    while name in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs with a number of each row: the doc_id where these are unique, else one that is written once with the rows so that it stays."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long"))
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


#: Keys that `spread` may deal to several parts, at most.
HOT = 10_000


def spread(many: DataFrame, few: DataFrame, key: str, count: str, salt: Column, *, part: int = 1 << 20, total: int | None = None) -> DataFrame:
    """Inner join on key; few has one row for each key and the key's number of rows in many. Rows of a key with more than `part` are dealt to parts by salt.

    Fewer than HOT keys have several parts, as a part grows with the sum of counts (total, where it is known); only these keys are broadcast.
    """
    if total is None:
        total, most = (int(x or 0) for x in few.agg(F.sum(count), F.max(count)).head())
    else:
        most = total
    size = max(part, -(-total // HOT))
    if most <= size:
        return many.join(few.drop(count), key)
    hot = F.broadcast(few.filter(F.col(count) > size).select(key, F.ceil(F.col(count) / size).cast("long").alias("_parts")))
    last = F.coalesce("_parts", F.lit(1)) - 1
    left = many.join(hot, key, "left").withColumn("_part", F.pmod(salt, last + 1)).drop("_parts")
    right = few.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_parts", count)
    return left.join(right, [key, "_part"]).drop("_part")


def fold(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8")) % n


#: Rows of an Arrow batch, at most: its texts lie in the memory of the executor and of its worker at once.
BATCH_ROWS = 1024


def in_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on hands at most BATCH_ROWS rows to Python at once; a smaller number that is set stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch of at most BATCH_ROWS rows."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return in_batches(df).mapInArrow(run, schema)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null counts as empty) and the len+1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about size bytes; a longer row stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


#: Bytes that end a word where words are runs of other characters than ASCII white space.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(raw: np.ndarray, offs: np.ndarray, gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each row the index of its first word (len+1)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~gap[raw]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:n]
    end[:-1] &= ~solid[1:] | cut[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


class ByteHash:
    """Polynomial hashes modulo 2**64 of byte ranges, by prefix sums; a seed gives an independent function."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
        self.base = int(rng.integers(1 << 40, 1 << 62)) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (self.base, self.inverse))

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.values[raw] * self.up[: len(raw)], out=total[1:])
            return mix((total[ends] - total[starts]) * self.down[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def windows(h: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of `width` consecutive elements of h, by doubling; the caller masks those across rows."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, power, run, left = None, 0, base, h, width
    size = 1
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = run[have : have + n]
                out = part.copy() if out is None else out * _U(pow(base, size, 1 << 64)) + part
                have += size
            left >>= 1
            if left:
                run = run[: len(run) - size] * _U(pow(base, size, 1 << 64)) + run[size:]
                size *= 2
        return mix(out)


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """For n elements, the row of each, from the index of each row's first one."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
