"""Incremental sources and sinks, windows, and the batch forms of what `stateful` does on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.context import ordinal

_PARTITIONS = "spark.sql.shuffle.partitions"


def source(spark: SparkSession, folder: str, schema: str | StructType, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream; its checkpoint remembers those already read."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


def once(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", partitions: int | None = None) -> StreamingQuery:
    """Handle what is there now, batch by batch, and stop.

    partitions: those of the state, which a new checkpoint fixes; if not given, two for each core, and no more than the session has for shuffles. Each one costs
    a store to load and commit and a file to write in every batch, however few rows it has, so they follow the cores and not the size of the table.
    """
    conf = df.sparkSession.conf
    usual = conf.get(_PARTITIONS)
    conf.set(_PARTITIONS, str(partitions or min(int(usual), 2 * df.sparkSession.sparkContext.defaultParallelism)))
    try:  # the stream keeps a copy of the settings from its start
        return df.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(_PARTITIONS, usual)


def append_to(path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to a folder of its own number, so a repeated batch replaces itself."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/batch={number}")

    return handle


def distinct_within(df: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first event of each key; repeats that come within the delay are dropped, state older than it is forgotten."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(df: DataFrame, ts: str, width: str, delay: str, keys: list[str], slide: str | None = None) -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *keys, "n")


def sessions(df: DataFrame, key: str, ts: str, gap: str, delay: str | None = None) -> DataFrame:
    """(key, session_start, session_end, n): runs of events with gaps below `gap`."""
    df = df.withWatermark(ts, delay) if delay else df
    out = df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def live_entries(entries: DataFrame, keys: list[str], written: str, expires: str, now: float) -> DataFrame:
    """Batch form of the cache: of each key the last entry, unless it has expired."""
    rest = [c for c in entries.columns if c not in keys]
    last = entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), written).alias("_e")).select(*keys, "_e.*")
    return last.filter(F.col(expires) > now)


def completed(parts: DataFrame, key: str, expected: str) -> DataFrame:
    """Batch form of completion: keys whose distinct parts number as many as expected."""
    return parts.groupBy(key).agg(F.count_distinct("part").alias("seen"), F.max(expected).alias("expected")).filter("seen >= expected")


def work_off(order: list[str], path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A handler that takes each batch of a queue in order (the most urgent first), numbers it on from what was taken before, and writes it to a folder of its own number."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            before = spark.read.format(fmt).load(path).filter(F.col("batch") < number).count() if number else 0
        except AnalysisException as error:  # nothing written yet
            if not (error.getCondition() or "").startswith(("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                raise
            before = 0
        taken = ordinal(batch, order, "place").withColumn("place", F.col("place") + before)
        taken.write.mode("overwrite").format(fmt).save(f"{path}/batch={number}")

    return handle


def stuck(status: DataFrame, now: float, limits: dict[str, float], default: float = 3600.0) -> DataFrame:
    """Batch form of stuck work: rows (id, stage, state, since) that are processing for longer than their stage's limit, as failed."""
    limit = F.lit(default)
    for stage, seconds in limits.items():
        limit = F.when(F.col("stage") == stage, seconds).otherwise(limit)
    return status.withColumn("state", F.when((F.col("state") == "processing") & (now - F.col("since") > limit), "failed").otherwise(F.col("state")))
