"""Queries over streams: the events arrive in files, a little out of order, and what a stream writes is the result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.queries import QUERIES
from tidemark.session import scratch
from tidemark.streaming import incremental, stateful

#: Files in which the events arrive; seconds by which one may be overtaken; how late a stream expects them.
FILES, JITTER, DELAY = 4, 1800, "1 hour"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("user_id").cast("string").alias("key"), "event_type", "value")


def arriving(rows: DataFrame, at: str, last: dict[str, Column]) -> DataFrame:
    """rows (ts, id, ...) as a stream of FILES files, each row up to JITTER seconds late, and a last row long after, so that the watermark passes all others. last: that row's values, where null will not do."""
    spark = rows.sparkSession
    arrival = F.unix_seconds("ts") + F.pmod(F.xxhash64("id"), F.lit(JITTER))
    cuts = rows.agg(F.percentile_approx(arrival, [i / FILES for i in range(1, FILES)]).alias("q")).head()["q"] or []
    number = reduce(lambda a, b: a + b, ((arrival > c).cast("int") for c in cuts), F.lit(0))
    dealt = rows.withColumn("_file", F.coalesce(number, F.lit(0)))
    for i in range(len(cuts) + 1):
        dealt.filter(F.col("_file") == i).drop("_file").write.parquet(f"{at}/in/{i}")
    end = rows.agg((F.coalesce(F.max("ts"), F.timestamp_seconds(F.lit(0))) + F.expr("interval 400 days")).alias("ts"))
    given = {"ts": F.col("ts"), "key": F.lit(""), **last}
    end.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema)).write.parquet(f"{at}/in/{len(cuts) + 1}")
    files = len(spark.read.parquet(f"{at}/in/*").inputFiles())
    return incremental.source(spark, f"{at}/in/*", rows.schema, files_per_batch=-(-files // (len(cuts) + 2)))


def written(out: DataFrame, at: str, name: str = "out", handle: Callable | None = None) -> DataFrame:
    """Runs the stream until all is handled; the table that it wrote."""
    incremental.once(out, handle or incremental.append_to(f"{at}/{name}"), f"{at}/checkpoint-{name}").awaitTermination()
    fields = [*out.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return out.sparkSession.read.schema(schema + (", place long" if handle else "") + ", batch int").parquet(f"{at}/{name}").drop("batch")


def flow(fn: Callable[[DataFrame, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(events(spark, sf_dir), scratch(spark, fn.__name__))

    QUERIES[fn.__name__] = run
    return fn


def _timed(rows: DataFrame, at: str, last: dict[str, Column] | None = None) -> DataFrame:
    return stateful.timed(arriving(rows, at, last or {}), "ts", DELAY)


@flow
def stream_dedupe(rows: DataFrame, at: str) -> DataFrame:
    """The first event of each user and type, and again the first that comes an hour or more after the one kept last."""
    keyed = rows.select("id", "ts", F.concat_ws("/", "key", "event_type").alias("key"))
    out = stateful.stateful(_timed(keyed, at), "key", stateful.Dedupe(3600), stateful.Dedupe.OUTPUT)
    return written(out, at).select("key", "id")


@flow
def stream_cache(rows: DataFrame, at: str) -> DataFrame:
    """Purchases and signups write an entry of their user, which lives for `value` hours (a tenth of the signups' for ever); all other events read it."""
    own = rows.select(
        "id", "ts", "key", F.col("event_type").isin("purchase", "signup").alias("write"), F.col("id").cast("string").alias("value"), F.when((F.col("event_type") == "purchase") | (F.col("user_id") % 10 != 0), F.col("value") * 3600).alias("ttl")
    )
    out = stateful.stateful(_timed(own, at), "key", stateful.TtlCache(), stateful.TtlCache.OUTPUT)
    return written(out, at).select("key", "id", "hit", "value")


def parts(rows: DataFrame) -> DataFrame:
    """The types of a user's events within three days as parts of a whole, of which there are four."""
    span = F.floor(F.unix_seconds("ts") / (3 * 86400))
    return rows.select("id", "ts", F.concat_ws(":", "key", span.cast("string")).alias("key"), F.col("event_type").alias("part"), F.lit(4).cast("long").alias("expected"), (F.col("user_id") % 3).cast("long").alias("priority"))


def _completion(rows: DataFrame, at: str) -> DataFrame:
    return stateful.stateful(_timed(parts(rows), at), "key", stateful.Completion(36 * 3600, 5 * 86400), stateful.Completion.OUTPUT)


@flow
def stream_completion(rows: DataFrame, at: str) -> DataFrame:
    """Each whole once: complete, or given up 36 hours after its first part."""
    return written(_completion(rows, at), at).select("key", "state", "parts", F.col("at").alias("told_at"))


@flow
def stream_chained(rows: DataFrame, at: str) -> DataFrame:
    """A second stream works off what the first completes, by priority."""
    first = written(_completion(rows, at), at, "done")
    spark = rows.sparkSession
    queue = spark.readStream.schema(first.schema).parquet(f"{at}/done/*").filter("state = 'complete'").select("key", "priority", "at")
    return written(queue, at, "taken", incremental.work_off(["priority", "at", "key"], f"{at}/taken")).select("place", "key", "priority")


@flow
def stream_stuck(rows: DataFrame, at: str) -> DataFrame:
    """Clicks and views start work, other events end it; work of over 6 (view: 24) hours fails."""
    status = rows.select("id", "ts", "key", F.col("event_type").alias("stage"), F.when(F.col("event_type").isin("click", "view"), "processing").otherwise("completed").alias("state"))
    out = stateful.stateful(_timed(status, at), "key", stateful.Stuck({"click": 6 * 3600, "view": 24 * 3600}), stateful.Stuck.OUTPUT)
    return written(out, at).select("key", "stage", "state", "since", F.col("at").alias("failed_at"))


@flow
def stream_reorder(rows: DataFrame, at: str) -> DataFrame:
    """A user's events as numbered frames; every tenth comes twice, some never."""
    from pyspark.sql import Window

    number = (F.row_number().over(Window.partitionBy("key").orderBy("ts", "id")) - 1).cast("long")
    frames = rows.withColumn("number", number).filter("id % 97 <> 0").withColumn("copy", F.explode(F.when(F.col("number") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    frames = frames.select((F.col("id") * 2 + F.col("copy")).alias("id"), "ts", "key", "number", F.col("event_type").alias("value"))
    out = stateful.stateful(_timed(frames, at, {"number": F.lit(-1)}), "key", stateful.Reorder(3 * 3600), stateful.Reorder.OUTPUT)
    return written(out, at).select("key", "place", "number", "value")


@flow
def stream_windows(rows: DataFrame, at: str) -> DataFrame:
    """Events of each type in windows of six hours, told when a window is over."""
    out = incremental.windowed_counts(arriving(rows.select("id", "ts", "key", "event_type"), at, {}), "ts", "6 hours", DELAY, ["event_type"])
    return written(out, at).select(F.unix_seconds("w_start").alias("w_start"), "event_type", "n")


@flow
def stream_sessions(rows: DataFrame, at: str) -> DataFrame:
    """Runs of a user's events with gaps of under 12 hours, told when they are over."""
    out = incremental.sessions(arriving(rows.select("id", "ts", "key"), at, {}), "key", "ts", "12 hours", DELAY)
    return written(out, at).select("key", F.unix_micros("session_start").alias("session_start"), "n")
