"""Selections and projections of recordings, samples and resources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import to_ms

# Seconds that a recording may last, and HTTP states after which a request is worth another try.
DURATION = (60, 60_000)
RETRY_STATES = (408, 409, 425, 429, 500, 502, 503, 504)


def with_status(df: DataFrame, status: str = "downloaded", column: str = "status") -> DataFrame:
    return df.filter(F.col(column) == status)


def duration_within(df: DataFrame, column: str = "duration", least: float = DURATION[0], most: float = DURATION[1]) -> DataFrame:
    """Rows whose duration lies in a closed range; null and other text than numbers drop out."""
    return df.filter(F.col(column).try_cast("double").between(least, most))


def without_fields(value: Column, fields: Sequence[str]) -> Column:
    """A struct without some of its fields."""
    return value.dropFields(*fields)


def split_evaluable(samples: DataFrame, response: str) -> tuple[DataFrame, DataFrame]:
    """Samples with a response, to be judged, and those without, which pass through as they are."""
    some = F.coalesce(F.trim(response) != "", F.lit(False))
    return samples.filter(some), samples.filter(~some)


def payload(start: Column, end: Column, **fields: Column) -> Column:
    """The payload of a stored point: its fields and its span in whole milliseconds."""
    return F.struct(*(c.alias(n) for n, c in fields.items()), to_ms(start).alias("start_time_ms"), to_ms(end).alias("end_time_ms"), (to_ms(end) - to_ms(start)).alias("duration_ms"))


def available(resources: DataFrame, free: str, least: float) -> DataFrame:
    """resources with a flag: is at least so much free; null is not."""
    return resources.withColumn("available", F.coalesce(F.col(free) >= least, F.lit(False)))


def retryable(state: Column) -> Column:
    """Whether a failed request is worth another try; without a state (a broken connection) it is."""
    return F.coalesce(state.isin(*RETRY_STATES), F.lit(True))


def confident_first_seen(texts: DataFrame, key: Sequence[str], frame: str, pos: str, text: str = "text", confidence: str = "confidence", least: float = 0.5) -> DataFrame:
    """(key, frame, text): of texts read with more than that confidence each one at its first frame and place, those of a frame in order as one text."""
    first = texts.filter(F.col(confidence) > least).groupBy(*key, text).agg(F.min(F.struct(frame, pos)).alias("_at"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(f"_at.{pos}").alias("p"), F.col(text).alias("t"))))
    return first.groupBy(*key, F.col(f"_at.{frame}").alias(frame)).agg(F.array_join(F.transform(lines, lambda x: x["t"]), " ").alias(text))


def batch_order(waiting: DataFrame, bucket: str, since: str, now: float, starved: float) -> DataFrame:
    """Buckets of waiting requests in the order in which they are served: those with a starved request by its age, then the largest, the oldest of equals."""
    each = waiting.groupBy(bucket).agg(F.min(since).alias("oldest"), F.count(F.lit(1)).alias("requests"))
    late = now - F.col("oldest") > starved
    order = Window.orderBy(F.desc("_late"), F.when(F.col("_late"), F.col("oldest")), F.desc("requests"), "oldest", bucket)  # one row for each bucket
    return each.withColumn("_late", late).withColumn("place", F.row_number().over(order)).drop("_late")
