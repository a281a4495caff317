"""Profiles of datasets, captions, descriptions, stores and logs; each is one or a few aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tidemark.functions.text import has_description, word_count
from tidemark.functions.values import ratio, round_exact


def histogram(df: DataFrame, value: str | Column, name: str = "value") -> DataFrame:
    """(name, n) by descending count; ties by value, as a distributed table has no first-seen order."""
    c = F.col(value) if isinstance(value, str) else value
    return df.groupBy(c.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)


def dataset_profile(samples: DataFrame) -> DataFrame:
    """One row of totals over samples (video_id, duration, sample_type, conversations, criteria_count)."""
    length = F.size("conversations")
    users = F.size(F.filter("conversations", lambda t: t["role"] == "user"))
    d = F.when(F.col("duration") != 0, F.col("duration"))
    multi = F.when(F.col("sample_type") == "multi_turn", users)
    n, with_criteria = F.count(F.lit(1)), F.count_if(F.col("criteria_count") > 0)
    stats = lambda c, name, average=True: [F.coalesce(f(c), F.lit(0)).alias(f"{k}_{name}") for k, f in (("min", F.min), ("max", F.max), ("avg", F.avg))[: 3 if average else 2]]
    return samples.agg(
        n.alias("total_samples"), F.count_if(F.col("sample_type") == "single_turn").alias("single_turn_samples"), F.count_if(F.col("sample_type") == "multi_turn").alias("multi_turn_samples"),
        F.count_distinct("video_id").alias("unique_videos"), *stats(d, "duration"), F.coalesce(F.sum(d), F.lit(0)).alias("total_duration"), *stats(length, "length"), *stats(multi, "turns"),
        F.coalesce(F.sum("criteria_count"), F.lit(0)).alias("total_criteria"), *stats(F.col("criteria_count"), "criteria"), with_criteria.alias("samples_with_criteria"), (n - with_criteria).alias("samples_without_criteria"),
        F.when(n > 0, with_criteria / n * 100).otherwise(0.0).alias("criteria_coverage"),
    )


def question_histograms(samples: DataFrame) -> DataFrame:
    """(kind, value, n) of difficulties and modalities of user turns, categories, tasks and scenarios."""
    turns = samples.select(F.explode(F.filter("conversations", lambda t: t["role"] == "user")).alias("t"))
    parts = {
        "difficulty": turns.select(F.col("t.difficulty").cast("string").alias("value")).filter("value <> '0'"),
        "modality": turns.select(F.explode("t.modalities").alias("value")),
        "category": samples.select(F.explode("categories").alias("value")),
        "task": samples.select(F.col("task").alias("value")),
        "scenario": samples.select(F.col("scenario").alias("value")),
        "turns": samples.filter("sample_type = 'multi_turn'").select(F.size(F.filter("conversations", lambda t: t["role"] == "user")).cast("string").alias("value")),
    }
    out = None
    for kind, df in parts.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def caption_stats(segments: DataFrame, key: str) -> DataFrame:
    """(key, segments, seconds, words)."""
    both = F.col("start").isNotNull() & F.col("end").isNotNull()
    return segments.groupBy(key).agg(F.count(F.lit(1)).alias("segments"), F.sum(F.when(both, F.col("end") - F.col("start")).otherwise(0)).alias("seconds"), F.sum(word_count(F.col("text"))).alias("words"))


def description_stats(segments: DataFrame, key: str, frames: str = "frames_extracted") -> DataFrame:
    out = segments.groupBy(key).agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum(frames), F.lit(0)).alias("frames"))
    return out.withColumn("frames_per_segment", ratio(F.col("frames"), F.col("segments")))


def mean_words(rows: DataFrame, text: str) -> DataFrame:
    """Mean words of the valid texts."""
    return rows.filter(has_description(F.col(text))).agg(F.coalesce(F.avg(word_count(F.col(text))), F.lit(0.0)).alias("mean_words"), F.count(F.lit(1)).alias("n"))


def numeric_summary(df: DataFrame, text: str) -> DataFrame:
    """n, mean, median (exact, interpolated), min, max, total of what reads as a number."""
    x = F.col(text).try_cast("double")
    x = F.when(~F.isnan(x), x)
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.min(x).alias("least"), F.max(x).alias("most"), F.sum(x).alias("total"))


def category_counts(df: DataFrame, text: str) -> DataFrame:
    one = F.explode(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))
    return df.select(one.alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def completeness(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """For each key the rows, the non-empty values of each field and their share."""
    full = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("rows"), *(full(c).alias(f"n_{c}") for c in fields), *((full(c) / n).alias(f"share_{c}") for c in fields))


def nested_total(singles: Column, multis: Column) -> Column:
    """Elements of an array and of an array of arrays."""
    return F.coalesce(F.size(singles), F.lit(0)) + F.aggregate(F.coalesce(multis, F.array()), F.lit(0), lambda s, x: s + F.size(x))


def summed(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of all numeric columns; true counts as 1."""
    cols = [f for f in df.schema if f.name not in keys and isinstance(f.dataType, (NumericType, BooleanType))]
    return df.groupBy(*keys).agg(*(F.sum(F.col(f.name).cast("int") if isinstance(f.dataType, BooleanType) else F.col(f.name)).alias(f.name) for f in cols))


def store_counts(points: DataFrame) -> DataFrame:
    """(video_id, points, types) of a vector store."""
    return points.groupBy("video_id").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("type").alias("types"))


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), (F.coalesce(F.sum("bytes"), F.lit(0)) / 1048576).alias("mb"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def stage_metrics(log: DataFrame, keys: Sequence[str] = ("stage",)) -> DataFrame:
    """log: stage, seconds, requests -> batches, requests, total, largest, mean per batch and per request."""
    out = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("batches"), F.sum("requests").alias("requests"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"))
    return out.withColumn("per_batch", ratio(F.col("seconds"), F.col("batches"))).withColumn("per_request", ratio(F.col("seconds"), F.col("requests")))


def hit_rate(hits: Column, misses: Column) -> Column:
    """Three decimals, rounded as Python does."""
    return round_exact(ratio(hits, hits + misses), 3)


def status_counts(df: DataFrame, stages: Sequence[str]) -> DataFrame:
    """For each stage the done, failed and pending rows; pending where the stage before is done. One row for each stage."""
    aggs = []
    for i, s in enumerate(stages):
        ready = F.lit(True) if i == 0 else F.col(stages[i - 1]) == "done"
        state = F.coalesce(F.col(s), F.lit("pending"))
        aggs.append(F.struct(F.lit(s).alias("stage"), F.count_if(state == "done").alias("done"), F.count_if(state == "failed").alias("failed"), F.count_if((state == "pending") & F.coalesce(ready, F.lit(False))).alias("pending")))
    return df.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


def conditional_counts(df: DataFrame, key: str, status: str = "status", good: str = "success") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(status) == good).alias("good"))


def grouped_in_order(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, first, values): values in order; keys have their first place to sort by."""
    out = df.groupBy(key).agg(F.min(order).alias("first"), F.array_sort(F.collect_list(F.struct(order, value))).alias("_v"))
    return out.select(key, "first", F.transform("_v", lambda x: x[value]).alias("values"))
