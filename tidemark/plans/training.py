"""Queries over the order of training samples, embedding of text, and table functions. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import inference, tables
from tidemark.operators import batching, vector
from tidemark.plans.queries import QUERIES, micros, query, turns
from tidemark.session import stored
from tidemark.sources import store

WORLD, BATCH = 4, 8


@query
def length_batches(t) -> DataFrame:
    """Documents in mega-batches of like load for each replica."""
    out = batching.length_grouped(t("documents").select("doc_id", "n_chars"), "doc_id", "n_chars", world=WORLD, batch=BATCH)
    return out.select("doc_id", "megabatch", "replica", "slot", "place")


@query
def modality_batches(t) -> DataFrame:
    """The same with two modalities apart; what is left of both comes last."""
    out = batching.modality_grouped(t("documents").select("doc_id", "lang", "n_chars"), "doc_id", "n_chars", F.col("lang").isin("en", "de"), world=WORLD, batch=BATCH)
    return out.select("doc_id", "multimodal", "megabatch", F.coalesce("replica", F.lit(-1)).alias("replica"), "place")


@query
def proportional_order(t) -> DataFrame:
    """Each replica's order of documents, their sources mixed in proportion."""
    return batching.proportional(t("documents").select("doc_id", "source"), "doc_id", "source", replicas=WORLD, batch=2, seed=3, epoch=1)


@query
def strided_shard(t) -> DataFrame:
    return batching.strided(t("documents").select("doc_id", "lang"), ["lang", "doc_id"], 1, 8).select("doc_id")


@query
def resample_plan(t) -> DataFrame:
    rate = F.when(F.col("doc_id") % 9 != 0, 8000 + F.col("doc_id") % 5 * 8000)
    return t("documents").select("doc_id", F.expr("n_chars / 100.0").cast("double").alias("s"), rate.alias("r")).select("doc_id", batching.resampling(F.col("s"), F.col("s") / 2, F.col("r")).alias("x")).select("doc_id", "x.resample", "x.rate")


@query
def text_neighbours(t) -> DataFrame:
    """Turns embedded from their text; for every conversation divisible by 50 the five turns nearest to its first user turn."""
    own = turns(t).withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))
    vectors = stored(own.select("conv_id", "turn", "role", "row_id", inference.embed(F.col("text")).alias("vector")), "vectors")
    asked = vectors.filter("conv_id % 50 = 0 and role = 'user'").groupBy("conv_id").agg(F.min_by(F.col("vector"), F.col("turn")).alias("query")).withColumnRenamed("conv_id", "query_id")
    best = vector.batch_top_k(asked, vectors, 5, id_col="row_id")
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def store_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store page by page through the data source, with a filter that it does itself."""
    at = stored(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"), "store")
    p = store.points(spark, at.inputFiles()[0].rsplit("/", 1)[0], "vec_id long, label int, embedding array<float>", "vec_id", page=100, partitions=4)
    return p.filter("label in (1, 3, 5) and vec_id >= 20").select("vec_id", "label", F.size("embedding").cast("long").alias("width"))


QUERIES["store_scroll"] = store_scroll


def _sql(fn):
    """Register a query that is SQL over temporary views of the tables and the table functions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.register(spark)
        return fn(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[fn.__name__] = run
    return fn


@_sql
def sentence_rows(spark, t) -> DataFrame:
    """Sentences of all turns, through the table function."""
    turns(t).createOrReplaceTempView("turns")
    return spark.sql("SELECT conv_id, turn, pos, md5(sentence) AS sentence FROM turns, LATERAL sentences(text, 100)")


@_sql
def clip_rows(spark, t) -> DataFrame:
    t("documents").selectExpr("doc_id", "n_chars / 10 as duration").createOrReplaceTempView("videos")
    return spark.sql("SELECT doc_id, cast(clip as bigint) AS clip, round(clip_start, 6) AS clip_start, round(clip_end, 6) AS clip_end FROM videos, LATERAL clips(duration, cast(10 as double))")


@_sql
def silence_rows(spark, t) -> DataFrame:
    """Hours without an event between a user's events of a minute each, through the table function on partitions in order."""
    t("events").select(F.col("user_id").alias("video"), micros("ts").alias("start"), (micros("ts") + 60).alias("end")).createOrReplaceTempView("segments")
    return spark.sql("SELECT video, round(start, 3) AS start, round(end, 3) AS `end` FROM silences(TABLE (SELECT video, start, end FROM segments) PARTITION BY video ORDER BY (start, end)) WHERE end - start >= 3600")
