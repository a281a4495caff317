"""Queries over readers, sinks and selections that had none: what is written from the tables is read again. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import values as V
from tidemark.operators import context, filters, joins, profile, vector
from tidemark.plans.assembly import stored_query, text_of
from tidemark.plans.queries import micros, query, search_queries, turns
from tidemark.sources import readers, sinks


@stored_query
def folders_by_key(spark: SparkSession, t, at: str) -> DataFrame:
    """Documents written in a folder for each language and once more together; both read back."""
    docs = t("documents").select("doc_id", "lang", "n_chars")
    sinks.write_by_key(docs, "lang", f"{at}/folder", f"{at}/all")
    parted = spark.read.schema("doc_id long, lang string, n_chars long").json(f"{at}/folder/*")
    both = parted.withColumn("place", F.lit("folder")).unionByName(readers.json_lines(spark, f"{at}/all", "doc_id long, lang string, n_chars long").withColumn("place", F.lit("all")))
    return both.groupBy("place", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@stored_query
def documents_in_files(spark: SparkSession, t, at: str) -> DataFrame:
    """One JSON document a source; those that are broken are left out, the first two by name are also read alone."""
    each = t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    body = F.when(F.col("n") % 2 == 0, F.to_json(F.struct("source", "n", "last"), {"pretty": "true"})).otherwise(F.lit('{"source": "x", "n": '))
    lines = each.select(body.alias("value"), F.col("source").alias("file"))
    lines.repartition("file").write.partitionBy("file").text(f"{at}/docs")
    good = readers.json_or_nothing(spark, f"{at}/docs/*", "source string, n long, last long").withColumn("how", F.lit("good"))
    first = readers.json_folder(spark, f"{at}/docs/*", "source string, n long, last long", "*.txt", first=2).drop("file").withColumn("how", F.lit("first"))
    return good.unionByName(first.filter("last is not null"))


@stored_query
def listed_ids(spark: SparkSession, t, at: str) -> DataFrame:
    """Ids written to a list with comments and blank lines, and to JSON lines; the documents that both name."""
    d = t("documents").select(F.format_string("d%06d", "doc_id").alias("id"), "doc_id", "n_chars")
    some = d.select(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("# "), "id")).when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.concat("id", F.lit("  chosen"))).alias("value"))
    some.write.text(f"{at}/list")
    sinks.append_log(d.select(F.col("id").alias("sample_id"), "n_chars").filter("doc_id % 3 > 0"), f"{at}/log")
    sinks.append_log(d.select(F.lit(1).alias("other")), f"{at}/log")
    ids = readers.id_list(spark, f"{at}/list", 7)
    named = readers.ids_in_lines(spark, f"{at}/log").withColumnRenamed("sample_id", "id")
    return d.join(ids, "id", "left_semi").join(named, "id", "left_semi").select("doc_id", "id")


@stored_query
def cached_subset(spark: SparkSession, t, at: str) -> DataFrame:
    """A dataset from its cache, its first rows by length; the limit is what the reader offers."""
    sinks.write_json(t("documents").select("doc_id", "lang", "n_chars"), at)
    return readers.cached_dataset(spark, at, "doc_id long, lang string, n_chars long", 1000, ["n_chars", "doc_id"]).select("doc_id", "lang")


@stored_query
def artefact_shards(spark: SparkSession, t, at: str) -> DataFrame:
    """Texts as artefacts by their hash; what each shard holds."""
    sinks.write_artefacts(t("documents").select(F.md5("text").alias("content_hash"), "n_chars").groupBy("content_hash").agg(F.max("n_chars").alias("n_chars")), at)
    back = spark.read.schema("content_hash string, n_chars long, shard string").parquet(at)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@stored_query
def run_log(spark: SparkSession, t, at: str) -> DataFrame:
    """Costs appended to a log in two runs, and what the log says of both."""
    o = t("orders").select("o_custkey", F.col("o_totalprice").alias("cost"))
    for run in (0, 1):
        sinks.append_log(o.filter(F.col("o_custkey") % 2 == run).withColumn("run", F.lit(run)), at)
    back = readers.json_lines(spark, at, "o_custkey long, cost double, run int")
    return back.groupBy("run").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("cost"), 2).alias("cost"))


@query
def searched_modalities(t) -> DataFrame:
    """Points of two types, each searched with the first query's vector; of the best twenty those that lie in a span of time."""
    e = t("embeddings")
    first = search_queries(e).orderBy("query_id").head()
    p = e.select(F.col("vec_id").alias("raw_id"), F.concat(F.lit("t"), text_of("label")).alias("type"), F.col("embedding").alias("vector"), (F.col("vec_id") * 1000).alias("start_time_ms"), (F.col("vec_id") * 1000 + 500).alias("end_time_ms"))
    if first is None:
        return p.select("raw_id", F.col("type").alias("modality")).limit(0)
    out = vector.multi_modal(p, {kind: list(first["query"]) for kind in ("t1", "t4")}, 20, within=(0.0, 400.0))
    return out.select("raw_id", "modality")


@query
def answered_samples(t) -> DataFrame:
    """Conversations in which every assistant turn of over 200 characters counts as answered, the others as empty."""
    said = F.when(F.length("text") > 200, F.col("text")).otherwise("")
    conv = turns(t).groupBy("conv_id").agg(F.collect_list(F.struct("role", said.alias("candidate_response"))).alias("conversations"))
    return context.answered(conv).select("conv_id", F.size("conversations").cast("long").alias("turns"))


@query
def retry_plan(t) -> DataFrame:
    """Requests by their state: what is worth another try, and which resources have room."""
    state = F.element_at(F.array(*(F.lit(s) for s in (200, 404, 408, 429, 500, 503, None))), (F.col("event_id") % 7 + 1).cast("int"))
    e = t("events").select("user_id", "value", filters.retryable(state).alias("again"))
    free = e.groupBy("user_id").agg(F.count_if("again").alias("again"), F.round(F.max("value"), 6).alias("free"))
    return filters.available(free, "free", 50.0)


@query
def deleted_keys(t) -> DataFrame:
    gone = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return joins.delete_keys(t("customer").select("c_custkey", "c_mktsegment"), gone, "c_custkey")


@query
def ranked_values(t) -> DataFrame:
    """Types of parts from the most to the least frequent, with their place."""
    out = profile.histogram(t("part"), "p_type", "type")
    return context.ordinal(out, [-F.col("n"), "type"], "place")


@query
def model_specs(t) -> DataFrame:
    """Arguments that name a model, its devices and flags, made from the sources, read again."""
    i = F.col("doc_id")
    flags = F.concat(*(F.when(i % n == 0, flag).otherwise("") for n, flag in ((2, ":omni"), (3, ":hf"), (5, ":api"), (7, ":f64"), (11, ":mount"), (13, ":fast"), (17, ":f8"))))
    spec = F.concat("source", F.when(i % 19 == 0, "").otherwise(F.concat(F.lit(":"), F.when(i % 23 == 0, "x").otherwise((i % 8).cast("string")))), flags, F.when(i % 4 == 0, F.concat(F.lit("@"), "lang")).otherwise(""))
    read = t("documents").select("doc_id", X.model_spec(spec).alias("s"))
    return read.filter("s is not null").select("doc_id", "s.*")


@query
def event_days(t) -> DataFrame:
    """Events of each user and day with the seconds of the first."""
    e = t("events").select("user_id", V.day(F.col("ts")).alias("day"), micros("ts").alias("s"))
    return e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("s"), 3).alias("first"))
