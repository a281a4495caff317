"""Queries over the reference's operators, by name. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import values as V
from tidemark.operators import context, cost, filters, fusion, graph, intervals, joins, profile, scoring, vector
from tidemark.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

#: Tasks dealt to documents by the number of their source; the last four are remapped, unknown or missing.
TASKS = (*(t for own in scoring.TASK_CATEGORIES.values() for t in own), "ocr_text_extraction", "question_answering", "unlisted_task", None)
TIERS = (
    {"max_input_tokens": 10, "input_per_1m": 1.0, "cached_input_per_1m": 0.25, "output_per_1m": 4.0},
    {"max_input_tokens": 30, "input_per_1m": 2.0, "cached_input_per_1m": 0.5, "output_per_1m": 8.0},
    {"max_input_tokens": None, "input_per_1m": 4.0, "cached_input_per_1m": 1.0, "output_per_1m": 16.0},
)
QUERIES: dict[str, Query] = {}


def query(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return fn


def micros(ts: str) -> Column:
    """Seconds since the epoch as a double."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def number_of_source() -> Column:
    return F.regexp_extract("source", r"(\d+)$", 1).cast("int")


def rubric(t) -> DataFrame:
    """Labelled documents as evaluated samples: one assistant turn with four criteria."""
    c = lambda w, p, met: F.struct(F.lit(w).alias("weight"), F.lit(p).alias("is_penalty"), met.alias("criteria_met"))
    criteria = F.array(c(5, False, F.col("quality") == 1), c(3, False, F.col("toxic") == 0), c(1, False, F.col("n_chars") > 500), c(-5, True, F.col("toxic") == 1))
    task = F.element_at(F.array(*(F.lit(x) for x in TASKS)), number_of_source() % len(TASKS) + 1)
    conv = F.array(F.struct(F.lit("assistant").alias("role"), criteria.alias("criteria")))
    docs = t("documents").select("doc_id", "lang", "source", "n_chars")
    return scoring.sample_scores(docs.join(t("labels"), "doc_id").withColumn("task", task).withColumn("conversations", conv)).drop("conversations")


@query
def rubric_sample_score(t) -> DataFrame:
    return rubric(t).select("doc_id", "obtained", "total", "score")


@query
def rubric_task_accuracy(t) -> DataFrame:
    return scoring.task_accuracy(rubric(t))


@query
def rubric_category_accuracy(t) -> DataFrame:
    return scoring.category_accuracy(scoring.task_accuracy(rubric(t))).withColumn("accuracy", F.round("accuracy", 9))


@query
def rubric_overall(t) -> DataFrame:
    out = scoring.overall(scoring.category_accuracy(scoring.task_accuracy(rubric(t))))
    return out.select(F.round("overall", 9).alias("overall"), F.round("overall_of_rounded", 9).alias("overall_of_rounded"), "samples")


@query
def rubric_dropped_tasks(t) -> DataFrame:
    return scoring.dropped_tasks(scoring.task_accuracy(rubric(t))).select("task", "samples")


@query
def modality_breakdown(t) -> DataFrame:
    tags = F.array_compact(F.array(F.when(F.col("lang").isin("en", "de"), "speech"), F.when(F.col("toxic") == 1, "audio_environment"), F.when(F.col("n_chars") > 1000, "text_overlay"), F.when(F.col("quality") == 0, "audio")))
    return scoring.modality_breakdown(rubric(t).withColumn("tags", tags), "tags")


@query
def duration_buckets(t) -> DataFrame:
    return scoring.duration_breakdown(rubric(t), "n_chars")


@query
def judge_mean(t) -> DataFrame:
    scores = rubric(t).withColumn("judge", F.col("doc_id") % 3)
    each = scores.groupBy("lang", "judge").agg(F.sum("obtained").alias("o"), F.sum("total").alias("n"))
    out = scoring.judge_mean(each.select(F.col("lang").alias("model"), V.ratio(F.col("o"), F.col("n")).alias("overall")))
    return out.withColumn("overall", F.round("overall", 9))


@query
def resume_pending(t) -> DataFrame:
    return joins.pending(t("documents").select("doc_id", "lang", "source"), t("labels"), ["doc_id"])


@query
def work_list(t) -> DataFrame:
    labels = t("labels")
    return joins.work_list([t("documents"), labels], [labels.filter("quality = 0")], "doc_id")


@query
def coverage_flags(t) -> DataFrame:
    labels = t("labels")
    others = {"labelled": labels, "good": labels.filter("quality = 1"), "toxic": labels.filter("toxic = 1")}
    return joins.mark_join(t("documents").select("doc_id"), others, "doc_id")


@query
def last_wins_join(t) -> DataFrame:
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_shipdate")
    last = joins.last_wins(lines, ["o_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"])
    return t("orders").select("o_orderkey", "o_custkey").join(last, "o_orderkey")


@query
def first_match_theta(t) -> DataFrame:
    """Each brand and type with the first catalogue entry that is equal to it, contains it or is contained in it."""
    kinds = t("part").select("p_brand", "p_type").distinct()
    catalogue = t("nation").select("n_nationkey", "n_name", F.lower(F.substring("n_name", 1, 1)).alias("initial"))
    low = F.lower("p_type")
    on = (F.col("n_name") == F.col("p_type")) | F.contains(F.lower("n_name"), low) | F.contains(low, F.col("initial"))
    return joins.first_match(kinds, F.broadcast(catalogue), on, ["p_brand", "p_type"], "n_nationkey", ["n_nationkey", "n_name"])


def turns(t) -> DataFrame:
    return t("conversations").select("conv_id", "turn", "role", "text")


@query
def zip_join(t) -> DataFrame:
    sides = [joins.positions(turns(t).filter(F.col("role") == role), ["conv_id"], ["turn", "text"]).select("conv_id", "pos", F.col("text").alias(name)) for role, name in (("user", "question"), ("assistant", "answer"))]
    out = joins.zip_join(*sides, ["conv_id"])
    return out.select("conv_id", F.col("pos").cast("long").alias("pos"), F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query
def prefix_context(t) -> DataFrame:
    df = context.prefix(turns(t), "conv_id", "turn", ["turn", "role", "text"]).filter("role = 'assistant'")
    chars = F.aggregate("context", F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"]))
    return df.select("conv_id", "turn", F.size("context").cast("long").alias("earlier"), chars.alias("chars"))


@query
def prev3_context(t) -> DataFrame:
    df = context.previous(turns(t), "conv_id", ["turn"], "text", 3, F.length("text") > 40)
    return df.select("conv_id", "turn", F.size("context").cast("long").alias("n"), F.md5(F.array_join("context", "|")).alias("context"))


@query
def aligned_pairs(t) -> DataFrame:
    df = context.with_previous(turns(t), "conv_id", ["turn"], "text", F.length("text") > 40)
    return df.select("conv_id", "turn", F.md5("before").alias("before"))


@query
def completeness(t) -> DataFrame:
    nxt = F.lead("role").over(joins.Window.partitionBy("conv_id").orderBy("turn"))
    asked = turns(t).withColumn("next", nxt).filter("role = 'user'")
    return context.complete_groups(asked, "conv_id", F.coalesce(F.col("next") == "assistant", F.lit(False)))


def event_segments(t) -> DataFrame:
    return t("events").select("user_id", "event_id", micros("ts").alias("start"), (micros("ts") + 60).alias("end"), F.lit("audio").alias("kind"))


@query
def gap_fill(t) -> DataFrame:
    out = intervals.close_gaps(event_segments(t), "user_id", ["start", "event_id"], 3600.0)
    return out.select("user_id", "event_id", "kind", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query
def silences(t) -> DataFrame:
    speech = t("documents").select((F.col("doc_id") % 50).alias("video"), (F.col("doc_id") * 7 % 600).cast("double").alias("start"), (F.col("doc_id") * 7 % 600 + F.col("n_chars") % 20).cast("double").alias("end"))
    videos = t("documents").select((F.col("doc_id") % 60).alias("video")).distinct().withColumn("duration", F.lit(700.0))
    return intervals.silences(speech, videos, "video")


@query
def interval_fusion(t) -> DataFrame:
    e = t("events").select("user_id", "event_id", "event_type", micros("ts").alias("s"))
    e = e.join(F.broadcast(e.agg(F.min("event_type").alias("a"))))  # one row: the first type against all others
    left = e.filter("event_type = a").select("user_id", F.col("event_id").alias("idx"), (F.col("s") - 7200).alias("start"), (F.col("s") + 7200).alias("end"))
    right = e.filter("event_type <> a").select("user_id", F.col("event_id").alias("o_idx"), F.col("s").alias("o_start"), (F.col("s") + 600).alias("o_end"))
    pairs = joins.interval_join(left, right, ["user_id"], 14400.0)
    hit = pairs.groupBy("user_id", "idx").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("o_idx")), lambda x: x.cast("string")), " ").alias("ids"))
    return left.select("user_id", "idx").join(hit, ["user_id", "idx"], "left").select("user_id", "idx", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.lit("")).alias("ids"))


@query
def first_overlap(t) -> DataFrame:
    """Caption segments with the first overlapping description of the same video."""
    lines = t("lineitem").select((F.col("l_suppkey") % 40).alias("video_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), (F.col("l_orderkey") % 5000).cast("double").alias("start"), F.col("l_quantity").alias("length"), "l_returnflag")
    lines = lines.groupBy("video_id", "idx").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.min("l_returnflag").alias("l_returnflag"))
    captions = lines.filter("idx % 3 = 0").select("video_id", "idx", "start", "end")
    others = lines.filter("idx % 3 <> 0").select("video_id", "idx", "start", "end", F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", F.col("idx").cast("string"))).alias("description"))
    return fusion.first_overlapping(captions, others, "description").select("video_id", "idx", "description")


@query
def largest_gap(t) -> DataFrame:
    out = intervals.largest_gap(event_segments(t), "user_id")
    return out.select("user_id", F.round("first_start", 3).alias("first_start"), F.round("last_end", 3).alias("last_end"), "any_negative", F.round("largest_gap", 3).alias("largest_gap"))


@query
def first_seen(t) -> DataFrame:
    return context.first_seen(t("events").select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query
def run_boundaries(t) -> DataFrame:
    return context.look_ahead(t("events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "next_1", "next_2")


@query
def clip_windows(t) -> DataFrame:
    out = intervals.clip_windows(t("documents").select("doc_id", (F.col("n_chars") / 10).alias("duration")), "duration")
    return out.select("doc_id", F.col("clip").cast("long").alias("clip"), F.round("clip_start", 6).alias("clip_start"), F.round("clip_end", 6).alias("clip_end"))


@query
def caption_split_times(t) -> DataFrame:
    """Conversation texts as captions, cut at full stops, their time spread over the pieces."""
    text = turns(t).select("conv_id", "turn", F.col("turn").cast("double").alias("start"), (F.col("turn") + F.length("text") / 15).alias("end"), F.posexplode(F.filter(F.split("text", r"\."), lambda x: x != "")).alias("pos", "text"))
    out = intervals.spread_pieces(text, ["conv_id", "turn"], "pos")
    return out.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.round("piece_start", 6).alias("piece_start"), F.round("piece_end", 6).alias("piece_end"))


@query
def merge_short(t) -> DataFrame:
    segments = t("events").select("user_id", micros("ts").alias("start"), (micros("ts") + F.col("event_id") % 3).alias("end"), F.repeat("event_type", 4).alias("text"), F.col("event_id").alias("pos"))
    return intervals.merge_short(segments, "user_id").withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})


@query
def split_sentences(t) -> DataFrame:
    parts = turns(t).select("conv_id", "turn", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "sentence"))
    return parts.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("sentences"), F.max(F.length("sentence")).cast("long").alias("longest"))


def search_queries(e: DataFrame) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 50."""
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query
def cosine_topk(t) -> DataFrame:
    e = t("embeddings")
    return vector.batch_top_k(search_queries(e), e, 5, id_col="vec_id", vector="embedding").select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id")


@query
def threshold_retrieval(t) -> DataFrame:
    e = t("embeddings")
    middle = vector.centroid(search_queries(e), "query")
    return vector.above(e, middle, vector="embedding").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query
def mean_similarity_rank(t) -> DataFrame:
    e = t("embeddings")
    best = vector.mean_similarity(e, search_queries(e), 20, id_col="vec_id", vector="embedding")
    return best.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query
def greedy_cluster(t) -> DataFrame:
    items = t("embeddings").select("label", "vec_id", F.concat(F.lit("item "), F.col("vec_id").cast("string"), F.lit(", more")).alias("item"), "embedding")
    return vector.greedy_clusters(items, "label", "vec_id")


@query
def entity_chunks(t) -> DataFrame:
    out = graph.entity_chunks(t("events"), ["event_type"], "user_id")
    return out.select("event_type", F.size("chunks").cast("long").alias("n"), F.md5(F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",")).alias("chunks"))


@query
def cooccurrence_edges(t) -> DataFrame:
    mentions = t("lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("chunk"), F.col("l_orderkey").alias("o"))
    return graph.cooccurrence(mentions, "entity", "chunk", "o")


@query
def tier_cost(t) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    usage = t("lineitem").select("l_orderkey", "l_linenumber", q.alias("prompt_token_count"), (q * F.col("l_linenumber") / 4).cast("long").alias("cached_content_token_count"), F.col("l_linenumber").cast("long").alias("candidates_token_count"))
    return cost.with_cost(usage, TIERS).select("l_orderkey", "l_linenumber", F.round(F.col("cost_usd") * 1e6, 4).alias("cost"))


@query
def cost_totals(t) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    usage = t("lineitem").select("l_returnflag", q.alias("prompt_token_count"), F.lit(1).cast("long").alias("cached_content_token_count"), F.col("l_linenumber").cast("long").alias("candidates_token_count"))
    out = cost.totals(cost.with_cost(usage, TIERS), ["l_returnflag"])
    return out.select("l_returnflag", "requests", F.col("prompt_token_count").alias("prompt"), F.col("candidates_token_count").alias("output"), F.round(F.col("cost_usd") * 1e6, 2).alias("cost"))


@query
def profile_report(t) -> DataFrame:
    conv = turns(t).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("conversations"), F.sum(F.length("text")).alias("duration"))
    users = F.size(F.filter("conversations", lambda x: x["role"] == "user"))
    df = conv.select((F.col("conv_id") % 97).alias("video_id"), "duration", F.when(users > 1, "multi_turn").otherwise("single_turn").alias("sample_type"), "conversations", (F.col("conv_id") % 4).alias("criteria_count"))
    out = profile.dataset_profile(df)
    return out.select(*(F.round(F.col(c).cast("double"), 6).alias(c) for c in out.columns))


@query
def numeric_summary(t) -> DataFrame:
    df = t("documents").select(F.when(F.col("doc_id") % 7 == 0, "n/a").when(F.col("doc_id") % 11 != 0, F.col("n_chars").cast("string")).alias("duration"))
    out = profile.numeric_summary(df, "duration")
    return out.select("n", *(F.round(c, 6).alias(c) for c in out.columns if c != "n"))


@query
def category_counts(t) -> DataFrame:
    df = t("documents").select(F.concat_ws(", ", "lang", F.lit(" "), "source", F.lit("")).alias("c"))
    return profile.category_counts(df, "c")


@query
def known_categories(t) -> DataFrame:
    df = t("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("Comedy, Nothing ,Travel")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Vlogs,"), "lang")).alias("c"))
    return df.select("doc_id", X.listed_categories(F.col("c")).alias("categories"))


@query
def field_completeness(t) -> DataFrame:
    df = t("documents").select("lang", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("speech"), F.when(F.col("doc_id") % 5 > 0, "x").otherwise("").alias("visual"))
    return profile.completeness(df, ["lang"], ["speech", "visual"])


@query
def words_and_sentences(t) -> DataFrame:
    d = t("documents").select("lang", X.word_count(F.col("text")).alias("w"), F.length(X.remove_punctuation(F.col("text"))).alias("c"), F.regexp_count("text", F.lit("[.!?]")).alias("s"))
    return d.groupBy("lang").agg(F.sum("w").alias("words"), F.sum("c").alias("plain_chars"), F.sum("s").alias("sentence_ends"))


@query
def json_extract(t) -> DataFrame:
    p = F.from_json("props", "k bigint")
    return t("events").select("event_id", p["k"].alias("k"), F.regexp_extract("props", r'"k"\s*:\s*(\d+)', 1).try_cast("long").alias("k_scanned"))


@query
def strip_tags(t) -> DataFrame:
    tagged = F.concat(F.lit("<think>plan "), F.col("role"), F.lit("\n</think> "), "text", F.lit("<tool_call>{}</tool_call>"))
    df = turns(t).withColumn("raw", F.when(F.col("turn") % 3 == 0, tagged).when(F.col("turn") % 3 == 1, F.concat(F.lit("rest</think>\n"), "text")).otherwise(F.concat("text", F.lit(" <answer> A </answer> x <answer>B</answer>"))))
    return df.select("conv_id", "turn", F.md5(X.strip_tool_calls(X.strip_think(F.col("raw")))).alias("clean"), F.md5(X.last_answer(F.col("raw"))).alias("answer"))


@query
def name_tags(t) -> DataFrame:
    c = F.concat("p_brand", F.lit("/"), "p_name", F.lit("@v.2"))
    return t("part").select("p_partkey", X.model_tag(c).alias("model"), X.tag(c, "none").alias("tag"), X.agent_name(F.concat(F.lit("my-Video-Agent-"), "p_name", F.lit("@v.2"))).alias("agent"))


@query
def chunk_tail_merge(t) -> DataFrame:
    out = context.chunked(t("documents").select("doc_id"), ["doc_id"], 300, 110)
    return out.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query
def worker_split(t) -> DataFrame:
    docs = t("documents").select("doc_id")
    even = context.even_parts(docs, ["doc_id"], 7, "part")
    return context.round_robin(even, ["doc_id"], 3).groupBy("part", "worker").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query
def update_join(t) -> DataFrame:
    base = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("answer"))
    changes = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("answer"), "l_linenumber", "l_shipdate", "l_partkey")
    return joins.update_join(base, changes, ["o_orderkey"], ["answer"], ["l_shipdate", "l_linenumber", "l_partkey", "answer"])


@query
def upsert_rows(t) -> DataFrame:
    base = t("customer").filter("c_custkey % 3 > 0").select("c_custkey", "c_name", "c_mktsegment")
    changes = t("customer").filter("c_custkey % 2 = 0 or c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.upper("c_mktsegment")).alias("c_mktsegment"), F.col("c_nationkey").alias("extra"))
    return joins.upsert(base, changes, "c_custkey")


@query
def set_algebra(t) -> DataFrame:
    d, lab = t("documents").select("doc_id"), t("labels").select("doc_id", "toxic")
    both = d.intersect(lab.select("doc_id")).withColumn("kind", F.lit("both"))
    only = d.subtract(lab.select("doc_id")).withColumn("kind", F.lit("only"))
    some = lab.filter("toxic = 1").select("doc_id").union(d.filter("doc_id % 10 = 0")).distinct().withColumn("kind", F.lit("some"))
    return both.unionByName(only).unionByName(some).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query
def summed_log(t) -> DataFrame:
    log = t("lineitem").select("l_returnflag", F.col("l_linenumber").cast("long").alias("samples"), (F.col("l_quantity") > 25).alias("interrupted"))
    return profile.summed(log, ["l_returnflag"])


@query
def stage_metrics(t) -> DataFrame:
    log = t("lineitem").select(F.col("l_linestatus").alias("stage"), F.col("l_returnflag").alias("replica"), F.col("l_quantity").alias("seconds"), F.col("l_linenumber").cast("long").alias("requests"))
    return profile.stage_metrics(log, ["stage", "replica"])


@query
def status_counts(t) -> DataFrame:
    state = lambda n: F.when(F.col("doc_id") % n == 0, "failed").when(F.col("doc_id") % (n + 1) == 0, F.lit(None)).otherwise("done")
    return profile.status_counts(t("documents").select(state(7).alias("download"), state(5).alias("caption"), state(3).alias("describe")), ["download", "caption", "describe"])


@query
def frame_plan(t) -> DataFrame:
    d = t("documents").select("doc_id", (F.col("n_chars") % 300 / 10).alias("d"))
    n = V.frame_count(F.col("d"), 20)
    return d.select("doc_id", n.cast("long").alias("frames"), F.round(F.element_at(V.frame_times(F.lit(0.0), F.col("d"), n), -1), 6).alias("last"), F.size(V.frame_times(F.lit(0.0), F.col("d"), n)).cast("long").alias("n"))


@query
def normal_intervals(t) -> DataFrame:
    e = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 20).alias("s"), (F.col("l_linenumber") * 8 - F.col("l_quantity")).alias("e"))
    x = V.normal_interval(F.col("s"), F.col("e"), 30.0)
    return e.select("l_orderkey", "l_linenumber", x["start"].alias("start"), x["end"].alias("end"))


@query
def session_gap(t) -> DataFrame:
    out = incremental.sessions(t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "1 hour")
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


@query
def live_entries(t) -> DataFrame:
    e = t("events").select("user_id", "event_type", F.col("event_id").alias("seq"), (F.col("event_id") * 13 % 5000).alias("expires"))
    return incremental.live_entries(e, ["user_id", "event_type"], "seq", "expires", 2500).select("user_id", "event_type", "seq", "expires")


@query
def selected_videos(t) -> DataFrame:
    """Recordings that are there and neither too short nor too long; one in eleven has no readable duration."""
    d = t("documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "download_failed").otherwise("downloaded").alias("status"), F.when(F.col("doc_id") % 11 == 0, "n/a").otherwise(F.col("n_chars").cast("string")).alias("duration"))
    return filters.duration_within(filters.with_status(d)).select("doc_id", "duration")


@query
def evaluable_samples(t) -> DataFrame:
    """Turns with a reply, to be judged, beside those that pass through."""
    judged, passed = filters.split_evaluable(turns(t).withColumn("text", F.when(F.col("turn") % 3 == 1, F.lit("  ")).otherwise(F.col("text"))), "text")
    both = judged.withColumn("judged", F.lit(True)).unionByName(passed.withColumn("judged", F.lit(False)))
    return both.groupBy("role", "judged").agg(F.count(F.lit(1)).alias("n"))


@query
def payload_rows(t) -> DataFrame:
    """Points' payloads, spans cut to whole milliseconds, and without one of their fields."""
    start = F.col("l_extendedprice") / 7
    p = filters.without_fields(filters.payload(start, start + F.col("l_quantity") / 3, kind=F.col("l_returnflag"), dropped=F.col("l_linestatus")), ["dropped"])
    return t("lineitem").select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query
def exact_text_match(t) -> DataFrame:
    """Parts with the first part of the same type that costs more than 1500; none where no such part exists."""
    listed = t("part").filter("p_retailprice > 1500").select("p_type", F.col("p_partkey").alias("first_part"), F.col("p_brand").alias("first_brand"))
    return joins.exact_first(t("part").select("p_partkey", "p_type"), listed, "p_type", ["first_part"], ["first_part", "first_brand"])


@query
def confident_texts(t) -> DataFrame:
    """Texts read from frames: the sure ones, each where it is first seen."""
    e = t("events").select("user_id", F.floor(F.col("event_id") / 20).alias("frame"), F.col("event_id").alias("pos"), F.concat("event_type", (F.col("event_id") % 6).cast("string")).alias("text"), ((F.col("event_id") % 10) / 10).alias("confidence"))
    return filters.confident_first_seen(e, ["user_id"], "frame", "pos").select("user_id", "frame", "text")


@query
def batch_order(t) -> DataFrame:
    """Kinds of events as buckets of waiting requests, served by age where one starves, else by size."""
    e = t("events").select(F.concat("event_type", (F.col("user_id") % 5).cast("string")).alias("bucket"), F.col("event_id").cast("double").alias("since"))
    out = filters.batch_order(e, "bucket", "since", 10_000.0, 9990.0)
    return out.select("bucket", "oldest", "requests", F.col("place").cast("long").alias("place"))


@query
def content_ids(t) -> DataFrame:
    """Name-based ids, cache keys of searches and days."""
    o = t("orders")
    key = V.search_key(F.array("o_orderpriority", "o_orderstatus"), query=F.col("o_orderpriority"), video=F.col("o_custkey"))
    return o.select("o_orderkey", V.name_uuid(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"))).alias("uuid"), key.alias("cache_key"), V.day(F.col("o_orderdate")).alias("day"))


@query
def worker_segments(t) -> DataFrame:
    d = t("documents").select("doc_id", F.inline(V.worker_segments(F.col("n_chars") / 8, 4, 5.0)))
    return d.select("doc_id", F.col("worker").cast("long").alias("worker"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "first_frame")


@query
def labels_and_weights(t) -> DataFrame:
    """Sizes as people read them, and weights of criteria by their category."""
    d = t("documents").select("doc_id", "n_chars", F.element_at(F.array(*(F.lit(x) for x in (*V.CATEGORY_WEIGHTS, "unknown", None))), (F.col("doc_id") % (len(V.CATEGORY_WEIGHTS) + 2) + 1).cast("int")).alias("category"))
    return d.select("doc_id", V.size_label(F.col("n_chars")).alias("size"), V.category_weight(F.col("category")).cast("long").alias("weight"))


@query
def choices(t) -> DataFrame:
    """The last letter chosen in a turn's text, small letters read as large ones."""
    return turns(t).select("conv_id", "turn", X.choice(F.translate("text", "abcde", "ABCDE")).alias("choice"))


@query
def subtitles(t) -> DataFrame:
    """Lines of a turn's text at fixed steps; blank ones count but do not appear."""
    return turns(t).select("conv_id", "turn", F.inline(X.subtitle_lines(F.col("text")))).withColumn("text", F.md5("text"))
