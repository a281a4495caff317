"""Queries over assembly of samples, fusion, statistics, selections, readers and sinks. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import values as V
from tidemark.operators import benchmark, fusion, graph, intervals, profile, vector
from tidemark.plans.queries import QUERIES, micros, query, turns
from tidemark.session import scratch
from tidemark.sources import readers, sinks


def stored_query(fn: Callable[[SparkSession, Callable, str], DataFrame]) -> Callable:
    """Register a query that also writes below a folder of its own."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), scratch(spark, fn.__name__))
    return fn


def lines(t) -> DataFrame:
    """One row for each line of an order: k, n, quantity, flag, status."""
    return t("lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("n")).agg(F.max("l_quantity").alias("quantity"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))


def text_of(c: str) -> Column:
    return F.col(c).cast("string")


@query
def fused_segments(t) -> DataFrame:
    """Video segments with the texts of all overlapping captions and sounds."""
    at = (F.col("l_orderkey") % 5000).cast("double")
    s = t("lineitem").groupBy((F.col("l_suppkey") % 40).alias("video_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"))
    s = s.agg(F.min(at).alias("start"), F.max(at + F.col("l_quantity")).alias("end"), F.min("l_returnflag").alias("flag"))
    named = F.concat("flag", text_of("idx"))
    captions = s.filter("idx % 3 = 1").withColumn("text", F.when(F.col("flag") != "N", named))
    audio = s.filter("idx % 3 = 2").withColumn("audio_description", F.when(F.col("flag") == "A", "").otherwise(named))
    video = s.filter("idx % 3 = 0").select("video_id", "idx", "start", "end")
    return fusion.fuse_overlapping(video, captions, audio, width=50.0).select("video_id", "idx", "speech_content", "audio_environment")


@query
def key_event_segments(t) -> DataFrame:
    """Turns with the key events of the same position; a video has as many as it has user turns."""
    said = turns(t).filter("role = 'user'").withColumn("events", F.array(F.concat("role", text_of("turn")), F.lit("x")))
    events = profile.grouped_in_order(said, "conv_id", "turn", "events").select(F.col("conv_id").alias("video_id"), F.col("values").alias("key_events"))
    segments = turns(t).select(F.col("conv_id").alias("video_id"), F.col("turn").alias("idx"))
    return fusion.with_key_events(segments, events).select("video_id", "idx", F.concat_ws("|", "key_events").alias("key_events"))


@query
def merged_positions(t) -> DataFrame:
    """Positions of the best source that knows the video, with the texts of all three, where there is any."""
    d = turns(t).select(F.col("conv_id").alias("video_id"), F.col("turn").alias("idx"), F.md5("text").alias("description"))
    return fusion.with_any_modality(fusion.merge_by_position(d.filter("video_id % 3 = 0 and idx < 2"), d.filter("video_id % 3 <> 2"), d.filter("idx > 0")))


@query
def fused_documents(t) -> DataFrame:
    """One document for each video with its statistics."""
    turn = F.col("turn")
    seg = turns(t).select(
        F.col("conv_id").alias("video_id"), turn.alias("idx"), (turn * 10.0).alias("start"), (turn * 10.0 + 4.0).alias("end"), F.when(turn % 2 == 0, F.col("role")).alias("multimodal_description"),
        F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (turn % 3).cast("int")).alias("key_events"), F.when(F.col("role") == "user", F.col("role")).alias("speech"), F.lit("").alias("visual"), F.when(turn % 3 == 0, "hum").alias("audio_environment"),
    )
    meta = t("customer").select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("channel"), F.col("c_acctbal").cast("string").alias("duration"), F.lit("n/a").alias("view_count"))
    s, ratio = F.col("statistics"), F.col("statistics.completeness_ratio")
    counts = [s[c].cast("long").alias(c) for c in ("total_segments", "segments_with_speech", "segments_with_visual", "segments_with_audio", "segments_with_multimodal", "segments_with_key_events", "total_key_events")]
    seconds = F.aggregate("segments", F.lit(0.0), lambda n, x: n + x["temporal"]["duration"])
    return fusion.documents(seg, meta).select("video_id", "video.title", "video.channel", "video.duration", "video.view_count", *counts, F.round(ratio["speech"], 9).alias("speech_share"), seconds.alias("seconds"), F.element_at("segments", -1)["segment_index"].alias("last_index"))


def benchmark_tables(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions, answers, criteria and videos of a benchmark: orders are tasks, their lines questions; up to line 3 single ones, the others one sequence.

    Some tasks lack answers or criteria, some answers failed, some are older versions, some questions lack criteria, some videos metadata.
    The lines are dealt by task once, and what is grouped and joined by task later stays where it is.
    """
    n, qid = F.col("n"), F.concat(F.lit("q"), text_of("n"))
    none = F.array().cast("array<string>")
    question = F.struct(qid.alias("question_id"), F.concat(F.lit("Q"), text_of("n"), "flag").alias("question"), (n % 3).alias("difficulty"), F.when(n % 2 == 0, F.array(F.lit("audio"))).otherwise(none).alias("modalities"), F.array(n).alias("key_segments"))
    answer = F.struct(qid.alias("question_id"), F.concat(F.lit("A"), F.col("quantity").cast("int").cast("string")).alias("answer"), F.when(F.col("flag") == "R", "failed").otherwise("success").alias("status"), F.lit(4).alias("difficulty"), F.array(F.lit("visual")).alias("modalities"), F.array(n).alias("key_segments"))
    one = lambda category: F.struct(F.lit("name").alias("name"), F.lit("what").alias("description"), F.lit(category).alias("category"))
    criteria = benchmark.weighted_criteria(F.when(F.col("status") == "O", F.array(one("low_priority"), one("penalty"))).otherwise(F.array(one("low_priority"))))
    graded = F.struct(qid.alias("question_id"), criteria.alias("criteria"))
    task_id = F.concat(F.lit("k"), text_of("k")).alias("task_id")
    dealt = t("lineitem").withColumn("k", F.col("l_orderkey")).select(task_id, "k", F.col("l_linenumber").cast("int").alias("n"), "l_quantity", "l_returnflag", "l_linestatus").repartition("task_id")
    line = dealt.groupBy("task_id", "k", "n").agg(F.max("l_quantity").alias("quantity"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    each = line.select("task_id", "k", "n", question.alias("q"), answer.alias("a"), F.when((F.col("flag") == "A") & n.isin(2, 5), None).otherwise(graded).alias("c"))
    task = each.groupBy("task_id", "k").agg(F.array_sort(F.collect_list(F.struct("n", "q", "a", "c"))).alias("x"))

    def single(f: str) -> Column:
        return F.filter(F.transform(F.filter("x", lambda r: r["n"] <= 3), lambda r: r[f]), lambda v: v.isNotNull())

    def sequence(f: str) -> Column:
        kept = F.filter(F.transform(F.filter("x", lambda r: r["n"] > 3), lambda r: r[f]), lambda v: v.isNotNull())
        return F.when(F.exists("x", lambda r: r["n"] > 3), F.array(kept)).otherwise(F.slice(F.array(kept), 1, 0))

    asked = task.select("task_id", "k", F.struct(single("q").alias("single_turn_questions"), sequence("q").alias("multi_turn_questions")).alias("questions"))
    o = t("orders").withColumn("k", F.col("o_orderkey")).select(task_id, F.col("o_custkey").alias("video_id"), F.col("o_orderpriority").alias("scenario"), F.concat(F.lit("s"), text_of("o_custkey")).alias("scenario_id"), F.col("o_orderstatus").alias("task"))
    questions = asked.join(o, "task_id").withColumnRenamed("k", "seq")
    replies = F.when(F.col("k") % 5 == 0, F.slice(sequence("a"), 1, 0)).otherwise(sequence("a"))
    answered = task.filter("k % 7 <> 0").select(F.lit(2).alias("seq"), "task_id", F.struct(single("a").alias("single_turn_answers"), replies.alias("multi_turn_answers")).alias("answers"))
    older = answered.select(F.lit(1).alias("seq"), "task_id", F.col("answers").withField("single_turn_answers", F.transform("answers.single_turn_answers", lambda a: a.withField("answer", F.lit("old")))).alias("answers"))
    grades = task.filter("k % 11 <> 0").select(F.lit(1).alias("seq"), "task_id", single("c").alias("single_turn_criteria"), sequence("c").alias("multi_turn_criteria"))
    videos = t("customer").filter("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("duration"), F.array("c_mktsegment").alias("categories"))
    return questions, answered.unionByName(older), grades, videos


@query
def benchmark_samples(t) -> DataFrame:
    """The samples in their order, their turns as text."""
    turn = lambda x: F.concat_ws(":", x["role"], x["content"], x["difficulty"].cast("string"), F.concat_ws(",", x["modalities"]), F.size(x["criteria"]).cast("string"))
    weight = F.aggregate(F.flatten(F.transform("conversations", lambda x: x["criteria"])), F.lit(0), lambda s, c: s + c["weight"])
    return benchmark.samples(*benchmark_tables(t)).select("sample_id", "video_id", "task_id", "sample_type", "title", "duration", F.concat_ws(",", "categories").alias("categories"), F.concat_ws("|", F.transform("conversations", turn)).alias("turns"), F.col("criteria_count").cast("long").alias("criteria_count"), weight.cast("long").alias("weight"))


@query
def clean_samples(t) -> DataFrame:
    """The samples as they are published, without ids, counted by what is left of their turns."""
    turn = lambda x: F.concat_ws(":", x["role"], F.substring(x["content"], 1, 1), F.size(x["criteria"]).cast("string"))
    c = benchmark.clean(benchmark.unnumbered(*benchmark_tables(t))).select("task", "sample_type", F.concat_ws("|", F.transform("conversations", turn)).alias("turns"))
    return c.groupBy("task", "sample_type", "turns").agg(F.count(F.lit(1)).alias("n"))


@query
def caption_totals(t) -> DataFrame:
    turn = F.col("turn")
    out = profile.caption_stats(turns(t).withColumn("start", turn * 2.0).withColumn("end", F.when(turn % 4 != 3, turn * 2.0 + 1.5)), "conv_id")
    return out.withColumn("words", F.col("words").cast("long"))


@query
def description_totals(t) -> DataFrame:
    out = profile.description_stats(turns(t).withColumn("frames_extracted", F.when(F.col("turn") % 3 > 0, F.col("turn").cast("long"))), "conv_id")
    return out.withColumn("frames_per_segment", F.round("frames_per_segment", 9))


@query
def valid_words(t) -> DataFrame:
    """Mean words of the texts that describe something."""
    out = profile.mean_words(turns(t).withColumn("text", F.when(F.col("turn") % 4 == 1, X.NO_DESCRIPTION[0]).when(F.col("turn") % 4 == 2, "").otherwise(F.col("text"))), "text")
    return out.select(F.round("mean_words", 6).alias("mean_words"), "n")


@query
def question_totals(t) -> DataFrame:
    """Single questions and those in sequences of each order."""
    g = lines(t).groupBy("k").agg(F.collect_list(F.when(F.col("n") <= 3, F.col("n"))).alias("s"), F.collect_list(F.when(F.col("n") > 3, F.col("n"))).alias("m"))
    return g.select("k", profile.nested_total("s", F.when(F.size("m") > 0, F.array("m"))).cast("long").alias("questions"))


@query
def success_counts(t) -> DataFrame:
    return profile.conditional_counts(t("lineitem"), "l_returnflag", "l_linestatus", "O")


@query
def store_counts(t) -> DataFrame:
    return profile.store_counts(t("events").select(F.col("user_id").alias("video_id"), F.col("event_type").alias("type")))


@query
def cache_stats(t) -> DataFrame:
    out = profile.cache_stats(t("documents").select(F.col("n_chars").cast("long").alias("bytes"), F.col("doc_id").alias("ts")))
    return out.withColumn("mb", F.round("mb", 9))


@query
def hit_rates(t) -> DataFrame:
    hits = F.count_if(F.col("event_id") % 3 == 0)
    return t("events").groupBy("user_id").agg(profile.hit_rate(hits, F.count(F.lit(1)) - hits).alias("hit_rate"))


@query
def ordered_values(t) -> DataFrame:
    """What each user did, in order; users by their first event."""
    out = profile.grouped_in_order(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
    return out.select("user_id", "first", F.md5(F.concat_ws(",", "values")).alias("values"))


@query
def nested_ids(t) -> DataFrame:
    """Ids of scenarios (a region's nations) and tasks (the market segments of their customers)."""
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = c.groupBy("n_regionkey", "n_name").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("tasks"))
    v = s.groupBy(F.concat(F.lit("v"), text_of("n_regionkey")).alias("video_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("scenario"), "tasks"))).alias("scenarios"))
    return benchmark.nested_ids(v)


@query
def request_ids(t) -> DataFrame:
    """Ids of requests for a turn or for one of its criteria, and their parts."""
    sample, n = F.concat(F.lit("sample_"), text_of("k")), F.col("n")
    r = lines(t).withColumn("id", F.when(n % 2 == 0, benchmark.request_id(sample, n, F.col("quantity").cast("int"))).otherwise(benchmark.request_id(sample, n)))
    return r.withColumn("p", benchmark.request_parts(F.col("id"))).select("id", "p.sample_id", F.col("p.turn").cast("long").alias("turn"), F.col("p.criterion").cast("long").alias("criterion"))


@query
def frame_matches(t) -> DataFrame:
    """Frames that lie near their times, for each customer up to the first time that has none."""
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("double")
    o = t("orders").select(F.col("o_custkey").alias("video_id"), pos.alias("target"), "o_orderkey")
    out = intervals.nearest_frames(o, o.select("video_id", (F.col("target") + F.col("o_orderkey") % 13 / 20 - 0.11).alias("frame")), "video_id")
    return out.select("video_id", "target", F.round("frame", 6).alias("frame"))


@query
def video_spans(t) -> DataFrame:
    """Widened spans, whole short videos and steps of speed."""
    a = F.col("l_quantity")
    wide, short, steps = V.widened_span(a, a + F.col("l_tax") * 100, F.lit(45.0)), V.short_video_span(a, a + 1, a * 2), V.tempo_steps(a / 10)
    cols = {"wide_start": wide["start"], "wide_end": wide["end"], "short_start": short["start"], "short_end": short["end"], "last_step": F.element_at(steps, -1)}
    return t("lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(k) for k, c in cols.items()), F.size(steps).cast("long").alias("steps"))


@query
def chunk_subtitles(t) -> DataFrame:
    """What each user did on each day from the first of the year, also where that is nothing."""
    e = t("events").select("user_id", (micros("ts") - 1704067200).alias("t"), F.col("event_type").alias("text"))
    days = e.groupBy("user_id").agg(F.max(F.floor(F.col("t") / 86400)).alias("last")).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk"))
    return graph.subtitles_in_chunks(days, e, "user_id", 86400.0)


@query
def unit_vectors(t) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return t("embeddings").select("vec_id", F.round(V.unit_vector(v)[0], 6).alias("first"), F.round(V.pixel_scale(v)[1], 6).alias("pixel"))


@query
def truncated_texts(t) -> DataFrame:
    return t("documents").select("doc_id", F.md5(X.truncated(F.col("text"), 200)).alias("text"), V.duration_label(F.col("n_chars").cast("double")).alias("duration"))


@query
def position_rules(t) -> DataFrame:
    asked = F.element_at(F.array(F.lit("At the Beginning?"), F.lit("the END"), F.lit("midway")), (F.col("turn") % 3 + 1).cast("int"))
    return turns(t).select("conv_id", "turn", F.concat_ws(",", vector.position_rule(asked, F.col("turn").cast("int")).cast("array<string>")).alias("chunks"))


@query
def verified_candidates(t) -> DataFrame:
    """The first candidates by what the verifier says of them."""
    return vector.verified(t("nation").select(F.col("n_nationkey").alias("pos"), (F.col("n_nationkey") * 7 % 5 / 5).alias("probability"), "n_name"))


@query
def filled_templates(t) -> DataFrame:
    values = {"name": F.col("c_name"), "segment": F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")), "nation": F.col("c_nationkey")}
    return t("customer").select("c_custkey", X.fill('{name}: {"s": {segment}} of {nation}, {name} {unknown}', values).alias("prompt"))


@query
def key_event_texts(t) -> DataFrame:
    """Events from fenced JSON, from lines and from neither."""
    fenced, listed = F.concat(F.lit('```json\n["a b", "", " '), "role", F.lit(' "]\n```')), F.concat(F.lit("Key events:\n- first "), "role", F.lit('\n2. second thing",\nab'))
    raw = F.when(F.col("turn") % 4 == 0, fenced).when(F.col("turn") % 4 == 1, listed).when(F.col("turn") % 4 == 2, "").otherwise('["open')
    return turns(t).select("conv_id", "turn", F.concat_ws("|", X.key_events(raw)).alias("events"))


@query
def json_or_text(t) -> DataFrame:
    """Replies that are JSON, that hold some, and that are none."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so: "), "props", F.lit("."))).otherwise("none")
    e = t("events").select("event_id", raw.alias("raw")).withColumn("x", X.json_or_raw(F.col("raw"), "k bigint"))
    return e.select("event_id", F.col("x.value.k").alias("k"), F.col("x.raw").alias("raw"), X.braces(F.col("raw")).alias("braces"))


@query
def aligned_or_raw(t) -> DataFrame:
    """Aligned segments, and raw ones of the videos that have none."""
    d = turns(t).select(F.col("conv_id").alias("video_id"), "turn", F.md5("text").alias("text"))
    return readers.prefer_aligned(d.filter("video_id % 3 = 0 and turn > 0").withColumn("aligned", F.lit(True)), d).select("video_id", "turn", "text", F.coalesce("aligned", F.lit(False)).alias("aligned"))


def listing(t) -> DataFrame:
    """A listing of files: one for each customer, some of no video, and one for each supplier elsewhere."""
    ext = F.element_at(F.array(*(F.lit(x) for x in (".mp4", ".webm", ".MOV", ".txt", ".mkv"))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    own = t("customer").select(F.concat(F.lit("/media/"), text_of("c_nationkey"), F.lit("/"), text_of("c_custkey"), ext).alias("path"), (F.col("c_custkey") * 10).cast("long").alias("length"))
    return own.unionByName(t("supplier").select(F.concat(F.lit("/other/"), text_of("s_suppkey"), F.lit(".avi")).alias("path"), F.lit(5).cast("long").alias("length")))


@query
def resolved_paths(t) -> DataFrame:
    """The files of videos: as hinted where that exists, else by the order of extensions."""
    ids = t("customer").select(text_of("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/other/"), text_of("c_custkey"), F.lit(".avi"))).alias("hint"))
    return readers.resolve_paths(ids, listing(t))


@query
def path_map(t) -> DataFrame:
    return readers.path_map(listing(t))


@query
def file_totals(t) -> DataFrame:
    return readers.file_stats(listing(t))


@query
def frame_lists(t) -> DataFrame:
    """Each folder's frames in order."""
    e = t("events").select(F.concat(F.lit("/f/"), text_of("user_id"), F.lit("/"), F.lpad(text_of("event_id"), 8, "0"), F.lit(".jpg")).alias("path"))
    return readers.frame_list(e).select("folder", F.size("frames").cast("long").alias("n"), F.md5(F.concat_ws(",", "frames")).alias("frames"))


@stored_query
def json_resumed(spark: SparkSession, t, at: str) -> DataFrame:
    """Half of the turns written, then all that have no result yet appended, and read again."""
    schema, all_turns = "conv_id long, turn int, role string, text string", turns(t)
    sinks.write_json(all_turns.filter("turn % 2 = 0"), at)
    sinks.append_new(all_turns, readers.json_lines(spark, at, schema), at, ["conv_id", "turn"])
    return readers.json_lines(spark, at, schema).select("conv_id", "turn", "role", F.md5("text").alias("text"))


@stored_query
def csv_round_trip(spark: SparkSession, t, at: str) -> DataFrame:
    """Texts with quotes and line breaks through CSV; numbers read again from text, with 0 where there are none."""
    d = t("documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")).alias("duration"), F.concat(F.lit(' "'), "text", F.lit('\n", ')).alias("text"))
    sinks.write_csv(d, at)
    back = readers.numbers(readers.metadata_csv(spark, at, "doc_id string, duration string, text string"), ["duration"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "duration", F.md5("text").alias("text"))


@stored_query
def complete_parts(spark: SparkSession, t, at: str) -> DataFrame:
    """Conversations all of whose turns are done, once each, with their turns in order; written by two runs after one that broke off, and one that is repeated."""
    parts = turns(t).select("conv_id", F.col("turn").alias("part"), ((F.col("turn") != 1) | (F.col("conv_id") % 3 > 0)).alias("done"), "role")
    # data without an entry in the log: what a run that breaks off leaves
    parts.filter("conv_id % 2 = 0").write.json(f"{at}/data/0-broken")
    sinks.write_complete(parts.filter("conv_id % 5 = 0"), "conv_id", at, "0")
    for _ in range(2):
        sinks.write_complete(parts, "conv_id", at, "1")
    sinks.write_complete(parts, "conv_id", at, "2")
    back = sinks.committed(spark, at, "conv_id long, parts array<struct<part int, role string>>")
    return back.select("conv_id", F.concat_ws(",", F.transform("parts", lambda p: F.concat(p["part"].cast("string"), p["role"]))).alias("parts"))


@stored_query
def points_upserted(spark: SparkSession, t, at: str) -> DataFrame:
    """A store of points, a third of them replaced by later ones that have one more column."""
    p = t("embeddings").select(F.col("vec_id").alias("raw_id"), F.lit(1).alias("seq"), F.concat(F.lit("t"), text_of("label")).alias("type"))
    sinks.upsert_points(None, p, f"{at}/1")
    sinks.upsert_points(spark.read.parquet(f"{at}/1"), p.filter("raw_id % 3 = 0").withColumns({"seq": F.lit(2), "video_id": F.concat(F.lit("v"), text_of("raw_id"))}), f"{at}/2")
    return spark.read.parquet(f"{at}/2").select("raw_id", "type", "seq", "video_id")
