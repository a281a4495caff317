import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import benchmark, context, cost, fusion, graph, intervals, joins, profile, scoring, vector


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_last_and_first_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, None)], "k int, seq int, v string")
    assert rows(joins.last_wins(df, ["k"], ["seq"]), "k", "v") == [(1, "b"), (2, None)]
    assert rows(joins.first_wins(df, ["k"], ["seq"]), "k", "v") == [(1, "a"), (2, None)]


def test_marks_work_list_pending(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "id int") for xs in ([1, 2, 3, 3], [2, 2, 4]))
    assert rows(joins.mark_join(a, {"b": b}, "id"), "id", "b") == [(1, False), (2, True), (3, False), (3, False)]
    assert rows(joins.work_list([a], [b], "id"), "id") == [(1,), (3,)]
    assert rows(joins.pending(a, b, ["id"]), "id") == [(1,), (3,), (3,)]


def test_update_and_upsert(spark):
    base = spark.createDataFrame([(1, ""), (2, "old"), (3, None)], "id int, v string")
    ch = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "new", 1)], "id int, v string, seq int")
    assert rows(joins.update_join(base, ch, ["id"], ["v"], ["seq"]), "id", "v") == [(1, "y"), (2, "old"), (3, None)]
    assert rows(joins.update_join(base, ch, ["id"], ["v"], ["seq"], keep=False), "id", "v") == [(1, "y"), (2, "new"), (3, None)]
    up = joins.upsert(base, spark.createDataFrame([(2, None, 7), (9, "n", 8)], "id int, v string, extra int"), "id")
    assert rows(up, "id", "v", "extra") == [(1, "", None), (2, "old", 7), (3, None, None), (9, "n", 8)]


@pytest.mark.parametrize("closed", [False, True])
def test_interval_join_is_a_nested_loop(spark, closed):
    rng = random.Random(3)
    side = lambda n: [(rng.randrange(3), i, s, s + rng.choice([0.0, 1.0, 4.5, 40.0])) for i in range(n) for s in [rng.randrange(60) / 2]]
    left, right = side(80), side(80)
    hit = (lambda a, b, c, d: a <= d and b >= c) if closed else (lambda a, b, c, d: a < d and b > c)
    want = sorted((i, j) for k, i, a, b in left for m, j, c, d in right if k == m and hit(a, b, c, d))
    l = spark.createDataFrame(left, "k int, i int, start double, end double")  # noqa: E741
    r = spark.createDataFrame(right, "k int, j int, o_start double, o_end double")
    assert sorted(map(tuple, joins.interval_join(l, r, ["k"], 5.0, closed=closed).select("i", "j").collect())) == want


def test_gaps(spark):
    df = spark.createDataFrame([("v", 0.0, 1.0, "audio", 0), ("v", 5.99, 7.0, "audio", 1), ("v", 12.0, 13.0, "audio", 2), ("v", 12.5, 14.0, "audio", 3)], "video string, start double, end double, kind string, pos int")
    got = rows(intervals.close_gaps(df, "video", ["start", "pos"]), "start", "end", "kind")
    assert got == sorted([(0.0, 1.0, "audio"), (1.0, 7.0, "audio"), (7.0, 12.0, "silent"), (12.0, 13.0, "audio"), (12.5, 14.0, "audio")], key=str)
    videos = spark.createDataFrame([("v", 30.0), ("w", 9.0)], "video string, duration double")
    assert rows(intervals.silences(df, videos, "video"), "video", "start", "end") == sorted([("v", 7.0, 12.0), ("v", 14.0, 30.0), ("w", 0.0, 9.0)], key=str)


def test_clips_and_windows(spark):
    df = spark.createDataFrame([(1, 21.0), (2, 21.5), (3, 0.4), (4, None)], "id int, d double")
    assert rows(intervals.clip_windows(df, "d"), "id", "clip", "clip_end") == [(1, 0, 10.0), (1, 1, 20.0), (2, 0, 10.0), (2, 1, 20.0), (2, 2, 21.5)]
    r = df.select(intervals.audio_windows(F.col("d")).alias("w")).collect()
    assert [len(x.w) if x.w is not None else None for x in r][:3] == [1, 1, 1]


def test_spread_pieces(spark):
    df = spark.createDataFrame([("v", 0, "aaaa", 0.0, 4.0), ("v", 1, "bbbbbbbb", 0.0, 4.0), ("v", 2, "c", 0.0, 4.0)], "video string, pos int, text string, start double, end double")
    got = intervals.spread_pieces(df, ["video"], "pos").orderBy("pos").collect()
    per, at = max(4 / 13, 1 / 3), 0.0
    for i, r in enumerate(got):
        end = 4.0 if i == 2 else min(at + max(len(r.text) * per, 1.0), 4.0)
        assert (r.piece_start, r.piece_end) == (pytest.approx(at), pytest.approx(end))
        at = end


def test_merge_short_pairs_up(spark):
    df = spark.createDataFrame([("v", float(i), i + 0.5, f"t{i}", i) for i in range(5)], "video string, start double, end double, text string, pos int")
    assert rows(intervals.merge_short(df, "video"), "id", "text") == [(0, "t0 t1"), (1, "t2 t3"), (2, "t4")]


def test_nearest_frames(spark):
    t = spark.createDataFrame([("v", 0.0), ("v", 1.0), ("v", 2.0)], "video string, target double")
    f = spark.createDataFrame([("v", 0.1), ("v", 0.95), ("v", 1.1), ("v", 2.5)], "video string, frame double")
    assert rows(intervals.nearest_frames(t, f, "video"), "target", "frame") == [(0.0, 0.1), (1.0, 0.95)]
    late = t.withColumn("target", F.col("target") - 0.5)
    assert rows(intervals.nearest_frames(late, f, "video"), "target") == []


def test_worked_score(spark):
    crit = "array<struct<weight:int,is_penalty:boolean,criteria_met:boolean>>"
    df = spark.createDataFrame([(1, "x", [("assistant", [(5, False, True), (3, False, False), (1, False, None), (-5, True, True)])]), (2, None, [("user", None)]), (3, "x", [])], f"id int, task string, conversations array<struct<role:string,criteria:{crit}>>")
    assert rows(scoring.sample_scores(df), "id", "obtained", "total", "score") == [(1, 5, 9, 5 / 9), (2, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert scoring.sample_scores(df, apply_penalties=True).filter("id = 1").head().obtained == 0
    assert rows(scoring.task_accuracy(scoring.sample_scores(df)), "task", "samples") == [("unknown", 1), ("x", 2)]


def test_macro_average(spark):
    t = spark.createDataFrame([("summarization", 1.0, 3), ("sentiment_analysis", 0.0, 1), ("motion_analysis", 0.333333, 5), ("odd", 1.0, 9)], "task string, accuracy double, samples long")
    c = scoring.category_accuracy(t)
    assert rows(c, "category", "accuracy", "samples") == [("Information Tasks", 0.5, 4), ("Multimodal Tasks", 0.333333, 5)]
    o = scoring.overall(c).head()
    assert o.overall == pytest.approx(0.4166665) and o.overall_of_rounded == pytest.approx(0.41665) and o.samples == 9
    assert rows(scoring.dropped_tasks(t), "task") == [("odd",)]


def test_buckets_and_groups(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1799.99, 1800.0, 2700.0, -1.0, None)], "d double")
    assert [r[0] for r in df.select(scoring.duration_bucket(F.col("d"))).collect()] == ["short", "short", "medium", "long", "long", "short"]
    s = spark.createDataFrame([(1, 2, ["visual", "text"]), (1, 2, ["audio_environment", "speech", "audio"]), (0, 2, None)], "obtained long, total long, tags array<string>")
    assert rows(scoring.modality_breakdown(s, "tags"), "modality", "samples") == [("audio", 1), ("speech", 1), ("visual", 2)]
    assert rows(scoring.modality_breakdown(s, "tags", audio_is_audio=True), "modality", "samples") == [("audio", 1), ("speech", 1), ("visual", 1)]


def test_ordinal_of_several_columns_after_a_join(spark):
    """Ties in the first columns, nulls, one value in a third of the rows and a plan that is read twice after a shuffle; an empty table."""
    a = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 7 when id % 50 = 1 then null else id % 400 end as k", "concat('x', id % 11) as s")
    df = a.join(a.select("id", (a.id * 7 % 3000).alias("w")), "id").repartition(5)
    got = [tuple(r) for r in context.ordinal(df, ["k", "s", "id"], "n").select("n", "k", "s", "id").collect()]
    want = sorted(((r["k"], r["s"], r["id"]) for r in a.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert sorted(got) == [(i, *r) for i, r in enumerate(want)]
    assert context.ordinal(df.filter("id < 0"), ["k"], "n").count() == 0


def test_ordinal_and_chunks(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7 % 1000).alias("id"))
    assert context.ordinal(df, ["id"], "n").filter("n <> id").count() == 0
    assert rows(context.chunked(df, ["id"], 200, 20).groupBy("chunk").count(), "chunk", "count") == [(i, 200) for i in range(5)]
    tail = context.chunked(spark.range(415), ["id"]).groupBy("chunk").count()
    assert rows(tail, "chunk", "count") == [(0, 200), (1, 215)]
    assert rows(context.even_parts(spark.range(10), ["id"], 4).groupBy("worker").count(), "worker", "count") == [(0, 3), (1, 3), (2, 2), (3, 2)]


def test_answered(spark):
    df = spark.createDataFrame([(1, [("assistant", "x"), ("user", None)]), (2, [("assistant", "")]), (3, [("assistant", None)])], "id int, conversations array<struct<role:string,candidate_response:string>>")
    assert rows(context.answered(df), "id") == [(1,)]


def test_tiers(spark):
    tiers = [{"max_input_tokens": 10, "input_per_1m": 1, "cached_input_per_1m": 1, "output_per_1m": 1}, {"max_input_tokens": 20, "input_per_1m": 2, "cached_input_per_1m": 1, "output_per_1m": 1}]
    df = spark.createDataFrame([(10,), (11,), (99,)], "p int")
    assert [r[0] for r in df.select(cost.price_tier(tiers, F.col("p"))["input_per_1m"]).collect()] == [1.0, 2.0, 2.0]


def test_graph(spark):
    m = spark.createDataFrame([("e", 1, 0), ("e", 2, 1), ("f", 1, 2), ("f", 2, 3), ("g", 3, 4)], "entity string, chunk int, o int")
    assert rows(graph.cooccurrence(m, "entity", "chunk", "o"), "src", "dst", "label") == [(1, 2, "f"), (2, 1, "f")]
    chunks = spark.createDataFrame([("v", 0), ("v", 1), ("v", 2)], "video string, chunk long")
    lines = spark.createDataFrame([("v", 0.0, "a"), ("v", 9.9, "b"), ("v", 10.0, "c")], "video string, t double, text string")
    assert rows(graph.subtitles_in_chunks(chunks, lines, "video", 10.0), "chunk", "text") == [(0, "a b"), (1, "c"), (2, "")]


def test_search(spark):
    p = spark.createDataFrame([("a", "v", "audio", 0, 1999, [1.0, 0.0]), ("b", "v", "audio", 5000, 6000, [1.0, 0.1]), ("c", "w", "visual", 0, 0, [1.0, 0.0]), ("d", "v", "audio", 0, 10, [0.0, 1.0])], "raw_id string, video_id string, type string, start_time_ms long, end_time_ms long, vector array<float>")
    got = vector.top_k(vector.payload_filter(p, "audio", "v"), [1.0, 0.0], 2)
    assert [r.raw_id for r in got.orderBy(F.desc("score")).collect()] == ["a", "b"]
    assert rows(vector.top_k(p, [1.0, 0.0], 2, within=(2.0, 9.0)), "raw_id") == []
    assert rows(vector.multi_modal(p, {"audio": [0.0, 1.0], "visual": [0.0, 1.0]}, 1), "modality", "raw_id") == [("audio", "d"), ("visual", "c")]
    with pytest.raises(ValueError):
        vector.multi_modal(p, {}, 21)


def test_greedy_clusters(spark):
    i = spark.createDataFrame([("v", 0, "Red Car, big", [1.0, 0.0]), ("v", 1, "car", [1.0, 0.1]), ("v", 2, "dog", [0.69, 0.7238]), ("v", 3, "cat", [0.0, 1.0])], "video string, pos int, item string, embedding array<double>")
    assert rows(vector.greedy_clusters(i, "video", "pos"), "pos", "cluster") == [(0, "red car"), (1, "red car"), (2, "dog"), (3, "dog")]


def test_position_rule(spark):
    df = spark.createDataFrame([("At the BEGINNING", 5), ("in the end", 2), ("else", 5)], "q string, n int")
    assert [r[0] for r in df.select(vector.position_rule(F.col("q"), F.col("n"))).collect()] == [[0, 1, 2], [0, 1], []]


def test_fusion(spark):
    v = spark.createDataFrame([("a", 0, 0.0, 10.0, "x"), ("a", 1, 10.0, 20.0, "y")], "video_id string, idx int, start double, end double, visual_description string")
    c = spark.createDataFrame([("a", 0, 0.0, 5.0, "one"), ("a", 1, 5.0, 6.0, ""), ("a", 2, 6.0, 12.0, "two")], "video_id string, idx int, start double, end double, text string")
    a = spark.createDataFrame([("a", 0, 0.0, 10.0, ""), ("a", 1, 2.0, 30.0, "hum")], "video_id string, idx int, start double, end double, audio_description string")
    assert rows(fusion.fuse_overlapping(v, c, a), "idx", "speech_content", "audio_environment") == [(0, "one  two", "hum"), (1, "two", "hum")]
    e = spark.createDataFrame([("a", [["k1", "k2"]])], "video_id string, key_events array<array<string>>")
    assert rows(fusion.with_key_events(v, e), "idx", "key_events") == [(0, ["k1", "k2"]), (1, [])]
    d = lambda *x: spark.createDataFrame(list(x), "video_id string, idx int, description string")
    m = fusion.merge_by_position(d(("a", 0, "m")), d(("a", 0, "v"), ("a", 1, "v1"), ("b", 0, "vb")), d(("c", 0, "ac")))
    assert rows(m, "video_id", "idx", "multimodal_description", "visual_description", "audio_description") == [("a", 0, "m", "v", ""), ("b", 0, "", "vb", ""), ("c", 0, "", "", "ac")]


def test_final_documents(spark):
    s = spark.createDataFrame([("a", 1, 5.0, 9.0, "", ["k"], "s", "", ""), ("a", 0, 0.0, 5.0, "m", [], "", "v", "")], "video_id string, idx int, start double, end double, multimodal_description string, key_events array<string>, speech string, visual string, audio_environment string")
    m = spark.createDataFrame([("a", "T", None, "12.5", "many")], "video_id string, title string, channel string, duration string, view_count string")
    r = fusion.documents(s, m).head()
    assert [x.segment_index for x in r.segments] == [0, 1] and r.statistics.total_key_events == 1 and r.statistics.completeness_ratio.speech == 0.5
    assert (r.video.duration, r.video.view_count, r.video.channel) == (12.5, 0.0, "")


Q = "struct<question_id:string,question:string,difficulty:int,modalities:array<string>,key_segments:array<int>>"
A = "struct<question_id:string,answer:string,status:string,difficulty:int,modalities:array<string>,key_segments:array<int>>"
C = "struct<question_id:string,criteria:array<struct<name:string,weight:int>>>"


def assembled(spark):
    q = lambda i, d=1, m=("visual",): (i, f"Q {i}", d, list(m), [1])
    a = lambda i, s="success": (i, f"A {i}", s, 4, ["audio"], [9])
    c = lambda i, n=1: (i, [("n", 5)] * n)
    questions = spark.createDataFrame([(0, "v", "sc", "v_s1", "task", "t1", ([q("t1_q1", 0, ()), q("t1_q2"), q("t1_q3")], [[q("t1_m1"), q("t1_m2")], [q("t1_m3")], [q("t1_m4")]])), (1, "w", "sc", "w_s1", "task", "t2", ([q("t2_q1")], []))], f"seq long, video_id string, scenario string, scenario_id string, task string, task_id string, questions struct<single_turn_questions:array<{Q}>,multi_turn_questions:array<array<{Q}>>>")
    answers = spark.createDataFrame([(0, "t1", ([a("t1_q1", "failed")], [])), (1, "t1", ([a("t1_q1"), a("t1_q2", "failed"), a("t1_q3")], [[a("t1_m1")], [a("zz")]])), (2, "t2", ([a("t2_q1")], []))], f"seq long, task_id string, answers struct<single_turn_answers:array<{A}>,multi_turn_answers:array<array<{A}>>>")
    criteria = spark.createDataFrame([(0, "t1", [c("t1_q1", 2), c("t1_q2"), c("t1_q3", 0)], [[c("t1_m1"), c("t1_m2")], [c("t1_m3")]])], f"seq long, task_id string, single_turn_criteria array<{C}>, multi_turn_criteria array<array<{C}>>")
    videos = spark.createDataFrame([("v", ("T", 12.0, ["x"]))], "video_id string, video struct<title:string,duration:double,categories:array<string>>")
    return questions, answers, criteria, videos


def test_samples(spark):
    out = benchmark.samples(*assembled(spark))
    got = out.orderBy("number").collect()
    assert [(r.sample_id, r.sample_type, len(r.conversations), r.criteria_count) for r in got] == [("sample_0", "single_turn", 2, 2), ("sample_1", "single_turn", 2, 0), ("sample_2", "multi_turn", 2, 1), ("sample_3", "multi_turn", 0, 0)]
    first = got[0].conversations[0]
    assert (first.difficulty, first.modalities, first.key_segments, got[0].title, got[0].duration) == (4, ["audio"], [1], "T", 12.0)
    assert benchmark.samples(*assembled(spark), strict_reference=True).head().title == ""
    clean = benchmark.clean(out).filter("criteria_count = 2").head()
    assert [(t.role, len(t.criteria)) for t in clean.conversations] == [("user", 0), ("assistant", 2)]
    assert profile.dataset_profile(out).head().multi_turn_samples == 2
    assert {(r.kind, r.value): r.n for r in profile.question_histograms(out).collect()}["modality", "audio"] == 1


def test_ids(spark):
    s = spark.createDataFrame([("v", [("one", ["a", "b"]), ("two", ["c"])])], "video_id string, scenarios array<struct<scenario:string,tasks:array<string>>>")
    assert rows(benchmark.nested_ids(s), "task_id", "task") == [("v_s1_t1", "a"), ("v_s1_t2", "b"), ("v_s2_t1", "c")]
    r = spark.range(1).select(benchmark.request_parts(benchmark.request_id(F.lit("s__t1"), F.lit(3), F.lit(4))).alias("x")).head().x
    assert tuple(r) == ("s__t1", 3, 4)


def test_profiles(spark):
    s = spark.createDataFrame([("a", 0.0, 2.0, "one two"), ("a", None, 3.0, None), ("b", 1.0, 4.0, "x")], "id string, start double, end double, text string")
    assert rows(profile.caption_stats(s, "id"), "id", "segments", "seconds", "words") == [("a", 2, 2.0, 2), ("b", 1, 3.0, 1)]
    n = spark.createDataFrame([("1",), ("2",), ("4",), ("x",), (None,), ("nan",)], "d string")
    r = profile.numeric_summary(n, "d").head()
    assert (r.n, r.median, r.least, r.most) == (3, 2.0, 1.0, 4.0)
    t = spark.createDataFrame([("s", True, 1.5), ("s", True, 1.0), ("t", None, None)], "stage string, interrupted boolean, x double")
    assert rows(profile.summed(t, ["stage"]), "stage", "interrupted", "x") == [("s", 2, 2.5), ("t", None, None)]
    g = spark.createDataFrame([("b", 0, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, pos int, v string")
    assert [(r.k, r["values"]) for r in profile.grouped_in_order(g, "k", "pos", "v").orderBy("first").collect()] == [("b", ["x", "z"]), ("a", ["y"])]


def test_selections(spark):
    from tidemark.functions import values as V
    from tidemark.operators import filters

    r = spark.createDataFrame([("a", 10.0), ("b", None), ("c", 90.0)], "gpu string, free double")
    assert rows(filters.available(r, "free", 80.0), "gpu", "available") == [("a", False), ("b", False), ("c", True)]
    s = spark.createDataFrame([(1, 503), (2, 404), (3, None)], "id int, state int")
    assert rows(s.withColumn("again", filters.retryable(F.col("state"))), "id", "again") == [(1, True), (2, False), (3, True)]
    assert [r.id for r in filters.duration_within(spark.createDataFrame([(1, "60"), (2, "59.9"), (3, None), (4, "x")], "id int, duration string")).collect()] == [1]
    import json
    import uuid

    u = spark.createDataFrame([("https://x.org/a",)], "n string")
    assert u.select(V.name_uuid(F.col("n"))).head()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://x.org/a"))
    text = u.select(V.pretty_json(F.struct("n"))).head()[0]
    assert "\n" in text and json.loads(text) == {"n": "https://x.org/a"}
    assert filters.confident_first_seen(spark.createDataFrame([], "v int, frame int, pos int, text string, confidence double"), ["v"], "frame", "pos").count() == 0


def test_interval_join_with_an_endless_interval(spark):
    import random

    from tidemark.operators import joins

    rng = random.Random(3)
    left = [("v", i, float(a), float(a + rng.choice([0, 1, 7, 30, 31, 400]))) for i, a in enumerate(rng.sample(range(3000), 150))] + [("v", 900, 0.0, 1e9)]
    right = [("v", i, float(a), float(a + rng.choice([0, 2, 30, 60, 1000]))) for i, a in enumerate(rng.sample(range(3000), 150))] + [("v", 901, -5.0, 2e9), ("w", 902, 0.0, 5.0)]
    a = spark.createDataFrame(left, "video string, i int, start double, end double")
    b = spark.createDataFrame(right, "video string, j int, o_start double, o_end double")
    for closed in (False, True):
        got = sorted((r.i, r.j) for r in joins.interval_join(a, b, ["video"], 30.0, closed=closed).collect())
        over = (lambda s, e, o, p: s <= p and e >= o) if closed else (lambda s, e, o, p: s < p and e > o)
        assert got == sorted((i, j) for v, i, s, e in left for w, j, o, p in right if v == w and over(s, e, o, p))
    rows = joins.dealt(a.filter("i = 900"), F.col("start"), F.col("end"), 30.0, [0, 3, 25, 40], "own")
    assert rows.count() <= 6


@pytest.mark.parametrize("part", [100_000, 20])
def test_first_overlap_by_a_sweep(spark, part):
    import random

    from tidemark.operators import fusion

    rng = random.Random(part)
    span = lambda: (float(rng.randrange(2000)), rng.choice([0.0, 1.0, 5.0, 40.0, 500.0, 90000.0, -3.0]))
    captions = [("v", i, s, s + d) for i in range(200) for s, d in [span()]] + [("v", 500, None, 4.0), ("w", 1, 0.0, 9.0)]
    others = [("v", i, s, s + d, f"t{i}" if rng.random() < 0.9 else None) for i in rng.sample(range(1000), 200) for s, d in [span()]]
    a = spark.createDataFrame(captions, "video_id string, idx long, start double, end double")
    b = spark.createDataFrame(others, "video_id string, idx long, start double, end double, text string")
    got = {(r.video_id, r.idx): r.text for r in fusion.first_overlapping(a, b, "text", width=64.0, part=part).collect()}
    want = {}
    for v, i, s, e in captions:
        hits = [(j, t) for w, j, o, p, t in others if s is not None and v == w and t and s < p and e > o]
        want[v, i] = min(hits)[1] if hits else ""
    assert got == want
    assert fusion.first_overlapping(a.filter("false"), b, "text").count() == 0


def test_cooccurrence_of_a_hot_entity(spark):
    from tidemark.operators import graph

    rows = [("hot", f"c{i}", i) for i in range(300)] + [("x", "c1", 400), ("x", "c2", 400), ("y", "c2", 1), ("y", "z", 1), ("y", "z", 2), ("alone", "q", 0)]
    df = spark.createDataFrame(rows, "entity string, chunk string, o int")
    got = {(r.src, r.dst): r.label for r in graph.cooccurrence(df, "entity", "chunk", "o", block=40).collect()}
    want = {}
    last = {}
    for e, c, o in rows:
        last[e, c] = max(o, last.get((e, c), -1))
    for (e, c), o in last.items():
        for (f, d), _ in last.items():
            if e == f and c != d:
                key = (c, d)
                # the order of a pair is that of the mention on its lesser side
                want.setdefault(key, []).append((last[e, min(c, d)], e))
    assert got == {k: max(v)[1] for k, v in want.items()}


def test_frames_meet_targets_as_in_order(spark):
    rng = random.Random(6)
    targets = [(k, round(rng.uniform(0, 50), 2)) for k in "abc" for _ in range(rng.choice([1, 20, 60]))] + [("d", 1.0), ("e", None)]
    frames = [(k, round(rng.uniform(0, 50), 1)) for k in "abcz" for _ in range(400)] + [("d", 9.0), ("e", 1.0)]
    got = intervals.nearest_frames(spark.createDataFrame(targets, "k string, target double"), spark.createDataFrame(frames, "k string, frame double"), "k", 0.4)
    want = []
    for k in "abcde":
        wanted = iter(sorted(t for j, t in targets if j == k and t is not None))
        t = next(wanted, None)
        for f in sorted(f for j, f in frames if j == k):
            if t is not None and abs(f - t) <= 0.4:
                want.append((k, t, f))
                t = next(wanted, None)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want


def test_numbers_of_rows_that_all_tie(spark):
    df = spark.range(2000).select(F.lit(1).alias("same"), "id")
    out = context.ordinal(df, ["same"], "n")
    assert sorted(r.n for r in out.collect()) == list(range(2000))
    assert len(context._bounds(df.select(F.struct(F.col("same").alias("_0"), F.xxhash64("same", "id").alias("_1")).alias("_k")))) > 1


def shuffled(spark, df):
    """Rows that go through the exchanges of df's plan, by their metrics once it has run."""
    df.collect()

    def visit(node):
        own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
        inner = [node.child()] if node.nodeName().startswith("WholeStage") else [node.children().apply(i) for i in range(node.children().size())]
        return own + sum(visit(n) for n in inner)

    return visit(df._jdf.queryExecution().executedPlan())


def test_fused_texts_are_a_nested_loop_and_no_pairs_are_shuffled(spark):
    import random

    rng = random.Random(3)

    def segments(n, long):
        starts = [rng.choice([None, rng.uniform(-40, 60)]) if rng.random() < 0.1 else rng.uniform(-40, 60) for _ in range(n)]
        return [(f"v{rng.randrange(2)}", i, s, None if rng.random() < 0.05 else (s or 0.0) + rng.uniform(-1, 500 if rng.random() < long else 5), rng.choice([None, "", f"t{i}"])) for i, s in enumerate(starts)]

    schema = "video_id string, idx int, start double, end double, {} string"
    for long in (0.0, 0.2):
        v, c, a = segments(60, long), segments(80, long), segments(80, long)
        df = fusion.fuse_overlapping(*(spark.createDataFrame(x, schema.format(t)) for x, t in ((v, "visual_description"), (c, "text"), (a, "audio_description"))), width=5.0)
        over = lambda p, q: p[0] == q[0] and (p[2] or 0) < (q[3] or 0) and (p[3] or 0) > (q[2] or 0)
        want = [(r[0], r[1], " ".join(q[4] or "" for q in c if over(r, q)).strip(" "), " ".join(q[4] for q in a if q[4] and over(r, q))) for r in v]
        assert sorted(rows(df, "video_id", "idx", "speech_content", "audio_environment")) == sorted(want)
    # 200 segments that all overlap 200 captions: 40,000 pairs
    same = [("v", i, 0.0, 4.0, "t") for i in range(200)]
    df = fusion.fuse_overlapping(*(spark.createDataFrame(same, schema.format(t)) for t in ("visual_description", "text", "audio_description")), width=5.0)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert shuffled(spark, df) < 5000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_samples_without_numbers_are_those_with_them_and_write_nothing(spark, monkeypatch):
    numbered = benchmark.samples(*assembled(spark))
    monkeypatch.setattr(benchmark, "stored", lambda df, name: pytest.fail("rows were written"))
    plain = benchmark.unnumbered(*assembled(spark))
    assert sorted(map(str, plain.collect())) == sorted(map(str, numbered.select(*plain.columns).collect()))


def test_lines_of_a_benchmark_are_dealt_by_task_once(spark, small):
    from tidemark.plans import assembly

    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for c, v in zip(before, ("false", "-1")):
        spark.conf.set(c, v)
    try:
        tables = assembly.benchmark_tables(lambda name: spark.read.parquet(f"{small}/{name}.parquet"))
        plan = benchmark.task_rows(*tables[:3])._jdf.queryExecution().executedPlan().toString()
        # lines for questions, answers (two versions) and criteria, the orders, and what the union of versions loses
        assert plan.count("Exchange hashpartitioning") <= 6
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_fused_segments_of_several_lengths_shuffle_no_texts(spark):
    # 200 segments that all overlap 200 longer captions and sounds, and three others; bins come in several batches
    same = [("v", i, float(i % 3), 4.0, f"t{i}") for i in range(200)]
    long = [("v", i, -900.0 if i % 2 else 3.0, 90.0 + i, f"t{i}") for i in range(200)]
    more = [("v", 200, 3.0, 9.0, "short"), ("v", 201, 3.0, 19.0, "longer"), (None, 202, 0.0, 4.0, "none")]
    schema = "video_id string, idx int, start double, end double, {} string"
    v, c, a = (spark.createDataFrame(x, schema.format(t)) for x, t in ((same + more[2:], "visual_description"), (long + more, "text"), (long, "audio_description")))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, x in conf.items():
            spark.conf.set(k, x)
        df = fusion.fuse_overlapping(v, c, a, width=5.0)
        texts = " ".join(f"t{i}" for i in range(200))
        want = [("v", i, f"{texts} short longer", texts) for i in range(200)] + [(None, 202, "", "")]
        assert sorted(rows(df, "video_id", "idx", "speech_content", "audio_environment"), key=str) == sorted(want, key=str)
        df.collect()

        def moved(node):
            own = node.metrics().apply("dataSize").value() if node.nodeName() == "Exchange" else 0
            inner = [node.child()] if node.nodeName().startswith("WholeStage") else [node.children().apply(i) for i in range(node.children().size())]
            return own + sum(moved(n) for n in inner)

        assert moved(df._jdf.queryExecution().executedPlan()) < 500_000
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
