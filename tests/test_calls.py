"""Model calls, table functions, the store's data source and the commit log."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import inference, tables
from tidemark.functions import text as X
from tidemark.operators import intervals
from tidemark.sources import readers, sinks, store


def test_retry_waits_longer_each_time():
    waits, calls = [], []
    retry = inference.Retry(4, base=1.0, most=3.0, jitter=0.0, sleep=waits.append)

    def fails(n):
        def fn():
            calls.append(1)
            if len(calls) <= n:
                raise OSError("busy")
            return "done"

        return fn

    assert retry.call(fails(3)) == "done" and waits == [1.0, 2.0, 3.0]
    calls.clear()
    waits.clear()
    with pytest.raises(OSError, match="busy"):
        retry.call(fails(9))
    assert len(calls) == 4 and len(waits) == 3
    jittered = inference.Retry(base=2.0, jitter=0.5)
    assert all(2.0 <= jittered.pause(1) <= 3.0 for _ in range(50))


def test_kept_is_bounded():
    kept = inference.Kept(2)
    for x in "aba":
        if not kept.get(x)[0]:
            kept.put(x, x.upper())
    kept.put("c", "C")
    assert (len(kept), kept.hits, kept.misses) == (2, 1, 2)
    assert kept.get("a") == (True, "A") and kept.get("b") == (False, None)


def test_one_model_for_a_process_and_one_call_for_a_text():
    made, asked = [], []

    def factory():
        made.append(1)

        def run(texts):
            asked.extend(texts)
            if "bad" in texts:
                raise ValueError("no")
            return [t.upper() for t in texts]

        return run

    quick = inference.Retry(2, sleep=lambda s: None)
    serve = lambda texts: inference.served("test", "once", factory, texts, quick, 10)
    assert serve(["a", "b", "a"]) == [("A", None), ("B", None), ("A", None)]
    assert serve(["b", "c", "bad"]) == [("B", None), ("C", None), (None, "ValueError: no")]
    assert serve(["c", "a"]) == [("C", None), ("A", None)]
    assert len(made) == 1 and asked == ["a", "b", "c", "bad", "c", "bad", "bad"]


def test_factory_is_called_once_in_a_worker(spark, tmp_path):
    at = str(tmp_path / "made")

    @inference.register("counted", inference.EMBEDDERS)
    def _counted():
        with open(at, "a") as f:
            f.write(".")
        return lambda texts: [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(f"text {i % 7}",) for i in range(200)], "t string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        got = df.select(inference.embed(F.col("t"), "counted").alias("v")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r.v) for r in got} == {(6.0,)} and open(at).read() == "."


def test_embeddings_of_odd_texts(spark):
    df = spark.createDataFrame([("a b",), ("b A ",), ("",), (None,)], "t string")
    one, two, blank, null = (r.v for r in df.select(inference.embed(F.col("t")).alias("v")).collect())
    assert one == two and len(one) == 32 and set(blank) == {0.0} and null is None


def test_table_functions_equal_the_array_forms(spark, small):
    tables.register(spark)
    texts = [("One. Two is longer! " + "word and " * 40,), ("",), (None,), ("no end",)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, t string")
    df.createOrReplaceTempView("t_texts")
    got = spark.sql("SELECT id, pos, sentence FROM t_texts, LATERAL sentences(t, 100)").orderBy("id", "pos").collect()
    want = df.select("id", F.posexplode(X.split_sentences(F.col("t"))).alias("pos", "sentence")).orderBy("id", "pos").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) > 3
    videos = spark.createDataFrame([(0, 0.4), (1, 10.9), (2, 11.2), (3, None), (4, 35.0)], "id int, d double")
    videos.createOrReplaceTempView("t_videos")
    got = spark.sql("SELECT id, clip, clip_start, clip_end FROM t_videos, LATERAL clips(d, cast(10 as double))").orderBy("id", "clip").collect()
    want = intervals.clip_windows(videos, "d", 10.0).select("id", "clip", "clip_start", "clip_end").orderBy("id", "clip").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    spans = [(1, 0.0, 4.0), (1, 3.0, 20.0), (1, 5.0, 6.0), (1, 30.0, 31.0), (2, 1.0, 2.0), (2, 6.9, 7.0), (2, 12.0, 13.0)]
    spark.createDataFrame(spans, "video long, start double, end double").repartition(3).createOrReplaceTempView("t_spans")
    got = spark.sql("SELECT * FROM silences(TABLE (SELECT video, start, end FROM t_spans) PARTITION BY video ORDER BY (start, end))").collect()
    assert sorted(tuple(r) for r in got) == [(1, 20.0, 30.0), (2, 7.0, 12.0)]


def test_store_pages_and_filters(spark, tmp_path):
    at = str(tmp_path / "points")
    rows = [(i, ["audio", "image", None][i % 3], float(i), [1.0 * i]) for i in range(50)]
    spark.createDataFrame(rows, "pid long, type string, t double, v array<double>").repartition(4).write.parquet(at)
    p = store.points(spark, at, "pid long, type string, t double, v array<double>", "pid", page=7, partitions=3)
    assert p.count() == 50 and p.rdd.getNumPartitions() == 3
    got = p.filter("type = 'audio' and t >= 10 and t < 40 and pid % 2 = 0").select("pid", "v")
    assert sorted((r.pid, r.v) for r in got.collect()) == [(i, [float(i)]) for i in range(10, 40) if i % 3 == 0 and i % 2 == 0]
    assert sorted(r.pid for r in p.filter("type is not null and pid in (1, 2, 4)").collect()) == [1, 4]
    reader = store.PointsReader(p.schema, {"path": at, "id": "pid"})
    from pyspark.sql.datasource import EqualTo, Not

    left = list(reader.pushFilters([EqualTo(("type",), "audio"), Not(EqualTo(("type",), "image"))]))
    assert reader.conditions == [("type", "=", "audio")] and len(left) == 1
    assert sum(b.num_rows for part in reader.partitions() for b in reader.read(part)) == 17
    spark.createDataFrame([], "pid long, type string").write.parquet(str(tmp_path / "none"))
    assert store.points(spark, str(tmp_path / "none"), "pid long, type string", "pid").count() == 0


def test_commits_count_once(spark, tmp_path):
    at, schema = str(tmp_path / "sink"), "id int, v string"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    assert sinks.committed(spark, at, schema).count() == 0
    assert sinks.commit(rows, at, "0") and not sinks.commit(rows, at, "0")
    # a run that breaks off before its entry
    rows.write.json(f"{at}/data/1-lost")
    assert sorted(tuple(r) for r in sinks.committed(spark, at, schema).collect()) == [(1, "a"), (2, "b")]
    assert sinks.commit(rows.filter("id = 2"), at, "1") and sinks.committed(spark, at, schema).count() == 3
    assert sinks.sweep(spark, at) == 1 and sinks.committed(spark, at, schema).count() == 3
    with pytest.raises(ValueError):
        sinks.commit(rows, at, "a/b")


def test_score_json(spark):
    tasks = spark.createDataFrame([("entity_recognition", 0.12345, 3), ("summarization", 0.5, 1), ("unlisted", 1.0, 9)], "task string, accuracy double, samples long")
    got = json.loads(sinks.score_json(tasks, "m", scored_at="now", modalities=spark.createDataFrame([("visual", 0.25, 4)], "modality string, accuracy double, samples long")))
    assert got["overall"] == {"accuracy": round((12.35 + 50.0) / 2, 2), "samples": 4} or got["overall"]["samples"] == 4
    assert set(got["subtasks"]) == {"entity_recognition", "summarization"} and got["subtasks"]["summarization"]["category"] == "Information Tasks"
    assert got["modality_breakdown"] == {"visual": {"accuracy": 25.0, "samples": 4}} and "duration_breakdown" not in got
    assert json.loads(sinks.score_json(tasks.filter("false"), "m"))["overall"] == {"accuracy": 0, "samples": 0}


def test_config_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"model": {"name": "x", "size": 1}, "n": 2}')
    (tmp_path / "c.yaml").write_text("model:\n  name: x\n  size: 1\nn: 2\n")
    for name in ("c.json", "c.yaml"):
        assert readers.config(spark, str(tmp_path / name), {"model": {"size": 3}}) == {"model": {"name": "x", "size": 3}, "n": 2}
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        readers.config(spark, str(tmp_path / "l.json"))
