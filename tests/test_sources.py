import json

from pyspark.sql import functions as F

from tidemark.sources import readers, sinks
from tidemark.streaming import incremental


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_json_lines(spark, tmp_path):
    at = put(tmp_path / "a.jsonl", '{"id": "x", "n": 1}\n\n{"id": "y"}\n')
    assert [tuple(r) for r in readers.json_lines(spark, at, "id string, n int").orderBy("id").collect()] == [("x", 1), ("y", None)]
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    assert [r[0] for r in readers.ids_in_lines(spark, put(tmp_path / "b.jsonl", '{"sample_id": "s1", "sample_id": "s2"}\nbad\n')).collect()] == ["s1"]


def test_folders(spark, tmp_path):
    for n in "cab":
        put(tmp_path / "docs" / f"{n}.json", json.dumps({"id": n}, indent=1))
    put(tmp_path / "docs" / "z.json", "{broken")
    assert [r.id for r in readers.json_folder(spark, str(tmp_path / "docs"), "id string", first=2).orderBy("id").collect()] == ["a", "b"]
    assert sorted(r.id for r in readers.json_or_nothing(spark, str(tmp_path / "docs"), "id string").collect()) == ["a", "b", "c"]


def test_aligned_first(spark):
    a = spark.createDataFrame([("v", "al")], "video_id string, d string")
    r = spark.createDataFrame([("v", "raw"), ("w", "raw")], "video_id string, d string")
    assert sorted(map(tuple, readers.prefer_aligned(a, r).collect())) == [("v", "al"), ("w", "raw")]


def test_csv_and_ids(spark, tmp_path):
    at = put(tmp_path / "m.csv", 'video_id,duration,description\nv1,12.5,"two\nlines, ""q"""\nv2,,x\n')
    df = readers.numbers(readers.metadata_csv(spark, at, "video_id string, duration string, description string"), ["duration"])
    assert [tuple(r) for r in df.orderBy("video_id").collect()] == [("v1", 12.5, 'two\nlines, "q"'), ("v2", 0.0, "x")]
    ids = put(tmp_path / "ids.txt", "# no\n\n abcdefghijk rest\nshort\n")
    assert [r.id for r in readers.id_list(spark, ids, 11).collect()] == ["abcdefghijk"] and readers.id_list(spark, ids).count() == 2


def test_files(spark, tmp_path):
    for n in ("x/a.mp4", "x/a.mkv", "y/b.mp4", "y/c.txt"):
        put(tmp_path / "f" / n, "123")
    ls = readers.files(spark, str(tmp_path / "f"))
    assert {r.extension: (r.files, r.bytes) for r in readers.file_stats(ls).collect()} == {"mp4": (2, 6), "mkv": (1, 3), "txt": (1, 3)}
    ids = spark.createDataFrame([("a", None), ("b", "nowhere"), ("q", None)], "id string, hint string")
    got = {r.id: r.path and r.path.rsplit("/", 1)[1] for r in readers.resolve_paths(ids, ls).collect()}
    assert got == {"a": "a.mp4", "b": "b.mp4", "q": None}
    assert len(readers.frame_list(ls).filter(F.col("folder").endswith("/x")).head().frames) == 2
    assert readers.path_map(ls).count() == 3


def test_config():
    reg = {"defaults": {"n": 1, "x": {"a": 1, "b": 2}}, "t1": {"x": {"a": 5}}, "t2": {}}
    assert readers.select_tasks(reg, "all")["t1"] == {"n": 1, "x": {"a": 5, "b": 2}}
    assert list(readers.select_tasks(reg, "t2")) == ["t2"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    out = str(tmp_path / "o")
    sinks.write_json(df, out)
    done = readers.json_lines(spark, out, "id string, n int")
    sinks.append_new(spark.createDataFrame([("b", 9), ("c", 3)], "id string, n int"), done, out, ["id"])
    assert sorted(map(tuple, readers.json_lines(spark, out, "id string, n int").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    parts = spark.createDataFrame([("s", 0, True, "x"), ("s", 1, True, "y"), ("t", 0, True, "z"), ("t", 1, False, "")], "id string, part int, done boolean, v string")
    for batch in ("0", "0", "1"):
        sinks.write_complete(parts, "id", str(tmp_path / "c"), batch)
    assert [r.id for r in sinks.committed(spark, str(tmp_path / "c"), "id string, parts array<struct<part int, v string>>").collect()] == ["s"]
    sinks.write_complete(parts.withColumn("done", F.lit(True)), "id", str(tmp_path / "c"), "2")
    assert sorted(r.id for r in sinks.committed(spark, str(tmp_path / "c"), "id string").collect()) == ["s", "t"]
    sinks.write_by_key(df, "id", str(tmp_path / "k"), str(tmp_path / "all"))
    assert spark.read.json(str(tmp_path / "k")).count() == 2
    sinks.write_csv(df, str(tmp_path / "csv"))
    pts = spark.createDataFrame([("p", "audio", 1, [1.0]), ("p", "audio", 2, [2.0])], "raw_id string, type string, seq int, vector array<double>")
    sinks.upsert_points(None, pts, str(tmp_path / "store"))
    assert [r.vector for r in spark.read.parquet(str(tmp_path / "store")).collect()] == [[2.0]]
    sinks.write_artefacts(df.withColumn("content_hash", F.sha2("id", 256)), str(tmp_path / "art"))
    s = spark.createDataFrame([("x", 0.5, 2)], "task string, accuracy double, samples long")
    o = spark.createDataFrame([(0.5, 2)], "overall double, samples long")
    assert "Overall 50.00 %" in sinks.score_report(s, s.withColumnRenamed("task", "category"), o)


def test_stream_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for batch in ([(1, "a"), (1, "a")], [(1, "a"), (2, "b")]):
        spark.createDataFrame([(f"2024-01-01 00:00:0{i}", *r) for i, r in enumerate(batch)], "ts string, id int, v string").select(F.to_timestamp("ts").alias("ts"), "id", "v").write.mode("append").parquet(src)
        df = incremental.distinct_within(incremental.source(spark, src, "ts timestamp, id int, v string"), ["id"], "ts", "1 hour")
        incremental.once(df, incremental.append_to(out), ck).awaitTermination()
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b")]


def test_stuck_and_completed(spark):
    s = spark.createDataFrame([("a", "x", "processing", 0.0), ("b", "y", "processing", 0.0), ("c", "x", "done", 0.0)], "id string, stage string, state string, since double")
    assert [r.state for r in incremental.stuck(s, 100.0, {"x": 50.0}).orderBy("id").collect()] == ["failed", "processing", "done"]
    p = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("b", 1, 1)], "k string, part int, n int")
    assert [r.k for r in incremental.completed(p, "k", "n").collect()] == ["b"]
