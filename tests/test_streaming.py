"""State machines on streams: the same result however the rows arrive, and state that leaves."""

import time

import pytest

from pyspark.sql import functions as F

from tidemark.plans import flows
from tidemark.streaming import incremental, stateful


#: Seconds since the epoch at which the tests' clock starts.
BASE = 1_000_000_000


def told(rows, *times):
    """Rows with these columns as seconds of the tests' clock."""
    return sorted(tuple(x / 10**6 - BASE if i in times else x for i, x in enumerate(r)) for r in rows)


def feed(spark, at, schema, *files):
    """Files one after the other; the last row of each is what moves the watermark."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + BASE)).drop("s").coalesce(1).write.parquet(f"{at}/in/{i}")
    return incremental.source(spark, f"{at}/in/*", spark.read.parquet(f"{at}/in/*").schema, files_per_batch=1)


def run(spark, at, rows, processor, last="2 hours"):
    out = stateful.stateful(stateful.timed(rows, "ts", last), "key", processor, type(processor).OUTPUT)
    query = incremental.once(out, incremental.append_to(f"{at}/out"), f"{at}/ck")
    query.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{at}/out").drop("batch").collect()], query.lastProgress.stateOperators[0]


H = 3600
CACHE = "key string, s long, id long, write boolean, value string, ttl double"
WRITES = [("a", 0, 1, True, "x", 1.0 * H), ("a", H - 1, 2, False, None, None), ("a", H, 3, False, None, None), ("b", 10, 4, True, "y", None), ("b", 90 * H, 5, False, None, None), ("c", 5, 6, False, None, None), ("a", 3 * H, 7, True, "z", 2.0 * H), ("a", 4 * H, 8, False, None, None)]
END = [("", 10_000 * H, 99, False, None, None)]


@pytest.mark.parametrize("files", [[WRITES, END], [WRITES[::-1], END], [[w for w in WRITES if w[1] < H + 1 and w[2] != 2], [WRITES[1]], [w for w in WRITES if w[1] > H], END]])
def test_ttl_cache(spark, tmp_path, files):
    got, state = run(spark, tmp_path, feed(spark, tmp_path, CACHE, *files), stateful.TtlCache(), "100 hours")
    assert sorted(got) == [("a", 2, True, "x"), ("a", 3, False, None), ("a", 8, True, "z"), ("b", 5, True, "y"), ("c", 6, False, None)]
    # what stays: the entry without end, and the closing row that waits
    assert state.numRowsTotal <= 4


def test_completion(spark, tmp_path):
    schema = "key string, s long, id long, part string, expected long, priority long"
    rows = [("a", 0, 1, "p", 2, 1), ("a", 5, 2, "p", 2, 1), ("a", 9, 3, "q", 2, 0), ("a", 20, 4, "q", 2, 1), ("b", 0, 5, "p", 2, 3), ("b", 5 * H, 6, "q", 2, 3), ("c", 7, 7, "p", 1, 2), ("a", 30 * H, 8, "p", 1, 5)]
    end = [("", 10_000 * H, 99, None, None, None)]
    want = [("a", "complete", 1, 1, 5, 30 * H), ("a", "complete", 2, 2, 0, 9), ("b", "incomplete", 1, 2, 3, 2 * H), ("c", "complete", 1, 1, 2, 7)]
    for i, files in enumerate(([rows, end], [rows[:3][::-1], rows[3:], end])):
        got, state = run(spark, f"{tmp_path}/{i}", feed(spark, f"{tmp_path}/{i}", schema, *files), stateful.Completion(2 * H, 10 * H), "100 hours")
        assert told(got, 5) == want
        assert state.numRowsTotal <= 3  # the closing row alone, with its timer


def test_stuck_by_event_time(spark, tmp_path):
    schema = "key string, s long, id long, stage string, state string"
    rows = [("a", 0, 1, "x", "processing"), ("a", H, 2, "x", "completed"), ("b", 0, 3, "x", "processing"), ("b", H + 1, 4, "x", "completed"), ("c", 3, 5, "y", "processing"), ("d", 8, 6, "x", "processing"), ("d", 9, 7, "y", "processing")]
    got, state = run(spark, tmp_path, feed(spark, tmp_path, schema, rows[::-1], [("", 10_000 * H, 9, None, None)]), stateful.Stuck({"x": H}, 2 * H))
    assert told(got, 3, 4) == [("b", "x", "failed", 0, H), ("c", "y", "failed", 3, 2 * H + 3), ("d", "y", "failed", 9, 2 * H + 9)]
    assert state.numRowsTotal <= 3


def test_reorder(spark, tmp_path):
    schema = "key string, s long, id long, number long, value string"
    frames = [("v", n * 60, n, n, f"f{n}") for n in range(12) if n != 5]
    files = [frames[3:6], frames[:4], frames[6:], [("", 10_000 * H, 99, -1, None)]]
    got, state = run(spark, tmp_path, feed(spark, tmp_path, schema, *files), stateful.Reorder(H))
    assert [r for r in sorted(got) if r[0]] == [("v", i, n, f"f{n}") for i, n in enumerate(x for x in range(12) if x != 5)]
    assert state.numRowsTotal <= 2  # the front of the video and of the closing key


def test_dedupe_keeps_one_in_each_span(spark, tmp_path):
    schema = "key string, s long, id long"
    rows = [("k", 0, 1), ("k", H - 1, 2), ("k", H, 3), ("k", H + 5, 4), ("j", 5, 5), ("k", 3 * H, 6)]
    got, state = run(spark, tmp_path, feed(spark, tmp_path, schema, [rows[5], *rows[:3]], rows[3:5], [("", 10_000 * H, 9)]), stateful.Dedupe(H), "100 hours")
    assert sorted((k, i) for k, i, _ in got) == [("j", 5), ("k", 1), ("k", 3), ("k", 6)] and state.numRowsTotal <= 3


def test_rows_come_in_frames_and_keep_their_values(spark, tmp_path):
    class InFrames(stateful.TtlCache):
        def handleInputRows(self, key, rows, timerValues):
            raise AssertionError("a row at a time")

    big = 2**60 + 1
    rows = [("a", 0, big, True, None, None), ("a", 5, big + 1, False, None, None), ("b", 0, big + 2, True, "NaN", 1e-3), ("b", 1, big + 3, False, "", 0.1), ("é,\n", 0, 1, True, '"\\', 10.5), ("é,\n", 9, 2, False, None, None)]
    out = stateful.stateful(stateful.timed(feed(spark, tmp_path, CACHE, rows, END), "ts", "1 hour"), "key", InFrames(), stateful.TtlCache.OUTPUT)
    incremental.once(out, incremental.append_to(f"{tmp_path}/out"), f"{tmp_path}/ck").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").drop("batch").collect())
    assert got == [("a", big + 1, True, None), ("b", big + 3, False, None), ("é,\n", 2, True, '"\\')]


def test_partitions_of_state_follow_the_cores_and_commit_changes(spark, tmp_path):
    schema = "key string, s long, id long, stage string, state string"
    rows = [(f"k{i}", i, i, "x", "processing") for i in range(50)]
    usual, cores = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(10 * cores))
    try:
        for given in (None, 3):
            at = f"{tmp_path}/{given}"
            out = stateful.stateful(stateful.timed(feed(spark, at, schema, rows, [("", 10_000 * H, 99, None, None)]), "ts", "2 hours"), "key", stateful.Stuck({}), stateful.Stuck.OUTPUT)
            query = incremental.once(out, incremental.append_to(f"{at}/out"), f"{at}/ck", partitions=given)
            assert spark.conf.get("spark.sql.shuffle.partitions") == str(10 * cores)
            query.awaitTermination()
            assert query.lastProgress.stateOperators[0].numShufflePartitions == (given or 2 * cores)
            assert spark.read.parquet(f"{at}/out").count() == 50
            assert list(tmp_path.glob(f"{given}/ck/state/0/*/*.changelog"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_rows_come_in_slices_of_arrow_batches_and_late_ones_are_dropped(spark, tmp_path):
    schema = "key string, s long, id long, stage string, state string"
    files = [[("a", 0, 1, "x", "processing")], [("", 1000 * H, 2, None, None)], [("", 1001 * H, 3, None, None)]]
    files += [[("a", 2, 4, "x", "processing"), ("a", 2000 * H, 5, "x", "processing")], [("", 10_000 * H, 9, None, None)]]
    got, state = run(spark, tmp_path, feed(spark, tmp_path, schema, *files), stateful.Stuck({"x": H}))
    assert told(got, 3, 4) == [("a", "x", "failed", 0, H), ("a", "x", "failed", 2000 * H, 2001 * H)]
    # transformWithStateInPandas makes a tuple of each row and a frame of the tuples, and asks for the state by messages
    assert state.operatorName == "applyInPandasWithState" and state.numRowsTotal == 1


class OfBucket:
    """The state of a group as applyInPandasWithState hands it over."""

    def __init__(self, watermark, value=None):
        self.exists, self.get, self.watermark, self.timeout = value is not None, value, watermark, None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutTimestamp(self, ms):
        assert ms > 0 and ms >= self.watermark  # or Spark fails
        self.timeout = ms


def test_timeout_of_a_bucket_is_the_millisecond_before_its_time():
    import pandas as pd

    def call(state, *rows):
        frame = pd.DataFrame([(0, *r) for r in rows], columns=["_bucket", "key", "at", "id", "stage", "state"], dtype=object)
        return [tuple(r) for f in handle((0,), iter([frame]), state) for r in f.itertuples(index=False)]

    handle = stateful.Frames(stateful.Stuck({}, 1)).handle
    first = OfBucket(0)
    assert call(first, ("a", "1", "1", "x", "processing")) == [] and first.timeout == 1  # not 0
    second = OfBucket(5000, first.get)
    assert call(second, ("b", "5000001", "2", "y", "processing")) == [("a", "x", "failed", 1, 1_000_001)]
    assert second.timeout == 5000  # over at the watermark 5001, which is past the row
    third = OfBucket(5001, second.get)
    assert call(third) == [] and third.timeout == 6000
    last = OfBucket(6001, third.get)
    assert call(last) == [("b", "y", "failed", 5_000_001, 6_000_001)] and not last.exists


def test_a_time_that_has_passed_is_due_when_the_watermark_moves():
    import pandas as pd

    class Behind(stateful.Reorder):
        def until(self, kept, rows):
            return 1

    state = OfBucket(5000)
    frame = pd.DataFrame([(0, "v", "4000000", "0", "x")], columns=["_bucket", "key", "at", "number", "value"], dtype=object)
    assert [len(f) for f in stateful.Frames(Behind(1)).handle((0,), iter([frame]), state)] == [1] and state.timeout == 5000


def wait_for(told, seconds=90):
    until = time.time() + seconds
    while time.time() < until:
        if told():
            return True
        time.sleep(0.5)
    return False


def test_live_cache_forgets(spark, tmp_path):
    spark.createDataFrame([("k", "x"), ("k", "x"), ("j", "y")], "key string, value string").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    rows = incremental.source(spark, f"{tmp_path}/in/*", "key string, value string")
    out = stateful.stateful(rows, "key", stateful.LiveCache(4000), stateful.LiveCache.OUTPUT, live=True)
    query = out.writeStream.foreachBatch(incremental.append_to(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    try:
        operators = lambda: [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        assert wait_for(lambda: any(n > 0 for n in operators()))
        assert wait_for(lambda: operators()[-1] == 0)
        spark.createDataFrame([("k", "z")], "key string, value string").coalesce(1).write.parquet(f"{tmp_path}/in/1")
        assert wait_for(lambda: spark.read.parquet(f"{tmp_path}/out").count() == 4)
        assert sorted((r.key, r.value, r.hit) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("j", "y", False), ("k", "x", False), ("k", "x", True), ("k", "z", False)]
    finally:
        query.stop()


def test_live_stuck_fails_without_input(spark, tmp_path):
    spark.createDataFrame([("a", "x", "processing"), ("b", "x", "completed"), ("c", "slow", "processing")], "key string, stage string, state string").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    rows = incremental.source(spark, f"{tmp_path}/in/*", "key string, stage string, state string")
    out = stateful.stateful(rows, "key", stateful.LiveStuck({"x": 2.0}), stateful.LiveStuck.OUTPUT, live=True)
    query = out.writeStream.foreachBatch(incremental.append_to(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    try:
        assert wait_for(lambda: query.recentProgress and spark.read.schema("key string, stage string, state string, since long").parquet(f"{tmp_path}/out").count() == 1)
        assert [(r.key, r.stage, r.state) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", "x", "failed")]
    finally:
        query.stop()


def test_work_off_goes_on_counting(spark, tmp_path):
    handle = incremental.work_off(["priority", "key"], f"{tmp_path}/taken")
    first = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "key string, priority int")
    handle(first, 0)
    handle(spark.createDataFrame([("d", 0)], "key string, priority int"), 1)
    handle(spark.createDataFrame([("d", 0)], "key string, priority int"), 1)  # a batch that is repeated replaces itself
    got = spark.read.parquet(f"{tmp_path}/taken").orderBy("place").collect()
    assert [(r.place, r.key) for r in got] == [(0, "b"), (1, "c"), (2, "a"), (3, "d")]


def test_arriving_covers_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id long, ts timestamp, key string")
    assert flows.stream_sessions(none.withColumn("user_id", F.lit(1)), str(tmp_path)).count() == 0


class Calls:
    """A handle and a value state that count the messages to the state store."""

    def __init__(self):
        self.n, self.value, self.timers = 0, None, set()

    def __getattr__(self, name):
        def call(*args):
            self.n += name not in ("getValueState", "getListState", "getMapState")
            match name:
                case "getValueState":
                    return self
                case "exists":
                    return self.value is not None
                case "get":
                    return self.value
                case "update":
                    self.value = args[0]
                case "clear":
                    self.value = None
                case "registerTimer":
                    self.timers.add(args[0])
                case "deleteTimer":
                    self.timers.remove(args[0])

        return call

    def getCurrentWatermarkInMs(self):
        return self.now


@pytest.mark.parametrize("processor", [stateful.Dedupe(10), stateful.TtlCache(), stateful.Completion(10, 20), stateful.Stuck({}, 10), stateful.Reorder(10)], ids=lambda p: type(p).__name__)
def test_calls_of_the_state_store_do_not_grow_with_rows_and_keys(processor):
    from pyspark.sql import Row

    store = Calls()
    values = {"write": True, "value": "x", "ttl": 5.0, "part": "p", "expected": 2, "priority": 1, "stage": "s", "state": "processing"}
    rows = [Row(key=f"k{i % 200}", at=i * 10**6, id=i, number=i // 200, **values) for i in range(2000)]
    processor.init(store)
    for store.now, batch in ((0, rows[:1000]), (1_000_000, rows[1000:]), (9_000_000, [])):
        before = store.n
        if batch:
            list(processor.handleInputRows((0,), iter(batch), store))
        else:
            list(processor.handleExpiredTimer((0,), store, None))
        assert store.n - before <= 5
    assert len(store.timers) <= 1
