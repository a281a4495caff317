"""Keyed state machines on streams: expiring caches, completion, stuck work, frames in order. All state leaves by a timer.

Processors by event time build on `InOrder`: rows wait until the watermark has passed them and are then
taken in order of time, so the result does not depend on how a stream falls into batches. They end with `once`, as their timers fire when the
watermark moves. Processors by the clock (`LiveCache`, `LiveStuck`) act on arrival and suit a stream that runs on.

Processors by event time keep the state of a bucket of keys as one value with one timeout. `stateful` runs them by `applyInPandasWithState`, in which a bucket's
rows are a slice of an Arrow batch and its state comes and goes beside them: no row is an object before a processor takes it, and no call of the state store is a
message between processes. A bucket's state and the rows that it takes from a batch are held in memory, and so is what the buckets of a partition keep after a
batch: choose `buckets` by the number of keys. The watermark's column has to lie before the year 2262, or the stream fails.

Rows carry `at`, microseconds since the epoch, beside the column of the watermark. A key's waiting rows are bounded by the watermark's
delay; what else is kept of a key is stated by each processor.
"""

from __future__ import annotations

import pickle
from collections.abc import Generator, Iterator, Mapping
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A commit then writes one file of changes; whole copies of the state follow in the background.
_CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
#: Marks the watermark's column in a schema.
_DELAY = "spark.watermarkDelayMs"
_NUMBERS = {"long": int, "double": float}
#: Buckets of keys of a processor by event time.
BUCKETS = 1024


def stateful(rows: DataFrame, key: str, processor: StatefulProcessor, output: str, *, live: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """The processor's output rows; by event time (rows are a stream with a watermark), or by the clock where live. State lies in RocksDB, on disk where it is large."""
    rows.sparkSession.conf.set(_STORE, _ROCKSDB)
    rows.sparkSession.conf.set(_CHANGES, "true")
    if isinstance(processor, Bucketed):
        rows = rows.withColumnRenamed(key, "key")
        clock = [f.name for f in rows.schema if _DELAY in f.metadata and f.name not in ("key", *processor.names)]
        # numbers go as text, as pandas has no integers beside nulls and no nulls beside NaN
        fields = [F.col(n).cast(k).cast("string").alias(n) if k in _NUMBERS else F.col(n) for n, k in processor.kinds.items()]
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("_bucket")
        grouped = rows.select(bucket, *clock, "key", *fields).groupBy("_bucket")
        return grouped.applyInPandasWithState(Frames(processor).handle, output, Frames.STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return rows.groupBy(key).transformWithState(processor, output, "Append", "ProcessingTime" if live else "EventTime")


def timed(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    """rows with a watermark on ts and `at` in microseconds; rows later than the delay are dropped."""
    return rows.withColumn("at", F.unix_micros(F.col(ts).cast("timestamp"))).withWatermark(ts, delay)


def _up(micros: int) -> int:
    """The first millisecond not before."""
    return -(-micros // 1000)


class Bucketed(StatefulProcessor):
    """Keeps what there is of each key of a bucket as a dict, empty if nothing is, and its waiting rows. `take` handles a key's rows, new or none, at a watermark.

    row: the DDL of the input's columns without the key's and the watermark's. OUTPUT: that of the rows that `take` yields, key first.
    `stateful` runs it by `Frames`; by itself it is a processor of rows for `transformWithState`.
    """

    OUTPUT: str

    def __init__(self, row: str):
        self.kinds = dict(c.split() for c in row.split(","))
        self.names = list(self.kinds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "timer long, keys binary")
        self.make = Row(*(c.split()[0] for c in self.OUTPUT.split(",")))

    def take(self, key, kept: dict, rows: list[tuple], now: int) -> Iterator[tuple]:
        """Changes `kept` and `rows` to what stays after the watermark `now` (microseconds)."""
        raise NotImplementedError

    def until(self, kept: dict, rows: list[tuple]) -> int | None:
        """When the key has to be looked at again if no row comes."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict = {}
        pick = None
        for row in rows:
            pick = pick or itemgetter(*(row.__fields__.index(n) for n in ("key", *self.names)))
            owner, *values = pick(tuple(row))
            new.setdefault(owner, []).append(tuple(values))
        yield from (self.make(*out) for out in self.told(new, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from (self.make(*out) for out in self.told({}, timerValues))

    def told(self, new: Mapping, timerValues) -> Iterator[tuple]:
        """What all keys of the bucket tell, with new rows of some of them, as (key, ...)."""
        timer, packed = self.state.get() if self.state.exists() else (None, None)
        due, stay = yield from self.turn(packed, new, timerValues.getCurrentWatermarkInMs())
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if stay:
            self.state.update((due, stay))
        elif packed:
            self.state.clear()

    def turn(self, packed: bytes | None, new: Mapping, watermark: int) -> Generator[tuple, None, tuple[int | None, bytes | None]]:
        """What all keys of the bucket tell at a watermark (milliseconds), as above; then when it has to be looked at again and what is kept of it, if anything is."""
        now = watermark * 1000
        keys = pickle.loads(packed) if packed else {}
        for owner, rows in new.items():
            keys.setdefault(owner, ({}, []))[1].extend(rows)
        stay, first = {}, None
        for owner, (kept, rows) in keys.items():
            for out in self.take(owner, kept, rows, now):
                yield owner, *out
            if kept or rows:
                stay[owner] = (kept, rows)
                until = self.until(kept, rows)
                if until is not None and (first is None or until < first):
                    first = until
        return None if first is None else _up(first), pickle.dumps(stay, pickle.HIGHEST_PROTOCOL) if stay else None

    def close(self) -> None:
        pass


class Frames:
    """A `Bucketed` on pandas frames of (bucket, watermark's column, key, its row with numbers as text)."""

    STATE = "keys binary"

    def __init__(self, processor: Bucketed):
        self.processor = processor

    def handle(self, key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new: dict = {}
        for frame in frames:  # an empty one where the time is out
            columns = [self._values(frame[name].tolist(), kind) for name, kind in self.processor.kinds.items()]
            for owner, values in zip(frame["key"].tolist(), zip(*columns, strict=True), strict=True):
                new.setdefault(owner, []).append(values)
        packed, watermark = state.get[0] if state.exists else None, state.getCurrentWatermarkMs()
        due, stay = yield from self._framed(self.processor.turn(packed, new, watermark))
        if stay:
            state.update((stay,))
            if due is not None:
                # a timeout is over when the watermark is past it, a time of `until` when it is reached; Spark takes none before the watermark
                state.setTimeoutTimestamp(max(due - 1, watermark, 1))
        elif packed:
            state.remove()

    def _values(self, column: list, kind: str) -> list:
        parse = _NUMBERS.get(kind)
        return [None if x is None else parse(x) for x in column] if parse else column

    def _framed(self, told: Generator) -> Generator:
        """Frames of what is told, with columns of objects, so that numbers and nulls stay what they are; then what `told` returns."""
        names, rows = [c.split()[0] for c in self.processor.OUTPUT.split(",")], []
        while True:
            try:
                rows.append(next(told))
            except StopIteration as end:
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                return end.value


class InOrder(Bucketed):
    """Takes a key's rows in order of (at, tie) once the watermark has passed them; `step` handles a row, `due` what a time brings.

    row: as above; the first two columns are `at` and the tie.
    """

    def step(self, kept: dict, row: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def due(self, kept: dict, now: int) -> Iterator[tuple]:
        """Called with the watermark (microseconds) after the rows up to it."""
        return iter(())

    def end(self, kept: dict) -> int | None:
        """The first watermark at which `due` has something to do."""
        raise NotImplementedError

    def take(self, key, kept, rows, now):
        rows.sort(key=lambda r: r[:2])
        ready = sum(r[0] <= now for r in rows)
        for row in rows[:ready]:
            yield from self.step(kept, row)
        del rows[:ready]
        yield from self.due(kept, now)

    def until(self, kept, rows):
        return min((x for x in (self.end(kept) if kept else None, rows[0][0] if rows else None) if x is not None), default=None)


class Dedupe(InOrder):
    """The first row of each key, and again the first one `within` seconds or more after the one kept last: (key, id, at). What stays is the keys of that time."""

    OUTPUT = "key string, id long, at long"

    def __init__(self, within: float):
        super().__init__("at long, id long")
        self.within = round(within * 1e6)

    def step(self, kept, row):
        at, number = row
        if not kept or at - kept["at"] >= self.within:
            kept["at"] = at
            yield number, at

    def due(self, kept, now):
        if kept and kept["at"] + self.within <= now:
            kept.clear()
        return iter(())

    def end(self, kept):
        return kept["at"] + self.within


class TtlCache(InOrder):
    """Reads and writes of one entry for each key: (key, id, hit, value) of every read.

    Rows: at, id, write (boolean), value, ttl (seconds; null: for ever). An entry is gone from the time at which it expires on; its state leaves then, so
    what stays is one entry for each key that was written within its time to live.
    """

    OUTPUT = "key string, id long, hit boolean, value string"

    def __init__(self):
        super().__init__("at long, id long, write boolean, value string, ttl double")

    def step(self, kept, row):
        at, number, write, new, ttl = row
        if write:
            kept["entry"] = new, None if ttl is None else at + round(ttl * 1e6)
        else:
            value, expires = kept.get("entry", (None, 0))
            hit = expires is None or expires > at
            yield number, hit, value if hit else None

    def due(self, kept, now):
        end = self.end(kept) if kept else None
        if end is not None and end <= now:
            kept.clear()
        return iter(())

    def end(self, kept):
        return kept["entry"][1]


class Completion(InOrder):
    """Tells of each key once: (key, state, parts, expected, priority, at), state `complete` when as many distinct parts as expected have come, `incomplete` when they have not within `patience` seconds.

    Rows: at, id, part, expected, priority. The parts of a key are forgotten when it is told; the mark that it was leaves after `keep` seconds, so what stays is
    the keys of that time.
    """

    OUTPUT = "key string, state string, parts long, expected long, priority long, at long"

    def __init__(self, patience: float, keep: float):
        super().__init__("at long, id long, part string, expected long, priority long")
        self.patience, self.keep = round(patience * 1e6), round(keep * 1e6)

    def _tell(self, kept, state, at):
        parts, expected, priority, _ = kept.pop("progress")
        kept["told"] = at
        yield state, len(parts), expected, priority, at

    def due(self, kept, now):
        """What has run out before `now`."""
        if "progress" in kept:
            first = kept["progress"][3]
            if first + self.patience < now:
                yield from self._tell(kept, "incomplete", first + self.patience)
        if "told" in kept and kept["told"] + self.keep < now:
            del kept["told"]

    def step(self, kept, row):
        at, _, part, expected, priority = row
        yield from self.due(kept, at)
        if "told" in kept:
            return
        parts, most, least, first = kept.get("progress", (set(), 0, priority, at))
        parts.add(part)
        expected = max(most, expected)
        kept["progress"] = parts, expected, min(least, priority), first
        if len(parts) >= expected:
            yield from self._tell(kept, "complete", at)

    def end(self, kept):
        return 1 + (kept["progress"][3] + self.patience if "progress" in kept else kept["told"] + self.keep)


class Stuck(InOrder):
    """Work that stays in a stage for longer than its limit: (key, stage, state, since, at), failed at the moment the limit is passed, without another row.

    Rows: at, id, stage, state. A row with state `processing` starts a stage, any other ends it. What stays of a key is its current stage, until then.
    """

    OUTPUT = "key string, stage string, state string, since long, at long"

    def __init__(self, limits: Mapping[str, float], default: float = 3600.0):
        super().__init__("at long, id long, stage string, state string")
        self.limits, self.default = {k: round(v * 1e6) for k, v in limits.items()}, round(default * 1e6)

    def _limit(self, kept):
        stage, since = kept["current"]
        return since + self.limits.get(stage, self.default)

    def due(self, kept, now):
        if kept and now > self._limit(kept):
            limit, (stage, since) = self._limit(kept), kept.pop("current")
            yield stage, "failed", since, limit

    def step(self, kept, row):
        at, _, stage, state = row
        yield from self.due(kept, at)
        kept.clear()
        if state == "processing":
            kept["current"] = stage, at

    def end(self, kept):
        return self._limit(kept) + 1


class Reorder(Bucketed):
    """Frames in order of their number from 0 on, each once: (key, place, number, value); place counts what was released.

    Rows: at, number, value. A frame is released when all before it were; one that is missing is given up when the watermark is `patience` seconds past
    the first frame behind it. Frames come again (at the seams of segments, say) are dropped by number, so no set of seen frames is kept; what stays is the frames behind a gap.
    """

    OUTPUT = "key string, place long, number long, value string"

    def __init__(self, patience: float):
        super().__init__("at long, number long, value string")
        self.patience = round(patience * 1e6)

    def take(self, key, kept, rows, now):
        number, place = kept.get("front", (0, 0))
        behind = kept.get("behind", {})
        for at, n, value in sorted(rows, key=lambda r: (r[1], r[0])):
            if n >= number and n not in behind:
                behind[n] = value, at
        rows.clear()
        given_up = -1
        # first what follows without a gap, which may end the wait of what stood behind it
        for last in (False, True):
            if last:
                given_up = max((n for n, (_, at) in behind.items() if at + self.patience <= now), default=-1)
            for n in sorted(behind):
                if n != number and n > given_up:
                    break
                yield place, n, behind.pop(n)[0]
                number, place = n + 1, place + 1
        kept["front"] = number, place
        if behind:
            kept["behind"] = behind
        else:
            kept.pop("behind", None)

    def until(self, kept, rows):
        return min((at + self.patience for _, at in kept.get("behind", {}).values()), default=None)


class LiveCache(StatefulProcessor):
    """By the clock: (key, value, hit) of (key, value) in order of arrival; was a value of the key written less than the time to live ago. State leaves by itself then."""

    OUTPUT = "key string, value string, hit boolean"

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.value = handle.getValueState("value", "value string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        hit, last = self.value.exists(), None
        for row in rows:
            yield Row(key=key[0], value=row.value, hit=hit)
            hit, last = True, row.value
        self.value.update((last,))

    def close(self):
        pass


class LiveStuck(StatefulProcessor):
    """By the clock: (key, stage, state, since) of work whose stage is not ended within its limit after arrival; fails by a timer, with no new input."""

    OUTPUT = "key string, stage string, state string, since long"

    def __init__(self, limits: Mapping[str, float], default: float = 3600.0):
        self.limits, self.default = dict(limits), default

    def init(self, handle):
        self.handle = handle
        self.current = handle.getValueState("current", "stage string, since long, until long")

    def handleInputRows(self, key, rows, timerValues):
        now, last = timerValues.getCurrentProcessingTimeInMs(), None
        for row in rows:
            last = row
        if last.state == "processing":
            until = now + round(self.limits.get(last.stage, self.default) * 1000)
            self.current.update((last.stage, now, until))
            self.handle.registerTimer(until)
        elif self.current.exists():
            self.current.clear()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.current.exists():
            stage, since, until = self.current.get()
            if until <= expiredTimerInfo.getExpiryTimeInMs():
                self.current.clear()
                yield Row(key=key[0], stage=stage, state="failed", since=since)

    def close(self):
        pass
