"""Time-stamped segments: gaps, silence, fixed windows, caption splitting and merging."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

GAP = 5.0
CLIP = 10.0


def close_gaps(segments: DataFrame, key: str, order: Sequence[str] = ("start",), gap: float = GAP) -> DataFrame:
    """Gaps below `gap` vanish (the segment starts where the one before ends); longer ones become rows of kind 'silent'.

    segments: key, start, end, kind and others; each segment is compared with the one just before it.
    """
    before = F.lag("end").over(Window.partitionBy(key).orderBy(*order))
    rest = [c for c in segments.columns if c not in (key, "start", "end", "kind")]
    df = segments.withColumn("_before", before).withColumn("_gap", F.col("start") - F.col("_before"))
    own = F.struct(F.when((F.col("_gap") > 0) & (F.col("_gap") < gap), F.col("_before")).otherwise(F.col("start")).alias("start"), F.col("end"), F.col("kind"), *rest)
    empty = [F.lit(None).cast(segments.schema[c].dataType).alias(c) for c in rest]
    silent = F.struct(F.col("_before").alias("start"), F.col("start").alias("end"), F.lit("silent").alias("kind"), *empty)
    rows = F.when(F.col("_gap") >= gap, F.array(silent, own)).otherwise(F.array(own))
    return df.select(key, F.explode(rows).alias("_s")).select(key, "_s.*").select(*segments.columns)


def silences(speech: DataFrame, videos: DataFrame, key: str, gap: float = GAP) -> DataFrame:
    """(key, start, end) of the stretches of at least `gap` without speech: before, between, behind; all of a video without any.

    videos: key, duration.
    """
    w = Window.partitionBy(key).orderBy("start", "end")
    s = speech.select(key, "start", "end").withColumn("next", F.lead("start").over(w)).withColumn("first", F.row_number().over(w) == 1)
    s = s.join(videos.select(key, "duration"), key)
    parts = F.array(F.when(F.col("first"), F.struct(F.lit(0.0).alias("s"), F.col("start").alias("e"))), F.struct(F.col("end").alias("s"), F.coalesce("next", "duration").alias("e")))
    inner = s.select(key, F.explode(parts).alias("x")).select(key, F.col("x.s").alias("start"), F.col("x.e").alias("end")).filter(F.col("end") - F.col("start") >= gap)
    silent = videos.join(speech.select(key), key, "left_anti").select(key, F.lit(0.0).alias("start"), F.col("duration").cast("double").alias("end"))
    return inner.unionByName(silent)


def largest_gap(segments: DataFrame, key: str) -> DataFrame:
    """(key, first_start, last_end, any_negative, largest_gap): gaps between neighbours, 0 at least."""
    nxt = F.lead("start").over(Window.partitionBy(key).orderBy("start", "end"))
    return segments.withColumn("_gap", nxt - F.col("end")).groupBy(key).agg(
        F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.bool_or((F.col("start") < 0) | (F.col("end") < 0)).alias("any_negative"), F.greatest(F.coalesce(F.max("_gap"), F.lit(0)), F.lit(0)).alias("largest_gap")
    )


def clip_windows(videos: DataFrame, duration: str, width: float = CLIP, least: float = 0.5) -> DataFrame:
    """videos with clip, clip_start, clip_end: floor(d / width) windows and one more where over 1 s is left; too short ones left out."""
    d = F.col(duration).cast("double")
    n = (F.floor(d / width) + F.when(d % width > 1, 1).otherwise(0)).cast("int")
    df = videos.filter(n > 0).withColumn("clip", F.explode(F.sequence(F.lit(0), n - 1)))
    df = df.withColumn("clip_start", F.col("clip") * width).withColumn("clip_end", F.least(F.col("clip_start") + width, d))
    return df.filter(F.col("clip_end") - F.col("clip_start") >= least)


def audio_windows(duration: Column, width: float = 30.0, most: int = 20) -> Column:
    """array<struct<start, end>>: consecutive windows, the last cut, `most` at the most."""
    n = F.least(F.ceil(duration / width), F.lit(most)).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct((i * width).alias("start"), F.least((i + 1) * width, duration).alias("end")))
    return F.when(n >= 1, rows).otherwise(F.slice(rows, 1, 0))


def spread_pieces(pieces: DataFrame, keys: Sequence[str], order: str, least: float = 1.0) -> DataFrame:
    """pieces (text, start, end of the whole) with piece_start, piece_end: time by characters, at least `least` s, within the whole.

    The running end is clamped; as clamping is monotone, it is a clamped running sum.
    """
    whole = Window.partitionBy(*keys)
    run = whole.orderBy(order)
    n = F.length("text")
    per_char = F.greatest((F.col("end") - F.col("start")) / F.sum(n).over(whole), F.lit(1.0) / F.count(F.lit(1)).over(whole))
    df = pieces.withColumn("_d", F.greatest(n * per_char, F.lit(least)))
    sums = lambda to: F.coalesce(F.sum("_d").over(run.rowsBetween(Window.unboundedPreceding, to)), F.lit(0.0))
    df = df.withColumn("piece_start", F.least(F.col("start") + sums(-1), F.col("end")))
    df = df.withColumn("piece_end", F.when(F.lead(order).over(run).isNull(), F.col("end")).otherwise(F.least(F.col("start") + sums(0), F.col("end"))))
    return df.drop("_d")


def merge_short(segments: DataFrame, key: str, least: float = 1.0, least_chars: int = 20) -> DataFrame:
    """(key, id, start, end, text): a short segment absorbs exactly the next one; what it makes is not looked at again.

    segments: key, start, end, text, pos (order among equal starts). After a segment that is not short the next one is never absorbed,
    and in a run of short ones every other is, so a segment's place behind the last one that is not short tells what becomes of it.
    """
    order = Window.partitionBy(key).orderBy("start", "pos")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    df = segments.select(key, F.col("start").cast("double"), F.col("end").cast("double"), "text", "pos", plain.alias("_plain")).withColumn("_i", F.row_number().over(order))
    df = df.withColumn("_short", (F.col("end") - F.col("start") < least) | (F.length("_plain") < least_chars))
    long_before = F.max(F.when(~F.col("_short"), F.col("_i"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_stays", (F.col("_i") - F.coalesce(long_before, F.lit(0))) % 2 == 1)
    df = df.withColumns({"_next_end": F.lead("end").over(order), "_next": F.lead("_plain").over(order)}).filter("_stays")
    pair = F.col("_short") & F.col("_next").isNotNull()
    text = F.when(pair, F.regexp_replace(F.concat_ws(" ", "_plain", "_next"), r"^\s+|\s+$", "")).otherwise(F.col("text"))
    return df.select(key, (F.row_number().over(order) - 1).cast("long").alias("id"), "start", F.when(pair, F.col("_next_end")).otherwise(F.col("end")).alias("end"), text.alias("text"))


def nearest_frames(targets: DataFrame, frames: DataFrame, key: str, tolerance: float = 0.2) -> DataFrame:
    """(key, target, frame): frames in order, each taken if within tolerance of the current target, which then moves on.

    A target that no frame meets therefore ends the matching of its key. Both sides come as one sorted stream, each target where the first frame may stand
    that meets it; what is held of a key is the targets within tolerance of the current frame.
    """
    kind = targets.schema[key].dataType
    names = [key, "target", "frame"]
    schema = pa.schema([pa.field(key, to_arrow_type(kind)), pa.field("target", pa.float64()), pa.field("frame", pa.float64())])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, waiting, over = None, deque(), False
        for batch in batches:
            for own, value, is_frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (own,):
                    last, over = (own,), False
                    waiting.clear()
                if over:
                    continue
                if not is_frame:
                    waiting.append(value)
                elif waiting and abs(value - waiting[0]) <= tolerance:
                    yield own, waiting.popleft(), value
                elif waiting and value > waiting[0]:
                    over = True
                    waiting.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = matched(batches)
        while held := list(islice(pairs, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], names=names)

    # a little earlier than where the first frame may stand, as differences are rounded
    first = F.col("target") - tolerance - F.abs(F.col("target")) * 1e-12 - 1e-9
    left = targets.select(key, F.col("target").cast("double").alias("target")).filter("target is not null").select(key, F.col("target").alias("_v"), F.lit(False).alias("_frame"), first.alias("_at"))
    right = frames.select(key, F.col("frame").cast("double").alias("_v"), F.lit(True).alias("_frame")).filter("_v is not null").withColumn("_at", F.col("_v"))
    events = left.unionByName(right).repartition(key).sortWithinPartitions(key, "_at", "_frame", "_v").select(key, "_v", "_frame")
    return events.mapInArrow(run, f"{key} {kind.simpleString()}, target double, frame double")
