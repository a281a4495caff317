"""Scalar functions on numbers, times, vectors and ids."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Longest duration in seconds of each tier, and its frames.
FRAME_TIERS = ((0.5, 1), (2.0, 4), (5.0, 8), (10.0, 16), (20.0, 24))
MOST_FRAMES = 32
# Weight of each criterion category; others weigh 3.
CATEGORY_WEIGHTS = {"high_priority": 5, "medium_priority": 3, "low_priority": 1, "penalty": -5}


def falsy(c: Column, kind: str) -> Column:
    """What counts as missing besides null: 0, '' or [] by kind ('number', 'string', 'array')."""
    empty = {"number": lambda: c == 0, "string": lambda: c == "", "array": lambda: F.size(c) == 0}[kind]()
    return c.isNull() | empty


def py_or(a: Column, b: Column, kind: str) -> Column:
    """a, or b where a is null or falsy."""
    return F.when(falsy(a, kind), b).otherwise(a)


def lookup(c: Column, table: Mapping[str, object], default: Column | None = None) -> Column:
    """table[c]; default (null if none is given) where c is no key."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    value = F.element_at(pairs, c)
    return value if default is None else F.coalesce(value, default)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 where b is 0 or null."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def round_exact(x: Column, digits: int) -> Column:
    """A double to some decimals (six at most), to even where its exact binary value lies half-way: what Python's formats and round() give.

    Spark rounds the shortest decimal of a double instead. Here the value is split in two parts whose products with a power of ten are exact, so
    the comparison with one half is exact, too. Values from 2**52 / 10**digits on stay as they are.
    """
    ten = F.lit(float(10**digits))

    def nearest(p: Column, whole: Column) -> Column:
        over = (p["a"] - whole - 0.5) + p["b"]
        return (whole + F.when((over > 0) | ((over == 0) & (F.pmod(whole, F.lit(2.0)) == 1)), 1.0).otherwise(0.0)) / ten

    def below(p: Column) -> Column:
        # the sum may have been rounded up to the next number
        return let(F.floor(p["a"] + p["b"]).cast("double"), lambda w: F.when((p["a"] - w) + p["b"] < 0, w - 1).otherwise(w))

    def rounded(x: Column) -> Column:
        high = let(x * 134217729.0, lambda split: split - (split - x))
        parts = let(high, lambda h: F.struct((h * ten).alias("a"), ((x - h) * ten).alias("b")))
        return F.when(F.abs(x) >= 2**52 / 10**digits, x).otherwise(let(parts, lambda p: let(below(p), lambda w: nearest(p, w))))

    return let(x, rounded)


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds, cut towards zero."""
    return (seconds * 1000).cast("bigint")


def duration_label(seconds: Column) -> Column:
    """42s, 1m05s or 2h07m."""
    whole = seconds.cast("bigint")
    h, m = F.floor(whole / 3600), F.floor(whole % 3600 / 60)
    return F.when(seconds < 60, F.format_string("%.0fs", round_exact(seconds.cast("double"), 0))).when(h > 0, F.format_string("%dh%02dm", h, m)).otherwise(F.format_string("%dm%02ds", m, whole % 60))


def size_label(n_bytes: Column) -> Column:
    """Bytes with one decimal, half-way cases to even, in the largest unit of 1024 that fits; 0 B for none."""
    units = [(1024.0**i, name) for i, name in enumerate(("B", "KB", "MB", "GB", "TB"))]
    scale, name = F.lit(units[-1][0]), F.lit(units[-1][1])
    for (size, own), (above, _) in reversed(list(zip(units, units[1:]))):
        scale, name = F.when(n_bytes < above, size).otherwise(scale), F.when(n_bytes < above, own).otherwise(name)
    return F.when(n_bytes == 0, "0 B").otherwise(F.format_string("%.1f %s", round_exact(n_bytes.cast("double") / scale, 1), name))


def category_weight(category: Column) -> Column:
    return lookup(F.coalesce(category, F.lit("medium_priority")), CATEGORY_WEIGHTS, F.lit(3))


def frame_count(duration: Column, max_frames: int) -> Column:
    out = F.when(duration <= FRAME_TIERS[0][0], FRAME_TIERS[0][1])
    for top, n in FRAME_TIERS[1:]:
        out = out.when(duration <= top, n)
    return F.least(out.otherwise(MOST_FRAMES), F.lit(max_frames))


def frame_times(start: Column, end: Column, n: Column) -> Column:
    """n times from start to end inclusive; the middle where n is 1; none where n is below 1."""
    spread = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(2)) - 1), lambda i: start + i * (end - start) / (n - 1))
    return F.when(n < 1, F.array().cast("array<double>")).when(n == 1, F.array((start + end) / 2)).otherwise(spread)


def normal_interval(start: Column, end: Column, longest: float, point: float = 5.0) -> Column:
    """struct<start, end>: swapped if reversed; one of no length becomes `point` seconds around it, from 0 on; cut to the longest; null where nothing is left."""
    a, b = F.least(start, end), F.greatest(start, end)
    lo = F.when(a == b, F.greatest(a - point / 2, F.lit(0.0))).otherwise(a)
    hi = F.least(F.when(a == b, lo + point).otherwise(b), lo + longest)
    return F.when((hi > lo) & (hi > 0), F.struct(lo.alias("start"), hi.alias("end")))


def widened_span(start: Column, end: Column, duration: Column) -> Column:
    """struct<start, end>: half the span's length more on each side, within the video."""
    half = (end - start) / 2
    return F.struct(F.greatest(start - half, F.lit(0.0)).alias("start"), F.least(end + half, duration).alias("end"))


def short_video_span(start: Column, end: Column, duration: Column) -> Column:
    """The whole video where it lasts at most 60 s."""
    short = (duration > 0) & (duration <= 60)
    return F.struct(F.when(short, 0.0).otherwise(start).alias("start"), F.when(short, duration).otherwise(end).alias("end"))


def token_cost(prompt: Column, cached: Column, output: Column, input_rate: Column, cached_rate: Column, output_rate: Column, discount: float = 1.0) -> Column:
    """USD at rates for a million tokens; cached tokens never exceed the prompt's."""
    fresh = F.greatest(prompt - cached, F.lit(0))
    return (fresh * input_rate + cached * cached_rate + output * output_rate) * (discount / 1e6)


def expired(now: Column, expires: Column, margin: float = 0.0) -> Column:
    return now >= expires - margin


def content_key(*cols: Column) -> Column:
    """sha256 of the JSON of the columns; order of arrays must be settled before."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def tempo_steps(factor: Column) -> Column:
    """A speed factor as factors from 0.5 to 2."""
    n = F.greatest(F.ceil(F.abs(F.log2(factor))), F.lit(1)).cast("int")
    step = F.when(factor > 1, 2.0).otherwise(0.5)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i < n, step).otherwise(factor / F.pow(step, n - 1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def unit_vector(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def pixel_scale(a: Column) -> Column:
    return F.transform(a, lambda x: x / 127.5 - 1)


#: The namespace of names that are URLs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version 5 UUID of a name, from its SHA-1 under a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def search_key(modalities: Column, **fields: Column) -> Column:
    """The cache key of a search: its fields by name, modalities sorted, as sha256 of JSON."""
    own = {**fields, "modalities": F.array_sort(modalities)}
    return content_key(*(own[n].alias(n) for n in sorted(own)))


def day(ts: Column) -> Column:
    """yyyy-MM-dd."""
    return F.date_format(ts, "yyyy-MM-dd")


def pretty_json(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})


def worker_segments(duration: Column, workers: int, fps: float) -> Column:
    """array<struct<worker, start, end, first_frame>>: a video in equal parts, one for each worker, with the number of each part's first frame."""
    part = duration / workers
    return F.transform(
        F.sequence(F.lit(0), F.lit(workers - 1)),
        lambda i: F.struct(i.alias("worker"), (i * part).alias("start"), F.when(i == workers - 1, duration).otherwise((i + 1) * part).alias("end"), F.floor(i * part * fps).alias("first_frame")),
    )
