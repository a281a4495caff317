"""Joins that the plain join API lacks: first match, last wins, by position, marks, resume, updates, intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key: the last by `order`. An aggregate with map-side combine, not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def first_match(left: DataFrame, right: DataFrame, on: Column, left_key: Sequence[str], order: str, take: Sequence[str]) -> DataFrame:
    """Each row of left with the columns `take` of the first row of right (by `order`) for which `on` holds, else null.

    left_key must identify the rows of left; columns of right must not clash with those of left.
    """
    best = left.join(right, on).groupBy(*left_key).agg(F.min_by(F.struct(*take), F.col(order)).alias("_hit"))
    return left.join(best, list(left_key), "left").select(*left.columns, *(F.col("_hit")[c].alias(c) for c in take))


def exact_first(left: DataFrame, right: DataFrame, on: str, order: Sequence[str | Column], take: Sequence[str]) -> DataFrame:
    """Each row of left with the columns `take` of the first row of right (by `order`) with the same text in `on`, else null. Null texts match nothing."""
    first = first_wins(right.filter(F.col(on).isNotNull()), [on], order).select(on, *take)
    return left.join(first, on, "left").select(*left.columns, *take)


def zip_join(left: DataFrame, right: DataFrame, keys: Sequence[str], pos: str = "pos", how: str = "inner") -> DataFrame:
    """Rows with equal keys and equal position."""
    return left.join(right, [*keys, pos], how)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """df with a position from 0 among the rows of each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def mark_join(df: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """df with a boolean column for each other table: does it have the row's key."""
    for name, other in others.items():
        ids = other.select(key).distinct().withColumn("_here", F.lit(True))
        df = df.join(ids, key, "left").withColumn(name, F.col("_here").isNotNull()).drop("_here")
    return df


def pending(new: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new whose keys have no result yet."""
    return new.join(done.select(*keys), list(keys), "left_anti")


def work_list(have: Sequence[DataFrame], without: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct keys that all of `have` hold and none of `without`."""
    out = have[0].select(key).distinct()
    for other in have[1:]:
        out = out.join(other.select(key), key, "left_semi")
    for other in without:
        out = out.join(other.select(key), key, "left_anti")
    return out


def update_join(base: DataFrame, changes: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str], keep: bool = True) -> DataFrame:
    """base with `values` taken from the last change of each key; with keep, values that base has (not null, not empty) stay."""
    new = last_wins(changes.select(*dict.fromkeys([*keys, *values, *order])), keys, order).drop(*(c for c in order if c not in [*keys, *values]))
    new = new.withColumnsRenamed({v: f"_new_{v}" for v in values})
    out = base.join(new, list(keys), "left")
    for v in values:
        old = F.when(F.col(v).cast("string") != "", F.col(v)) if keep else F.lit(None)
        out = out.withColumn(v, F.coalesce(old, F.col(f"_new_{v}"), F.col(v))).drop(f"_new_{v}")
    return out.select(*base.columns)


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the rows of changes put in: each column of a change that is not null replaces; new keys and columns are added."""
    new = changes.withColumnsRenamed({c: f"_new_{c}" for c in changes.columns})
    both = base.join(new, base[key] == new[f"_new_{key}"], "full")
    cols = [*base.columns, *(c for c in changes.columns if c not in base.columns)]
    pick = lambda c: F.coalesce(*(F.col(x) for x in (f"_new_{c}", c) if x in both.columns)).alias(c)
    return both.select(*(pick(c) for c in cols))


def delete_keys(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return base.join(gone.select(key), key, "left_anti")


def level(start: Column, end: Column, width: float) -> Column:
    """How often `width` has to be doubled to hold the interval."""
    longest = F.greatest(end - start, F.lit(0.0)) / width
    return F.when(longest <= 1, 0).otherwise(F.ceil(F.log2(longest))).cast("int")


def dealt(rows: DataFrame, start: Column, end: Column, width: float, levels: Sequence[int], own: str) -> DataFrame:
    """rows with their level (named `own`), _level and _bin: once for each bin that they touch of their own level and of each coarser one of `levels`.

    A bin of a level is at least as long as the level's intervals, so a row touches two bins of each, or three where the logarithm is rounded, however long it is.
    """
    rows = rows.withColumn(own, level(start, end, width))
    there = F.array(*(F.lit(x) for x in sorted(levels))).cast("array<int>")
    at = F.array_distinct(F.concat(F.array(own), F.filter(there, lambda x: x > F.col(own))))
    rows = rows.withColumn("_level", F.explode(at))
    size = width * F.pow(F.lit(2.0), "_level")
    lo, hi = F.floor(start / size), F.floor(F.greatest(start, end) / size)
    return rows.withColumn("_lo", lo).withColumn("_bin", F.explode(F.sequence(lo, hi)))


def levels(sides: Sequence[tuple[DataFrame, Column, Column]], width: float) -> list[list[int]]:
    """The levels that occur on each side, a few dozen at most; one job."""
    each = [df.select(F.lit(i).alias("side"), level(s, e, width).alias("level")) for i, (df, s, e) in enumerate(sides)]
    found = reduce(DataFrame.unionByName, each).filter("level is not null").distinct().collect()
    return [[r["level"] for r in found if r["side"] == i] for i in range(len(sides))]


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float, *, names: tuple[str, str, str, str] = ("start", "end", "o_start", "o_end"), closed: bool = False) -> DataFrame:
    """Pairs with equal keys whose intervals overlap (strictly, or with touching ends where closed).

    Both sides are dealt to bins of `width`, or of the power of two times `width` that holds an interval, so that an endless one costs a few rows. A pair
    is kept at the coarser of its two levels, in the first bin that both touch, so none appears twice. Bins make many small join keys of one
    long-running key, which a plain join on the keys does not.
    """
    ls, le, rs, re = (F.col(n) for n in names)
    over = (ls <= re) & (le >= rs) if closed else (ls < re) & (le > rs)
    l_levels, r_levels = levels([(left, ls, le), (right, rs, re)], width)
    a = dealt(left, ls, le, width, r_levels, "_l").withColumnRenamed("_lo", "_la")
    b = dealt(right, rs, re, width, l_levels, "_r").withColumnRenamed("_lo", "_ra")
    pairs = a.join(b, [*keys, "_level", "_bin"])
    return pairs.filter(over & (F.col("_level") == F.greatest("_l", "_r")) & (F.col("_bin") == F.greatest("_la", "_ra"))).drop("_bin", "_level", "_l", "_r", "_la", "_ra")
