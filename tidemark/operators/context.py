"""Rows in their context: earlier turns, previous segments, first occurrences, indexes, chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows looked at for each range when the whole table is numbered.
SAMPLED = 20


def prefix(turns: DataFrame, key: str, order: str, fields: Sequence[str], name: str = "context") -> DataFrame:
    """turns with the structs of all earlier rows of the key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn(name, F.collect_list(F.struct(*fields)).over(w))


def previous(rows: DataFrame, key: str, order: Sequence[str], text: str, n: int = 3, valid: Column | None = None, name: str = "context") -> DataFrame:
    """rows with the array of the valid texts among the n rows before; rows without any are left out."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-n, -1)
    kept = F.when(F.lit(True) if valid is None else valid, F.col(text))
    return rows.withColumn(name, F.collect_list(kept).over(w)).filter(F.size(name) > 0)


def with_previous(rows: DataFrame, key: str, order: Sequence[str], text: str, valid: Column, name: str = "before") -> DataFrame:
    """Rows with the text of the row just before, where both are valid."""
    w = Window.partitionBy(key).orderBy(*order)
    df = rows.withColumn("_ok", valid).withColumn(name, F.lag(text).over(w)).withColumn("_ok2", F.lag("_ok").over(w))
    return df.filter(F.col("_ok") & F.col("_ok2")).drop("_ok", "_ok2")


def first_seen(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    from tidemark.operators.joins import first_wins

    return first_wins(rows, keys, order)


def boundaries(rows: DataFrame, key: str, order: Sequence[str], value: str, name: str = "new_run") -> DataFrame:
    """rows with a flag where the value differs from the row before (the first row too)."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn(name, before.isNull() | ~before.eqNullSafe(F.col(value)))


def look_ahead(rows: DataFrame, key: str, order: Sequence[str], value: str, n: int = 2) -> DataFrame:
    """The runs of equal values with the values of the next n runs as next_1, next_2 ..."""
    runs = boundaries(rows, key, order, value).filter("new_run").drop("new_run")
    w = Window.partitionBy(key).orderBy(*order)
    return runs.withColumns({f"next_{i}": F.lead(value, i).over(w) for i in range(1, n + 1)})


def ordinal(rows: DataFrame, order: Sequence[str | Column], name: str, parts: Sequence[str] = ()) -> DataFrame:
    """rows with a number from 0 in the given order (over all rows, or in each part); nulls first.

    Over all rows it is counted by ranges: local numbers plus the running sum of the ranges' sizes, so that no
    single task sorts everything. A random sample only places the ranges' bounds, which are constants of the
    plan; each row's range depends on its own values alone, so that every scan, also one after a loss, agrees.
    """
    if parts:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*parts).orderBy(*order)).cast("long") - 1)
    # rows that tie are told apart by all their values, so that many equal keys do not make one range
    if not any("map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() for f in rows.schema.fields):
        order = [*order, F.xxhash64(*rows.columns)]
    key = F.struct(*((F.col(c) if isinstance(c, str) else c).alias(f"_{i}") for i, c in enumerate(order)))
    dealt = rows.withColumn("_part", _range_of(key, _bounds(rows.select(key.alias("_k")))))
    local = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.drop("_size")), "_part").withColumn(name, F.col("_n") + F.col("_before") - 1).drop("_part", "_n", "_before")


def _bounds(keys: DataFrame) -> list[Column]:
    """Distinct keys that part the table into about as many ranges as there are shuffle partitions, in order; SAMPLED for each are looked at."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = keys.orderBy(F.rand(7)).limit(SAMPLED * n).orderBy("_k").collect()
    fields = keys.schema["_k"].dataType.fields
    found = dict.fromkeys(tuple(seen[i * len(seen) // n]["_k"]) for i in range(1, n)) if seen else {}
    return [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(k, fields))) for k in found]


def _range_of(key: Column, bounds: list[Column]) -> Column:
    """How many of the bounds are not above the key, by bisection."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*bounds)
    # the key, maybe a hash of wide rows, is evaluated once and not at each step
    return F.transform(F.array(key), lambda k: _bisected(k, listed, len(bounds)))[0]


def _bisected(key: Column, listed: Column, n: int) -> Column:
    lo, hi = F.lit(0).alias("lo"), F.lit(n).alias("hi")

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        up = (at["lo"] < at["hi"]) & (F.get(listed, mid) <= key)
        return F.struct(F.when(up, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(up | (at["lo"] >= at["hi"]), at["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(n.bit_length()))
    return F.aggregate(steps, F.struct(lo, hi), halve)["lo"]


def chunked(rows: DataFrame, order: Sequence[str], size: int = 200, tail: int = 20, name: str = "chunk") -> DataFrame:
    """rows with a chunk number: chunks of `size` in order, a last one of under `tail` rows joined to the one before."""
    n = rows.count()
    chunks = max(1, -(-n // size))
    if chunks > 1 and n - (chunks - 1) * size < tail:
        chunks -= 1
    return ordinal(rows, order, "_at").withColumn(name, F.least(F.floor(F.col("_at") / size), F.lit(chunks - 1))).drop("_at")


def round_robin(rows: DataFrame, order: Sequence[str], n: int, name: str = "worker") -> DataFrame:
    return ordinal(rows, order, "_at").withColumn(name, F.col("_at") % n).drop("_at")


def even_parts(rows: DataFrame, order: Sequence[str], n: int, name: str = "worker") -> DataFrame:
    """n contiguous parts; the first ones get the remainder."""
    total = rows.count()
    base, more = divmod(total, n)
    at, edge = F.col("_at"), more * (base + 1)
    part = F.when(at < edge, F.floor(at / (base + 1))).otherwise(more + F.floor((at - edge) / max(base, 1)))
    return ordinal(rows, order, "_at").withColumn(name, part).drop("_at")


def numbered(array: Column, prefix_: Column, mark: str) -> Column:
    """array<struct<id, value>> with ids prefix_mark1, prefix_mark2 ..."""
    return F.transform(array, lambda x, i: F.struct(F.concat(prefix_, F.lit(f"_{mark}"), (i + 1).cast("string")).alias("id"), x.alias("value")))


def complete_groups(parts: DataFrame, key: str, done: Column) -> DataFrame:
    """Keys all of whose parts are done."""
    return parts.groupBy(key).agg(F.count(F.lit(1)).alias("parts"), F.count_if(done).alias("done")).filter("parts = done").select(key, "parts")


def answered(samples: DataFrame, conversations: str = "conversations") -> DataFrame:
    """Samples without an empty candidate response of the assistant."""
    return samples.filter(~F.exists(conversations, lambda t: (t["role"] == "assistant") & (F.coalesce(t["candidate_response"], F.lit("")) == "")))
