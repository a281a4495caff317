"""Order of training samples: batches of like lengths, modalities apart, sources mixed in proportion, replicas' shares.

Permutations are by a hash of a seed and the id, so every scan, also one after a loss, agrees on them, and SQL can repeat them. Numbers come from
`context.ordinal`; what is sequential by nature (the even split by running load) works on one mega-batch, whose size is a parameter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.context import ordinal
from tidemark.session import stored

# Bounds beyond which audio is resampled, and the two rates.
MOST_MB, MOST_SECONDS, MOST_RATE = 10, 30, 24000
LOW_RATE, HIGH_RATE = 12000, 16000


def shuffled(row_id: Column, *seeds: object) -> Column:
    """What to sort by for a seeded permutation."""
    return F.md5(F.concat_ws(":", *(F.lit(str(s)) for s in seeds), row_id.cast("string")))


def _even(world: int, length: str, names: list[str], schema: pa.Schema):
    """One mega-batch, longest first: dealt in turn, or, where its size is a multiple of the replicas, to the one with the least load that has room."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(length, "descending"), ("_at", "ascending")])
        lengths, n = table.column(length).to_pylist(), table.num_rows
        loads, rows = [0] * world, [[] for _ in range(world)]
        for i, size in enumerate(lengths):
            if n % world:
                to = i % world
            else:
                to = min((r for r in range(world) if len(rows[r]) < n // world), key=lambda r: (loads[r], r))
            rows[to].append(i)
            loads[to] += size
        order = [i for own in rows for i in own]
        first = table.column("megabatch")[0].as_py()
        added = {
            "replica": pa.array([r for r, own in enumerate(rows) for _ in own], pa.int64()),
            "slot": pa.array([s for own in rows for s in range(len(own))], pa.int64()),
            "place": pa.array(range(first * run.size, first * run.size + n), pa.int64()),
        }
        taken = table.take(order)
        return pa.table([added[c] if c in added else taken.column(c) for c in names], names=names).cast(schema)

    return run


def length_grouped(samples: DataFrame, id_col: str, length: str, *, world: int, batch: int, seed: int = 0) -> DataFrame:
    """samples with megabatch, replica, slot and place: a seeded permutation, cut into mega-batches of world * batch samples, each split evenly between the replicas, longest first.

    place is the sample's number in the whole order: mega-batch by mega-batch, replica by replica. A mega-batch that does not divide by the replicas, the last
    one, is dealt in turn. Ties in length go by the permutation. Repeated ids are in any order among themselves; null lengths count as 0.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    size = world * batch
    rows = samples.withColumn(length, F.coalesce(length, F.lit(0)))
    at = ordinal(rows, [shuffled(F.col(id_col), seed), id_col], "_at").withColumn("megabatch", F.floor(F.col("_at") / size))
    schema = StructType([*rows.schema.fields, *at.select("megabatch").schema.fields]).add("replica", "long").add("slot", "long").add("place", "long")
    run = _even(world, length, schema.names, to_arrow_schema(schema))
    run.size = size
    return at.groupBy("megabatch").applyInArrow(run, schema)


def modality_grouped(samples: DataFrame, id_col: str, length: str, multimodal: Column, *, world: int, batch: int, seed: int = 0) -> DataFrame:
    """As length_grouped for each of two modalities, their mega-batches then in a seeded permutation; the last mega-batches of both are one at the end, by id.

    With one modality alone this is length_grouped, and the column `multimodal` tells which.
    """
    size = world * batch
    marked = samples.withColumn("multimodal", multimodal)
    sides = [length_grouped(marked.filter(test), id_col, length, world=world, batch=batch, seed=f"{seed}:{name}") for name, test in (("mm", "multimodal"), ("text", "not multimodal"))]
    both = stored(sides[0].unionByName(sides[1]), "modalities")
    last = both.groupBy("multimodal").agg(F.max("megabatch").alias("_last"))  # two rows
    if last.count() < 2:
        return both
    both = both.join(F.broadcast(last), "multimodal").withColumn("_rest", F.col("megabatch") == F.col("_last")).drop("_last")
    whole = ordinal(both.filter("not _rest").select("multimodal", "megabatch").distinct(), [shuffled(F.concat_ws(":", F.col("multimodal").cast("string"), F.col("megabatch").cast("string")), seed)], "_new")
    many = both.filter("not _rest").select("multimodal").count() // size
    full = both.filter("not _rest").join(whole, ["multimodal", "megabatch"])
    full = full.withColumns({"place": F.col("_new") * size + F.col("place") % size, "megabatch": F.col("_new")}).drop("_new")
    # at most two mega-batches
    end = both.filter("_rest").withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(id_col)) - 1)
    end = end.withColumns({"place": F.lit(many * size) + F.col("_n"), "megabatch": F.lit(many).cast("long"), "replica": F.lit(None).cast("long"), "slot": F.col("_n").cast("long")}).drop("_n")
    return full.unionByName(end).drop("_rest")


def proportional(samples: DataFrame, id_col: str, source: str, *, replicas: int, batch: int, accumulate: int = 1, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Each replica's order of samples, with the sources mixed in proportion: samples with replica and place; what is cut away is left out.

    Every source is cut to a multiple of replicas * batch * accumulate samples, in order of ids; a replica has a contiguous share of each, permuted by seed and epoch. A replica's
    places are then given out source by source, the largest first: the i-th of n samples takes the floor(i * free / n)-th of the places that are still free. The place is computed
    from i by undoing the earlier sources' choices one after the other, so nothing is iterated over samples. Sources are few (one row each is broadcast).
    """
    step = replicas * batch * accumulate
    rows = samples.filter(F.col(source).isNotNull())
    at = stored(ordinal(rows, [source, id_col], "_at"), "sources")
    sizes = at.groupBy(source).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # the number of samples of one source that each replica has
    sizes = sizes.withColumn("_own", (F.floor(F.col("_n") / step) * batch * accumulate).cast("long")).filter("_own > 0")
    every = Window.partitionBy(F.lit(0)).orderBy(F.desc("_own"), source)
    total = F.sum("_own").over(Window.partitionBy(F.lit(0)))
    free = total - F.coalesce(F.sum("_own").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_free", free).withColumn("_earlier", F.collect_list(F.struct(F.col("_free").alias("free"), F.col("_own").alias("own"))).over(every.rowsBetween(Window.unboundedPreceding, -1)))
    share = F.col("_at") - F.col("_first")
    mine = at.join(F.broadcast(sizes), source).filter(share < F.col("_own") * replicas).withColumn("replica", F.floor(share / F.col("_own")))
    order = [source, "replica", shuffled(F.col(id_col), seed, epoch), id_col]
    mine = ordinal(stored(mine.drop("_at"), "shares"), order, "_at")
    # shares are of equal size within a source, and sources follow each other by name
    by_name = Window.partitionBy(F.lit(0)).orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(source, F.coalesce(F.sum(F.col("_own") * replicas).over(by_name), F.lit(0)).alias("_before"))
    i = (F.col("_at") - F.col("_before")) % F.col("_own")
    # the products may pass 64 bits
    wide = lambda c: c.cast("decimal(19,0)")
    start = F.expr("cast(_i as decimal(19,0)) * cast(_free as decimal(19,0)) div cast(_own as decimal(19,0))")

    def undo(place: Column, step_: Column) -> Column:
        # the place-th of those that an earlier source left free, among those it chose from
        product, left = wide(place + 1) * wide(step_["free"]), wide(step_["free"] - step_["own"])
        whole = F.floor(product / left).cast("bigint")
        return _ceil_div(product, left, whole) - 1

    place = F.aggregate(F.reverse("_earlier"), F.col("_start"), undo)
    out = mine.join(F.broadcast(before), source).withColumn("_i", i).withColumn("_start", start).withColumn("place", place)
    return out.select(*samples.columns, "replica", "place")


def _ceil_div(product: Column, by: Column, guess: Column) -> Column:
    """product / by, rounded up, from a guess that decimals may have rounded."""
    near = F.array(*(guess + d for d in (-1, 0, 1, 2)))
    return F.array_min(F.filter(near, lambda q: q.cast("decimal(19,0)") * by >= product))


def strided(samples: DataFrame, order: list[str], shard: int, shards: int) -> DataFrame:
    """Every shards-th sample in order, from the shard-th on."""
    return ordinal(samples, order, "_at").filter(F.col("_at") % shards == shard).drop("_at")


def resampling(seconds: Column, size_mb: Column, rate: Column) -> Column:
    """struct<resample, rate>: audio that is long, large or finely sampled is brought to 12 kHz; other audio, and what cannot be read (nulls), stays at 16 kHz."""
    heavy = F.coalesce((size_mb > MOST_MB) | (seconds > MOST_SECONDS) | (rate > MOST_RATE), F.lit(False))
    return F.struct(heavy.alias("resample"), F.when(heavy, LOW_RATE).otherwise(HIGH_RATE).alias("rate"))
