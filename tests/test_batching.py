"""Orders of training samples against the sequential rules."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import batching

md5 = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()


def grouped(rows, world, batch, seed):
    """[(id, megabatch, replica, slot, place)] by the rule, one list after the other."""
    order = sorted(rows, key=lambda r: (md5(seed, r[0]), r[0]))
    out, place = [], 0
    for m, lo in enumerate(range(0, len(order), world * batch)):
        mega = sorted(order[lo : lo + world * batch], key=lambda r: -r[1])
        if len(mega) % world:
            chunks = [mega[i::world] for i in range(world)]
        else:
            chunks, loads = [[] for _ in range(world)], [0] * world
            for r in mega:
                to = min((i for i in range(world) if len(chunks[i]) < len(mega) // world), key=lambda i: (loads[i], i))
                chunks[to].append(r)
                loads[to] += r[1]
        for replica, chunk in enumerate(chunks):
            for slot, r in enumerate(chunk):
                out.append((r[0], m, replica, slot, place))
                place += 1
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 24, 37, 96])
def test_length_grouped(spark, n):
    rng = random.Random(n)
    rows = [(i * 3, rng.randint(1, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, n long").withColumn("slot_", F.lit("x"))
    got = batching.length_grouped(df, "id", "n", world=4, batch=3, seed=5)
    assert sorted(tuple(r) for r in got.select("id", "megabatch", "replica", "slot", "place").collect()) == grouped(rows, 4, 3, 5)
    if n >= 96:
        loads = got.filter("megabatch < 8").groupBy("megabatch").agg(F.collect_list("n").alias("all")).collect()
        assert loads and all(len(r["all"]) == 12 for r in loads)
        spread = got.groupBy("megabatch", "replica").agg(F.sum("n").alias("s")).groupBy("megabatch").agg((F.max("s") - F.min("s")).alias("d")).collect()
        assert max(r.d for r in spread) <= 50  # no more than one sample


def test_length_grouped_of_odd_rows(spark):
    rows = [(1, None), (1, 5), (None, 7), (2, 7)]
    got = batching.length_grouped(spark.createDataFrame(rows, "id long, n long"), "id", "n", world=2, batch=1, seed=0).collect()
    assert sorted(r.place for r in got) == [0, 1, 2, 3] and sorted(r.n for r in got) == [0, 5, 7, 7]


def test_modality_grouped(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 30), rng.random() < 0.6) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, n long, mm boolean")
    got = {r.id: r for r in batching.modality_grouped(df, "id", "n", F.col("mm"), world=2, batch=4).collect()}
    assert sorted(r.place for r in got.values()) == list(range(100))
    sides = {kind: grouped([(i, n) for i, n, mm in rows if mm == kind], 2, 4, f"0:{name}") for kind, name in ((True, "mm"), (False, "text"))}
    whole, rest = [], []
    for kind, side in sides.items():
        last = max(r[1] for r in side)
        rest += [r[0] for r in side if r[1] == last]
        whole += [(md5(0, f"{str(kind).lower()}:{m}"), sorted((r for r in side if r[1] == m), key=lambda r: r[4])) for m in range(last)]
    want = [r[0] for _, mega in sorted(whole) for r in mega] + sorted(rest)
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1].place)] == want
    one = batching.modality_grouped(df.filter("mm"), "id", "n", F.col("mm"), world=2, batch=4)
    assert sorted(tuple(r) for r in one.select("id", "megabatch", "replica", "slot", "place").collect()) == sides[True]


def mixed(rows, replicas, batch, accumulate, seed, epoch):
    """[(id, replica, place)] by lists of free places."""
    by = {}
    for i, source in sorted(rows):
        by.setdefault(source, []).append(i)
    out = []
    own = {s: len(ids) // (replicas * batch * accumulate) * batch * accumulate for s, ids in by.items()}
    for replica in range(replicas):
        free = list(range(sum(own.values())))
        for s in sorted(by, key=lambda s: (-own[s], s)):
            mine = sorted(by[s][replica * own[s] : (replica + 1) * own[s]], key=lambda i: md5(seed, epoch, i))
            taken = [free[i * len(free) // len(mine)] for i in range(len(mine))]
            out += [(i, replica, p) for i, p in zip(mine, taken, strict=True)]
            free = [p for p in free if p not in set(taken)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_proportional(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaaaaaabbbccd")) for i in range(rng.choice([60, 211, 400]))]
    df = spark.createDataFrame([*rows, (10_000, None)], "id long, source string")
    got = batching.proportional(df, "id", "source", replicas=3, batch=2, accumulate=2, seed=seed, epoch=4)
    assert sorted(tuple(r) for r in got.select("id", "replica", "place").collect()) == mixed(rows, 3, 2, 2, seed, 4)


def test_proportional_of_few(spark):
    none = spark.createDataFrame([], "id long, source string")
    assert batching.proportional(none, "id", "source", replicas=2, batch=2).count() == 0
    few = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, source string")
    assert batching.proportional(few, "id", "source", replicas=2, batch=2).count() == 0
    equal = [(i, "ab"[i % 2]) for i in range(16)]
    got = batching.proportional(spark.createDataFrame(equal, "id long, source string"), "id", "source", replicas=2, batch=2)
    assert sorted(tuple(r) for r in got.select("id", "replica", "place").collect()) == mixed(equal, 2, 2, 1, 0, 0)


def test_shards_and_rates(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id long")
    assert [r.id for r in batching.strided(df, ["id"], 1, 4).orderBy("id").collect()] == [1, 5, 9]
    rows = spark.createDataFrame([(31.0, 1.0, 16000), (3.0, 11.0, 16000), (3.0, 1.0, 44100), (30.0, 10.0, 24000), (None, None, None)], "s double, mb double, r int")
    assert [tuple(r.x) for r in rows.select(batching.resampling(F.col("s"), F.col("mb"), F.col("r")).alias("x")).collect()] == [(True, 12000)] * 3 + [(False, 16000)] * 2
