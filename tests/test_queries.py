import pytest

from tests.compare import connect, same
from tidemark.plans.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, name):
    same(QUERIES[name](spark, small), connect(small), SQL[name])


def test_every_query_runs(spark, small):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, small).count() > 0, name


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["overall", "overall_of_rounded", "samples"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_merge_short_is_the_sequential_rule(spark, small):
    ev = spark.read.parquet(f"{small}/events.parquet").selectExpr("user_id", "unix_micros(cast(ts as timestamp)) / 1e6 as s", "event_id", "event_type").collect()
    users = {}
    for r in ev:
        users.setdefault(r["user_id"], []).append((r["s"], r["event_id"], r["s"] + r["event_id"] % 3, r["event_type"] * 4))
    want = set()
    for u, rows in users.items():
        rows.sort()
        n = i = 0
        while i < len(rows):
            s, _, e, text = rows[i]
            i += 1
            if (e - s < 1 or len(text) < 20) and i < len(rows):
                e, text, i = rows[i][2], text + " " + rows[i][3], i + 1
            want.add((u, n, round(s, 3), round(e, 3), text))
            n += 1
    got = {tuple(r) for r in QUERIES["merge_short"](spark, small).select("user_id", "id", "start", "end", "text").collect()}
    assert {(a, b, e) for a, b, _, _, e in got} == {(a, b, e) for a, b, _, _, e in want}
