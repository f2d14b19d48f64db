import random

import pytest
from pyspark.sql import functions as F

from prepkit.operators import aggregates as a
from prepkit.operators import selection as s

ORDERS = {
    "plain": lambda: ["v", "k"],
    "down": lambda: [F.col("v").desc(), "k"],
    "nulls last": lambda: [F.col("v").asc_nulls_last(), F.col("k").desc()],
    "down, nulls first": lambda: [F.col("v").desc_nulls_first(), F.col("w").desc(), "k"],
}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(s, "NEAR_ROWS", 0)
    monkeypatch.setattr(s, "SORTED_ROWS", 20)
    monkeypatch.setattr(s, "SAMPLED_KEYS", 40)
    monkeypatch.setattr(s, "RANGES", 5)


def table(spark):
    chance = random.Random(2)
    rows = [(i, chance.choice([None, 1.5, 2.0, float("nan"), -3.0]), chance.choice([None, "a", "b", "é"])) for i in range(400)]
    rows += [(1000 + i, 9.0, "hot") for i in range(300)]
    chance.shuffle(rows)
    return spark.createDataFrame(rows, "k int, v double, w string").repartition(6).cache()


@pytest.mark.parametrize("name", ORDERS)
def test_every_depth(spark, small, name):
    df, order = table(spark), ORDERS[name]()
    want = [r["k"] for r in df.orderBy(*order).collect()]
    for first, count in ((13, 25), (395, 60), (695, 20), (5000, 5)):
        got = [r["k"] for r in s.rows_at(df, order, first, count).collect()]
        assert got == want[first : first + count], (first, count)


def test_ties_end(spark, small):
    df = spark.range(500).select(F.lit(1).alias("k"))
    assert s.rows_at(df, ["k"], 250, 10).count() == 10
    assert s.rows_at(df.limit(0), ["k"], 3, 2).count() == 0


def test_expressions_are_numbered(spark, small):
    df = spark.range(100).select(F.col("id").alias("k"))
    assert s.rows_at(df, [-F.col("k")], 50, 5) is None
    assert [r["k"] for r in a.page(df, [-F.col("k")], 10, 5).collect()] == [49, 48, 47, 46, 45]


def test_nothing_is_written_and_the_filter_reaches_the_files(spark, monkeypatch, plan):
    from prepkit.operators import row_id

    monkeypatch.setattr(row_id, "stage", lambda *_: pytest.fail("written"))
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    monkeypatch.setattr(s, "SORTED_ROWS", 5_000)
    order = ["l_orderkey", "l_linenumber"]
    deep = a.page(lines, order, 4_000, 10)
    assert "GreaterThanOrEqual(l_orderkey" in plan(deep)
    assert deep.collect() == lines.orderBy(*order).offset(40_000).limit(10).collect()
