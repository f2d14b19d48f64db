import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prepkit.operators import changes


def plain(old, new):
    """The changes of two dictionaries of key -> (a, b)."""
    out = []
    for k in {*old, *new}:
        if k not in new:
            out.append((k, "removed", None, None, None))
        elif k not in old:
            out.append((k, "added", None, None, None))
        else:
            out += [(k, "changed", n, *(None if x is None else str(x) for x in (a, b))) for n, a, b in zip("ab", old[k], new[k]) if a != b]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], "k bigint, a bigint, b string")


values = st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.sampled_from(["", "x"])))
tables = st.dictionaries(st.one_of(st.none(), st.integers(0, 5)), values, max_size=5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tables, tables)
def test_small_tables(spark, rows, old, new):
    assert rows(changes.cell_changes(frame(spark, old), frame(spark, new), ["k"])) == plain(old, new)


def test_descent(spark, rows):
    """Splitting further gives the same rows and leaves fewer to look at."""
    old = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("a"), F.lit("x").alias("b"))
    new = old.withColumn("b", F.when(F.col("k") % 4000 == 3, "y").otherwise(F.col("b"))).select("b", "a", "k")
    want = [(k, "changed", "b", "x", "y") for k in range(3, 40_000, 4000)]
    assert rows(changes.cell_changes(old, new, ["k"], rows_at_once=0)) == sorted(want, key=repr)
    both = changes._versions(old, new.select("k", "a", "b"), ["k"], ["a", "b"])
    first = changes.differing_ranges(both, 0)
    n = [first.agg(F.sum("n")).first()[0], changes.differing_ranges(changes._within(both, first, 0), 1).agg(F.sum("n")).first()[0]]
    assert 20 <= n[1] <= 24 and n[1] < n[0] < 500


def test_repeated_keys_and_swapped_nulls(spark, rows):
    old = spark.createDataFrame([(1, 5, None), (1, 5, None), (2, None, 4)], "k int, a int, b int")
    new = spark.createDataFrame([(1, 5, None), (2, 4, None)], "k int, a int, b int")
    assert rows(changes.cell_changes(old, new, ["k"])) == sorted(
        [(1, "removed", None, None, None), (2, "changed", "a", None, "4"), (2, "changed", "b", "4", None)], key=repr)


def test_keys_only_and_wrong_input(spark, rows):
    one, two = spark.range(3), spark.range(1, 4)
    assert rows(changes.cell_changes(one, two, ["id"])) == [(0, "removed", None, None, None), (3, "added", None, None, None)]
    assert rows(changes.cell_changes(one, one, ["id"])) == []
    with pytest.raises(ValueError):
        changes.cell_changes(one, one.selectExpr("cast(id as int) id"), ["id"])
    with pytest.raises(ValueError):
        changes.cell_changes(one, one, [])
