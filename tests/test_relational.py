import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.operators import aggregates as a
from prepkit.operators import filters as f
from prepkit.operators import joins as j
from prepkit.operators.row_id import with_row_id
from prepkit.operators.types import common_type
from prepkit.operators.union import union_relaxed

KEYS = st.lists(st.one_of(st.none(), st.integers(0, 4)), max_size=12)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, keys, name):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k bigint, {name} bigint")


# ---- filters


def test_filters(spark, rows):
    df = spark.createDataFrame([(1, "Ab", 1.0), (2, None, float("nan")), (None, "b", None)], "i int, s string, d double")
    assert rows(f.equals(df, "i", 1).select("i")) == [(1,)]
    assert df.where(f.equals_ignore_case("s", "aB")).count() == 1
    assert df.where(f.equals_ignore_case("s", "")).count() == 1
    assert f.drop_null_rows(df, ["i", "d"]).count() == 2  # NaN stays
    assert f.drop_null_rows(df).count() == 1


def test_search(spark):
    df = spark.createDataFrame([(5.0, "X"), (0.5, "50"), (None, None)], "d double, s string")
    assert f.search(df, ["d", "s"], "5.0").count() == 0
    assert f.search(df, ["d", "s"], "5").count() == 2
    assert f.search(df, ["s"], "x").count() == 1
    assert f.search(df, ["s"], "").count() == f.search(df, ["s"], None).count() == 3


# ---- joins against a nested loop in Python


def brute_left(left, right):
    out = []
    for k, l in left:
        found = [r for rk, r in right if rk is not None and rk == k]
        out += [(k, l, r) for r in found] or [(k, l, None)]
    return sorted(out, key=repr)


@FEW
@given(KEYS, KEYS)
def test_joins_match_brute_force(spark, left, right):
    l, r = frame(spark, left, "l"), frame(spark, right, "r")
    ls, rs = [(k, i) for i, k in enumerate(left)], [(k, i) for i, k in enumerate(right)]
    known = {k for k in right if k is not None}
    got = sorted((tuple(x) for x in j.left_join(l, r, ["k"]).collect()), key=repr)
    assert got == brute_left(ls, rs)
    semi = sorted(x["l"] for x in j.semi_join(l, r, ["k"]).collect())
    anti = sorted(x["l"] for x in j.anti_join(l, r, ["k"]).collect())
    assert semi == [i for k, i in ls if k in known]
    assert anti == [i for k, i in ls if k not in known]
    inner = sorted(tuple(x) for x in j.inner_join(l, r, ["k"]).collect())
    assert inner == sorted(x for x in brute_left(ls, rs) if x[2] is not None)
    metrics = dict(a.fanout(l, r, "k", "k").collect())
    assert metrics["rows_in"] == len(left) and metrics["rows_out"] == len(got)
    report = dict(a.reconcile(l, r, "k", "k").collect())
    assert report == {
        "left_rows": len(left), "right_rows": len(right), "left_keys": len(set(left)), "right_keys": len(set(right)),
        "matched_keys": len(known & set(left)), "left_only_rows": len(anti),
    }


def test_reports_on_several_keys(spark):
    left = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (1, 1)], "a int, b int")
    right = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, 2)], "c int, d int")
    assert dict(a.reconcile(left, right, ["a", "b"], ["c", "d"]).collect()) == {
        "left_rows": 4, "right_rows": 4, "left_keys": 3, "right_keys": 3, "matched_keys": 1, "left_only_rows": 2
    }
    joined = j.left_join(left, right, [("a", "c"), ("b", "d")]).count()
    assert dict(a.fanout(left, right, ["a", "b"], ["c", "d"]).collect()) == {
        "rows_in": 4, "rows_out": joined, "rows_added": joined - 4, "keys_with_several_matches": 1
    }


def test_left_join_with_a_frequent_right_key(spark):
    left = spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").alias("l"))
    right = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("k"), F.col("id").alias("r"))
    joined, plain = j.left_join(left, right, ["k"]), left.join(right, "k", "left")
    assert joined.exceptAll(plain).count() == 0 and plain.exceptAll(joined).count() == 0


def test_frequent_left_key_in_semi_and_anti_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("k"))
    for known in ([7, 9], [9]):
        right = spark.createDataFrame([(k,) for k in known], "r bigint")
        ones = left.where(F.col("k").isin(known)).count()
        assert j.semi_join(left, right, [("k", "r")]).count() == ones
        assert j.anti_join(left, right, [("k", "r")]).count() == 3000 - ones


def test_keys_of_different_width_and_type(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("int").alias("k"), "id")
    right = spark.createDataFrame([(7, 1)], "r bigint, x int")
    assert j.semi_join(left, right, [("k", "r")]).count() == 1501
    assert j.anti_join(left, right, [("k", "r")]).count() == 1499
    assert j.lookup_join(left, right, [("k", "r")]).where("x = 1").count() == 1501
    assert j.left_join(right, left, [("r", "k")]).count() == 1501
    text = right.withColumn("r", F.col("r").cast("string"))
    for join in (j.left_join, j.inner_join, j.semi_join, j.anti_join, j.lookup_join):
        with pytest.raises(TypeError):
            join(left, text, [("k", "r")])


def test_lookup_join_with_a_frequent_key(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("k"), "id")
    totals = left.where("k < 2000").groupBy("k").agg(F.count("*").alias("n"))
    joined = j.lookup_join(left, totals, ["k"])
    plain = left.join(totals, "k", "left").select("k", "id", "n")
    assert joined.exceptAll(plain).count() == 0 and plain.exceptAll(joined).count() == 0


@pytest.fixture
def small_skew(spark):
    """Thresholds low enough for adaptive execution to see skew in small tables."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint")
    left = spark.range(0, 200000, 1, 8).select(key.alias("k"), F.col("id").alias("l"))
    right = spark.range(200000).select(F.col("id").alias("k"), F.col("id").alias("r"))
    return left, right


def test_adaptive_execution_splits_a_skewed_left_side(spark, plan, small_skew):
    """The plain left join keeps the shape that adaptive execution can split."""
    left, right = skewed(spark)
    done = j.left_join(left, right, ["k"], unique=True).agg(F.count("*"), F.sum("l"), F.sum("r"))
    assert done.collect()[0][0] == 200000
    assert "skew=true" in plan(done)


def test_the_first_of_two_joins_on_one_key_is_split_too(spark, plan, small_skew):
    left, right = skewed(spark)
    both = j.left_join(j.left_join(left, right, ["k"], unique=True), right.withColumnRenamed("r", "q"), ["k"], unique=True)
    done = both.agg(F.count("*"), F.sum("l"), F.sum("r"), F.sum("q"))
    assert done.collect()[0][0] == 200000
    assert "skew=true" in plan(done)


@pytest.mark.parametrize("share", [100, 25])
@pytest.mark.parametrize("how", ["semi", "anti", "lookup", "right"])
def test_keys_with_few_hundredths_of_the_rows_are_split(spark, plan, small_skew, how, share):
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "4KB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4KB")
    key = F.when(F.col("id") % share == 0, 7).otherwise(F.col("id")).cast("bigint")
    big = spark.range(0, 400000, 1, 8).select(key.alias("k"), F.md5(F.col("id").cast("string").cast("binary")).alias("l"))
    small = spark.range(400000).select(F.col("id").alias("k"))
    if how == "semi":
        done, want = j.semi_join(big, small, ["k"]).agg(F.count("l"), F.max("l")), 400000
    elif how == "anti":
        done, want = j.anti_join(big, small.where("k % 2 = 0"), ["k"]).agg(F.count("l"), F.max("l")), None
    elif how == "lookup":
        done, want = j.lookup_join(big, small.groupBy("k").agg(F.count("*").alias("n")), ["k"]).agg(F.count("l"), F.max("l"), F.sum("n")), 400000
    else:
        done, want = j.left_join(small, big, ["k"]).agg(F.count("l"), F.max("l")), 400000
    got = done.collect()[0][0]
    assert want is None or got == want
    assert "skew=true" in plan(done)


def test_suffix_rules(spark):
    left = spark.createDataFrame([(1, "a")], "k int, v string")
    right = spark.createDataFrame([(1, "b")], "q int, v string")
    got = j.left_join(left, right, [("k", "q")])
    assert got.columns == ["k", "v", "v_right"] and tuple(got.first()) == (1, "a", "b")
    with pytest.raises(ValueError):
        j.left_join(left.withColumn("v_right", F.lit(1)), right, [("k", "q")])
    with pytest.raises(ValueError):
        j.left_join(left, right, [("k", "nope")])


# ---- distinct, counts


def test_distinct(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("b", 0)], "v string, n int")
    assert [r[0] for r in a.distinct_sorted(df, "v").collect()] == [None, "a", "b"]
    assert [r[0] for r in a.distinct_first_seen(df, "v", "n").collect()] == ["b", None, "a"]
    assert df.agg(a.distinct_count("v")).first()[0] == 3
    assert df.limit(0).agg(a.distinct_count("v")).first()[0] == 0
    assert a.row_count(df).first()[0] == 4


# ---- row numbers and pages


@FEW
@given(st.lists(st.integers(-1000, 1000), unique=True, max_size=40), st.integers(0, 5))
def test_row_id(spark, keys, start):
    df = spark.createDataFrame([(k, str(k)) for k in keys], "k bigint, s string").repartition(5)
    got = sorted((r["ID"], r["k"]) for r in with_row_id(df, ["k"], start=start).collect())
    assert got == [(start + i, k) for i, k in enumerate(sorted(keys))]


def test_row_id_needs_no_single_task(spark, plan):
    numbered = with_row_id(spark.range(10000).select(F.col("id").alias("k")), ["k"])
    text = plan(numbered)
    assert "Window" not in text and "SinglePartition" not in text and "hashpartitioning" not in text
    assert numbered.agg(F.min("ID"), F.max("ID"), F.countDistinct("ID")).first() == (0, 9999, 10000)


def test_pages_visit_each_row_once(spark):
    df = spark.range(23).select(F.col("id").alias("k"), (F.col("id") % 2).alias("v"))
    order = [F.col("v").desc(), "k"]
    pages = [r["k"] for n in range(3) for r in a.page(df, order, n).collect()]
    assert pages == [r["k"] for r in df.orderBy(*order).collect()]
    seen, last = [], None
    while True:
        part = a.page_after(df, "k", last).collect()
        if not part:
            break
        seen += [r["k"] for r in part]
        last = seen[-1]
    assert seen == list(range(23))
    numbered = with_row_id(df, ["k"])
    assert sorted(r["k"] for n in range(3) for r in a.page_by_id(numbered, n).collect()) == list(range(23))
    states = [tuple(a.page_state(df, n).first()) for n in range(3)]
    assert states == [(23, 3, False, True), (23, 3, True, True), (23, 3, True, False)]


def test_sort(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, "b")], "k int, v string")
    assert [r["k"] for r in a.sort_rows(df, "v", ["k"]).collect()] == [3, 2, 4, 1]
    assert [r["k"] for r in a.sort_rows(df, "v", ["k"], ascending=False).collect()] == [2, 4, 3, 1]


def test_pair_by_position(spark):
    left = spark.createDataFrame([("c", 1), ("a", 2), ("b", 3)], "l string, x int")
    right = spark.createDataFrame([("z",), ("y",)], "r string")
    got = sorted(tuple(r) for r in j.pair_by_position(left, right, "l", "r").select("position", "l", "r").collect())
    assert got == [(0, "a", "y"), (1, "b", "z")]


# ---- stacking


@pytest.mark.parametrize(
    "left, right, common",
    [("int", "int", "int"), ("int", "bigint", "bigint"), ("int", "double", "double"), ("bigint", "string", "string"),
     ("boolean", "int", "int"), ("boolean", "string", "string"), ("void", "double", "double"), ("date", "timestamp_ntz", "timestamp_ntz"),
     ("float", "float", "float"), ("float", "int", "double"), ("decimal(10,2)", "decimal(8,4)", "decimal(12,4)"), ("decimal(5,1)", "int", "decimal(11,1)"),
     ("decimal(5,1)", "double", "double"), ("decimal(38,0)", "decimal(38,10)", "double"), ("decimal(5,1)", "boolean", "decimal(5,1)"),
     ("timestamp", "timestamp_ntz", "timestamp"), ("decimal(5,1)", "string", "string")],
)
def test_common_type(left, right, common):
    ddl = T.DataType.fromDDL
    assert common_type(ddl(left), ddl(right)) == common_type(ddl(right), ddl(left)) == ddl(common)


def test_no_common_type():
    with pytest.raises(TypeError):
        common_type(T.DateType(), T.DoubleType())
    with pytest.raises(TypeError):
        common_type(T.DateType(), T.DecimalType(5, 1))


@FEW
@given(st.lists(st.lists(st.sampled_from("abcd"), unique=True, min_size=1), min_size=1, max_size=5), st.integers(0, 9))
def test_stacking_loses_nothing(spark, headers, seed):
    kinds = [lambda c: c.cast("int"), lambda c: c.cast("double"), lambda c: c.cast("string"), lambda c: c % 2 == 0]
    frames = [
        spark.range(i + 1).select(*[kinds[(seed + i + ord(c)) % 4](F.col("id")).alias(c) for c in header])
        for i, header in enumerate(headers)
    ]
    got = union_relaxed(frames)
    assert got.columns == list(dict.fromkeys(c for header in headers for c in header))
    counts = got.agg(F.count(F.lit(1)), *[F.count(c) for c in got.columns]).collect()[0]
    assert counts[0] == sum(i + 1 for i in range(len(headers)))
    assert list(counts[1:]) == [sum(i + 1 for i, h in enumerate(headers) if c in h) for c in got.columns]


def test_union(spark, rows):
    one = spark.createDataFrame([(1, 2)], "a int, b int")
    two = spark.createDataFrame([("x", 0.5)], "c string, b double")
    three = spark.createDataFrame([("q", True)], "a string, d boolean")
    got = union_relaxed([one, two, three])
    assert got.dtypes == [("a", "string"), ("b", "double"), ("c", "string"), ("d", "boolean")]
    assert rows(got) == sorted([("1", 2.0, None, None), (None, 0.5, "x", None), ("q", None, None, True)], key=repr)
    with pytest.raises(ValueError):
        union_relaxed([])
