import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.operators import scenario as s
from prepkit.operators import validate as v
from prepkit.plans.what_if import what_if


def test_field_errors(spark):
    values = [None, "", " ", "5", " 5 ", "1e3", "0x10", "5d", "NaN", "150", "-.5"]
    df = spark.createDataFrame([(x,) for x in values], "f string")
    got = [r[0] for r in df.select(v.field_error("f")).collect()]
    need, number = "This field is required.", "Must be a number"
    assert got == [need, need, number, None, None, None, number, number, number, None, None]
    ranged = [r[0] for r in df.select(v.field_error("f", -100, 100)).collect()]
    assert ranged[9] == "Must be between -100 and 100" and ranged[3] is None


def test_gate_is_all_or_nothing(spark):
    df = spark.createDataFrame([(1, "1", "2"), (2, "x", ""), (3, " 3 ", "4\t")], "id int, a string, b string")
    valid, rejected = v.gate(df, ["a", "b"])
    assert sorted(map(tuple, valid.collect())) == [(1, 1.0, 2.0), (3, 3.0, 4.0)]
    assert [r["reason"] for r in rejected.collect()] == ["a: Must be a number; b: This field is required."]


def test_bindings_pair_by_position():
    district, grade = s.form_fields()
    fields = district + grade
    assert len(district) == 10 and len(grade) == 2
    top, bottom = [f"top {i}" for i in range(10)], ["low 1", "low 2"]
    full = s.bindings(fields, top, bottom)
    assert full[0] == ("district_feature1", "top_0") and full[-1] == ("grade_feature2", "low_2") and len(full) == 12
    # Eight top names: the ninth district field moves on to a bottom name.
    shifted = dict(s.bindings(fields, top[:8], bottom))
    assert shifted["district_feature9"] == "low_1" and len(shifted) == 10
    # A name given twice keeps its place and takes the later field.
    assert s.bindings(fields, ["a", "b", "a"], []) == [("district_feature3", "a"), ("district_feature2", "b")]
    assert len(s.bindings(fields, top, bottom + ["surplus"])) == 12


def test_bind_adjustments(spark):
    df = spark.createDataFrame([(1, "5", "7")], "id int, p string, q string")
    got = s.bind_adjustments(df, ["id"], [("q", "x"), ("p", "y")]).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "q", "x", 7.0), (1, 1, "p", "y", 5.0)]


def test_adjustments(spark, rows):
    df = spark.createDataFrame([("a", 10.0, 1.0), ("b", 20.0, 2.0), ("c", 30.0, None)], "k string, x double, y double")
    assert rows(s.apply_adjustments(df, {"x": 50})) == [("a", 15.0, 1.0), ("b", 30.0, 2.0), ("c", 45.0, None)]
    long = spark.createDataFrame(
        [("a", 1, "x", 100.0), ("a", 0, "x", 300.0), ("a", 2, "y", -50.0), ("b", 0, "y", 90.0), ("b", 1, "y", 10.0)], "k string, position int, feature string, pct double"
    )
    got = s.apply_adjustments_by_key(df, long, "k", ["x", "y"])
    assert got.columns == df.columns and rows(got) == [("a", 20.0, 0.5), ("b", 20.0, 2.2), ("c", 30.0, None)]
    with pytest.raises(ValueError):
        s.apply_adjustments(df, {"nope": 1.0})


def test_tag_fields(spark):
    df = spark.createDataFrame([("1", "2")], "feature1 string, feature2 string")
    assert s.tag_fields(df, df.columns, "grade").columns == ["grade_feature1", "grade_feature2"]


def test_slugs(spark):
    df = spark.createDataFrame([("Lee County", 1), ("Lee-County", 2), ("Clay  City", 3), ("clay  city", 4)], "n string, i int")
    assert [r["i"] for r in s.select_by_slug(df, "n", "clay-city").orderBy("i").collect()] == [3, 4]
    with pytest.raises(ValueError):
        s.select_by_slug(df, "n", "Lee County")
    assert [tuple(r) for r in s.slug_collisions(df, "n").collect()] == [("lee-county", 2)]
    assert [r[0] for r in s.district_names(df, "n").collect()] == sorted(["Lee County", "Lee-County", "Clay  City", "clay  city"])


@pytest.fixture
def observations(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        x, z, flat = rng.normal(10, 2), rng.normal(5, 1), 1.0
        rows.append((f"District {i % 20}", i % 4, float(x), float(z), flat, float(3 + 2 * x - 4 * z)))
    rows.append(("District 1", 1, None, 1.0, 1.0, 5.0))
    return spark.createDataFrame(rows, "district string, state int, x double, `z z` double, flat double, y double")


def test_ranking(observations):
    ranked = s.rank_features(observations, "y", {"top": (["x", "flat"], 2), "bottom": (["z z"], 2)})
    assert s.feature_lists(ranked, "top", "bottom") == (["x", "flat"], ["z z"])
    assert [r["score"] for r in ranked.where("feature = 'flat'").collect()] == [None]


def test_fit_finds_the_line(observations):
    model = s.fit(observations, "y", ["x", "z z"])
    assert model.intercept == pytest.approx(3) and model.coefficients == pytest.approx({"x": 2, "z z": -4})
    assert observations.where("x is not null").select(F.max(F.abs(model.predict() - F.col("y")))).first()[0] < 1e-8


def test_similar_districts_match_brute_force(observations):
    totals = s.district_totals(observations, "district", "state", ["x", "z z"])
    near = s.similar_districts(s.profile(totals, "district", ["x", "z z"]), "district", "District 1", ["x", "z z"], 5)
    pdf = observations.toPandas().dropna().groupby("district")[["x", "z z"]].mean()
    scaled = (pdf - pdf.loc["District 1"]) / pdf.std(ddof=0)
    want = ((scaled**2).sum(axis=1) ** 0.5).drop("District 1").nsmallest(5)
    assert [r["district"] for r in near.collect()] == list(want.index)
    with pytest.raises(ValueError):
        s.similar_districts(s.profile(totals, "district", ["x"]), "district", "nowhere", ["x"], 5)


def test_what_if_matches_scoring_every_row(spark, observations):
    sweep = s.random_scenarios(spark.range(6).withColumnRenamed("id", "scenario"), ["scenario"], seed=5)
    spoilt = sweep.withColumn("grade_feature2", F.when(F.col("scenario") == 4, "").otherwise(F.col("grade_feature2")))
    scored, rejected = what_if(
        observations, spoilt, ["scenario"], "district-1", "y", (["x"], 10), (["z z"], 2), "district", "state", similar=3
    )
    assert [tuple(r) for r in rejected.select("scenario", "reason").collect()] == [(4, "grade_feature2: This field is required.")]
    got = {r["scenario"]: tuple(r)[1:] for r in scored.collect()}
    assert sorted(got) == [0, 1, 2, 3, 5]
    pdf = observations.toPandas().dropna()
    totals = s.district_totals(observations, "district", "state", ["x", "z z"])
    profiles = s.profile(totals, "district", ["x", "z z"], "state")
    near = [tuple(r)[:2] for r in s.similar_districts(profiles, "district", "District 1", ["x", "z z"], 3, "state", 1).collect()]
    masks = [(pdf.district == "District 1") & (pdf.state == 1), np.array([p in near for p in zip(pdf.district, pdf.state)]), pdf.state == 1]
    for r in sweep.collect():
        if r["scenario"] == 4:
            continue
        # One top name only: the second district field moves on to the bottom name.
        px, pz = float(r["district_feature1"]), float(r["district_feature2"])
        for text, mask in zip(got[r["scenario"]], masks):
            part = pdf[mask]
            before = 3 + 2 * part.x - 4 * part["z z"]
            after = 3 + 2 * part.x * (1 + px / 100) - 4 * part["z z"] * (1 + pz / 100)
            assert float(text) == pytest.approx(100 * (after.sum() - before.sum()) / before.sum(), abs=0.0051)


def test_one_name_in_two_states(spark):
    rows = [("Lee", st, float(x), float(2 * x + st)) for st in (1, 2) for x in range(1, 9)] + [(f"D{i}", 1, float(i), float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "district string, state int, x double, y double")
    sweep = s.random_scenarios(spark.range(2), ["id"], seed=5)
    call = lambda **more: what_if(df, sweep, ["id"], "lee", "y", (["x"], 1), ([], 0), "district", "state", 3, **more)
    with pytest.raises(ValueError, match="several states"):
        call()
    one, two = (sorted(map(tuple, call(state=st)[0].collect())) for st in (1, 2))
    assert [r[1] for r in one] == [r[1] for r in two] and [r[3] for r in one] != [r[3] for r in two]
    with pytest.raises(ValueError, match="no such"):
        call(state=3)


def test_moments_follow_the_rows_that_hold_the_numbers(spark, observations):
    spoilt = observations.withColumn("w", F.when(F.rand(3) > 0.3, F.col("x") * 0.5 + F.rand(4))).withColumn("none", F.lit(None).cast("double"))
    pdf = spoilt.toPandas()
    spoilt = spark.createDataFrame(pdf).replace(float("nan"), None)
    m = s.Moments(spoilt, "district", "state", ["x", "z z", "flat", "w", "none", "y"])
    levels = {"top": (["x", "flat", "w"], 3), "bottom": (["z z", "none"], 2)}
    want = s.feature_lists(s.rank_features(spoilt, "y", levels), "top", "bottom")
    assert tuple(m.rank("y", levels).values()) == want
    for used in (["x", "z z"], ["x", "w"], ["w", "flat"]):
        part = pdf.dropna(subset=[*used, "y"])
        rows, means, c = m.together([[*used, "y"]])[0]
        assert rows == len(part) and means == pytest.approx(part[[*used, "y"]].mean().to_numpy())
        assert c / rows == pytest.approx(np.cov(part[[*used, "y"]].T, ddof=0), abs=1e-9)
        got, plain = m.fit("y", used), s.fit(spoilt, "y", used)
        assert got.intercept == pytest.approx(plain.intercept) and got.coefficients == pytest.approx(plain.coefficients)
        a, b = ({(r["district"], r["state"]): tuple(r) for r in t.collect()} for t in (m.totals(used), s.district_totals(spoilt, "district", "state", used)))
        assert a.keys() == b.keys() and all(a[k][2:] == pytest.approx(b[k][2:]) for k in a)
    with pytest.raises(ValueError):
        m.fit("y", ["none"])


def test_nothing_to_compare_with(spark):
    totals = spark.createDataFrame([("a", 1, 0, 0.0)], "d string, s int, rows bigint, x double")
    sums = s.grain_sums(totals, ["x"], F.col("d") == "a", F.lit(False), F.col("s") == 1)
    scenarios = spark.createDataFrame([(1, 5.0)], "i int, f double")
    got = s.percent_increase(scenarios, ["i"], [("f", "x")], s.LinearModel(1.0, {"x": 1.0}), sums)
    assert tuple(got.first()) == (1, "N/A", "N/A", "N/A")


def test_a_change_rounded_to_zero_keeps_its_sign(spark):
    totals = spark.createDataFrame([("a", 1, 2, 4.0, 3.0)], "d string, s int, rows bigint, x double, flat double")
    sums = s.grain_sums(totals, ["x", "flat"], F.col("d") == "a", F.col("d") == "a", F.col("s") == 1)
    scenarios = spark.createDataFrame([(1, -0.0, 5.0), (2, 0.0, -5.0), (3, -0.01, 0.0), (4, 50.0, -5.0)], "i int, f double, g double")
    bound = [("f", "x"), ("g", "flat")]
    got = s.percent_increase(scenarios, ["i"], bound, s.LinearModel(4.0, {"x": 1.0, "flat": 0.0}), sums)
    assert [tuple(r) for r in got.orderBy("i").collect()] == [(i, t, t, t) for i, t in ((1, "-0.00"), (2, "0.00"), (3, "-0.00"), (4, "16.67"))]
    flat = s.percent_increase(scenarios, ["i"], bound, s.LinearModel(4.0, {"x": 0.0, "flat": 0.0}), sums)
    assert {r["state_percent_increase"] for r in flat.collect()} == {"0.00"}


def test_random_scenarios(spark):
    df = s.random_scenarios(spark.range(500), ["id"], seed=1)
    assert len(df.columns) == 13
    low, high = df.select(F.col("district_feature1").cast("double").alias("x")).agg(F.min("x"), F.max("x")).first()
    assert -100 <= low < -95 and 95 < high <= 100
    assert df.where(~F.col("grade_feature2").rlike(r"^-?[0-9]+[.][0-9]{2}$")).count() == 0
    again = s.random_scenarios(spark.range(500).repartition(3), ["id"], seed=1)
    assert df.exceptAll(again).count() == 0
    assert s.random_scenarios(spark.range(500), ["id"], seed=2).intersect(df).count() == 0


def test_performance(spark, rows):
    df = spark.createDataFrame([(3, 2020, 1.0, 2.0), (3, 2020, 3.0, None), (4, 2020, 5.0, 6.0)], "grade int, year int, math double, rla double")
    assert rows(s.performance(df, ["math", "rla"], ["grade", "year"])) == [(3, 2020, 2.0, 2.0), (4, 2020, 5.0, 6.0)]
