import pytest
from pyspark.sql import types as T

from prepkit.operators import columns as c
from prepkit.operators import schemas


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, "x", 2.0, None)], "`a.b` int, name_right string, r_nat double, c5_x string")


def test_select_rules(df):
    assert c.select_not(df, ["_nat"], ["c5_"]).columns == ["a.b", "name_right"]
    assert c.drop_suffix(df, ["_right", "_left"]).columns == ["a.b", "r_nat", "c5_x"]
    assert c.visible(df, ["r_nat"]).columns == ["a.b", "name_right", "c5_x"]


def test_strict_drop_and_rename(df):
    assert c.drop_strict(df, "c5_x").columns == ["a.b", "name_right", "r_nat"]
    with pytest.raises(ValueError):
        c.drop_strict(df, "missing")
    for names in ({"missing": "x"}, {"r_nat": None}, {"r_nat": ""}, {"r_nat": "c5_x"}):
        with pytest.raises(ValueError):
            c.rename_strict(df, names)
    assert c.rename_strict(df, {"a.b": "n"}).columns[0] == "n"


def test_rename_from_dictionary(spark, df):
    names = spark.createDataFrame([(2, "r_nat", "late"), (1, "r_nat", "early")], "n int, `Column` string, `New Label` string")
    assert c.rename_from_dictionary(df, names, order_by="n").columns[2] == "late"


def test_unnest(spark):
    df = spark.createDataFrame([(1, "a, b", 3)], "i int, t string, j int")
    got = c.unnest_split(df, "t", ",", ["p", "q", "r"])
    assert got.columns == ["i", "p", "q", "r", "j"] and tuple(got.first()) == (1, "a", " b", None, 3)
    with pytest.raises(ValueError):
        c.unnest_split(df, "t", ",", ["i", "q"])
    with pytest.raises(TypeError):
        c.unnest_struct(df, "i")


def test_case_rules(spark):
    df = spark.createDataFrame([(1, 2)], "`State FIPS` int, b int")
    assert c.names_upper(df).columns == ["STATE FIPS", "B"]
    assert c.names_snake(df).columns == ["state_fips", "b"]
    with pytest.raises(ValueError):
        c.names_upper(df.toDF("x", "X"))


def test_all_null_columns(spark):
    df = spark.createDataFrame([(1, None, float("nan"), None), (2, None, None, "x")], "a int, b string, c double, d string")
    assert c.drop_all_null_columns(df).columns == ["a", "d"]
    assert dict(c.non_null_counts(df).collect()) == {"a": 2, "b": 0, "c": 0, "d": 1}


def test_labels_and_key(spark):
    df = spark.createDataFrame([("Ab", 1)], "LEANM string, n int")
    assert c.project_labels(df, [("n", "Number")]).columns == ["Number"]
    with pytest.raises(ValueError):
        c.project_labels(df, [("m", "Number")])
    got = c.derive_key(df, "LEANM", "district_name")
    assert got.columns == ["n", "district_name"] and got.first()[1] == "ab"
    assert [tuple(r) for r in c.columns_report(df).collect()] == [(0, "LEANM", "string"), (1, "n", "int")]


def test_declared_tables():
    sizes = {t: len(schemas.declared(t)) for t in schemas.DECLARED}
    assert sizes == {
        "SCHOOL_ACCOUNTABILITY": 10, "SCHOOL_EDUNOMICS": 40, "STUDENT_DEMOGRAPHICS": 20,
        "TEACHER_DEMOGRAPHICS": 10, "TEACHER_EFFECTIVENESS": 8, "TEACHER_EXPERIENCE": 12,
    }
    assert schemas.declared("SCHOOL_EDUNOMICS")["enroll_raw_AL"].dataType == T.StringType()


@pytest.mark.parametrize("name", list(schemas.DECLARED))
def test_conform(spark, name):
    schema = schemas.declared(name)
    fields = schema.fields
    # Wrong order, all text, one column missing, one extra, one cell that cannot be cast.
    whole = next(f.name for f in fields if f.dataType == T.IntegerType())
    missing = next(f.name for f in fields if f.dataType == T.StringType())
    data = {f.name: "2020" for f in reversed(fields) if f.name != missing} | {"extra": "x"}
    df = spark.createDataFrame([tuple(data.values()), tuple({**data, whole: "late"}.values())], [*data])
    got = schemas.conform(df, schema)
    assert got.schema.names == schema.names and [f.dataType for f in got.schema] == [f.dataType for f in fields]
    assert sorted(map(str, [r[whole] for r in got.collect()])) == ["2020", "None"]
    report = {r["name"]: tuple(r)[1:] for r in schemas.conform_report(df, schema).collect()}
    assert report[missing] == ("missing", 0, 0) and report["extra"] == ("extra", 2, 0)
    assert report[whole] == ("cast", 2, 1)


def test_conform_keeps_no_half_numbers(spark):
    df = spark.createDataFrame([(2.0, "2.0"), (2.5, "2.5")], "a double, b string")
    got = schemas.conform(df, T.DataType.fromDDL("a int, b int"))
    assert [tuple(r) for r in got.collect()] == [(2, 2), (None, None)]
