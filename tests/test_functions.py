import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prepkit import functions as p
from prepkit.functions import fixed_values as fv


def one(spark, expression, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, parts", [("a,b,c", ("a", "b", "c")), ("a,b", ("a", "b", None)), ("a", ("a", None, None)), ("a,b,c,d", ("a", "b", "c")),
                    ("", ("", None, None)), (None, (None, None, None))]
)
def test_exact_split(spark, text, parts):
    got = one(spark, p.split_struct_exact("v", ",", ["x", "y", "z"]), text)
    assert tuple(got) == parts
    assert tuple(one(spark, p.split_part_exact("v", ",", i), text) for i in range(3)) == parts


def test_split_separator_is_literal(spark):
    assert one(spark, p.split_part_exact("v", ".", 1), "a.b") == "b"


def test_strip_takes_any_white_space(spark):
    assert one(spark, p.strip_chars("v"), "\t  a b  \n") == "a b"


@pytest.mark.parametrize(
    "label, index, subdomain",
    [
        ("education domain", "edu_dmn", "edu_dmn"),
        ("educational domain", "edual_dmn", "edu_dmn"),
        ("standard", "stard", "stard"),
        ("social and economic", "soc_econ", "soc_econ"),
        ("a    b", "a__b", "a__b"),
        ("child opportunity environment", "oppty_environ", "oppty_environ"),
    ],
)
def test_label_rules(spark, label, index, subdomain):
    assert one(spark, p.apply_rules("v", fv.INDEX_LABEL_RULES), label) == index
    assert one(spark, p.apply_rules("v", fv.SUBDOMAIN_LABEL_RULES), label) == subdomain


def test_whole_word_rules(spark):
    assert one(spark, p.apply_rules("v", [("and", "")], whole_word=True), "standard and") == "standard "


def test_district_rules(spark):
    clean = p.strip_chars(p.apply_rules(F.lower("v"), fv.DISTRICT_NAME_RULES))
    assert one(spark, clean, "A City City School District") == "a city"
    assert one(spark, clean, "St. B School District") == "st b"
    assert one(spark, clean, "trusts city") == "trust city"


def test_append_when(spark):
    df = spark.createDataFrame([("z_a", "x"), ("a", "x"), ("z_a", None), (None, "x")], "k string, v string")
    got = [r[0] for r in df.select(p.append_when(p.contains_text("k", "z_"), "v", " std")).collect()]
    assert got == ["x std", "x", None, "x"]


@pytest.mark.parametrize(
    "text, title", [("st. clair-county o'neal école", "St. Clair-County O'Neal École"), ("ABC 1st", "Abc 1st"), ("", ""), (None, None)]
)
def test_title_case(spark, text, title):
    assert one(spark, p.title_case("v"), text) == title
    assert one(spark, p.title_case(p.title_case("v")), text) == title


def test_slug_and_underscore(spark):
    assert one(spark, p.slug("v"), "a  b\tc") == "a-b-c"
    assert one(spark, p.underscore("v"), "a  b") == "a__b"
    assert one(spark, p.prefix_key("grade_", "v"), "feature1") == "grade_feature1"


@pytest.mark.parametrize("text, shown", [(None, "N/A"), ("", "N/A"), ("1", "1")])
def test_default_text(spark, text, shown):
    assert one(spark, p.default_text("v"), text) == shown


@pytest.mark.parametrize("value, text", [(1.0, "1.00"), (-0.001, "-0.00"), (1234.567, "1234.57"), (None, None)])
def test_fixed_decimals(spark, value, text):
    assert one(spark, p.fixed_decimals("v"), value, "double") == text


@pytest.mark.parametrize(
    "value, text",
    [(5.0, "5"), (0.5, "0.5"), (100.0, "100"), (1e10, "10000000000"), (12345678.9, "12345678.9"), (1e21, "1e+21"),
     (1.5e-7, "1.5e-7"), (0.0, "0"), (-0.0, "0"), (-3.25, "-3.25"), (1e16, "10000000000000000"), (float("nan"), "NaN"),
     (1e-6, "0.000001"), (None, None)],
)
def test_number_text(spark, value, text):
    assert one(spark, p.number_text("v"), value, "double") == text


def test_display_text(spark):
    assert one(spark, p.display_text("v", "double"), None, "double") == ""
    assert one(spark, p.display_text("v", "bigint"), 7, "bigint") == "7"
    assert one(spark, p.display_text("v", "float"), 0.1, "float") == "0.1"


@pytest.mark.parametrize(
    "text", ["2024-01-02", "2024-01-02 03:04:05", "2024-01-02T03:04:05", "2024-01-02T03:04:05.123456"]
)
def test_timestamps(spark, text):
    got = one(spark, p.checked_timestamp("v"), text)
    assert got.isoformat().startswith(text.replace(" ", "T")[:10])


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_timestamp(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert one(spark, p.checked_timestamp("v", strict=False), "soon") is None
        assert one(spark, p.checked_timestamp("v"), None) is None
        with pytest.raises(PySparkException):
            one(spark, p.checked_timestamp("v"), "soon")
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_scale_and_modulo(spark):
    assert one(spark, p.scale("v"), 10.0, "double") == 10.0 * 1.1
    assert one(spark, p.modulo("v"), 1001, "bigint") == 1
    assert one(spark, p.modulo("v", 3), -7, "bigint") == 2


@pytest.mark.parametrize(
    "text, number",
    [("5", 5.0), (" 5 ", 5.0), (" 5\t", 5.0), ("1e3", 1000.0), ("-7.", -7.0), (".5", 0.5), ("0x10", None), ("5d", None),
     ("NaN", None), ("Infinity", None), ("", None), ("  ", None), (None, None), ("1,5", None)],
)
def test_plain_number(spark, text, number):
    assert one(spark, p.is_plain_number("v"), text) is (number is not None)
    assert one(spark, p.plain_number("v"), text) == number


def test_unit_hash_is_stable_and_uniform(spark):
    df = spark.range(4000).select(p.unit_hash(F.lit(1), "id").alias("u"), "id")
    again = spark.range(4000).repartition(7).select(p.unit_hash(F.lit(1), "id").alias("u"), "id")
    assert df.exceptAll(again).count() == 0
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.03
