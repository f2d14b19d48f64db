"""Whole jobs on small hand-made files."""

import datetime

import pytest
from pyspark.errors import PySparkException

from prepkit.operators.columns import names_upper
from prepkit.plans import bulk_load, clean_sample, identify, index_join, table_view
from prepkit.sources import csv, tables


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    return write


INDEX = """geoid10,year,state_fips,county_fips,county_name,in100,metro_type,state_name,r_ed_stt,z_ed_stt,r_ed_nat,r_ed_met,c5_ed_stt
11,2020,1,1001,"Lee County , Alabama",1,big,AL,5.5,0.1,9,9,9
12,2020,1,1003,Clay,1,big,AL,6.5,0.2,9,9,9
13,2020,1,1005,"A, B, C",1,big,AL,7.5,0.3,9,9,9
14,2020,1,1007,,1,big,AL,8.5,0.4,9,9,9
,2020,1,1009,"No Key, AL",1,big,AL,9.5,0.5,9,9,9
15,2020,2,2001,"Else, XX",1,big,XX,1.5,0.6,9,9,9
16,2020,,9001,"Null State, XX",1,big,XX,1.5,0.6,9,9,9
"""
SUBDOMAINS = """geoid10,year,state_fips,county_name,r_soc_stt,z_soc_stt,r_soc_nat
11,2020,1,other,1.5,0.1,9
13,2020,1,other,2.5,0.2,9
99,2020,1,other,3.5,0.3,9
"""
INDEX_DICTIONARY = """Column,Label
r_ed_stt,"Index, Educational domain  score, state"
z_ed_stt,"Index, Educational domain  score, state"
r_ed_nat,"Index, Educational domain, nation"
c5_ed_stt,"Group, Educational domain"
x_c5_y_stt,"Group, inside"
"""
SUBDOMAIN_DICTIONARY = """Column,Label
r_soc_stt,"Part, Social and economic child opportunity"
z_soc_stt,"Part, Educational standard"
"""
POPULATION = """geoid10,year,pop_total,state_fips
11,2020,100,1
14,2020,400,1
77,2020,700,1
"""


def test_index_join(spark, put, tmp_path):
    paths = [
        put("index.csv", INDEX), put("sub.csv", SUBDOMAINS), put("pop.csv", POPULATION),
        put("d1.csv", INDEX_DICTIONARY), put("d2.csv", SUBDOMAIN_DICTIONARY),
    ]
    target = {"path": str(tmp_path / "table")}
    report = index_join.run(spark, *paths, target, str(tmp_path / "out"), table_format="parquet")
    assert report.first()[0] == 5  # four names and null
    names = [
        "ID", "geoid10", "year", "state_fips", "county_fips", "county_name", "edual_dmn_score", "edual_dmn_score_std",
        "soc_econ_oppty", "edu_stard_std", "pop_total", "state_fips_right",
    ]
    got = tables.read_table(spark, target, fmt="parquet")
    assert got.columns == names
    assert [tuple(r) for r in got.orderBy("ID").collect()] == [
        (0, None, 2020, 1, 9, "No Key", 9.5, 0.5, None, None, None, None),
        (1, 11, 2020, 1, 1, "Lee County ", 5.5, 0.1, 1.5, 0.1, 100, 1),
        (2, 12, 2020, 1, 3, "Clay", 6.5, 0.2, None, None, None, None),
        (3, 13, 2020, 1, 5, "A", 7.5, 0.3, 2.5, 0.2, None, None),
        (4, 14, 2020, 1, 7, None, 8.5, 0.4, None, None, 400, 1),
    ]
    written = csv.read_csv_tolerant(spark, str(tmp_path / "out"), got.drop("ID").schema)
    assert written.count() == 5 and written.exceptAll(got.drop("ID")).count() == 0


@pytest.mark.parametrize("label", ['"one part"', '"Index, Educational domain  score, state"'])
def test_bad_dictionary(spark, put, label):
    """A label without a second part, and two labels that give one name."""
    dictionary = f"Column,Label\nr_ed_stt,{label}\nz_ed_stt,\"Index, other\"\n"
    if "Index" in label:
        dictionary = f"Column,Label\nr_ed_stt,\"Index, x std\"\nz_ed_stt,\"Index, x\"\n"
    frames = [csv.read_csv_tolerant(spark, put(n, t)) for n, t in (
        ("i.csv", INDEX), ("s.csv", SUBDOMAINS), ("p.csv", POPULATION), ("d1.csv", dictionary), ("d2.csv", SUBDOMAIN_DICTIONARY))]
    with pytest.raises(ValueError):
        index_join.index_join(*frames)


COUNTIES = """State FIPS,State Postal Code,School District Name,County Names
1,AL,A City City School District,LEE
1,AL,A City City School District,st. clair
1,AL,\tSt. B School District ,o'neal-école
1,AL,Nobody School District,Clay
2,XX,Trusts City School District,Else
,XX,A City School District,Null
1,AL,Trusts City School District,
"""


def test_identify(spark, put, tmp_path):
    districts = spark.createDataFrame(
        [("A CITY", 2020, 1.0), ("a City", 2021, 2.0), ("St B", 2020, 3.0), ("Trust City", 2020, 4.0), ("Alone", 2020, 5.0), (None, 2020, 6.0)],
        "LEANM string, YEAR int, MATH double",
    )
    source = str(tmp_path / "district")
    districts.write.parquet(source)
    path = put("counties.csv", COUNTIES)
    report = identify.run(spark, {"path": source}, path, str(tmp_path / "out"), table_format="parquet")
    metrics = dict(report.collect())
    assert metrics == {
        "left_rows": 5, "right_rows": 6, "left_keys": 4, "right_keys": 5, "matched_keys": 3, "left_only_rows": 1, "counties": 5
    }
    schema = "leanm string, year int, math double, county_names string"
    got = csv.read_csv_strict(spark, str(tmp_path / "out"), schema)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(
        [
            ("A City", 2020, 1.0, "Lee"), ("A City", 2020, 1.0, "St. Clair"),
            ("A City", 2021, 2.0, "Lee"), ("A City", 2021, 2.0, "St. Clair"),
            ("St B", 2020, 3.0, "O'Neal-École"), ("Trust City", 2020, 4.0, None),
            ("Alone", 2020, 5.0, None), (None, 2020, 6.0, None),
        ],
        key=repr,
    )


def test_bulk_load(spark, put, tmp_path):
    path = put("bulk.csv", "id,name,score,all_empty,all_na,some_na\n1,x,1.5,,NA,NA\n2,,2.5,,null,7\n3,z,N/A,,N/A,8\n")
    target = {"path": str(tmp_path / "t")}
    for _ in range(2):
        bulk_load.run(spark, path, target, table_format="parquet")
    got = tables.read_table(spark, target, fmt="parquet")
    assert got.dtypes == [("ID", "bigint"), ("NAME", "string"), ("SCORE", "double"), ("SOME_NA", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(
        [(1, "x", 1.5, None), (2, None, 2.5, 7), (3, "z", None, 8)] * 2, key=repr
    )


def test_columns_without_a_value_are_not_loaded(spark, put):
    path = put("bulk.csv", "id,none\n1,NA\n2,\n")
    got = names_upper(csv.read_csv_null_set(spark, path, drop_empty=True))
    assert got.columns == ["ID"]


def test_clean_sample(spark, put, tmp_path):
    raw = put("raw.csv", "timestamp,value\n2024-01-02,1.5\n2024-01-02 03:04:05,2\n2024-01-02T03:04:05.25,\n,4.0\n2024-01-03,NaN\n")
    out = str(tmp_path / "clean")
    assert "Reading" in clean_sample.run(spark, raw, out)
    got = csv.read_csv_strict(spark, out, "timestamp timestamp_ntz, value double, adjusted_value double").orderBy("timestamp").collect()
    day = datetime.datetime(2024, 1, 2)
    assert [tuple(r) for r in got[:2]] == [(day, 1.5, 1.5 * 1.1), (day.replace(hour=3, minute=4, second=5), 2.0, 2.0 * 1.1)]
    assert len(got) == 3 and got[2]["value"] != got[2]["value"]  # NaN is a value and stays


def test_clean_sample_stops_at_a_bad_cell(spark, put, tmp_path):
    lines = "".join(f"2024-01-02,{i}\n" for i in range(120))
    raw = put("raw.csv", "timestamp,value\n" + lines + "2024-01-02,many\n")
    with pytest.raises(PySparkException, match="many"):
        clean_sample.run(spark, raw, str(tmp_path / "clean"))


def test_clean_rows(spark):
    raw = spark.createDataFrame(
        [("2024-01-02", 1.5), ("2024-01-02T03:04:05", None), (None, 2.0), ("2024-01-02 03:04:05.25", float("nan"))],
        "timestamp string, value double",
    )
    got = sorted(clean_sample.clean(raw).collect())
    assert got[0][0] == datetime.datetime(2024, 1, 2) and got[0][2] == 1.5 * 1.1
    assert len(got) == 2 and got[1][1] != got[1][1]
    with pytest.raises(PySparkException):
        clean_sample.clean(spark.createDataFrame([("soon", 1.0)], "timestamp string, value double")).collect()


def test_clean_sample_without_a_file(spark, tmp_path):
    message = clean_sample.run(spark, str(tmp_path / "none.csv"), str(tmp_path / "out"))
    assert "place a CSV file" in message and not (tmp_path / "out").exists()


def test_table_view(spark, put):
    lines = [f"Lee,{i % 8},{2000 + i},{i / 2},{'' if i == 3 else i},x" for i in range(25)]
    path = put("d.csv", "leanm,grade,year,math,rla,extra\n" + "\n".join(lines) + "\nClay,1,2000,5,5,x\n,1,2000,5,5,x\n")
    df = csv.read_csv_dynamic(spark, path)
    pages = [table_view.table_view(df, "LEE", ["year"], number=n) for n in range(4)]
    assert pages[0].columns == ["Grade", "Year", "Math Score", "Reading Score"]
    assert [p.count() for p in pages] == [10, 10, 5, 0]
    assert [r["Year"] for p in pages for r in p.collect()] == list(range(2000, 2025))
    # Half points are searched as displayed; a hidden column is searched too.
    assert table_view.view_rows(df, "lee", "2.5").count() == 1
    assert table_view.view_rows(df, "lee", "5.0").count() == 0
    hidden = table_view.table_view(df, "lee", ["year"], term="2013", hidden=["Year"])
    assert hidden.columns == ["Grade", "Math Score", "Reading Score"] and hidden.count() == 1
    assert table_view.view_rows(df, "").count() == 1
