"""Every registered query against its SQL, and the shape of its plan."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import check
from prepkit.catalog import all_registries

FOLDER = "/root/testdata/sf0.001"
OWN = {name for registry in all_registries() for name in registry.queries}
QUERIES = {name: query for name, query in entry.queries().items() if name in OWN}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in OWN}
# The one-row SinglePartition step of an aggregate or a page is wanted; a window over all rows is not.
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, plan, name):
    df = QUERIES[name](spark, FOLDER)
    text = plan(df)
    assert not [word for word in FORBIDDEN if word in text]
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = check.rows_of(columns, result.fetchall())
    assert want, "the query is not tried on anything"
    assert check.rows_of(df.columns, df.collect()) == want


def test_registries_need_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__))
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.schema == entry.entry(spark).schema


def test_filters_reach_the_scan(spark, plan):
    text = plan(QUERIES["page_keyset"](spark, FOLDER))
    assert "GreaterThan(event_id,777)" in text and "props" not in text
    assert "EqualTo(o_orderstatus,F)" in plan(QUERIES["filter_equals"](spark, FOLDER))


def test_second_join_reuses_the_partitioning_of_the_first(spark, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from prepkit.plans import index_join

        keys = "geoid10 bigint, year int, state_fips int"
        index = spark.createDataFrame([], f"{keys}, county_fips int, county_name string, in100 int, metro_type int, state_name int, r_x_stt double")
        names = spark.createDataFrame([], "`Column` string, Label string")
        joined = index_join.index_join(
            index, spark.createDataFrame([], f"{keys}, r_y_stt double"), spark.createDataFrame([], "geoid10 bigint, year int, pop int"),
            names, names, unique=True,
        )
        assert plan(joined).count("Exchange hashpartitioning") == 3  # one per input
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
