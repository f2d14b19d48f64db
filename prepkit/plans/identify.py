"""Give every district row the counties its district lies in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.functions import fixed_values as fv
from prepkit.functions.text import apply_rules, strip_chars, title_case
from prepkit.operators.aggregates import distinct_count, reconcile
from prepkit.operators.columns import derive_key, drop_strict, names_snake
from prepkit.operators.filters import equals
from prepkit.operators.joins import left_join
from prepkit.session import stage
from prepkit.sources.csv import read_csv_tolerant, write_csv
from prepkit.sources.tables import read_table

DISTRICT = "School District Name"
COUNTY = "County Names"


def clean_names(counties: DataFrame, state: int = fv.STATE_CODE) -> DataFrame:
    """District and county names of one state, the district name in the form of the district table."""
    rows = drop_strict(equals(counties, "State FIPS", state), "State FIPS", "State Postal Code")
    cleaned = strip_chars(apply_rules(F.lower(F.col(f"`{DISTRICT}`")), fv.DISTRICT_NAME_RULES))
    return rows.withColumn(DISTRICT, cleaned)


def identify(districts: DataFrame, counties: DataFrame, state: int = fv.STATE_CODE) -> DataFrame:
    """District rows with their county; a district in several counties gives several rows.

    Names that no district row has need no removal beforehand: the left join never meets them. Title case is
    made on both sides before the join, once per row and not once per match. Both sides are written once, since the join
    reads them twice.
    """
    key = F.lower("LEANM")
    left = stage(districts.withColumns({"LEANM": key, "__title": title_case(key)}), "districts")
    right = stage(clean_names(counties, state).withColumn(COUNTY, title_case(f"`{COUNTY}`")), "counties")
    joined = left_join(left, right, [("LEANM", DISTRICT)])
    return names_snake(joined.withColumn("LEANM", F.col("__title")).drop("__title"))


def match_report(districts: DataFrame, counties: DataFrame, state: int = fv.STATE_CODE) -> DataFrame:
    """How well the names of the county list match the district table: ``(metric, value)``."""
    names = clean_names(counties, state)
    known = derive_key(districts.select("LEANM"), "LEANM", "district_name")
    sides = reconcile(names, known, DISTRICT, "district_name")
    number = names.agg(distinct_count(COUNTY).alias("counties")).unpivot([], ["counties"], "metric", "value")
    return sides.unionByName(number)


def run(
    spark: SparkSession,
    district_options: dict[str, str],
    counties: str,
    csv_path: str,
    table_format: str = "jdbc",
    state: int = fv.STATE_CODE,
    partition: dict[str, str] | None = None,
) -> DataFrame:
    """Read the district table and the county list, write the result as CSV; gives the match report."""
    districts = stage(read_table(spark, district_options, partition, table_format), "districts")
    names = read_csv_tolerant(spark, counties)
    write_csv(identify(districts, names, state), csv_path)
    return match_report(districts, names, state)
