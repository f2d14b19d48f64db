"""Join of the index, subdomain and population measures of one state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.functions import fixed_values as fv
from prepkit.functions.text import append_when, apply_rules, contains_text, split_part_exact, strip_chars
from prepkit.functions.values import modulo
from prepkit.operators.aggregates import distinct_count
from prepkit.operators.columns import drop_strict, drop_suffix, rename_from_dictionary, select_not
from prepkit.operators.filters import equals, suffix_not_contains
from prepkit.operators.joins import left_join
from prepkit.session import stage
from prepkit.sources.csv import read_csv_tolerant, write_csv
from prepkit.sources.tables import write_table_replace


def short_labels(dictionary: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """New column names from a data dictionary: ``(Column, New Label)``.

    The second of the comma-separated parts of a label is trimmed, marked when the measure is
    standardised, lower-cased and shortened.
    """
    part = strip_chars(split_part_exact("Label", ",", 1))
    marked = append_when(contains_text("Column", fv.STANDARDISED_MARK), part, fv.STANDARDISED_SUFFIX)
    return dictionary.where(suffix_not_contains("Column", fv.KEPT_SUFFIX, fv.DROPPED_PREFIX)).select(
        "Column", apply_rules(F.lower(marked), rules).alias("New Label")
    )


def state_measures(measures: DataFrame, state: int = fv.STATE_CODE) -> DataFrame:
    """The rows of one state without the column families that are not wanted."""
    kept = select_not(measures, suffixes=fv.DROPPED_SUFFIXES, prefixes=[fv.DROPPED_PREFIX])
    return equals(kept, "state_fips", state)


def index_join(
    index: DataFrame,
    subdomains: DataFrame,
    population: DataFrame,
    index_dictionary: DataFrame,
    subdomain_dictionary: DataFrame,
    state: int = fv.STATE_CODE,
    unique: bool = False,
) -> DataFrame:
    """Index rows with their subdomain measures and population, under short column names.

    Both joins use the same keys, so the result of the first is not shuffled again for the second. The
    population is not cut to the known places beforehand: the left join does that by itself. ``unique`` says that the
    right sides have one row per key; otherwise the sides are read more than once and are written before.
    """
    left = rename_from_dictionary(state_measures(index, state), short_labels(index_dictionary, fv.INDEX_LABEL_RULES))
    right = rename_from_dictionary(
        state_measures(subdomains, state), short_labels(subdomain_dictionary, fv.SUBDOMAIN_LABEL_RULES)
    )
    if not unique:
        left, right, population = stage(left, "index"), stage(right, "subdomains"), stage(population, "population")
    joined = drop_suffix(left_join(left, right, fv.MEASURE_KEYS, unique=unique), [fv.RIGHT_SUFFIX, fv.LEFT_SUFFIX])
    # The part before the comma is kept as it stands, untrimmed.
    joined = joined.withColumn("county_name", split_part_exact("county_name", ",", 0))
    joined = drop_strict(joined, "in100", "metro_type", "state_name")
    if not unique:
        joined = stage(joined, "index-subdomains")
    return left_join(joined, population, fv.MEASURE_KEYS, unique=unique).withColumn("county_fips", modulo("county_fips"))


def county_report(joined: DataFrame) -> DataFrame:
    """Number of counties in the result, null counted as one."""
    return joined.agg(distinct_count("county_name").alias("counties"))


def run(
    spark: SparkSession,
    index: str,
    subdomains: str,
    population: str,
    index_dictionary: str,
    subdomain_dictionary: str,
    table_options: dict[str, str],
    csv_path: str,
    table_format: str = "jdbc",
    state: int = fv.STATE_CODE,
) -> DataFrame:
    """Read the five CSV files, replace the table, write the CSV; gives the county report.

    The join is written once to the shared folder and feeds both sinks and the report.
    """
    read = [
        read_csv_tolerant(spark, p)
        for p in (index, subdomains, population, index_dictionary, subdomain_dictionary)
    ]
    joined = stage(index_join(*read, state=state), "index-join")
    write_table_replace(joined, table_options, order_by=fv.MEASURE_KEYS, fmt=table_format)
    write_csv(joined, csv_path)
    return county_report(joined)


