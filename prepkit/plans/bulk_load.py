"""Append a CSV file to a table."""

from __future__ import annotations

from pyspark.sql import SparkSession

from prepkit.operators.columns import names_upper
from prepkit.sources.csv import read_csv_null_set
from prepkit.sources.tables import write_table_append


def run(spark: SparkSession, path: str, table_options: dict[str, str], table_format: str = "jdbc") -> None:
    """Read with the usual null markers and append. The pass that finds the types also finds the empty columns."""
    rows = names_upper(read_csv_null_set(spark, path, drop_empty=True))
    write_table_append(rows, table_options, fmt=table_format)
