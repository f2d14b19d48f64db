"""Raw layer to clean layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prepkit.functions.values import checked_timestamp, scale
from prepkit.operators.filters import drop_null_rows
from prepkit.sources.csv import read_csv_strict, write_csv
from prepkit.sources.files import exists_or_skip


def clean(raw: DataFrame) -> DataFrame:
    """Rows without nulls, the time parsed and a scaled value added; a time that cannot be read stops the job."""
    return drop_null_rows(raw).withColumns(
        {"timestamp": checked_timestamp("timestamp"), "adjusted_value": scale("value")}
    )


def run(spark: SparkSession, raw_path: str, clean_path: str) -> str:
    """Clean a file into a folder, or say what is missing."""
    ready, message = exists_or_skip(spark, raw_path)
    if ready:
        write_csv(clean(read_csv_strict(spark, raw_path)), clean_path)
    return message
