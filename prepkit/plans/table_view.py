"""The table of one district: filter, search, choose columns, sort, page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from prepkit.functions import fixed_values as fv
from prepkit.operators.aggregates import page
from prepkit.operators.columns import project_labels, visible
from prepkit.operators.filters import equals_ignore_case, search
from prepkit.sources.csv import read_csv_dynamic


def view_rows(
    df: DataFrame,
    district: str,
    term: str | None = None,
    district_column: str = "leanm",
    columns: Sequence[tuple[str, str]] = tuple(fv.TABLE_VIEW_COLUMNS),
) -> DataFrame:
    """Rows of a district that contain the term in one of the shown columns, hidden or not."""
    rows = df.where(equals_ignore_case(district_column, district))
    return search(rows, [key for key, _ in columns], term)


def table_view(
    df: DataFrame,
    district: str,
    order: Sequence[str],
    term: str | None = None,
    hidden: Sequence[str] = (),
    number: int = 0,
    size: int = fv.PAGE_SIZE,
    district_column: str = "leanm",
    columns: Sequence[tuple[str, str]] = tuple(fv.TABLE_VIEW_COLUMNS),
) -> DataFrame:
    """One page under display labels. ``order`` names a total order; hidden columns go by their label."""
    rows = view_rows(df, district, term, district_column, columns)
    return visible(project_labels(page(rows, list(order), number, size), columns), hidden)


def run(spark: SparkSession, path: str, district: str, order: Sequence[str], **view) -> DataFrame:
    """One page of the table in a CSV file; the arguments are those of ``table_view``."""
    return table_view(read_csv_dynamic(spark, path), district, order, **view)


