"""Distinct values, counts, reports, sorting and paging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.functions import fixed_values as fv
from prepkit.operators.row_id import with_row_id
from prepkit.operators.selection import rows_at
from prepkit.operators.columns import column


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    """Distinct values, null included."""
    return df.select(column(name)).distinct()


def distinct_sorted(df: DataFrame, name: str) -> DataFrame:
    """Distinct values in order, null first."""
    return distinct_values(df, name).orderBy(column(name).asc_nulls_first())


def distinct_first_seen(df: DataFrame, name: str, order_by: str) -> DataFrame:
    """Distinct values with the place of their first row, in that order."""
    first = df.groupBy(column(name)).agg(F.min(column(order_by)).alias("first_seen"))
    return first.orderBy("first_seen")


def distinct_count(name: str) -> Column:
    """Aggregate: number of distinct values, where null is one of them."""
    value = column(name)
    return (F.countDistinct(value) + F.coalesce(F.max(value.isNull().cast("bigint")), F.lit(0))).cast("bigint")


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


Key = str | Sequence[str]


def _key_counts(left: DataFrame, right: DataFrame, left_key: Key, right_key: Key) -> DataFrame:
    """Rows per key on both sides from one shuffle, added up on the map side; no join.

    ``present`` tells whether no part of the key is null, that is, whether the key can match at all.
    """

    def side(df: DataFrame, key: Key, l: int, r: int) -> DataFrame:
        parts = [column(k).alias(f"k{i}") for i, k in enumerate([key] if isinstance(key, str) else key)]
        return df.select(*parts, F.lit(l).alias("l"), F.lit(r).alias("r"))

    both = side(left, left_key, 1, 0).union(side(right, right_key, 0, 1))
    keys = both.columns[:-2]
    present = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return both.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).withColumn("present", present)


def _as_metrics(totals: DataFrame) -> DataFrame:
    return totals.unpivot([], [column(c) for c in totals.columns], "metric", "value")


def reconcile(left: DataFrame, right: DataFrame, left_key: Key, right_key: Key) -> DataFrame:
    """How well two tables match on a key, as ``(metric, value)``. Null is one key and matches nothing."""
    present = F.col("present")

    def rows(condition: Column, value: Column | int = 1) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")

    return _as_metrics(
        _key_counts(left, right, left_key, right_key).agg(
            rows(F.lit(True), F.col("l")).alias("left_rows"),
            rows(F.lit(True), F.col("r")).alias("right_rows"),
            rows(F.col("l") > 0).alias("left_keys"),
            rows(F.col("r") > 0).alias("right_keys"),
            rows(present & (F.col("l") > 0) & (F.col("r") > 0)).alias("matched_keys"),
            rows(~present | (F.col("r") == 0), F.col("l")).alias("left_only_rows"),
        )
    )


def fanout(left: DataFrame, right: DataFrame, left_key: Key, right_key: Key) -> DataFrame:
    """What a left join would do to the number of rows, without doing it: ``(metric, value)``."""
    matches = F.when(F.col("present"), F.greatest(F.col("r"), F.lit(1))).otherwise(1)
    total = F.coalesce(F.sum("l"), F.lit(0)).cast("bigint")
    joined = F.coalesce(F.sum(F.col("l") * matches), F.lit(0)).cast("bigint")
    several = F.col("present") & (F.col("l") > 0) & (F.col("r") > 1)
    return _as_metrics(
        _key_counts(left, right, left_key, right_key).agg(
            total.alias("rows_in"),
            joined.alias("rows_out"),
            (joined - total).alias("rows_added"),
            F.count(F.when(several, 1)).alias("keys_with_several_matches"),
        )
    )


def sort_rows(df: DataFrame, name: str, ties: Sequence[str], ascending: bool = True) -> DataFrame:
    """Sort by a column, nulls last.

    ``ties`` makes the order total. It also lets the range partitioning cut through rows that share one
    value, which would otherwise all meet in one task.
    """
    value = column(name)
    first = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return df.orderBy(first, *[column(t) for t in ties])


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int = fv.PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 0) of a total order, at any depth, in order.

    A page near the start takes one scan; a deep one is found by counts of key ranges (``selection.rows_at``), and only its range is sorted. An order of expressions
    that are no columns numbers the rows by range partitions instead. ``page_after`` and ``page_by_id`` find a page without either, where a key or row numbers are at hand.
    """
    found = rows_at(df, order, number * size, size)
    if found is not None:
        return found
    numbered = with_row_id(df, order, "__row")
    return page_by_id(numbered, number, size, "__row").orderBy("__row").drop("__row")


def page_after(df: DataFrame, key: str, last, size: int = fv.PAGE_SIZE) -> DataFrame:
    """The page that follows a key. The filter reaches the scan, so any depth costs the same."""
    rows = df if last is None else df.where(column(key) > F.lit(last))
    return rows.orderBy(column(key)).limit(size)


def page_by_id(numbered: DataFrame, number: int, size: int = fv.PAGE_SIZE, name: str = "ID") -> DataFrame:
    """Any page of a table that carries contiguous row numbers, as a range filter."""
    low = number * size
    return numbered.where((column(name) >= low) & (column(name) < low + size))


def page_state(df: DataFrame, number: int, size: int = fv.PAGE_SIZE) -> DataFrame:
    """Rows and pages in total, and whether there is a page before and after page ``number``."""
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"),
        F.ceil(rows / F.lit(size)).cast("bigint").alias("pages"),
        (F.lit(number) > 0).alias("has_previous"),
        (rows > (number + 1) * size).alias("has_next"),
    )
