"""Checks of scenario records that arrive as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.functions import fixed_values as fv
from prepkit.functions.values import is_plain_number, number_of, plain_number
from prepkit.operators.columns import column


def field_error(name: str, low: float | None = None, high: float | None = None) -> Column:
    """The first rule a field breaks, or null: it must not be empty and must be a decimal number.

    A range is checked only when given. Blank, hexadecimal, infinite and NaN texts are not numbers here.
    """
    value = column(name)
    required = F.length(F.coalesce(value, F.lit(""))) == 0
    problem = F.when(required, fv.REQUIRED_MESSAGE).when(~is_plain_number(value), fv.NUMBER_MESSAGE)
    if low is not None and high is not None:
        problem = problem.when(~plain_number(value).between(low, high), f"Must be between {low:g} and {high:g}")
    return problem


def check_records(
    df: DataFrame, fields: Sequence[str], low: float | None = None, high: float | None = None
) -> DataFrame:
    """Add ``reason``: the broken rules of all fields, or null. One bad field fails the whole record."""
    # A field without a problem gives null, which concat passes on and concat_ws leaves out.
    found = [F.concat(F.lit(f + ": "), field_error(f, low, high)) for f in fields]
    return df.withColumn("reason", F.nullif(F.concat_ws("; ", *found), F.lit("")))


def gate(df: DataFrame, fields: Sequence[str], **limits: float) -> tuple[DataFrame, DataFrame]:
    """Split records into valid ones, with numbers in place of texts, and rejected ones with a reason."""
    checked = check_records(df, fields, **limits)
    valid = checked.where(F.col("reason").isNull()).drop("reason")
    return (
        valid.withColumns({f: number_of(column(f)) for f in fields}),
        checked.where(F.col("reason").isNotNull()),
    )
