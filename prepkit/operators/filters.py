"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.functions.text import display_text
from prepkit.operators.columns import column


def equals(df: DataFrame, name: str, value) -> DataFrame:
    """Rows whose column equals a constant; null rows go."""
    return df.where(column(name) == F.lit(value))


def suffix_not_contains(name: str, suffix: str, pattern: str) -> Column:
    """Text ends with a suffix and does not contain a pattern."""
    return column(name).endswith(suffix) & ~column(name).rlike(pattern)


def equals_ignore_case(name: str, value: str) -> Column:
    """Equality without regard to case; null counts as the empty text."""
    return F.lower(F.coalesce(column(name), F.lit(""))) == F.lower(F.lit(value))


def search(df: DataFrame, names: Sequence[str], term: str | None) -> DataFrame:
    """Rows where any of the columns, as displayed, contains the term; an empty term keeps all rows."""
    if not term:
        return df
    types = dict(df.dtypes)
    hits = [F.contains(F.lower(display_text(column(n), types[n])), F.lower(F.lit(term))) for n in names]
    return df.where(reduce(or_, hits))


def drop_null_rows(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any column. NaN is a value and stays."""
    return df.where(reduce(and_, [column(n).isNotNull() for n in names or df.columns]))
