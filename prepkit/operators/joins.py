"""Equi-joins that keep clear names and hold up when one key has many of the rows.

Spark picks the physical join. Adaptive execution splits a skewed left side of left, semi and anti joins and either side of an
inner join, if both sides come straight from a shuffle. So a side that was aggregated per key is written first, and a left join
whose right side repeats keys is made of an inner join and the left rows without a match. No share of the rows or number of
keys switches between ways.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions import fixed_values as fv
from prepkit.operators.columns import column, require
from prepkit.operators.row_id import with_row_id
from prepkit.session import stage


def _keys(on: Sequence[str] | Sequence[tuple[str, str]]) -> tuple[list[str], list[str]]:
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    return [left for left, _ in pairs], [right for _, right in pairs]


def _require_keys(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> None:
    """Keys must exist and be of one type; whole numbers may differ in width."""
    require(left, left_keys)
    require(right, right_keys)
    for one, other in zip(left_keys, right_keys):
        kinds = left.schema[one].dataType, right.schema[other].dataType
        if kinds[0] != kinds[1] and not all(isinstance(k, T.IntegralType) for k in kinds):
            raise TypeError(f"join keys {one} and {other} differ in type: {kinds}")


def _prepared(left: DataFrame, right: DataFrame, left_keys, right_keys, suffix: str) -> DataFrame:
    """The right side with its keys under the left names and clashing other columns under a suffix."""
    _require_keys(left, right, left_keys, right_keys)
    names = dict(zip(right_keys, left_keys))
    out = []
    for c in right.columns:
        if c in names:
            out.append(column(c).alias(names[c]))
        elif c not in left.columns:
            out.append(column(c))
        elif c + suffix in left.columns or c + suffix in right.columns:
            raise ValueError(f"column {c}{suffix} exists already")
        else:
            out.append(column(c).alias(c + suffix))
    return right.select(*out)


def _distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys once each, without nulls; written, so that a join with them can be split."""
    return stage(df.select(*map(column, keys)).dropna("any").distinct(), "join-keys")


def left_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | Sequence[tuple[str, str]],
    suffix: str = fv.RIGHT_SUFFIX,
    unique: bool = False,
) -> DataFrame:
    """All left rows with every match; only the left keys stay, clashing right columns get a suffix.

    A left join cannot split its right side, so matches come from an inner join, which splits both, and the other left rows from
    an anti join with the distinct right keys. Both read the left side: stage one that is costly to make. ``unique`` says
    that the right side has one row per key; then it is one plain join.
    """
    left_keys, right_keys = _keys(on)
    right = _prepared(left, right, left_keys, right_keys, suffix)
    if unique:
        return left.join(right, left_keys, "left").select(*_order(left, right))
    matched = left.join(right, left_keys, "inner").select(*_order(left, right))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name not in left.columns]
    alone = left.join(_distinct_keys(right, left_keys), left_keys, "left_anti").select(*map(column, left.columns), *missing)
    return matched.unionByName(alone)


def _order(left: DataFrame, right: DataFrame) -> list[Column]:
    return [column(c) for c in left.columns + [c for c in right.columns if c not in left.columns]]


def inner_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | Sequence[tuple[str, str]],
    suffix: str = fv.RIGHT_SUFFIX,
) -> DataFrame:
    """Matching rows; only the left keys stay. Adaptive execution can split both sides."""
    left_keys, right_keys = _keys(on)
    right = _prepared(left, right, left_keys, right_keys, suffix)
    return left.join(right, left_keys, "inner").select(*_order(left, right))


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str] | Sequence[tuple[str, str]]) -> DataFrame:
    """Left join to a table with one row per key, such as totals that were just added up per key. It is written before."""
    left_keys, right_keys = _keys(on)
    right = stage(_prepared(left, right, left_keys, right_keys, fv.RIGHT_SUFFIX), "lookup")
    return left.join(right, left_keys, "left").select(*_order(left, right))


def _membership(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    left_keys, right_keys = _keys(on)
    _require_keys(left, right, left_keys, right_keys)
    # One row per key: partial aggregation removes repeated right keys before the shuffle.
    renamed = right.select(*[column(r).alias(k) for k, r in zip(left_keys, right_keys)])
    return left.join(_distinct_keys(renamed, left_keys), left_keys, how)


def semi_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Left rows whose key occurs on the right; a null key does not match."""
    return _membership(left, right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Left rows whose key does not occur on the right; a row with a null key stays."""
    return _membership(left, right, on, "left_anti")


def pair_by_position(left: DataFrame, right: DataFrame, order_left: str, order_right: str) -> DataFrame:
    """Pair the n-th row of one ordered list with the n-th row of the other, cut to the shorter list."""
    numbered = with_row_id(right, [order_right], "position")
    return inner_join(with_row_id(left, [order_left], "position"), numbered, ["position"])
