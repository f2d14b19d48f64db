"""Type inference from text cells and the common type of columns that are stacked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions import fixed_values as fv

_INTEGERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_FLOATS = [T.FloatType(), T.DoubleType()]


def column_types(
    cell: Column | str,
    empty: str = "string",
    nulls: Sequence[str] = ("",),
    truths: Sequence[str] = ("true", "false"),
) -> Column:
    """Aggregate: the narrowest of long, double, boolean and string that takes every cell that is no null marker.

    Each cell is looked at once and gives one bit for its kind; the kinds of a column are the bits put
    together. ``empty`` is the type of a column without any value.
    """
    cell = F.col(cell) if isinstance(cell, str) else cell
    whole, fraction, truth, text = 1, 2, 4, 8
    kind = (
        F.when(cell.isNull() | cell.isin(list(nulls)), None)
        .when(cell.rlike(fv.INTEGER_PATTERN) & cell.try_cast("bigint").isNotNull(), whole)
        .when(cell.rlike(fv.FLOAT_PATTERN), fraction)
        .when(cell.isin(list(truths)), truth)
        .otherwise(text)
    )
    kinds = F.bit_or(kind)
    return (
        F.when(kinds.isNull(), empty)
        .when(kinds == whole, "bigint")
        .when(kinds.isin(fraction, whole | fraction), "double")
        .when(kinds == truth, "boolean")
        .otherwise("string")
    )


#: Digits that hold every value of a whole-number type.
_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def _with_decimal(left: T.DataType, right: T.DataType) -> T.DataType:
    """A decimal that holds both sides; a float on one side, or more digits than a decimal has, make a double."""
    sides = []
    for kind in (left, right):
        if isinstance(kind, T.DecimalType):
            sides.append((kind.precision - kind.scale, kind.scale))
        elif kind.simpleString() in _DIGITS:
            sides.append((_DIGITS[kind.simpleString()], 0))
        elif kind in _FLOATS:
            return T.DoubleType()
        else:
            raise TypeError(f"no common type for {left.simpleString()} and {right.simpleString()}")
    whole, scale = (max(s) for s in zip(*sides))
    return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()


def common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type both sides are cast to when they are stacked."""
    if left == right:
        return left
    for one, other in ((left, right), (right, left)):
        if isinstance(one, T.NullType):
            return other
        if isinstance(one, T.StringType):
            return T.StringType()
        if isinstance(one, T.BooleanType) and isinstance(other, T.NumericType):
            return other
        if isinstance(one, T.DateType) and isinstance(other, (T.TimestampType, T.TimestampNTZType)):
            return other
        if isinstance(one, T.TimestampNTZType) and isinstance(other, T.TimestampType):
            return other
    if isinstance(left, T.DecimalType) or isinstance(right, T.DecimalType):
        return _with_decimal(left, right)
    if left in _INTEGERS and right in _INTEGERS:
        return max(left, right, key=_INTEGERS.index)
    if left in _INTEGERS + _FLOATS and right in _INTEGERS + _FLOATS:
        return T.DoubleType()
    raise TypeError(f"no common type for {left.simpleString()} and {right.simpleString()}")
