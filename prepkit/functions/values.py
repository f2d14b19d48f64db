"""Number and timestamp functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prepkit.functions import fixed_values as fv
from prepkit.functions.text import strip_chars


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def checked_timestamp(value: Column | str, strict: bool = True) -> Column:
    """Text to a timestamp without zone; takes a date, or date and time with a space or ``T``.

    A text that cannot be read stops the job when ``strict``, else it becomes null.
    """
    value = _column(value)
    parsed = value.try_cast("timestamp_ntz")
    if not strict:
        return parsed
    failure = F.raise_error(F.concat(F.lit("not a timestamp: "), value)).cast("timestamp_ntz")
    return F.when(value.isNotNull() & parsed.isNull(), failure).otherwise(parsed)


def scale(value: Column | str, factor: float = fv.VALUE_FACTOR) -> Column:
    """Multiply by a constant, as a double."""
    return _column(value).cast("double") * F.lit(float(factor))


def modulo(value: Column | str, modulus: int = fv.COUNTY_MODULUS) -> Column:
    """Remainder that is never negative; the type of the column stays."""
    return F.pmod(_column(value), F.lit(modulus))


def is_plain_number(value: Column | str) -> Column:
    """True for a decimal number, blanks around it allowed; false for null, blank, hex, ``5d`` and ``NaN``.

    The forms a double cast would take beyond that (``5d``, ``NaN``, ``Infinity``) are ruled out by the pattern.
    """
    return F.coalesce(_column(value).rlike(fv.PADDED_DECIMAL_PATTERN), F.lit(False))


def number_of(value: Column | str) -> Column:
    """A text as a double; white space that the cast itself does not skip is taken off only when it has to be."""
    value = _column(value)
    return F.coalesce(value.try_cast("double"), strip_chars(value).try_cast("double"))


def plain_number(value: Column | str) -> Column:
    """The decimal number in a text as a double; null where ``is_plain_number`` is false."""
    return F.when(is_plain_number(value), number_of(value))


def unit_hash(*parts: Column | str, second: bool = False) -> Column:
    """A number in [0, 1) that depends only on the given values; ``second`` takes another one from the same digest.

    Unlike ``rand`` it does not depend on partitioning, so a task that runs again gives the same numbers.
    52 bits of the digest are used, which a double holds exactly.
    """
    digest = F.md5(F.concat_ws("|", *[_column(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 14 if second else 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
