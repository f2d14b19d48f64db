"""Text functions, all built from native Spark expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from prepkit.functions import fixed_values as fv


_SPECIAL = re.compile(r"[\\^$.|?*+()\[\]{}]")


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def split_part_exact(value: Column | str, separator: str, index: int) -> Column:
    """Part ``index`` of a split on a literal separator; null when there is no such part."""
    return F.get(F.split(_column(value), re.escape(separator), index + 2), index)


def split_struct_exact(value: Column | str, separator: str, names: Sequence[str]) -> Column:
    """Split into exactly ``len(names)`` named parts: missing parts are null, surplus parts are dropped."""
    parts = F.split(_column(value), re.escape(separator), len(names) + 1)
    return F.struct(*[F.get(parts, i).alias(name) for i, name in enumerate(names)])


def strip_chars(value: Column | str) -> Column:
    """Remove any white space at both ends, tabs and no-break spaces included."""
    return F.regexp_replace(_column(value), fv.WHITESPACE_ENDS, "")


def apply_rules(value: Column | str, rules: Iterable[tuple[str, str]], whole_word: bool = False) -> Column:
    """Replace all matches of each rule in turn.

    With ``whole_word`` a rule that starts and ends with a letter matches whole words only; by default
    it also matches inside longer words (``standard`` loses its ``and``). A rule without any special sign
    means the same as plain text, which is replaced several times faster.
    """

    def step(acc: Column, rule: tuple[str, str]) -> Column:
        pattern, replacement = rule
        if whole_word and pattern[0].isalpha() and pattern[-1].isalpha():
            return F.regexp_replace(acc, rf"\b{pattern}\b", replacement)
        if not _SPECIAL.search(pattern) and not _SPECIAL.search(replacement):
            return F.replace(acc, F.lit(pattern), F.lit(replacement))
        return F.regexp_replace(acc, pattern, replacement)

    return reduce(step, rules, _column(value))


def contains_text(value: Column | str, pattern: str) -> Column:
    """Regular expression search."""
    return _column(value).rlike(pattern)


def append_when(condition: Column, value: Column | str, suffix: str) -> Column:
    """Append a literal where the condition holds; a null condition keeps the value, a null value stays null."""
    value = _column(value)
    return F.when(condition, F.concat(value, F.lit(suffix))).otherwise(value)


def title_case(value: Column | str) -> Column:
    """Upper-case the first letter of each run of letters and digits, lower-case the rest."""
    pieces = F.regexp_extract_all(F.lower(_column(value)), F.lit(fv.WORDS_AND_GAPS), 1)
    capital = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
    return F.array_join(capital, "")


def slug(value: Column | str) -> Column:
    """One hyphen for each run of white space."""
    return F.regexp_replace(_column(value), r"[\s\p{Z}]+", "-")


def underscore(value: Column | str) -> Column:
    """One underscore for each single space."""
    return F.replace(_column(value), F.lit(" "), F.lit("_"))


def prefix_key(prefix: str, value: Column | str) -> Column:
    """Put a group tag before a key."""
    return F.concat(F.lit(prefix), _column(value))


def default_text(value: Column | str, default: str = fv.MISSING_TEXT) -> Column:
    """Replace a null or empty text."""
    return F.coalesce(F.nullif(_column(value), F.lit("")), F.lit(default))


def fixed_decimals(value: Column | str, digits: int = 2) -> Column:
    """Number with a fixed count of decimals; null stays null."""
    # A null is printed as the first letters of "null", which no number is. Taking that back reads the value
    # once, where a condition on the value would compute it twice.
    printed = F.format_string(f"%.{digits}f", _column(value).cast("double"))
    return F.nullif(printed, F.lit("null"[:digits]))


def number_text(value: Column | str) -> Column:
    """A double as a browser prints it: ``5`` and not ``5.0``, no exponent below 1e21."""
    value = _column(value).cast("double")
    shortest = value.cast("string")
    plain = F.when(
        F.abs(value) >= 1e16, value.try_cast("decimal(38,0)").cast("string")
    ).otherwise(shortest.try_cast("decimal(38,22)").cast("string"))
    trimmed = F.regexp_replace(plain, r"[.]?0+$", "")
    exponent = F.regexp_replace(
        F.regexp_replace(F.lower(shortest), r"[.]0e", "e"), r"e([0-9])", "e+$1"
    )
    size = F.abs(value)
    return (
        F.when(value.isNull() | F.isnan(value) | (size == float("inf")), shortest)
        .when((size < 1e15) & (value == F.floor(value)), value.cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), shortest)
        .when((size >= 1e21) | (size < 1e-6), exponent)
        .when(size >= 1e16, plain)
        .otherwise(trimmed)
    )


def display_text(value: Column | str, data_type: str) -> Column:
    """Cell text as the table view searches it: null is the empty text."""
    value = _column(value)
    if data_type == "float":
        value = value.cast("string").cast("double")  # 0.1 stays 0.1
    text = number_text(value) if data_type in ("double", "float") else value.cast("string")
    return F.coalesce(text, F.lit(""))
