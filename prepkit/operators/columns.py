"""Choosing, naming and adding columns. Names are driver-side metadata; the work is one select."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions.text import split_struct_exact, strip_chars


def quoted(name: str) -> str:
    """A column name as one identifier, dots and back-ticks in it included."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """Reference to a column by its literal name."""
    return F.col(quoted(name))


def require(df: DataFrame, names: Iterable[str]) -> None:
    """Raise when one of the names is not a column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {missing}")


def _unique(names: Sequence[str]) -> list[str]:
    twice = sorted(n for n, count in Counter(names).items() if count > 1)
    if twice:
        raise ValueError(f"column name would occur twice: {twice}")
    return list(names)


def select_not(df: DataFrame, suffixes: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """Keep the columns that end with none of the suffixes and start with none of the prefixes."""
    kept = [c for c in df.columns if not c.endswith(tuple(suffixes)) and not c.startswith(tuple(prefixes))]
    return df.select(*[column(c) for c in kept])


def drop_suffix(df: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Drop every column that ends with one of the suffixes, whether a join made the name or not."""
    return select_not(df, suffixes=suffixes)


def drop_strict(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; a missing name is an error."""
    require(df, names)
    return df.drop(*names)


def rename_strict(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns; a missing old name, an empty new name or a duplicate result is an error."""
    require(df, names)
    unnamed = [old for old, new in names.items() if not new]
    if unnamed:
        raise ValueError(f"no new name for: {unnamed}")
    _unique([names.get(c, c) for c in df.columns])
    return df.withColumnsRenamed(names)


def dictionary_names(
    dictionary: DataFrame, columns: Sequence[str], old: str, new: str, order_by: str | None = None
) -> tuple[dict[str, str], list[str]]:
    """The new names that a dictionary table gives to ``columns``, and some old names that are none of them.

    One row per column reaches the driver at most, however long the dictionary is. With ``order_by`` the last row of a
    repeated name wins, otherwise the greatest new name.
    """
    order = column(order_by) if order_by else column(new)
    known = F.when(column(old).isin(list(columns)), column(old))
    last = F.max_by(column(new), F.coalesce(order.cast("string"), F.lit("")) if not order_by else order)
    rows = dictionary.groupBy(known.alias("old")).agg(last.alias("new"), F.min(F.when(known.isNull(), column(old))).alias("other")).collect()
    names = {r["old"]: r["new"] for r in rows if r["old"] is not None}
    return names, [r["other"] for r in rows if r["old"] is None]


def rename_from_dictionary(
    df: DataFrame, dictionary: DataFrame, old: str = "Column", new: str = "New Label", order_by: str | None = None
) -> DataFrame:
    """Rename columns by a dictionary table of old and new names."""
    names, others = dictionary_names(dictionary, df.columns, old, new, order_by)
    require(df, [str(o) for o in others])
    return rename_strict(df, names)


def unnest_struct(df: DataFrame, name: str) -> DataFrame:
    """Replace a struct column by its fields, at the same place."""
    require(df, [name])
    kind = df.schema[name].dataType
    if not isinstance(kind, T.StructType):
        raise TypeError(f"{name} is no struct")
    out, names = [], []
    for c in df.columns:
        fields = kind.names if c == name else [None]
        for field in fields:
            out.append(column(c) if field is None else column(c).getField(field).alias(field))
            names.append(field or c)
    _unique(names)
    return df.select(*out)


def unnest_split(df: DataFrame, name: str, separator: str, names: Sequence[str]) -> DataFrame:
    """Split a text column into exactly these columns, at the same place."""
    return unnest_struct(df.withColumn(name, split_struct_exact(column(name), separator, names)), name)


def rename_all(df: DataFrame, rule: Callable[[str], str]) -> DataFrame:
    """Apply a rule to all names; a collision is an error."""
    return df.toDF(*_unique([rule(c) for c in df.columns]))


def names_upper(df: DataFrame) -> DataFrame:
    """All names in upper case."""
    return rename_all(df, str.upper)


def names_snake(df: DataFrame) -> DataFrame:
    """All names in lower case, spaces as underscores."""
    return rename_all(df, lambda c: c.lower().replace(" ", "_"))


def non_null_counts(df: DataFrame) -> DataFrame:
    """Count of values per column, NaN taken as null, in one pass: ``(column, non_null)``."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    counts = [
        F.count(F.when(~F.isnan(column(c)), column(c)) if c in floats else column(c)).alias(c) for c in df.columns
    ]
    return df.agg(*counts).unpivot([], [column(c) for c in df.columns], "column", "non_null")


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value. One aggregation decides; its result has one row per column."""
    empty = [r["column"] for r in non_null_counts(df).where("non_null = 0").collect()]
    return df.drop(*empty)


def project_labels(df: DataFrame, labels: Sequence[tuple[str, str]]) -> DataFrame:
    """A fixed list of columns under display labels."""
    require(df, [key for key, _ in labels])
    return df.select(*[column(key).alias(label) for key, label in labels])


def visible(df: DataFrame, hidden: Iterable[str]) -> DataFrame:
    """All columns but the hidden ones."""
    hidden = set(hidden)
    return df.select(*[column(c) for c in df.columns if c not in hidden])


def derive_key(df: DataFrame, source: str, target: str) -> DataFrame:
    """Put the lower-cased source column under a new name, last, and drop the source."""
    require(df, [source])
    return df.withColumn(target, F.lower(column(source))).drop(source)


def strip_column(df: DataFrame, name: str) -> DataFrame:
    """Trim a text column in place."""
    return df.withColumn(name, strip_chars(column(name)))


def columns_report(df: DataFrame) -> DataFrame:
    """Position, name and type of each column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")
