"""What changed between two versions of a table, cell by cell.

Keys are placed by a hash; the leading bits of it name a range, further bits the ranges inside that one: a tree of digests. A range's digest
is the difference of sums of row hashes of both versions, added up on the map side, so only one row per range and task is shuffled. Where
the sums cancel out, the range is equal and none of its rows is looked at again; the other ranges are split until few rows are left,
and only those are shuffled by key and compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.operators.columns import column, require
from prepkit.session import stage

#: Bits of a level of the tree: so many ranges (4096) at first, and in each of them.
BITS = 12
LEVELS = 3
#: Ranges that hold no more rows than these are not split. It decides the work, never the result.
ROWS_AT_ONCE = 1_000_000


def _hashed(names: Sequence[str]) -> list[Column]:
    """Columns to hash: values, and which are null, since the hash functions pass over nulls."""
    return [column(n) for n in names] + [column(n).isNull() for n in names]


def _versions(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of both versions: sign (1 old, -1 new), place of the key, keys and values as structs."""

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(
            F.lit(sign).cast("bigint").alias("sign"), F.xxhash64(*_hashed(keys)).alias("place"), F.struct(*[column(k) for k in keys]).alias("k"),
            F.struct(*[column(v) for v in values]).alias("v"), F.xxhash64(*_hashed([*keys, *values])).alias("h"), F.hash(*_hashed([*values, *keys])).alias("h2"),
        )

    return side(old, 1).unionByName(side(new, -1))


def _range(level: int) -> Column:
    return F.shiftrightunsigned("place", 64 - BITS * (level + 1))


def _within(rows: DataFrame, ranges: DataFrame, level: int) -> DataFrame:
    """Rows that lie in the ranges of a level; the table of ranges is written, so Spark knows its size."""
    return rows.withColumn("range", _range(level)).join(ranges.select("range"), "range", "left_semi").drop("range")


def differing_ranges(rows: DataFrame, level: int) -> DataFrame:
    """Ranges of a level whose versions differ, with the number of their rows in both."""
    # Halves of a hash, so that sums of two thousand million rows of a range stay whole numbers.
    halves = {"low": F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)), "high": F.shiftrightunsigned("h", 32), "other": F.col("h2").cast("bigint"), "one": F.lit(1)}
    sums = [F.sum(F.col("sign") * half).alias(name) for name, half in halves.items()]
    equal = (F.col("low") == 0) & (F.col("high") == 0) & (F.col("other") == 0) & (F.col("one") == 0)
    return rows.groupBy(_range(level).alias("range")).agg(*sums, F.count(F.lit(1)).alias("n")).filter(~equal).select("range", "n")


def cell_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], levels: int = LEVELS, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """Keys with ``change``, ``column``, ``old`` and ``new``: one row per changed cell, one per added or removed row.

    Both versions need the same columns and types, in any order; ``old`` and ``new`` hold the values as text, and are null, as ``column`` is, for
    added and removed rows. Nulls equal nulls, in keys too. Rows that share a key are paired in the order of their values.
    Two ranges that differ count as equal only if sums of a 64-bit and of a 32-bit hash agree.
    """
    require(old, keys)
    if sorted(old.dtypes) != sorted(new.dtypes):
        raise ValueError(f"versions differ in columns or types: {sorted(set(old.dtypes) ^ set(new.dtypes))}")
    values = [c for c in old.columns if c not in keys]
    if not keys or {"change", "column", "old", "new"} & set(keys):
        raise ValueError("keys are needed, under names other than change, column, old and new")
    every = rows = _versions(old, new, keys, values)
    before = None
    for level in range(levels):
        ranges = stage(differing_ranges(rows, level), "differing-ranges")
        left = ranges.agg(F.sum("n").alias("n")).first()["n"] or 0
        rows = _within(every, ranges, level)
        if left <= rows_at_once or (before is not None and 2 * left > before):
            break
        before = left
    return _compared(rows, keys, values)


def _compared(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Cells of the rows of both versions, paired by key."""
    number = F.row_number().over(Window.partitionBy("k", "sign").orderBy("v", "h"))
    near = rows.repartition("k").withColumn("copy", number)
    paired = near.groupBy("k", "copy").agg(
        F.max(F.when(F.col("sign") == 1, F.col("v"))).alias("o"), F.max(F.when(F.col("sign") == -1, F.col("v"))).alias("n"),
        F.sum("sign").alias("left_over"),
    )
    none = F.lit(None).cast("string")

    def cell(name: str) -> Column:
        before, after = F.col("o").getField(name), F.col("n").getField(name)
        return F.struct(F.lit(name).alias("column"), before.cast("string").alias("old"), after.cast("string").alias("new"), (~before.eqNullSafe(after)).alias("differs"))

    lone = F.array(F.struct(none.alias("column"), none.alias("old"), none.alias("new"), F.lit(True).alias("differs")))
    cells = F.filter(F.array(*[cell(v) for v in values]), lambda c: c["differs"]) if values else F.slice(lone, F.lit(1), F.lit(0))
    change = F.when(F.col("left_over") == 1, "removed").when(F.col("left_over") == -1, "added").otherwise("changed")
    out = paired.select("k", change.alias("change"), F.explode(F.when(F.col("left_over") == 0, cells).otherwise(lone)).alias("c"))
    return out.select(*[F.col("k").getField(k).alias(k) for k in keys], "change", "c.column", "c.old", "c.new")
