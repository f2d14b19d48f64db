"""Rows at given places of a total order, found by counting instead of sorting or writing the table.

A sample of keys cuts the order into ranges, one pass counts the rows of each, and only the range that holds the wanted places is looked at again: cut
again while it is large, sorted in the end. Every pass is a scan with a filter that reaches the files and a count per range added up on the map side; nothing is shuffled but the last
range's rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.operators.columns import column

#: Places from the start that each task can hold in a heap: such a page needs one scan.
NEAR_ROWS = 2_000
#: Rows of a range that are sorted at once.
SORTED_ROWS = 200_000
#: Keys sampled in a pass, and ranges they are made into.
SAMPLED_KEYS, RANGES = 2_000, 64
_SORTED = re.compile(r"^Column<'(.*) (ASC|DESC) NULLS (FIRST|LAST)'>$", re.DOTALL)


@dataclass(frozen=True)
class Key:
    """One column of an order."""

    name: str
    ascending: bool = True
    nulls_first: bool = True
    floating: bool = False

    def _more(self, value, equal: bool = False) -> Column:
        """Whether a row's value is larger. NaN, the largest, is asked for itself: statistics of files and caches leave it out."""
        cell = column(self.name)
        if self.floating and math.isnan(value):
            return F.isnan(cell) if equal else F.lit(False)
        out = cell >= F.lit(value) if equal else cell > F.lit(value)
        return out | F.isnan(cell) if self.floating else out

    def _less(self, value, equal: bool = False) -> Column:
        cell = column(self.name)
        if self.floating and math.isnan(value):
            return cell.isNotNull() if equal else ~F.isnan(cell) & cell.isNotNull()
        return cell <= F.lit(value) if equal else cell < F.lit(value)

    def equals(self, value) -> Column:
        cell = column(self.name)
        return F.coalesce(F.isnan(cell), F.lit(False)) if self.floating and value is not None and math.isnan(value) else cell.eqNullSafe(F.lit(value))

    def before(self, value) -> Column:
        """Whether a row's value comes ahead of the given one."""
        cell = column(self.name)
        if value is None:
            return F.lit(False) if self.nulls_first else cell.isNotNull()
        ahead = F.coalesce(self._less(value) if self.ascending else self._more(value), F.lit(False))
        return cell.isNull() | ahead if self.nulls_first else ahead

    def reach(self, value, lower: bool) -> Column:
        """A simple bound that holds for every row behind (``lower``) or ahead of a value, or at it."""
        if value is None:
            return F.lit(True)
        bound = self._more(value, True) if self.ascending == lower else self._less(value, True)
        return bound | column(self.name).isNull() if self.nulls_first != lower else bound


def keys_of(df: DataFrame, order: Sequence[Column | str]) -> list[Key] | None:
    """The order as keys, none where it has an expression that is no column of ``df``."""
    keys, floating = [], {n for n, kind in df.dtypes if kind in ("double", "float")}
    for item in order:
        if isinstance(item, str):
            keys.append(Key(item, floating=item in floating))
            continue
        found = _SORTED.match(str(item))
        name, direction, nulls = found.groups() if found else (str(item)[8:-2], "ASC", "FIRST")
        if name not in df.columns:
            return None
        keys.append(Key(name, direction == "ASC", nulls == "FIRST", name in floating))
    return keys


def _before(keys: Sequence[Key], values: Sequence) -> Column:
    """Whether a row comes ahead of a key of the order."""
    out = F.lit(False)
    for key, value in reversed(list(zip(keys, values))):
        out = key.before(value) | (key.equals(value) & out)
    return out


def _number(keys: Sequence[Key], cuts: Sequence[Sequence], low: int, high: int) -> Column:
    """How many of the cuts a row does not come ahead of, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(_before(keys, cuts[middle]), _number(keys, cuts, low, middle)).otherwise(_number(keys, cuts, middle + 1, high))


def rows_at(df: DataFrame, order: Sequence[Column | str], first: int, count: int) -> DataFrame | None:
    """The rows at places ``first`` to ``first + count - 1`` of a total order, in that order; none if the order is not one of columns.

    ``df`` must give the same rows at every pass. Rows with equal keys lie in one range, so ties are safe; how they are ordered among themselves is open.
    """
    sorts = [column(k) if isinstance(k, str) else k for k in order]
    if first + count <= NEAR_ROWS:
        return df.orderBy(*sorts).offset(first).limit(count)
    keys = keys_of(df, order)
    if keys is None:
        return None
    names = [k.name for k in keys]
    part, rows = df, None
    while rows is None or rows > SORTED_ROWS:
        drawn = part.select(*map(column, names)).orderBy(F.rand(7)).limit(SAMPLED_KEYS)
        ordered = [tuple(r) for r in drawn.orderBy(*sorts).collect()]
        step = -(-len(ordered) // RANGES) or 1
        cuts = list(dict.fromkeys(ordered[step::step]))
        counted = part.groupBy(_number(keys, cuts, 0, len(cuts)).alias("n")).count().collect()
        counts = {r["n"]: r["count"] for r in counted}
        total = sum(counts.values())
        if first >= total:
            return df.limit(0)
        at, before = 0, 0
        while before + counts.get(at, 0) <= first:
            before += counts.get(at, 0)
            at += 1
        end, upto = at, before + counts.get(at, 0)
        while upto < min(first + count, total):
            end += 1
            upto += counts.get(end, 0)
        # Simple bounds on the first column reach the files; the whole key decides.
        if at > 0:
            part = part.where(keys[0].reach(cuts[at - 1][0], True)).where(~_before(keys, cuts[at - 1]))
        if end < len(cuts):
            part = part.where(keys[0].reach(cuts[end][0], False)).where(_before(keys, cuts[end]))
        first, shrunk = first - before, upto - before
        if rows is not None and shrunk >= rows or shrunk == total:
            break  # ties or a page as wide as the range: no cut makes it smaller
        rows = shrunk
    return part.orderBy(*sorts).offset(first).limit(count)

