"""CSV records from byte ranges of files whose cells hold line breaks.

Where a line lies, inside or outside of a quoted cell, depends on all quotes before it. Each range of a file is read under both assumptions and gives one narrow row: the
parity of its quotes, whether its lines are well formed under either, and whether it has any that is not blank. Prefix sums over these rows say which holds, range by range, so records are
put together within tasks and only those that a border of ranges cuts meet in a shuffle. No task reads a whole file.

The reading is sound where quotes stand only around cells and doubled inside of them. A file with another quote, such as one for inches in a cell without quotes, is found by
the same pass; it is left to Spark's parser, which reads such a file with one task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.session import stage

# The helpers below travel to the executors with the task, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ranges whose states are sent to every task, some 100 bytes each; beyond them lines and states are joined by a shuffle.
SENT_RANGES = 100_000
_REST = r'(?:[^",]*|"(?:[^"]|"")*")'
_OPEN = r'"(?:[^"]|"")*'
#: A line that starts outside of a quoted cell, and one that starts inside.
_WELL_FORMED = (
    rf"^(?:{_REST},)*(?:{_REST}|{_OPEN})\r?$",
    rf'^(?:[^"]|"")*(?:"(?:,(?:{_REST},)*(?:{_REST}|{_OPEN}))?\r?)?$',
)
_NAMED = "uri string, start bigint"


@dataclass(frozen=True)
class Ranges:
    """Files to be read by ranges: ``states`` holds ``(uri, start, inside, head)`` for every range that has lines, ``head`` where the
    first line that is not blank lies; ``number`` how many."""

    states: DataFrame
    number: int


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines with the range they start in, in order within a task; carriage returns stay, as they may belong to a cell."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start")
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of a batch that belong to one range each."""
    starts = batch.column("start").to_numpy()
    files = batch.column("uri").dictionary_encode().indices.to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(starts) != 0) | (np.diff(files) != 0)) + 1), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if low < high:
            yield (batch.column("uri")[int(low)].as_py(), int(starts[low])), batch.slice(low, high - low)


def _odd(values: pa.Array) -> np.ndarray:
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False) & 1


def _blank(values: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(values, r"^[\x00-\x20]*$").to_numpy(zero_copy_only=False)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: parity of its quotes, and whether a line is malformed if the range starts outside or inside of a cell."""

    def row(key, parity: int, bad: list[bool], filled: bool) -> pa.RecordBatch:
        numbers = {"start": pa.array([key[1]], pa.int64()), "parity": pa.array([parity], pa.int32())}
        return pa.RecordBatch.from_pydict({"uri": [key[0]], **numbers, "bad0": [bad[0]], "bad1": [bad[1]], "filled": [filled]})

    now, parity, bad, filled = None, 0, [False, False], False
    for batch in batches:
        for key, part in _runs(batch):
            if key != now:
                if now:
                    yield row(now, parity, bad, filled)
                now, parity, bad, filled = key, 0, [False, False], False
            values = part.column("value")
            odd = _odd(values)
            before = (parity + np.cumsum(odd) - odd) & 1  # relative to the state at the start of the range
            good = [pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False) for pattern in _WELL_FORMED]
            for state in (0, 1):
                here = before ^ state
                bad[state] = bad[state] or not np.where(here == 0, good[0], good[1]).all()
            parity = (parity + int(odd.sum())) & 1
            filled = filled or not _blank(values).all()
    if now:
        yield row(now, parity, bad, filled)


def ranges(spark: SparkSession, path: str | Sequence[str]) -> Ranges | None:
    """The state at the start of every range; none if a file has quotes that only a parser can place."""
    found = _lines(spark, path).mapInArrow(_summaries, f"{_NAMED}, parity int, bad0 boolean, bad1 boolean, filled boolean")
    before = Window.partitionBy("uri").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    head = F.min(F.when(F.col("filled"), F.col("start"))).over(Window.partitionBy("uri"))
    inside = F.coalesce(F.bit_xor("parity").over(before), F.lit(0))
    states = stage(found.withColumns({"inside": inside, "head": F.coalesce(F.col("start") == head, F.lit(False))}), "csv-ranges")
    # A file that ends inside of a cell is malformed too.
    ends = states.groupBy("uri").agg((F.bit_xor("parity") == 1).alias("open"))
    checks = states.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("inside") == 0, F.col("bad0")).otherwise(F.col("bad1"))).alias("bad")).first()
    if checks["bad"] or ends.agg(F.max("open")).first()[0]:
        return None
    return Ranges(states.select("uri", "start", "inside", "head"), checks["n"])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of ranges in order: whole ones, and pieces (``piece`` 0: the end or middle of a record begun before, 1: its beginning) of those that a border cuts."""

    def made(key, values, firsts: Sequence[bool], piece: int | None = None) -> pa.RecordBatch:
        n = len(values)
        columns = [[key[0]] * n, pa.array([key[1]] * n, pa.int64()), pa.array([piece] * n, pa.int32()), pa.array(firsts, pa.bool_()), pa.array(values, pa.binary())]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["uri", "start", "piece", "first", "value"])

    # The lines held of a record that is not complete, whether it began in this range, and whether it is the file's first.
    now, held, begun, first = None, [], False, False
    inside, fresh = 0, False
    for batch in batches:
        for key, part in _runs(batch):
            if key != now:
                if held:
                    yield made(now, [b"\n".join(held)], [first], int(begun))
                now, held, begun, first = key, [], False, False
                inside, fresh = part.column("inside")[0].as_py(), part.column("head")[0].as_py()
            values = part.column("value")
            after = (inside + np.cumsum(_odd(values))) & 1
            before = np.concatenate([[inside], after[:-1]])
            inside = int(after[-1])
            alone = (before == 0) & (after == 0)
            keep = alone & ~_blank(values)
            begins = keep | ((before == 0) & ~alone)
            header = int(np.argmax(begins)) if fresh and begins.any() else -1
            fresh = fresh and header < 0
            if keep.any():
                yield made(key, values.filter(pa.array(keep)), np.flatnonzero(keep) == header)
            whole: list[tuple[bytes, bool]] = []
            for i in np.flatnonzero(~alone):  # lines that share a record with others
                if not before[i]:
                    begun, first = True, int(i) == header
                held.append(values[int(i)].as_py())
                if not after[i]:
                    if begun:
                        whole.append((b"\n".join(held), first))
                    else:
                        yield made(key, [b"\n".join(held)], [False], 0)
                    held, begun, first = [], False, False
            if whole:
                yield made(key, *map(list, zip(*whole)))
    if held:
        yield made(now, [b"\n".join(held)], [first], int(begun))


def records(spark: SparkSession, path: str | Sequence[str], found: Ranges) -> DataFrame:
    """``(uri, first, value)``: every record of the files as text, without blank lines; ``first`` marks a file's header."""
    lines = _lines(spark, path)
    on = ["uri", "start"]
    if found.number <= SENT_RANGES:
        placed = lines.join(F.broadcast(found.states), on)
    else:
        placed = lines.withColumn("place", F.monotonically_increasing_id()).join(found.states.hint("merge"), on).sortWithinPartitions(*on, "place").drop("place")
    parts = placed.select("value", *on, "inside", "head").mapInArrow(_assembled, f"{_NAMED}, piece int, first boolean, value binary")
    whole = parts.filter("piece IS NULL").select("uri", "first", "value")
    # At most two pieces per range: the end of a record begun before stands ahead of the beginning of one that goes on.
    order = Window.partitionBy("uri").orderBy("start", "piece")
    pieces = parts.filter("piece IS NOT NULL").withColumn("n", F.sum("piece").over(order))
    joined = pieces.groupBy("uri", "n").agg(F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", "piece", "value"))).alias("v"))
    text = F.array_join(F.transform("v", lambda x: x["value"].cast("string")), "\n")
    out = whole.withColumn("value", F.col("value").cast("string")).unionByName(joined.select("uri", "first", text.alias("value")))
    bare = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return out.withColumn("value", bare)


def parsed(rows: DataFrame, schema: T.StructType, options: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Cells of the records that are no headers, with the columns of ``rows`` to keep."""
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    # Each record is a text of its own; line breaks in its cells stay as they are.
    cells = F.from_csv("value", fields, {k: v for k, v in options.items() if k != "header"} | {"multiLine": "true"})
    return rows.filter("NOT first").select(*keep, cells.alias("cells")).select(*keep, "cells.*")
