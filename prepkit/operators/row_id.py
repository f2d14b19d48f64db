"""Contiguous row numbers without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.operators.columns import column
from prepkit.session import stage

_ROW_BITS = 33  # documented layout of monotonically_increasing_id: partition above, row below


def with_row_id(df: DataFrame, order_by: Sequence[Column | str], name: str = "ID", start: int = 0) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` in the order of ``order_by``, which must be unique.

    The rows are range-partitioned and sorted once, then written with their place (partition, row). The
    number is the place within the partition plus the rows of all partitions before it. Only one count per
    partition is joined back, so there is no second shuffle of the rows.
    """
    keys = [column(k) if isinstance(k, str) else k for k in order_by]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(placed.withColumn("__place", F.monotonically_increasing_id()), "row-id")
    part = F.shiftright("__place", _ROW_BITS)
    sizes = {r["part"]: r["count"] for r in placed.select(part.alias("part")).groupBy("part").count().collect()}
    offset, offsets = start, []
    for p in sorted(sizes):
        offsets.append((p, offset))
        offset += sizes[p]
    # At most one row per shuffle partition: safe to broadcast.
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part bigint, __before bigint"))
    row = F.col("__place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("__part", part)
        .join(before, "__part")
        .select((F.col("__before") + row).alias(name), *[column(c) for c in df.columns])
    )
