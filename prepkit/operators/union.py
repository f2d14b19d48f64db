"""Stacking frames whose columns differ."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.operators.columns import column
from prepkit.operators.types import common_type


def common_schema(schemas: Sequence[T.StructType]) -> T.StructType:
    """Columns in the order first seen, each with the common type of all its occurrences."""
    types: dict[str, T.DataType] = {}
    for schema in schemas:
        for field in schema.fields:
            known = types.get(field.name)
            types[field.name] = field.dataType if known is None else common_type(known, field.dataType)
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a missing column is null and types widen to a common one.

    Every frame is cast to the target first, since Spark's own widening would read text as numbers.
    """
    if not frames:
        raise ValueError("nothing to stack: no readable input")
    target = common_schema([f.schema for f in frames])

    def conformed(df: DataFrame) -> DataFrame:
        return df.select(
            *[
                (column(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in target.fields
            ]
        )

    return reduce(DataFrame.unionByName, [conformed(f) for f in frames])
