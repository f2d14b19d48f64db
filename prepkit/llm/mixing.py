"""Mixing sources to target weights by Poisson replication.

The target weight of a source over its share of all UTF-8 bytes gives its repetition rate. Each document draws a uniform number from a hash
of seed and doc_id and inverts the Poisson distribution with that rate: the number of copies it
gets, 0 included, so that the expected bytes of each source are its weight's share of the budget. Copies are then dealt and
sorted by a hash of doc_id and copy number, which is a global shuffle that any rerun repeats.

The inverse is a table per source: the cumulative probabilities up to where a double holds no more. Its
length depends on the rate alone. A document takes the number of entries below its uniform number.

Defined results: a null source is a source like others; a null text counts no bytes, and a source without any bytes
keeps its documents once; sources without a weight get none; repeated rows of a doc_id get equal counts and keys; a null doc_id hashes as the empty text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.llm.common import UNIFORM_DIGITS, fresh, prepared, seeded
from prepkit.session import stage

SEED = 411
_RANGE = 16**UNIFORM_DIGITS


def cumulative(rate: float) -> list[float]:
    """Poisson probabilities of at most 0, 1, ... copies, as far as they differ from 1."""
    if rate <= 0:
        return [1.0]
    out, total, k = [], 0.0, 0
    last = rate + 12 * math.sqrt(rate) + 40
    while k <= last:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(min(total, 1.0))
        k += 1
    return out


def _tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["cdf"] = [cumulative(r) for r in frame["rate"]]
        yield frame


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", text: str = "text",
          budget: float = 1.0) -> DataFrame:
    """One row per source: name, bytes, rate and the table of its inverse. ``budget`` is the output's size in inputs.

    Equal weights unless given; the weights of the sources present are scaled to one.
    """
    spark = prepared(docs.sparkSession)
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint")
    sizes = stage(docs.groupBy(F.col(f"`{source}`").alias("name")).agg(F.sum(size).alias("bytes")), "mix-sizes")
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = spark.createDataFrame(list(weights.items()), "w_name string, weight double")
        weighed = sizes.join(given, sizes["name"].eqNullSafe(given["w_name"]), "left").drop("w_name")
        weighed = weighed.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    present = F.when(F.col("bytes") > 0, F.col("weight"))
    total = weighed.agg(F.sum("bytes").alias("bytes"), F.sum(present).alias("weight")).first()
    share = F.col("weight") / F.lit(total["weight"] or 1.0) * F.lit(float((total["bytes"] or 0) * budget))
    rated = weighed.withColumn("rate", F.when(F.col("bytes") > 0, share / F.col("bytes")))
    known = rated.filter(F.col("rate").isNotNull()).mapInPandas(_tables, "name string, bytes bigint, weight double, rate double, cdf array<double>")
    return known.unionByName(rated.filter(F.col("rate").isNull()), allowMissingColumns=True)


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", text: str = "text",
        key: str = "doc_id", seed: int = SEED, budget: float = 1.0) -> DataFrame:
    """The copies, in shuffled order: columns of ``docs``, ``n_copies``, ``copy_no`` (from 0) and ``shuffle_key``."""
    table = stage(rates(docs, weights, source, text, budget), "mix-rates").select(F.col("name").alias("__name"), F.col("cdf").alias("__cdf"))
    draw, copies, copy, order = (fresh(n, docs.columns) for n in ("__draw", "n_copies", "copy_no", "shuffle_key"))
    drawn = docs.withColumn(draw, seeded(seed, F.col(f"`{key}`")) / F.lit(float(_RANGE)))
    joined = drawn.join(table, drawn[f"`{source}`"].eqNullSafe(table["__name"]), "left")
    number = F.when(F.col("__cdf").isNull(), F.lit(1)).otherwise(F.size(F.filter("__cdf", lambda c: c <= F.col(draw))))
    counted = joined.withColumn(copies, number.cast("bigint")).drop("__name", "__cdf", draw).filter(F.col(copies) > 0)
    out = counted.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(copies) - 1)))
    out = out.withColumn(order, seeded(seed + 1, F.col(f"`{key}`"), F.col(copy)))
    return out.repartitionByRange(F.col(order), F.col(f"`{key}`")).sortWithinPartitions(order, f"`{key}`")
