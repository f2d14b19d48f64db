"""Two-pass external shuffle into shards whose row counts differ by one at most.

Pass one scatters the rows by a seeded hash into buckets that fit in a task's memory. Pass two sorts each bucket by
its hashes, so that the order does not depend on how fetched blocks arrive, shuffles it with Fisher-Yates under a seed
of seed and bucket, and writes it. The buckets one after the other are the shuffled order; shards are equal runs of it, so
a bucket reaches into few shards. The hash takes in the row's place in its input, so that repeated rows
are spread like others: a result depends on the seed and on the input files and their splits. Input that comes from
a shuffle is written first, since its rows have no fixed places. A very long text makes its bucket that much larger.

Defined results: a null text counts no bytes; an empty table gives no rows; repeated rows each keep a place of their own;
columns named like the operator's own get underscores on the operator's side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.llm.common import fresh, prepared
from prepkit.session import stage

SHARDS = 40
SEED = 20_240_607
#: Bytes of text in a bucket: one is held in memory at a time.
BUCKET_BYTES = 24 << 20
ROW_BYTES = 16
#: Tasks of the scatter: each takes as many buckets, one after the other, as it needs to.
MOST_PARTS = 20_000


def row_size(text: str = "text"):
    """UTF-8 bytes of the text and a fixed amount."""
    return F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint") + F.lit(ROW_BYTES)


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform order of n rows: each place, from the last, swaps with one at or before it."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


def _shuffle_buckets(bucket: str, place: str, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            order = fisher_yates(len(table), seed, current)
            step = max(1, int(len(table) * (4 << 20) / max(1, table.nbytes)))
            for start in range(0, len(table), step):
                some = table.take(pa.array(order[start : start + step]))
                places = pa.array(np.arange(start, start + len(some)), pa.int64())
                yield from some.append_column(place, places).combine_chunks().to_batches()

        for batch in batches:
            ids = np.asarray(batch.column(batch.schema.get_field_index(bucket)))
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and current != int(ids[a]):
                        yield from flush()
                        held = []
                    current = int(ids[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    return run


def shuffled(docs: DataFrame, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, str, int]:
    """The written buckets with each row's place in the whole order, the name of that column, and the number of rows."""
    prepared(docs.sparkSession)
    bucket, key, place, at = (fresh(n, docs.columns) for n in ("__bucket", "__key", "__place", "position"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        # Rows that come from a shuffle have no fixed place: a task run again after a lost executor would give them other keys.
        docs = stage(docs, "shard-input")
    total = docs.agg(F.coalesce(F.sum(row_size(text)), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(1, -(-total["bytes"] // bucket_bytes))
    scattered = docs.withColumn(key, F.xxhash64(F.lit(seed), F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")), F.monotonically_increasing_id()))
    scattered = scattered.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(buckets)).cast("int"))
    parts = min(buckets, MOST_PARTS)
    part = F.expr(f"cast(cast(`{bucket}` as bigint) * {parts}L div {buckets}L as int)")
    dealt = scattered.repartitionById(parts, part).sortWithinPartitions(bucket, key).drop(key)
    schema = T.StructType([*dealt.schema.fields, T.StructField(place, T.LongType())])
    written = stage(dealt.mapInArrow(_shuffle_buckets(bucket, place, seed), schema), "shuffled-buckets")
    sizes = {r[0]: r[1] for r in written.groupBy(bucket).count().collect()}  # one small row per bucket
    offset, offsets = 0, []
    for b in sorted(sizes):
        offsets.append((b, offset))
        offset += sizes[b]
    before = fresh("__before", docs.columns)
    starts = F.broadcast(docs.sparkSession.createDataFrame(offsets, f"`{bucket}` int, `{before}` bigint"))  # two numbers per bucket
    placed = written.join(starts, bucket).withColumn(at, F.col(before) + F.col(place)).drop(bucket, before, place)
    return placed, at, total["n"]


def shards(docs: DataFrame, n_shards: int = SHARDS, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``shard`` (0 to n_shards - 1) and ``slot`` (the place in the shard, from 0)."""
    placed, at, n = shuffled(docs, text, seed, bucket_bytes)
    shard, slot = fresh("shard", docs.columns), fresh("slot", docs.columns)
    first = F.expr(f"(cast(`{shard}` as bigint) * {n}L + {n_shards - 1}L) div {n_shards}L")
    placed = placed.withColumn(shard, F.expr(f"cast(`{at}` * {n_shards}L div {max(n, 1)}L as int)"))
    return placed.withColumn(slot, F.col(at) - first).drop(at)


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, text: str = "text", seed: int = SEED) -> None:
    """Write each shard to a folder ``shard=N`` below ``path``, its rows with their slots."""
    out = shards(docs, n_shards, text, seed)
    out.write.mode("errorifexists").partitionBy(fresh("shard", docs.columns)).parquet(path)
