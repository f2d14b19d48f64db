"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the library counts on. They are set once per session; what a user sets later, or gave the session at
# its start, stays. ANSI stays on: the library uses try_cast / get wherever a bad value is tolerated.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join also where the next join then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
_DONE = "prepkit.configured"

PARTITION_BYTES = 128 << 20
#: Bytes in a shuffle for each byte of a compressed input file, at most as a rule.
EXPANSION = 3


def configure(spark: SparkSession, shuffled_bytes: int | None = None) -> SparkSession:
    """Apply the runtime settings to an existing session, once.

    With ``shuffled_bytes``, the size of the largest shuffle to come, there are enough shuffle partitions for
    each to fit a task; adaptive execution joins those that turn out small. A higher setting is kept.
    """
    if spark.conf.get(_DONE, None) is None:
        given = spark.sparkContext.getConf()
        for key, value in RUNTIME_CONF.items():
            if not given.contains(key):
                spark.conf.set(key, value)
        spark.conf.set(_DONE, "true")
    if shuffled_bytes:
        wanted = -(-shuffled_bytes // PARTITION_BYTES)
        present = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if wanted > present:
            spark.conf.set("spark.sql.shuffle.partitions", wanted)
    return spark


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that a frame reads, by Spark's own statistics; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # A source without statistics counts as the largest number there is: it says nothing.
    return sum(s for s in sizes if s < 1 << 60)


def scratch_root(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting, as in a test, gets a folder of this machine, which it keeps.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="prepkit-"))
    return spark.sparkContext.getCheckpointDir()


_STAGED: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    path = f"{scratch_root(spark)}/prepkit/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    What follows reads files, so a lost executor costs a re-read and never a recomputation that could
    give other partition ids or another row order. The number of shuffle partitions follows the size of what is read.
    """
    configure(df.sparkSession, EXPANSION * input_bytes(df))
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that were staged inside the block at its end; results must be written or collected by then."""
    first = len(_STAGED)
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _STAGED[first:]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        del _STAGED[first:]
