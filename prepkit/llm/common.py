"""What the operators of this subpackage share: workers made ready, hash-seeded uniform numbers, names that don't clash."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Texts may be long, so a batch holds few of them.
BATCH_ROWS = 256
BATCH_BYTES = 32 << 20

#: Hexadecimal digits of a digest that make a uniform number: 52 bits, exact in a double.
UNIFORM_DIGITS = 13


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application: they need not have it installed."""
    package = Path(__file__).resolve().parent.parent
    if spark.sparkContext.applicationId in _SHIPPED or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="prepkit-")) / f"{package.name}.zip"  # on the driver, which serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(spark.sparkContext.applicationId)


def prepared(spark: SparkSession) -> SparkSession:
    """Ready for Python functions on texts: the package on the workers, Arrow batches small enough for long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def seeded(seed: int, *parts: Column | str) -> Column:
    """A whole number from 0 to 2**52 - 1 that depends on the seed and the parts only (null: empty)."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts).cast("binary"))
    return F.conv(F.substring(digest, 1, UNIFORM_DIGITS), 16, 10).cast("bigint")


def fresh(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores before it until no given column has it."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def aside(df: DataFrame, own: Sequence[str]) -> DataFrame:
    """``df`` with underscores before the names of columns that an operator's ``own`` columns would clash with."""
    names = list(df.columns)
    for i, name in enumerate(names):
        if name.lower() in {o.lower() for o in own}:
            names[i] = fresh(f"_{name}", [*own, *names])
    return df.toDF(*names)


def same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Join condition of null-safe equalities."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition
