"""Whole tables: read, replace with row numbers, append.

A table is named by a Spark data source format and its options. The usual one is a database over JDBC; any
other format with the same options, such as a folder of Parquet files, works alike. ``COMMITTED`` is a folder with versions (``commits``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from prepkit.functions import fixed_values as fv
from prepkit.operators.row_id import with_row_id
from prepkit.session import stage
from prepkit.sources import commits

COMMITTED = "committed"


def jdbc_options(url: str, table: str, **properties: str) -> dict[str, str]:
    """Options of a database table; user, password and driver come as properties from the caller."""
    return {"url": url, "dbtable": table, **properties}


def partition_options(name: str, low, high, partitions: int) -> dict[str, str]:
    """Options that split a database read into ranges of a column, one connection each.

    The bounds only shape the ranges: rows outside of them are read too, by the first and last range.
    """
    if partitions < 1:
        raise ValueError("at least one partition")
    return {
        "partitionColumn": name,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
    }


def ranged_options(spark: SparkSession, options: dict[str, str], name: str, partitions: int) -> dict[str, str]:
    """The same with the smallest and largest value of the column, which the database itself works out.

    Nothing to split in an empty table. The column should be spread evenly, as a key is.
    """
    bounds = f"(SELECT min({name}) AS low, max({name}) AS high FROM {options['dbtable']}) bounds"
    low, high = read_table(spark, options | {"dbtable": bounds}, {}).first()
    return partition_options(name, low, high, partitions) if low is not None else {}


def read_table(
    spark: SparkSession, options: dict[str, str], partition: dict[str, str] | None = None, fmt: str = "jdbc"
) -> DataFrame:
    """A whole table.

    A database is read in ranges of a column: see ``ranged_options``. For a small table an empty ``partition`` asks for one
    connection; without any the call is refused, so that a large one is never read so by oversight.
    """
    if fmt == COMMITTED:
        return commits.read(spark, options["path"])
    if partition is None and fmt == "jdbc":
        raise ValueError("say how to split the table (ranged_options), or give {} to read it over one connection")
    return spark.read.format(fmt).options(**options, **(partition or {})).load()


def write_table_replace(
    df: DataFrame,
    options: dict[str, str],
    order_by: Sequence[str] | None = None,
    fmt: str = "jdbc",
    id_name: str = "ID",
    batch_rows: int = fv.BATCH_ROWS,
    batch: str | None = None,
) -> None:
    """Replace a table. With ``order_by`` (a unique key) the rows get a contiguous number from 0.

    The format ``COMMITTED`` replaces it as a whole or not at all, and once for each name of a ``batch``.
    """
    out = with_row_id(df, order_by, id_name) if order_by else df
    if fmt == COMMITTED:
        commits.overwrite(out, options["path"], batch or uuid.uuid4().hex)
        return
    _writer(out, options, fmt, batch_rows).mode("overwrite").save()


def write_table_append(
    df: DataFrame, options: dict[str, str], fmt: str = "jdbc", batch_rows: int = fv.BATCH_ROWS, batch: str | None = None
) -> None:
    """Add rows to a table, without row numbers.

    The format ``COMMITTED`` adds the rows of a ``batch`` once, however often tasks or the whole job run. In other formats each task commits its own rows. Over JDBC a task that is lost after its commit runs again, so a table
    that must not hold a row twice needs a primary key in the database.
    """
    if fmt == COMMITTED:
        commits.append(df, options["path"], batch or uuid.uuid4().hex)
        return
    _writer(df, options, fmt, batch_rows).mode("append").save()


def _writer(df: DataFrame, options: dict[str, str], fmt: str, batch_rows: int):
    # With a limit on connections (numPartitions) Spark merges the tasks that write. What makes the rows is written before,
    # so that only the write itself has so few tasks.
    if fmt == "jdbc" and "numPartitions" in options:
        df = stage(df, "to-database")
    usual = {"batchsize": str(batch_rows)} if fmt == "jdbc" else {}
    return df.write.format(fmt).options(**(usual | options))
