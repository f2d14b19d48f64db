"""Finding CSV files and looking at their heads, as Spark jobs over the list of files."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.functions import fixed_values as fv

HEAD_SCHEMA = "path string, header array<string>, message string"
_CHUNK = 1 << 16

# The helpers below travel to the executors with the task, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def exists(spark: SparkSession, path: str) -> bool:
    """True when the path can be listed; no file content is read."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)  # lists the path
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def exists_or_skip(spark: SparkSession, path: str) -> tuple[bool, str]:
    """Whether a job can start on ``path``, and the message for the user."""
    if exists(spark, path):
        return True, f"Reading raw data from {path}"
    return False, f"Nothing to do: place a CSV file at {path}"


def list_csv(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files below a folder as ``(path, length, uri)``, files without any byte included.

    ``uri`` is the name that Spark gives in the metadata of rows. A scan leaves empty files out, so they are
    added from the list of files that Spark itself keeps for every scan.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.csv"}
    found = spark.read.format("binaryFile").options(**options).load(path)
    # Metadata writes an empty host as one slash, the list of files as three.
    names = spark.createDataFrame([(name.replace(":///", ":/", 1),) for name in found.inputFiles()], "uri string")
    known = found.select("path", "length", F.col("_metadata.file_path").alias("uri"))
    listed = names.join(known, "uri", "left")
    return listed.select(F.coalesce("path", "uri").alias("path"), F.coalesce("length", F.lit(0)).alias("length"), "uri")


def line_checks(spark: SparkSession, paths: Sequence[str] | str, first_line: str | None = None) -> DataFrame:
    """What one pass over the lines of files shows: ``(uri, broken, invalid, other)``.

    ``broken``: lines with an odd number of quotes, as a cell with a line break makes; ``invalid``: lines that are no
    UTF-8; ``other``: whether the first line that is not blank is another one than ``first_line``. Only numbers
    are added up per file, on the map side.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    opening = (F.col("start") == 0) & (F.trim("value") != "")
    checks = lines.groupBy("uri").agg(
        F.sum((quotes % 2 == 1).cast("bigint")).alias("broken"),
        F.sum((~F.is_valid_utf8("value")).cast("bigint")).alias("invalid"),
        F.min(F.when(opening, F.col("place"))).alias("first"),
        F.min(F.when(opening & (F.col("value") == F.lit(first_line)), F.col("place"))).alias("same"),
    )
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("same"))
    return checks.select("uri", "broken", "invalid", other.alias("other"))


def discover(
    spark: SparkSession,
    root: str,
    levels: Sequence[str] = tuple(fv.RAW_LEVELS),
    categories: Sequence[str] = tuple(fv.RAW_CATEGORIES),
) -> dict[tuple[str, str], DataFrame]:
    """Files of each (level, category) folder; a folder that is missing is left out."""
    found = {}
    for level in levels:
        for category in categories:
            folder = f"{root.rstrip('/')}/{level}/{category}"
            if exists(spark, folder):
                found[(level, category)] = list_csv(spark, folder)
    return found


def _open(path: str):
    """Open a file by the path Spark gives. The path is no URI: blanks and other signs in it stand for themselves."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    host, _, name = rest.removeprefix("//").partition("/")
    try:
        system, root = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{host}/")
    except (ValueError, NotImplementedError, OSError, ImportError) as error:
        # Not a fault of this one file: no file of that kind can be read, so the job stops.
        raise RuntimeError(f"no reader for {path}: {error}") from error
    return system.open_input_file(f"{root.rstrip('/')}/{name}")


def _header(path: str, separator: str) -> list[str]:
    """The first record of a file that is not blank; no more of the file is read."""
    csv.field_size_limit(sys.maxsize)
    with _open(path) as stream:
        text = io.TextIOWrapper(io.BufferedReader(stream, _CHUNK), encoding="utf-8-sig", newline="")
        for record in csv.reader(text, delimiter=separator):
            if any(cell.strip() for cell in record):
                return record
    raise ValueError("no header line")


def file_heads(files: DataFrame, separator: str = ",") -> DataFrame:
    """Header of every file: ``(path, header, message)``.

    The list of files is spread over the executors and each task reads only the first block of its
    files. A file that cannot be read is reported in ``message`` and does not stop the others.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    out.append((path, _header(path, separator), None))
                except (OSError, ValueError, csv.Error) as error:
                    out.append((path, None, f"{error}"))
            yield pd.DataFrame(out, columns=["path", "header", "message"])

    spread = files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(read, HEAD_SCHEMA)


def file_profile(heads: DataFrame) -> DataFrame:
    """Number of columns per readable file."""
    return heads.where(F.col("header").isNotNull()).select(
        "path", F.size("header").cast("bigint").alias("n_columns"), F.array_join("header", ",").alias("header")
    )


def file_errors(heads: DataFrame) -> DataFrame:
    """Files that could not be read and why."""
    return heads.where(F.col("message").isNotNull()).select("path", "message")
