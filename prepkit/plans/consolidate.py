"""Stack all CSV files of each raw folder, whatever their headers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.functions import fixed_values as fv
from prepkit.operators.union import union_relaxed
from prepkit.session import stage
from prepkit.sources.csv import inferred_schema, line_breaks, typed_scan, write_csv
from prepkit.sources.files import discover, file_errors, file_heads, file_profile, line_checks


def literal_path(path: str) -> str:
    """A path that a reader takes as it stands, where it would take some signs as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_groups(spark: SparkSession, heads: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """One frame per distinct header, in the order of the first file of each; and the files with invalid bytes, per header.

    Files with different headers must not share one scan, which would line them up by position. The number of scans follows the number of
    distinct headers. What reaches the driver beside the headers is the list of file names that each scan needs and Spark keeps anyway.
    All lines are checked: a file with a byte that is no UTF-8, wherever it is, is left out as a whole.
    """
    frames, broken_files = [], []
    kinds = heads.where("header is not null").groupBy("header").agg(F.min("path").alias("first")).orderBy("first").collect()
    for kind in kinds:
        same = heads.where(F.col("header") == F.lit(kind["header"])).select("path", "uri")
        paths = [literal_path(r["path"]) for r in same.collect()]
        checks = stage(line_checks(spark, paths), "line-checks")
        invalid = same.join(checks.where("invalid > 0"), "uri")
        broken_files.append(invalid.select("path", F.concat(F.col("invalid").cast("string"), F.lit(" lines are no UTF-8")).alias("message")))
        good = same.join(checks.where("invalid = 0"), "uri").select("path", "broken").collect()
        paths = [literal_path(r["path"]) for r in sorted(good)]
        if paths:
            whole = line_breaks(spark, paths, any(r["broken"] for r in good))
            schema = inferred_schema(spark, paths, kind["header"], whole)
            frames.append(typed_scan(spark, paths, schema.names, schema, whole))
    return frames, broken_files


def consolidate(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stacked rows, the files that could not be read, and the columns per file."""
    heads = stage(file_heads(files).join(files.select("path", "uri"), "path"), "heads")
    frames, invalid = read_groups(spark, heads)
    failed = reduce(DataFrame.unionByName, invalid, file_errors(heads))
    return union_relaxed(frames), failed, file_profile(heads.join(failed, "path", "left_anti"))


def run(
    spark: SparkSession,
    raw_root: str,
    out_root: str,
    levels: Sequence[str] = tuple(fv.RAW_LEVELS),
    categories: Sequence[str] = tuple(fv.RAW_CATEGORIES),
) -> dict[tuple[str, str], DataFrame]:
    """Write one folder per (level, category); gives the errors of each. Missing folders are skipped."""
    errors = {}
    for (level, category), files in discover(spark, raw_root, levels, categories).items():
        rows, failed, _ = consolidate(spark, files)
        write_csv(rows, f"{out_root.rstrip('/')}/{level}_{category}")
        errors[(level, category)] = failed
    return errors
