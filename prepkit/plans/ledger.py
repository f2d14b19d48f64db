"""Stacking of CSV files that are added, changed and removed over time, without reading again what is known.

A ledger holds for every file its length, time of change, header, types, a fingerprint of its lines and the run that read it. A run lists the files, reads only those that are new or
changed, adds their cells as text, and then puts a new ledger in place; that one step makes the run visible. The stacked table is the cells that the ledger names, cast to the
types that all present files together allow: the same rows and types as stacking everything anew.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.functions import fixed_values as fv
from prepkit.operators.types import column_types
from prepkit.operators.union import union_relaxed
from prepkit.plans.consolidate import literal_path
from prepkit.session import stage
from prepkit.sources import commits
from prepkit.sources.csv import line_breaks, schema_of, text_cells, unique_names
from prepkit.sources.files import file_heads, line_checks, list_csv

LEDGER_SCHEMA = """uri string, path string, length bigint, changed timestamp, header array<string>, message string,
    n_lines bigint, fingerprint bigint, kinds array<string>, run string"""
CELLS_SCHEMA = "header_id string, run string, uri string, cells array<string>"


def _ledger(spark: SparkSession, root: str) -> DataFrame:
    place = f"{root}/ledger"
    return commits.read(spark, place) if commits.manifest(spark, place).version else spark.createDataFrame([], LEDGER_SCHEMA)


def _header_id() -> F.Column:
    return F.sha2(F.to_json("header").cast("binary"), 256)


def changes(spark: SparkSession, raw: str, root: str) -> DataFrame:
    """What a run would do with each file: ``(uri, path, length, changed, action)``, where the action is read, keep or drop. No content is read."""
    times = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.csv").load(raw)
    times = times.select(F.col("_metadata.file_path").alias("uri"), F.col("modificationTime").alias("changed"))
    listed = list_csv(spark, raw).join(times, "uri", "left").alias("n")
    known = _ledger(spark, root).select("uri", "length", "changed").alias("k")
    same = F.col("n.length").eqNullSafe(F.col("k.length")) & F.col("n.changed").eqNullSafe(F.col("k.changed"))
    action = F.when(F.col("n.uri").isNull(), "drop").when(F.col("k.uri").isNotNull() & same, "keep").otherwise("read")
    both = listed.join(known, F.col("n.uri") == F.col("k.uri"), "full")
    return both.select(F.coalesce("n.uri", "k.uri").alias("uri"), "n.path", "n.length", "n.changed", action.alias("action"))


def _read_files(spark: SparkSession, files: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """Ledger rows of the files, and their cells as text."""
    heads = stage(file_heads(files).join(files, "path"), "ledger-heads")
    paths = [literal_path(r["path"]) for r in heads.where("header IS NOT NULL").select("path").collect()]
    entries = heads.withColumns({"n_lines": F.lit(0).cast("bigint"), "fingerprint": F.lit(None).cast("bigint"), "kinds": F.lit(None).cast("array<string>"), "run": F.lit(run)})
    if not paths:
        return entries, spark.createDataFrame([], CELLS_SCHEMA)
    lines = spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("uri")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.bit_xor(F.xxhash64("value")).alias("fingerprint")
    )
    checked = stage(heads.join(line_checks(spark, paths).select("uri", "broken", "invalid"), "uri").join(lines, "uri"), "ledger-lines")
    cells, kinds = [], []
    for row in checked.where("invalid = 0").groupBy("header").agg(F.max(F.col("broken") > 0).alias("broken"), F.collect_list("path").alias("paths")).collect():
        names = unique_names(row["header"])
        own = [literal_path(p) for p in sorted(row["paths"])]
        found = text_cells(spark, own, names, line_breaks(spark, own, row["broken"]))
        named = found.withColumn("header", F.array(*[F.lit(h) for h in row["header"]]))
        cells.append(named.select(_header_id().alias("header_id"), F.lit(run).alias("run"), "uri", "cells"))
        each = F.array(*[column_types(F.get("cells", F.lit(i)), "void") for i in range(len(names))])
        kinds.append(found.groupBy("uri").agg(each.alias("kinds")))
    message = F.when(F.col("invalid") > 0, F.concat(F.col("invalid").cast("string"), F.lit(" lines are no UTF-8")))
    held = checked.withColumn("message", message).drop("broken", "invalid")
    if not cells:
        return _shaped(held.withColumns({"kinds": F.lit(None).cast("array<string>"), "run": F.lit(run)}), entries), spark.createDataFrame([], CELLS_SCHEMA)
    held = held.join(reduce(DataFrame.unionByName, kinds), "uri", "left").withColumn("run", F.lit(run))
    return _shaped(held, entries), reduce(DataFrame.unionByName, cells)


def _shaped(held: DataFrame, entries: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in LEDGER_SCHEMA.replace("\n", " ").split(", ")]
    return held.select(*names).unionByName(entries.where("header IS NULL").select(*names))


def update(spark: SparkSession, raw: str, root: str, run: str) -> DataFrame:
    """Bring the stacked table below ``root`` up to date with the CSV files below ``raw``; what was done with each file.

    ``run`` names the run: one that failed midway is repeated under the same name or another one, and nothing counts twice; one that is done is not done again. Cells of a
    failed attempt stay unseen, as files may have changed since.
    """
    root = root.rstrip("/")
    plan = stage(changes(spark, raw, root), "ledger-plan")
    if run in commits.manifest(spark, f"{root}/ledger").batches:
        return plan.limit(0).select("path", "uri", "action")
    attempt = f"{run}-{uuid.uuid4().hex[:8]}"
    entries, cells = _read_files(spark, plan.where("action = 'read'").select("uri", "path", "length", "changed"), attempt)
    old = _ledger(spark, root).alias("o")
    kept = old.join(plan.where("action = 'keep'").select("uri"), "uri", "left_semi")
    # Files that were touched but hold the same lines stay with the cells read before.
    same = [F.col("e.uri") == F.col("k.uri"), F.col("e.fingerprint") == F.col("k.fingerprint"), F.col("e.n_lines") == F.col("k.n_lines"), F.col("e.header") == F.col("k.header")]
    before = _ledger(spark, root).where("kinds IS NOT NULL").select("uri", "fingerprint", "n_lines", "header", F.col("run").alias("old_run"))
    entries = stage(entries, "ledger-entries")
    marked = entries.alias("e").join(before.alias("k"), reduce(lambda a, b: a & b, same), "left")
    marked = stage(marked.select("e.*", "old_run"), "ledger-marked")
    new = marked.where("old_run IS NULL AND kinds IS NOT NULL").select("uri")
    fresh = cells.join(new, "uri", "left_semi").select("header_id", "run", "uri", "cells")
    commits.append(fresh, f"{root}/cells", attempt, ["header_id"])
    names = entries.columns
    settled = marked.withColumn("run", F.coalesce("old_run", "run")).select(*names)
    commits.overwrite(kept.select(*names).unionByName(settled), f"{root}/ledger", run)
    return plan.select("path", "uri", "action")


def _joined(kinds: list[str]) -> str:
    """The narrowest type of values that were found to be of several."""
    found = set(kinds) - {"void", None}
    if len(found) == 1:
        return found.pop()
    return "double" if found == {"bigint", "double"} else "string"


def current(spark: SparkSession, root: str) -> DataFrame:
    """The stacked rows of all files that the ledger holds, with the types their cells allow."""
    root = root.rstrip("/")
    ledger = _ledger(spark, root).where("kinds IS NOT NULL")
    cells = commits.read(spark, f"{root}/cells")
    # One row per header, with the kinds that each column was found to have.
    kinds = ledger.select("header", "path", F.posexplode("kinds")).groupBy("header", "pos").agg(F.collect_set("col").alias("kinds"), F.min("path").alias("first"))
    by_header = kinds.groupBy("header").agg(F.sort_array(F.collect_list(F.struct("pos", "kinds"))).alias("kinds"), F.min("first").alias("first")).orderBy("first")
    frames = []
    for row in by_header.select("header", "kinds", _header_id().alias("header_id")).collect():
        schema = schema_of(unique_names(row["header"]), [_joined(k["kinds"]) for k in row["kinds"]])
        own = ledger.where(_header_id() == row["header_id"]).select("uri", "run")
        rows = cells.where(F.col("header_id") == row["header_id"]).join(own, ["uri", "run"], "left_semi")
        frames.append(rows.select(*[F.get("cells", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]))
    return union_relaxed(frames)


def failures(spark: SparkSession, root: str) -> DataFrame:
    """Files that could not be read and why."""
    return _ledger(spark, root.rstrip("/")).where("message IS NOT NULL").select("path", "message")


def run(spark: SparkSession, raw_root: str, out_root: str, name: str, levels=tuple(fv.RAW_LEVELS), categories=tuple(fv.RAW_CATEGORIES)) -> dict[tuple[str, str], DataFrame]:
    """Update one stacked table per (level, category) folder; what was done with each file. Missing folders are skipped."""
    from prepkit.sources.files import exists

    folders = {(x, y): f"{raw_root.rstrip('/')}/{x}/{y}" for x in levels for y in categories}
    return {key: update(spark, folder, f"{out_root.rstrip('/')}/{key[0]}_{key[1]}", name) for key, folder in folders.items() if exists(spark, folder)}
