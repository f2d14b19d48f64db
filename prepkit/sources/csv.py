"""CSV scans and the CSV sink.

Quoted cells may hold line breaks, columns are bound by the names of the header, and types come from all rows: the same
data gives the same rows and types in one file or in many.
"""

from __future__ import annotations

import csv as parser
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions import fixed_values as fv
from prepkit.operators.columns import column
from prepkit.operators.types import column_types
from prepkit.sources.files import line_checks
from prepkit.sources.records import Ranges, parsed, ranges, records

# A quote inside a quoted cell is written twice, and white space belongs to the cell.
_FORMAT = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "positiveInf": "inf",
    "negativeInf": "-inf",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
Schema = T.StructType | str


def _reader(spark: SparkSession, mode: str, multi_line: bool):
    return spark.read.options(**_FORMAT).option("mode", mode).option("multiLine", multi_line)


def _scan(spark: SparkSession, mode: str, schema: T.StructType, path: str | Sequence[str], multi_line: bool | Ranges) -> DataFrame:
    """Cells by position: by lines, by whole files, or by ranges of files whose cells hold line breaks."""
    if isinstance(multi_line, Ranges):
        return parsed(records(spark, path, multi_line), schema, _FORMAT | {"mode": mode})
    return _reader(spark, mode, multi_line).schema(schema).csv(path)


def unique_names(header: Sequence[str], pattern: str = "{name}_duplicated_{n}", first: int = 0) -> list[str]:
    """Column names of a header line: a repeated name gets a number, an empty one its place."""
    seen: Counter[str] = Counter()
    names = []
    for place, name in enumerate(header, 1):
        name = name or f"column_{place}"
        names.append(name if not seen[name] else pattern.format(name=name, n=seen[name] - 1 + first))
        seen[name] += 1
    return names


def ddl_type(name: str) -> T.DataType:
    """Type object of a type name."""
    return T.DataType.fromDDL(name)


def schema_of(names: Sequence[str], types: Sequence[str]) -> T.StructType:
    """Schema from names and type names."""
    return T.StructType([T.StructField(n, ddl_type(t)) for n, t in zip(names, types)])


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def line_breaks(spark: SparkSession, path: str | Sequence[str], broken: bool | None) -> bool | Ranges:
    """How to read files: by lines where no cell is ``broken`` by one, else by ranges, and by whole files where quotes stand elsewhere than around cells."""
    return (ranges(spark, path) or True) if broken else False


def _first_record(spark: SparkSession, path: str | Sequence[str], multi_line: bool) -> list[str] | None:
    """The first record of the first file, as text; only the start of it is read."""
    rows = _reader(spark, "PERMISSIVE", multi_line).option("header", "false").csv(path).take(1)
    return [name or "" for name in rows[0]] if rows else None


def layout(spark: SparkSession, path: str | Sequence[str], multi_line: bool | None = None) -> tuple[list[str], bool | Ranges]:
    """The one header of the files, and how to read them (see ``line_breaks``).

    One pass over the lines, the same for one file and for many. Lines with an odd number of quotes mean that a record may
    go on in the next line; then a second pass finds where ranges of the files begin. ``multi_line`` overrides what the passes find: by whole files or by lines.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").take(1)
    if not lines:
        raise ValueError(f"{path}: no readable CSV header")
    first = lines[0]["value"]
    found = line_checks(spark, path, first).agg(F.max("broken").alias("broken"), F.max("other").alias("other")).first()
    if found["other"]:
        raise ValueError(f"{path}: files with different headers")
    whole = line_breaks(spark, path, found["broken"]) if multi_line is None else multi_line
    header = next(parser.reader([first]))
    # A name with a line break goes on beyond the first line.
    return (_first_record(spark, path, bool(whole)) or header) if first.count('"') % 2 else header, whole


def header_of(spark: SparkSession, path: str, multi_line: bool | None = None) -> list[str]:
    """The header of a file, or of the files of a folder, which must have one header."""
    return layout(spark, path, multi_line)[0]


def _as_schema(schema: Schema) -> T.StructType:
    return T.DataType.fromDDL(schema) if isinstance(schema, str) else schema


def _require_columns(path, names: Sequence[str], schema: T.StructType) -> None:
    missing = [n for n in schema.names if n not in names]
    if missing:
        raise ValueError(f"{path}: no such columns: {missing}")


def typed_scan(spark: SparkSession, path: str | Sequence[str], names: Sequence[str], schema: T.StructType, multi_line: bool | Ranges) -> DataFrame:
    """Scan by the names of the header, columns in the order of the schema."""
    _require_columns(path, names, schema)
    kinds = {f.name: f.dataType for f in schema.fields}
    as_written = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    return _scan(spark, "PERMISSIVE", as_written, path, multi_line).select(*map(column, schema.names))


def scan_csv(spark: SparkSession, path: str | Sequence[str], schema: Schema, multi_line: bool | None = None) -> DataFrame:
    """Typed scan: columns are found by their names in the header, whatever their order in the file; Spark prunes the others
    and pushes simple filters into the scan.

    Cells may hold line breaks; files stay splittable. ``multi_line`` says beforehand that files are to be read whole, or by lines.
    """
    header, whole = layout(spark, path, multi_line)
    return typed_scan(spark, path, unique_names(header), _as_schema(schema), whole)


def text_cells(spark: SparkSession, path: str | Sequence[str], names: Sequence[str], multi_line: bool | Ranges) -> DataFrame:
    """``(uri, cells)``: every row's file and its cells as text, by position."""
    schema = _text_schema(names)
    if isinstance(multi_line, Ranges):
        rows = parsed(records(spark, path, multi_line), schema, _FORMAT | {"mode": "PERMISSIVE"}, keep=["uri"])
        return rows.select(F.col("uri"), F.array(*map(column, names)).alias("cells"))
    rows = _reader(spark, "PERMISSIVE", multi_line).schema(schema).csv(path)
    return rows.select(F.col("_metadata.file_path").alias("uri"), F.array(*map(column, names)).alias("cells"))


def inferred_schema(spark: SparkSession, path: str | Sequence[str], header: Sequence[str], multi_line: bool | Ranges) -> T.StructType:
    """Types from all rows, in one aggregate; a column without any value is text."""
    names = unique_names(header)
    cells = _scan(spark, "PERMISSIVE", _text_schema(names), path, multi_line)
    kinds = cells.agg(*[column_types(column(c)).alias(str(i)) for i, c in enumerate(names)]).first()
    return schema_of(names, list(kinds))


def read_csv_tolerant(spark: SparkSession, path: str, schema: Schema | None = None, multi_line: bool | None = None) -> DataFrame:
    """A cell that does not fit the type given for its column becomes null and the row stays.

    Without a schema each column has the narrowest type that takes all its cells, however they are spread over files.
    """
    header, whole = layout(spark, path, multi_line)
    schema = _as_schema(schema) if schema else inferred_schema(spark, path, header, whole)
    return typed_scan(spark, path, unique_names(header), schema, whole)


def read_csv_strict(spark: SparkSession, path: str, schema: Schema | None = None, multi_line: bool | None = None) -> DataFrame:
    """A cell that does not fit its column stops the job, also in columns that are not used later.

    So does a row with too few or too many cells. Spark's fail-fast mode checks only the columns a query
    asks for. Here all cells are read as text and a filter over every column does the check, which column
    pruning cannot take away.
    """
    header, whole = layout(spark, path, multi_line)
    names = unique_names(header)
    schema = _as_schema(schema) if schema else inferred_schema(spark, path, header, whole)
    _require_columns(path, names, schema)
    raw = _scan(spark, "FAILFAST", _text_schema(names), path, whole)
    passed = F.lit(True)
    for field in schema.fields:
        cell = column(field.name)
        bad = cell.isNotNull() & cell.try_cast(field.dataType).isNull()
        message = F.concat(F.lit(f"column {field.name} takes {field.dataType.simpleString()}, not: "), cell)
        passed = F.when(bad, F.raise_error(message).cast("boolean")).otherwise(passed)
    return raw.where(passed).select(*[column(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_csv_null_set(
    spark: SparkSession,
    path: str,
    markers: Sequence[str] = tuple(fv.NULL_MARKERS),
    schema: Schema | None = None,
    drop_empty: bool = False,
    multi_line: bool | None = None,
) -> DataFrame:
    """Cells that equal one of the markers are null; types are inferred from all other cells.

    One aggregation gives the types and, for ``drop_empty``, the columns that hold no value at all. A schema picks columns by name.
    """
    header, whole = layout(spark, path, multi_line)
    names = unique_names(header, pattern="{name}.{n}", first=1)
    raw = _scan(spark, "PERMISSIVE", _text_schema(names), path, whole)
    markers = sorted({"", *markers})
    types = dict.fromkeys(names, "string")
    if schema is None or drop_empty:
        kinds = [column_types(column(c), "void", markers, fv.TRUTH_WORDS) for c in names]
        found = raw.agg(*[kind.alias(str(i)) for i, kind in enumerate(kinds)]).first()
        types = dict(zip(names, found))
    if schema is None:
        schema = schema_of(names, [t.replace("void", "string") for t in types.values()])
    schema = _as_schema(schema)
    _require_columns(path, names, schema)
    return raw.select(
        *[
            F.when(~column(f.name).isin(markers), column(f.name).try_cast(f.dataType)).alias(f.name)
            for f in schema.fields
            if not (drop_empty and types[f.name] == "void")
        ]
    )


def read_csv_dynamic(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Scan with types inferred from every row, one type per column, by Spark's own inference; it reads files with line breaks in cells whole."""
    _, whole = layout(spark, path, multi_line)
    return _reader(spark, "PERMISSIVE", bool(whole)).option("inferSchema", "true").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV parts with headers, one part per partition."""
    df.write.options(**_FORMAT).mode(mode).csv(path)
