"""Small tables with the cases that every operator must bear."""

from __future__ import annotations

LONG = "alpha beta gamma delta " * 20_000
ODD_TEXTS = [None, "", " \n\t", "word", "a b c d e", "same text here " * 30, "same text here " * 30, LONG, "é́ 你好 👍 ." * 9, "x" * 50_000]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t) if t else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (None, "no id " * 40, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, names):
    """``df`` with extra columns of the given names."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("mine") for n in names})
