"""A corpus from raw documents to packed sequences: five stages, each an operator of prepkit.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before has kept, and returns the columns of the documents;
the last returns pieces of sequences. ``run`` writes each stage's rows as Parquet below the shared folder and reads them again for the next.

Defined results: nulls, empty and very long texts and repeated rows go by the operators' rules (a null or empty text fails the quality rules); an empty
table gives an empty result; extra columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.llm import dart_minhash, mixing, packing, pii, quality_rules
from prepkit.llm.common import fresh
from prepkit.llm.queries import tokenizer_path
from prepkit.session import stage


def _columns(out: DataFrame, docs: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs``, also those that an operator has put an underscore before."""
    names = []
    for name in docs.columns:
        names.append(name if name.lower() not in {o.lower() for o in own} else fresh(f"_{name}", [*own, *docs.columns]))
    return out.select(*[F.col(f"`{n}`").alias(name) for n, name in zip(names, docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their group's thresholds keep."""
    return _columns(quality_rules.quality_rules(docs).filter("kept"), docs, quality_rules.OWN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return dart_minhash.survivors(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with marks in place of personal data, and their length after that."""
    redacted = pii.redact(pii.find(docs))
    changed = redacted.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _columns(changed, docs, pii.OWN)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, all sources with equal weights, in shuffled order."""
    return mixing.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    pieces = packing.pack(docs.select("doc_id", "text"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality),
    ("dart_minhash", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", packed),
]

# Near duplicates, learned spans and packing are beyond SQL; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"corpus-{name}")
    return docs
