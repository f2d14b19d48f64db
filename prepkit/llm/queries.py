"""Registered queries of this subpackage. SQL is given where SQL can say the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.catalog import Registry, table
from prepkit.llm import byte_bpe, dart_minhash, flat_graph, license_templates, mixing, oracles, packing, pii, prefix_trie, quality_classifier, quality_rules, sharding, turn_repair, url_filter
from prepkit.session import stage

registry = Registry()
TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"


def tokenizer_path() -> str:
    """Place of the public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@registry.add(oracles.license_templates())
def op1_license_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of every document by phrases and templates."""
    scanned = license_templates.scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", *license_templates.RESULT)


@registry.add(oracles.quality_rules())
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base verdict and verdict of every document."""
    judged = quality_rules.quality_rules(table(spark, folder, "documents"), keep=["doc_id", "lang", "source"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@registry.add()
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document by a classifier that saw two thirds of the labels."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality_classifier.classify(docs, table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@registry.add()
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document's tokens in sequences of 4096."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    packed = packing.pack(docs, tokenizer_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@registry.add()
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of base spans and all spans of every document."""
    found = pii.find(table(spark, folder, "documents"), keep=["doc_id"])
    counts = [pii.count(F.col("base_spans"), k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    digest = F.sha2(pii.named(F.col("base_spans")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.named(F.col("spans")).alias("spans"))


@registry.add()
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.filter_urls(table(spark, folder, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@registry.add()
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document; row counts of shards differ by one at most."""
    dealt = sharding.shards(table(spark, folder, "documents"))
    return dealt.select(
        "doc_id",
        sharding.row_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@registry.add()
def op8_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near duplicates of every document."""
    found = dart_minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), "class_id", "kept")


@registry.add()
def op9_flat_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector at cosine 0.95."""
    return flat_graph.near_vectors(table(spark, folder, "embeddings"))


@registry.add(oracles.mixing())
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of every document, equal weights for all sources, in shuffled order."""
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "n_copies", "copy_no", "shuffle_key")


@registry.add(oracles.turn_repair())
def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation, and cost, audit and digest of its cheapest repair."""
    return turn_repair.decide(turn_repair.damage(table(spark, folder, "conversations")))


@registry.add(oracles.prefix_trie())
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie of conversations with shared openings."""
    turns = prefix_trie.numbered(table(spark, folder, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(stage(turns, "turns")))


def ranks_path() -> str:
    """Place of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(RANKS)


@registry.add()
def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Number and digest of every document's ids, and digest of the bytes they decode to."""
    encoded = byte_bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), ranks_path())
    decoded = byte_bpe.decode(encoded, ranks_path())
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
