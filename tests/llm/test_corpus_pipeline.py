"""Every stage on what the stage before kept, against plain versions."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from prepkit.llm import mixing, oracles, pii, quality_rules
from tests.llm.helpers import clashing, no_documents, odd_documents
from tests.llm.test_dart_minhash import brute_classes
from tests.llm.test_packing import check_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("steps") / name)
        got = step(spark, docs, FOLDER)
        if name != "packing":
            assert got.columns == docs.columns and got.dtypes == docs.dtypes
        got.write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_quality_stage(steps, tmp_path):
    import duckdb

    docs, kept = steps[0]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(oracles.quality_rules(columns="doc_id") + " WHERE kept").fetchall()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in want) and 0 < len(want) < docs.count()


def test_near_duplicate_stage(steps):
    docs, kept = steps[1]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(rows).values()))
    assert {r["doc_id"]: r["text"] for r in kept.collect()}.items() <= dict(rows).items()


def test_pii_stage(steps):
    docs, out = steps[2]
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in (docs, out))
    assert before.keys() == after.keys()
    changed = 0
    for i, r in after.items():
        if r["text"] == before[i]["text"]:
            assert r == before[i]
        else:
            changed += 1
            assert r["n_chars"] == len(r["text"])
    spans = pii.find(out).filter(F.size("base_spans") > 0).count()
    assert changed > 0 and spans == 0


def test_mixing_stage(steps):
    docs, out = steps[3]
    got = Counter(r["doc_id"] for r in out.collect())
    rates = {r["name"]: r["rate"] for r in mixing.rates(docs).collect()}
    drawn = docs.select("doc_id", "source", (mixing.seeded(mixing.SEED, "doc_id") / mixing._RANGE).alias("u")).collect()
    want = {r["doc_id"]: sum(c <= r["u"] for c in mixing.cumulative(rates[r["source"]])) for r in drawn}
    assert got == Counter({k: v for k, v in want.items() if v})


def test_packing_stage(steps):
    docs, out = steps[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    copies = Counter(r["doc_id"] for r in docs.collect())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    covered, used = Counter(), Counter()
    for r in out.collect():
        covered[r["doc_id"]] += r["length"]
        used[r["sequence_id"]] += r["length"]
    for doc, n in copies.items():
        assert covered[doc] == n * (len(tokenizer.encode(texts[doc], add_special_tokens=False).ids) + 1)
    assert all(n == 4096 or n & (n - 1) == 0 for n in used.values())
    assert check_rows  # pieces of single documents are checked with the operator


def test_run_equals_the_steps(spark, steps):
    key = lambda d: sorted(map(tuple, d.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert key(corpus_pipeline.run(spark, FOLDER)) == key(steps[-1][1])


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_odd_rows(spark, kind):
    docs = clashing(odd_documents(spark), ["kept", "spans", "n_copies", "start"]) if kind == "odd" else no_documents(spark)
    start = docs
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, "")
        if name != "packing":
            assert docs.columns == start.columns
            assert all(r["kept"] == "mine" and r["spans"] == "mine" for r in docs.collect() if kind == "odd")
    docs.collect()
