import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prepkit.llm import pii
from prepkit.llm import queries
from tests.llm.helpers import clashing, no_documents, odd_documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), k, m.end()) for k, name in enumerate(PATTERNS) for m in re.finditer(PATTERNS[name], text or "") if passes(name, m.group())]
    return sorted(spans)


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = docs.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()
    base = [i for i, g in enumerate(pii.GENERATORS) if g.base]
    return {r["doc_id"]: sorted((c["start"], c["kind"], c["stop"]) for c in r["c"] if c["gen"] in base and c["label"]) for r in spans}


TRICKY = [None, "", "a@b.c_d@e.com", "a@b..c", "x@y.z@w.v", "@a.b", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1 001.02.3.255", "é👍 4111 1111 1111 1111é",
          "4111-1111-1111-1111 1", "+1 (555) 123-4567.", "+1+1+12345678901234567", "+49 30 123456 +4930123456789", "a" * 30000, "1" * 30000, "a@" * 1000, "1.1." * 1000,
          "a.b@" + "c." * 1000, "4 " * 3000, "+1" + " " * 20000 + "2"]


def test_base_spans_of_tricky_texts(spark):
    got = found(spark, TRICKY)
    for i, text in enumerate(TRICKY):
        if not text or len(text) < 25000:
            assert got[i] == brute(text), text[:60] if text else text


def test_base_spans_of_random_texts(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("a1235@.+-( )é\n"), rng.integers(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice(["4111 1111 1111 1111", "a.b@c.de", " ", "10.0.0.1", "+1 555 123 4567", "-", "x", "7"], 6)) for _ in range(500)]
    got = found(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == brute(text), text


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op5_pii(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute(docs[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_looser_forms(spark):
    texts = ["please phone 555-123-4567 now", "write to bob[at]example[dot]com please", "card 4111.1111.1111.1111 was used", "nothing 123-456-7890 here",
             "the part 4111.1111.1111.1112", "plain words", "x +1 (464) 555-9887 39.197.112.39 y", "é 4871773763039823 39 z", "n 4405240589021365 39 z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in pii.redact(pii.find(docs)).collect()}
    assert [out[i]["text"] for i in range(6)] == ["please phone <PHONE> now", "write to <EMAIL> please", "card <CARD> was used", *texts[3:6]]
    assert passes("card", "4871773763039823") and not passes("card", "4405240589021365")
    assert [out[i]["text"] for i in range(6, 9)] == ["x <PHONE> <IP> y", "é <CARD> 39 z", texts[8]]


def test_redact_runs(spark):
    docs = spark.createDataFrame([(1, "né ab@c.de, +1 555 123 4567 8 and 10.0.0.1!"), (2, None), (3, "4111 1111 1111 1111")], "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(pii.find(docs)).collect()}
    assert out == {1: "né <EMAIL>, <PHONE> and <IP>!", 2: None, 3: "<CARD>"}


def test_odd_rows(spark):
    rows = pii.find(clashing(odd_documents(spark), ["spans", "candidates"])).collect()
    assert len(rows) == 14 and all(r["_spans"] == "mine" and not r["spans"] for r in rows)
    assert pii.find(no_documents(spark)).count() == 0


def test_no_python_in_the_plan(spark, plan):
    docs = odd_documents(spark).select("doc_id", "text")
    text = plan(pii.redact(pii.find(docs)))
    assert not any(w in text for w in ("Python", "Pandas", "Arrow"))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 1), st.integers(1, 9)), max_size=20))
def test_threshold(rows):
    s, y, w = (np.array([r[i] for r in rows], float) for i in range(3))
    t = pii.threshold(s, y, w)
    at = s >= t
    assert t >= 0.5 and (not at.any() or (w * y)[at].sum() >= pii.PRECISION * w[at].sum() or t == 0.5)


def test_spelled_out_emails_in_capitals_are_proposed(spark):
    texts = ["WRITE TO JOHN (AT) EXAMPLE (DOT) COM", "JOHN[AT]EXAMPLE[DOT]COM", "John (At) Example (Dot) Com", "john (at) example (dot) com", "JOHN AT EXAMPLE DOT COM"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    number = next(i for i, g in enumerate(pii.GENERATORS) if g.kind == "email" and not g.base)
    rows = docs.select("doc_id", F.size(F.filter(pii.candidates(F.col("text")), lambda c: c["gen"] == number)).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_megabytes_of_matches(spark):
    """Places, contexts and marks of very long texts with very many matches; time follows their length."""
    texts = ["12 34é " * 150_000, "john.doe@example.org call 555-123-4567\n" * 26_000]
    got = found(spark, texts)
    assert [got[i] for i in range(2)] == [brute(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(pii.find(docs)).collect()}
    assert out == {0: texts[0], 1: "<EMAIL> call <PHONE>\n" * 26_000}


def test_runs_and_running_sums_over_blocks(spark):
    n = 3 * pii.BLOCK + 5
    rows = spark.range(1).select(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint")).alias("v"))
    assert rows.select(pii.running(F.col("v"), pii._plus).alias("s")).first()["s"] == list(np.cumsum(range(1, n + 1)))
    assert rows.select(pii.running(F.slice("v", 1, 0), pii._plus).alias("s")).first()["s"] == []
    spans = [(0, 0, 9), (2, 1, 3), (8, 0, 12), (12, 0, 13), *((20 + 2 * i, 0, 22 + 2 * i) for i in range(n))]
    df = spark.createDataFrame([(spans,), ([],)], "s array<struct<start:int,kind:int,stop:int>>")
    got = sorted((r["r"] for r in df.select(pii.runs(F.col("s")).alias("r")).collect()), key=len)
    assert got[0] == [] and [len(g) for g in got[1]] == [3, 1] + [1] * n
