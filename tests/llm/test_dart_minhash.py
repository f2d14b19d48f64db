import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from prepkit.llm import components as c
from prepkit.llm import dart_minhash as d
from prepkit.llm import queries
from tests.llm.helpers import clashing, no_documents, odd_documents


def classes_of(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 3), (3, 5), (9, 8), (8, 5), (20, 21)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in c.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == classes_of([e for e in edges if e[0] != e[1]], nodes)


def test_random_components(spark):
    rng = np.random.default_rng(2)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (260, 2))]
    got = {r["node"]: r["root"] for r in c.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for a, b in edges for n in (a, b) if a != b}
    assert got == classes_of([e for e in edges if e[0] != e[1]], nodes)


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("share", [0.3, 0.8, 0.95])
def test_coordinates_agree_as_often_as_the_sets_are_similar(weighted, share):
    rng = np.random.default_rng(7)
    size, n, sets = 4000, 300, []
    pool = np.unique(rng.integers(1, 2**63, 2 * n, dtype=np.uint64))
    common = int(2 * n * share / (1 + share))
    for start in (0, n - common):
        own = np.sort(pool[start : start + n])
        sets.append((own, (own % np.uint64(4) + np.uint64(1)).astype(np.int64)))
    sig = d.signatures(sets, weighted, size)
    want = d.similarity(sets[0], sets[1], weighted)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=4 * np.sqrt(want * (1 - want) / size))


def test_signature_does_not_depend_on_the_batch():
    sets = [d.shingles(("w%d " * 1).join(map(str, range(n))).encode()) for n in (1, 3, 50, 2000, 0, 7)]
    alone = [d.signatures([s])[0].tolist() for s in sets]
    assert d.signatures(sets).tolist() == alone
    assert not any(alone[4]) and all(alone[3])


def test_memory_for_a_batch_of_long_texts_is_bounded(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [(np.unique(rng.integers(1, 2**63, n, dtype=np.uint64)), np.ones(n, np.int64)) for n in (20_000, 0, 3, 20_000, 1, 0) * 12]
    want = d.signatures(sets).tolist()
    assert d.signatures_by_parts(sets).tolist() == want and d.signatures_by_parts([]).shape == (0, d.BANDS * d.ROWS)
    monkeypatch.setattr(d, "HELD_SHINGLES", 20_000)
    assert d.signatures_by_parts(sets).tolist() == want
    keys, one, many = d._keys_of(False).func, pa.array(["".join(f"w{i} " for i in rng.integers(0, 10**6, 20_000))]), []
    d.shingles(one[0].as_py().encode())
    for texts in (one, pa.concat_arrays([one] * 24)):
        tracemalloc.start()
        keys(texts)
        many.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    # The shingles themselves are kept for the batch, 16 bytes each; darts are not.
    assert many[1] < 2 * many[0] + 24 * 20_000 * 16


def test_shingles():
    assert len(d.shingles(b"a b c")[0]) == 1 and len(d.shingles(b"a b c d e f")[0]) == 2 and len(d.shingles(b" .,")[0]) == 0
    assert d.shingles(b"A, b c; D e!")[0].tolist() == d.shingles(b"a b c d e")[0].tolist()
    assert d.shingles(b"a a a a a a a")[1].tolist() == [3]


@pytest.mark.parametrize("weighted", [False, True])
def test_sketches_differ_in_no_more_bits_than_sets_in_elements(weighted):
    rng = np.random.default_rng(3)
    for n in (3, 100, 1500):
        pool = np.unique(rng.integers(1, 2**63, 2 * n, dtype=np.uint64))
        a, b = (np.sort(rng.choice(pool, n, replace=False)) for _ in range(2))
        ca, cb = (rng.integers(1, 4, n) if weighted else np.ones(n, np.int64) for _ in range(2))
        bits = sum(int(x ^ y).bit_count() if x ^ y >= 0 else (int(x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(d.parity_sketch(a, ca, weighted), d.parity_sketch(b, cb, weighted)))
        da, db = dict(zip(a.tolist(), ca.tolist())), dict(zip(b.tolist(), cb.tolist()))
        assert bits <= sum(abs(da.get(k, 0) - db.get(k, 0)) for k in da.keys() | db.keys())


def brute_classes(rows):
    """Classes by all pairs of distinct texts."""
    texts = {}
    for doc, text in rows:
        if text is not None:
            texts[text] = min(doc, texts.get(text, doc))
    sets = {t: set(d.shingles(t.encode())[0].tolist()) for t in texts}
    keys, edges = list(texts), []
    by_shingle = defaultdict(set)
    for i, t in enumerate(keys):
        for s in sets[t]:
            by_shingle[s].add(i)
    for i, t in enumerate(keys):
        for j in {j for s in sets[t] for j in by_shingle[s] if j < i}:
            a, b = sets[t], sets[keys[j]]
            if len(a & b) >= 0.8 * len(a | b):
                edges.append((texts[t], texts[keys[j]]))
    found = classes_of(edges, set(texts.values()))
    return {doc: found[texts[text]] if text is not None else doc for doc, text in rows}


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op8_dart_minhash(spark, folder).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == brute_classes([tuple(r) for r in docs])
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)


def test_buckets_with_several_leaders(spark):
    """Groups of edited copies with chains between them: classes equal those of all pairs."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], [words[i] for i in rng.integers(0, 3000, 200)]
    current = list(base)
    for i in range(60):  # a chain: neighbours are similar, ends are not
        rows.append((i, " ".join(current)))
        current[int(rng.integers(0, 200))] = words[int(rng.integers(0, 3000))]
        current[int(rng.integers(0, 200))] = words[int(rng.integers(0, 3000))]
    for i in range(60, 120):  # far copies: half of the text is shared
        rows.append((i, " ".join(base[:120] + [words[j] for j in rng.integers(0, 3000, 60)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc"]: r["class_id"] for r in d.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def test_texts_of_survivors_are_shuffled_once(spark, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, f"text number {i % 7} of some words", "x") for i in range(40)], "doc_id bigint, text string, lang string")
        out = d.survivors(docs)
        text = plan(out)
        assert out.count() == 7 and text.count("Exchange hashpartitioning") == 2  # the documents and the kept ones
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), ["node", "h1", "class_id"])
    rows = d.near_duplicates(docs).collect()
    assert len(rows) == 14
    kept = d.survivors(docs).collect()
    assert len([r for r in kept if r["text"] is None]) == 2
    texts = [r["text"] for r in kept if r["text"] is not None]
    assert len(texts) == len(set(texts)) and sum("same text" in t for t in texts) == 1 and sum("no id" in t for t in texts) == 1
    assert all(r["node"] == "mine" for r in kept)
    assert d.near_duplicates(no_documents(spark)).count() == 0 and d.survivors(no_documents(spark)).count() == 0
