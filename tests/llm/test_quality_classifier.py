import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.llm import queries
from prepkit.llm import quality_classifier as q
from tests.llm.helpers import clashing, no_documents, odd_documents


def test_bag_counts_every_gram():
    index, counts = q.bag("Ab ab cÉ".encode())
    want = {}
    for word in ("ab", "\x00", "cÉ"):
        for b in q.buckets_of(word.encode()):
            want[b] = want.get(b, 0) + 1
    assert dict(zip(index.tolist(), counts.tolist())) == want
    assert [len(a) for a in q.bag(b"")] == [0, 0]


def grams(word):
    marked = b"<" + word + b">"
    return sorted(zlib.crc32(g) % q.BUCKETS for g in [marked + b"=", *[marked[i : i + n] for n in q.GRAMS for i in range(len(marked) - n + 1)]])


def test_long_words_count_whole(monkeypatch):
    rng = np.random.default_rng(2)
    for piece, size in ((1 << 20, 70), (1 << 20, 5000), (100, 997)):
        monkeypatch.setattr(q, "PIECE_BYTES", piece)
        word = rng.integers(128, 256, size).astype(np.uint8).tobytes()
        assert sorted(q.buckets_of(word)) == sorted(np.concatenate(list(q.long_buckets(word))).tolist()) == grams(word)
        index, counts = q.bag(b"ab " + word + b" ab")
        want = np.bincount(grams(word), minlength=q.BUCKETS) + 2 * np.bincount(q.buckets_of(b"ab"), minlength=q.BUCKETS)
        assert index.tolist() == np.flatnonzero(want).tolist() and counts.tolist() == want[want > 0].tolist()


def test_the_middle_of_a_text_without_blanks_is_seen():
    ends = "一二三四五六七八九十" * 4
    good, bad = [f"{ends}{'好文章很清楚' * n}{ends}".encode() for n in (40, 60)], [f"{ends}{'垃圾广告点击' * n}{ends}".encode() for n in (40, 60)]
    model = q.train([q.bag(t) for t in good + bad], [1, 1, 0, 0], epochs=40)
    known = {}
    assert all(model.score(t, known) > 0.5 for t in good) and all(model.score(t, known) < 0.5 for t in bad)
    assert not known
    index, counts = q.bag(good[0])
    logit = model.bias + float((model.weights[index] * counts).sum() / counts.sum())
    assert model.score(good[0], {}) == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_score_is_the_softmax_of_the_average():
    rng = np.random.default_rng(5)
    good, bad = [b"fine prose here", b"more fine words"], [b"x### y$$$", b"z*** ###"]
    bags = [q.bag(b" ".join(rng.permutation(t.split()))) for t in good + bad]
    model = q.train(bags, [1, 1, 0, 0], epochs=40)
    for text, (index, counts) in zip(good + bad, bags):
        logit = model.bias + float((model.weights[index] * counts).sum() / counts.sum())
        assert model.score(text, {}) == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)
    assert all(model.score(t, {}) > 0.5 for t in good) and all(model.score(t, {}) < 0.5 for t in bad)
    assert model.score(b"", {}) == pytest.approx(1 / (1 + np.exp(-model.bias)))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op3_quality_classifier(spark, folder)
    assert rows.count() == 1000
    for r in rows.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.5)
    judged = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in judged])
    low, high = ([r["score"] for r in judged if r["quality"] == y] for y in (0, 1))
    auc = np.mean([[h > l for l in low] for h in high])
    assert right > 0.9 and auc > 0.9, (right, auc)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    wrong = labels.withColumn("quality", F.when(q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert q.fit(docs, labels).weights.tolist() == q.fit(docs, wrong).weights.tolist()


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), ["score", "held_out"])
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (5, 1), (5, 0), (6, None), (None, 1), (2, 1)], "doc_id bigint, quality int")
    rows = q.classify(docs, labels).collect()
    assert len(rows) == 14 and all(r["score"] == "mine" and 0 <= r["_score"] <= 1 for r in rows)
    assert {r["_score"] for r in q.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert q.classify(no_documents(spark), labels).count() == 0
