from collections import Counter, defaultdict

from prepkit.llm import sharding as s
from tests.llm.helpers import clashing, no_documents, odd_documents


def shards_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r["slot"])
    return out


def test_counts_and_slots(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = s.shards(docs, bucket_bytes=100_000).collect()
    found = shards_of(rows)
    assert sorted(found) == list(range(40)) and {len(v) for v in found.values()} == {25}
    assert all(sorted(v) == list(range(len(v))) for v in found.values())
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert rows == s.shards(docs, bucket_bytes=100_000).collect()  # seeded
    other = s.shards(docs, seed=1, bucket_bytes=100_000).collect()
    assert {(r["doc_id"], r["shard"]) for r in rows} != {(r["doc_id"], r["shard"]) for r in other}


def test_order_is_shuffled(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    rows = s.shards(docs, n_shards=8, bucket_bytes=8000).collect()
    mean = defaultdict(list)
    for r in rows:
        mean[r["shard"]].append(r["doc_id"])
    assert all(abs(sum(v) / len(v) - 2000) < 250 for v in mean.values())
    assert [len(v) for v in mean.values()] == [500] * 8


def test_repeated_rows_do_not_meet_in_one_bucket(spark):
    docs = spark.range(3000).selectExpr("7L as doc_id", "'same' as text")
    placed, at, n = s.shuffled(docs, bucket_bytes=4000)
    assert n == 3000 and sorted(r[at] for r in placed.collect()) == list(range(3000))


def test_odd_rows(spark):
    rows = s.shards(clashing(odd_documents(spark), ["shard", "position", "__bucket"]), n_shards=3).collect()
    assert len(rows) == 14 and all(r["shard"] == "mine" and r["__bucket"] == "mine" for r in rows)
    counts = Counter(r["_shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert s.shards(no_documents(spark)).count() == 0


def test_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    s.write_shards(docs, str(tmp_path / "out"), n_shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 50, 1: 50, 2: 50, 3: 50}


def test_input_from_a_shuffle_is_written_first(spark, monkeypatch):
    """No row number is given below a shuffle, so a task that runs again gives the same keys."""
    names, stage = [], s.stage
    monkeypatch.setattr(s, "stage", lambda df, name: names.append(name) or stage(df, name))
    s.shuffled(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert names == ["shuffled-buckets"]
    docs = spark.range(2000).selectExpr("id as doc_id", "'t' as text").repartition(7, "doc_id")
    placed, at, n = s.shuffled(docs, bucket_bytes=4000)
    rows = placed.collect()
    assert n == 2000 and sorted(r[at] for r in rows) == list(range(2000)) and len({r["doc_id"] for r in rows}) == 2000
    assert names[1:] == ["shard-input", "shuffled-buckets"]


def test_buckets_share_tasks(spark, monkeypatch):
    """With fewer tasks than buckets the order is the same: one bucket after the other within a task."""
    docs = spark.range(3000).selectExpr("id as doc_id", "'t' as text")
    one = s.shards(docs, n_shards=5, bucket_bytes=4000).collect()
    monkeypatch.setattr(s, "MOST_PARTS", 3)
    assert sorted(one) == sorted(s.shards(docs, n_shards=5, bucket_bytes=4000).collect())
