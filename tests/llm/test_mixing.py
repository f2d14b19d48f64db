import math

import pytest

from prepkit.llm import mixing as m
from tests.llm.helpers import clashing, no_documents, odd_documents


@pytest.mark.parametrize("rate", [0.01, 0.5, 3.0, 80.0, 2000.0])
def test_cumulative(rate):
    cdf = m.cumulative(rate)
    assert cdf == sorted(cdf) and cdf[-1] == pytest.approx(1, abs=1e-9)
    mean = sum(1 - c for c in cdf)
    assert mean == pytest.approx(rate, rel=1e-6)
    if rate < 100:
        assert cdf[0] == pytest.approx(math.exp(-rate))


def test_weights_are_met(spark):
    docs = spark.range(12000).selectExpr("id as doc_id", "repeat('x', 100) as text", "case when id % 6 = 0 then 'a' else 'b' end as source")
    rows = m.mix(docs, {"a": 3.0, "b": 1.0}).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in rows}
    assert counts["a"] == pytest.approx(9000, rel=0.05) and counts["b"] == pytest.approx(3000, rel=0.05)


def test_copies_and_order(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "'text' as text", "cast(id % 3 as string) as source")
    rows = m.mix(docs, budget=2.0).collect()
    for r in rows:
        assert 0 <= r["copy_no"] < r["n_copies"]
    keys = [r["shuffle_key"] for r in rows]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert sorted(map(str, rows)) == sorted(map(str, m.mix(docs.repartition(7), budget=2.0).collect()))


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), ["n_copies", "__draw"])
    rows = m.mix(docs, budget=30.0).collect()
    assert rows and all(r["n_copies"] == "mine" for r in rows)
    assert m.mix(no_documents(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id bigint, text string, source string")
    assert sorted(r["doc_id"] for r in m.mix(blank).collect()) == [1, 2]
    assert m.mix(blank, {"other": 1.0}).count() == 2  # sources without bytes keep their documents once
    named = spark.createDataFrame([(1, "x", "s")], "doc_id bigint, text string, source string")
    assert m.mix(named, {"other": 1.0}).count() == 0
