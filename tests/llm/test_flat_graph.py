import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.llm import flat_graph as g
from prepkit.llm import queries
from prepkit.session import stage
from tests.llm.test_dart_minhash import classes_of


def brute(vectors, least=g.LEAST):
    """(id -> links, id -> component) by all pairs."""
    good = {i: np.array(v, np.float64) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, edges = sorted(good), []
    links = {i: 0 for i, _ in vectors}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = good[i], good[j]
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                edges.append((i, j))
                links[i] += 1
                links[j] += 1
    return links, classes_of(edges, links)


def groups(rng, n, dims, near):
    centre = rng.normal(size=dims)
    return [(centre + near * rng.normal(size=dims)).tolist() for _ in range(n)]


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op9_flat_graph(spark, folder).collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    links, roots = brute(vectors)
    assert {r["vec_id"]: r["n_links"] for r in rows} == links
    assert {r["vec_id"]: r["component_id"] for r in rows} == roots
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_many_shards(spark, monkeypatch):
    """Small shards force several levels; recall stays high and nothing false is linked."""
    monkeypatch.setattr(g, "SHARD_ROWS", 100)
    rng = np.random.default_rng(6)
    vectors = [v for _ in range(40) for v in groups(rng, int(rng.integers(1, 40)), 16, 0.15)] + rng.normal(size=(300, 16)).tolist()
    vectors = list(enumerate(vectors))
    got = {r["vec_id"]: r for r in g.near_vectors(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")).collect()}
    links, _ = brute(vectors)
    assert all(got[i]["n_links"] <= n for i, n in links.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(links.values())


def test_a_group_that_cannot_be_split(spark, monkeypatch):
    """Almost equal vectors, more than a shard holds: all links are found in blocks."""
    monkeypatch.setattr(g, "SHARD_ROWS", 40)
    monkeypatch.setattr(g, "LEVELS", 1)
    monkeypatch.setattr(g, "centres", lambda x, k, seed, rounds=8: x[:1])
    vectors = [(i, [1.0, 1e-12 * i]) for i in range(150)] + [(i, [0.0, 1.0 + i]) for i in range(150, 160)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in g.near_vectors(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {i: (149, 0) if i < 150 else (9, 150) for i in range(160)}


def test_dense_groups_of_several_shards(spark, monkeypatch):
    """Jittered copies, several shards of them, between other vectors: every link is found, and so is every small group's."""
    monkeypatch.setattr(g, "SHARD_ROWS", 100)
    monkeypatch.setattr(g, "BLOCK_BYTES", 64 * 16 * 8)
    rng = np.random.default_rng(8)
    vectors = [v for n in (600, 250, 120, *[3] * 30) for v in groups(rng, n, 16, 0.12)] + rng.normal(size=(100, 16)).tolist()
    vectors = list(enumerate(vectors))
    got = {r["vec_id"]: r for r in g.near_vectors(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")).collect()}
    links, roots = brute(vectors)
    assert sum(links.values()) > 300_000
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["component_id"] for i, r in got.items()} == roots


def test_every_link_lies_in_the_owner_cell():
    rng = np.random.default_rng(2)
    x = g.unit(np.array([v for _ in range(60) for v in groups(rng, 20, 8, 0.2)]))
    first, can = g.reached(x, g.centres(x, 24, 3))
    a, b = np.nonzero(x @ x.T >= g.LEAST)
    assert (first[a] != first[b]).any() and can[b, first[a]].all() and can[np.arange(len(x)), first].all()
    assert can.mean() < 0.6


def test_blocks_compare_all_pairs():
    rng = np.random.default_rng(4)
    x = g.unit(np.array(groups(rng, 1500, 8, 0.25) + rng.normal(size=(900, 8)).tolist()))[rng.permutation(2400)]
    near, copies = x @ x.T >= g.LEAST, rng.integers(1, 4, 2400).astype(float)
    np.fill_diagonal(near, False)
    links, root = g.links_between(x, None, copies, g.LEAST)
    assert (links == near @ copies).all() and (root == g.roots_of(near)).all()
    near[:1100, :1100] = near[1100:, 1100:] = False
    links, root = g.links_between(x[:1100], x[1100:], copies, g.LEAST)
    assert (links == near @ copies).all() and (root == g.roots_of(near)).all()


def test_odd_vectors(spark):
    e = [1.0, 2.0, 3.0]
    vectors = [(1, e), (2, e), (3, [2.0, 4.0, 6.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 3.0]), (8, [float("nan"), 1.0, 1.0]),
               (9, [float("inf"), 1.0, 1.0]), (10, [1.0, 2.0]), (11, [1e200, 2e200, 3e200]), (12, [-1.0, -2.0, -3.0]), (13, [1e-200, 2e-200, 3e-200])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in g.near_vectors(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")).collect()}
    for i in (1, 2, 3, 11, 13):
        assert got[i] == (4, 1, i == 1)
    for i in (4, 5, 6, 7, 8, 9, 10, 12):
        assert got[i] == (0, i, True)
    rows = spark.createDataFrame([(1, e, "x"), (1, e, "x"), (None, e, "y"), (None, None, "z")], "vec_id bigint, embedding array<double>, node string")
    again = sorted(map(tuple, g.near_vectors(rows).collect()), key=repr)
    assert again == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)], key=repr)
    assert g.near_vectors(rows.limit(0)).count() == 0


def test_search_finds_all_of_a_dense_group():
    rng = np.random.default_rng(1)
    x = g.unit(np.array(groups(rng, 300, 32, 0.05) + rng.normal(size=(200, 32)).tolist()))
    found, looked = g.search(x, g.build(x, 5))
    want = x @ x.T >= g.LEAST
    np.fill_diagonal(want, False)
    assert not (found & ~want).any() and found.sum() >= 0.99 * want.sum()


def test_pruning_keeps_the_nearest_and_drops_what_it_covers():
    x = g.unit(np.array([[1, 0.0], [1, 0.1], [1, 0.11], [0, 1.0]]))
    near = x @ x.T
    order = np.argsort(-near, axis=1)
    order = order[:1, 1:]
    kept = g.prune(near[[0]][:, order[0]], near[order[0]][:, order[0]][None], order, degree=4)
    assert kept[0].tolist() == [1, 3, -1, -1]


def test_audit_sees_what_is_missing(spark):
    vectors = [(i, [1.0, 0.001 * i]) for i in range(100)]
    _, nodes = g._nodes(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    full = nodes.selectExpr("node", "99L as links")
    assert g.audit(nodes, full, g.LEAST) == pytest.approx(1)
    assert g.audit(nodes, full.selectExpr("node", "33L as links"), g.LEAST) == pytest.approx(1 / 3)


def test_audit_weighs_nodes_alike_and_asks_without_marked_ids(spark):
    """A large group that was found does not hide that all pairs were missed; no id here is divisible by 50."""
    rng = np.random.default_rng(3)
    vectors = groups(rng, 100, 16, 0.01) + [v for _ in range(50) for v in groups(rng, 2, 16, 0.01)]
    vectors = [(50 * i + 1, v) for i, v in enumerate(vectors)]
    _, nodes = g._nodes(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    missed = nodes.selectExpr("node", "if(id < 5000, 99L, 0L) as links")
    assert g.audit(nodes, missed, g.LEAST) == pytest.approx(0.5)


def test_low_recall_is_mended(spark, monkeypatch):
    """A search that finds nothing: the links come from all pairs."""
    monkeypatch.setattr(g, "search", lambda x, lists, least, asked: (np.zeros((len(asked), len(x)), bool), np.ones(len(asked), int)))
    rng = np.random.default_rng(7)
    vectors = list(enumerate(v for _ in range(20) for v in groups(rng, 4, 16, 0.05)))
    got = {r["vec_id"]: r for r in g.near_vectors(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")).collect()}
    links, roots = brute(vectors)
    assert {i: r["n_links"] for i, r in got.items()} == links and {i: r["component_id"] for i, r in got.items()} == roots
    monkeypatch.setattr(g, "audit", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="recall"):
        g.near_vectors(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>"))


def test_audit_asks_every_marked_id(spark, monkeypatch):
    """More marked ids than one turn takes: a node missed in any of them shows."""
    vectors = spark.range(400).selectExpr("id AS vec_id", "array(cast(cos(id div 2) as double), cast(sin(id div 2) as double)) AS embedding")
    nodes = vectors.selectExpr("vec_id AS node", "1L AS copies", "true AS asked", "embedding AS vec")
    full = g._true_links(nodes, nodes.select("node", "vec").collect(), g.LEAST).withColumnRenamed("true", "links")
    assert g.audit(nodes, full, g.LEAST, rows=64) == pytest.approx(1)
    assert g.audit(nodes, full.selectExpr("node", "CASE WHEN node = 399 THEN 0 ELSE links END AS links"), g.LEAST, rows=64) < 1


def test_the_graph_gives_the_result(spark):
    """Given vectors with jittered copies: nodes are answered by the graph, few cosines are looked at, and no more than one link in a hundred is missed."""
    rng = np.random.default_rng(9)
    x = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()], np.float64)
    x = g.unit(x)
    x = np.concatenate([x, *[x + rng.normal(0, 0.02, x.shape) for _ in range(3)]])
    x = np.unique(g.unit(x), axis=0)
    true = np.concatenate([(x[i : i + 1000] @ x.T >= g.LEAST).sum(axis=1) - 1 for i in range(0, len(x), 1000)])
    nodes = stage(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node bigint, vec array<double>").withColumn("copies", F.lit(1)), "test-nodes")
    cells, whole = g.shards(nodes)
    assert cells.filter("own").count() >= 0.9 * len(x) and cells.filter("own").count() + whole.filter("own").count() == len(x)
    got = g._links(nodes, g.LEAST).groupBy("node").agg(F.sum("links").alias("links"), F.sum("looked").alias("looked")).toPandas().set_index("node").sort_index()
    short = true - got["links"].to_numpy()
    print("short", short.sum(), "of", true.sum(), "looked", got["looked"].sum() / (len(x) ** 2 / 2))
    assert (short >= 0).all() and short.sum() <= 0.01 * true.sum()
    assert got["looked"].sum() < 0.2 * len(x) ** 2 / 2
