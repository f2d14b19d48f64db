"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

1. Equal vectors become one node with a count. Nodes are dealt into shards by k-means, level by level, until a shard holds
   ``SHARD_ROWS`` nodes at most; each level's centres come from a bounded sample of each cell, and centres in link range of each other
   are one. A node goes to the ``OVERLAP`` nearest cells that can hold a link of it; the nearest owns it. A large cell that is left with one centre is
   denser than the link range: there almost all pairs are links, and all pairs of each two of its blocks are compared.
2. In each shard every node takes the nearest of those that share a leaf of some random trees with it, and some seeded random ones, as candidates and
   keeps those that robust pruning leaves: a candidate goes once a kept one is nearer to it by ``ALPHA``. Edges are added in both directions.
3. The adjacency lists of a node from all its shards are united. Neighbours within ``WIDE`` of a node that lie in other shards join its own shard as guests.
4. In each shard every node that it owns searches the united graph from the shard's medoid and its own place: greedily with a beam, and wherever a
   node within range is met, on through all its neighbours, guests too. Cosines are worked out, in double precision, for visited nodes only.
5. A node's links count in the shard that owns it, so no list of pairs is made or merged: a shard gives each
   node's number of links and its root among what was found there. Roots are joined up by connected components.
6. Recall is audited against brute force, for all nodes with an id divisible by 50 against all nodes, ``AUDIT_ROWS`` queries at a time: the
   share of all their links, and the mean share of a node. If either is below ``LEAST_RECALL``, all pairs of vectors are compared in blocks instead.

Defined results: vectors that are null, zero, empty or hold null or non-finite components link with nothing and are components of their own;
vectors of different length never link; repeated rows and equal vectors link with each other; a component is named by its smallest id.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.llm.common import prepared
from prepkit.llm.components import components
from prepkit.session import stage

LEAST = 0.95
SHARD_ROWS = 2048
#: Cells that a level may make of one, and rows of the sample their centres come from.
BRANCHES, SAMPLE_ROWS = 64, 4096
LEVELS = 6
#: Cells that hold a node, and the cosine from which a neighbour in another shard is a guest.
OVERLAP, WIDE = 3, 0.9
#: Bytes of a block's vectors, the least number of a cell's blocks, and nodes whose cosines are held at once.
BLOCK_BYTES, LEAST_BLOCKS, TILE = 8 << 20, 4, 1024
#: Bytes of vectors gathered at once.
GATHERED = 32 << 20
TREES, LEAF = 8, 48
NEAREST, FAR, DEGREE, ALPHA = 32, 8, 24, 1.2
BEAM = 16
AUDIT_ROWS, LEAST_RECALL = 4096, 0.9
SEED = 9

log = logging.getLogger(__name__)


def usable(vector: Column) -> Column:
    """Whether a vector can link at all."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def centres(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k-means of unit vectors, started from points far from each other."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    far = np.full(len(x), np.inf)
    while len(chosen) < min(k, len(x)):
        far = np.minimum(far, np.maximum(0, 2 - 2 * x @ x[chosen[-1]]))
        if far.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
    return c


def reached(x: np.ndarray, c: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and per centre whether its cell can hold a vector in range.

    What a cell owns lies on its side of the plane halfway to each other centre. So a vector that lies beyond one of these
    planes by more than the longest chord of a link has no link into that cell.
    """
    d = x @ c.T
    chord = np.sqrt(max(0.0, 2 - 2 * least))
    can = np.empty(d.shape, bool)
    for j in range(len(c)):
        can[:, j] = (d - chord * np.linalg.norm(c - c[j], axis=1)).max(axis=1) <= d[:, j] + 1e-9
    return np.argmax(d, axis=1), can


def apart(c: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Centres without those in link range of an earlier one."""
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or (c[kept] @ c[i]).max() < least:
            kept.append(i)
    return c[kept]


def cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, some at a time."""
    step = max(1, GATHERED // (8 * x.shape[1]))
    parts = [np.einsum("ij,ij->i", x[a[k : k + step]], x[b[k : k + step]]) for k in range(0, len(a), step)]
    return np.concatenate([np.zeros(0), *parts])


def prune(own: np.ndarray, between: np.ndarray, order: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of some rows at once.

    ``order`` holds each row's candidates, nearest first (-1 for none), ``own`` their cosines with it and ``between`` those among them.
    Returns the kept ones, -1 for none.
    """
    rows = np.arange(len(order))
    far = np.sqrt(np.maximum(0, 2 - 2 * own))
    alive = order >= 0
    kept = np.full((len(order), degree), -1)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = np.argmax(alive, axis=1)
        kept[some, k] = order[rows, pick][some]
        alive &= alpha * np.sqrt(np.maximum(0, 2 - 2 * between[rows, pick])) > far
        alive[rows, pick] = False
    return kept


def leaves(x: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Leaves of a random tree: halves on both sides of a plane between two nodes, down to ``LEAF`` nodes."""
    parts = [rng.permutation(len(x))]
    while parts:
        part = parts.pop()
        if len(part) <= LEAF:
            yield part
            continue
        side = np.argsort(x[part] @ (x[part[0]] - x[part[1]]), kind="stable")
        parts += [part[side[: len(part) // 2]], part[side[len(part) // 2 :]]]


def candidates(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node's candidates, nearest first, and their cosines; -1 for none."""
    n, rng = len(x), np.random.default_rng(seed)
    rows = np.arange(n)
    ids = np.full((n, TREES * LEAF + FAR), -1)
    cos = np.full(ids.shape, -np.inf)
    for t in range(TREES):
        for leaf in leaves(x, rng):
            at = slice(t * LEAF, t * LEAF + len(leaf))
            ids[leaf, at] = leaf
            cos[leaf, at] = x[leaf] @ x[leaf].T
    ids[:, -FAR:] = rng.integers(0, n, (n, FAR))
    cos[:, -FAR:] = cosines(x, np.repeat(rows, FAR), ids[:, -FAR:].reshape(-1)).reshape(n, FAR)
    by_id = np.argsort(ids, axis=1, kind="stable")
    ids, cos = np.take_along_axis(ids, by_id, axis=1), np.take_along_axis(cos, by_id, axis=1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    cos[again | (ids < 0) | (ids == rows[:, None])] = -np.inf
    best = np.argsort(-cos, axis=1, kind="stable")
    best = np.concatenate([best[:, :NEAREST], best[:, NEAREST:][:, :: max(1, (best.shape[1] - NEAREST) // FAR)][:, :FAR]], axis=1)
    ids, cos = np.take_along_axis(ids, best, axis=1), np.take_along_axis(cos, best, axis=1)
    return np.where(np.isfinite(cos), ids, -1), cos


def build(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Adjacency of a shard: pruned candidates in both directions, nearest first."""
    n = len(x)
    order, own = candidates(x, seed)
    kept = np.full((n, DEGREE), -1)
    step = max(1, GATHERED // (8 * order.shape[1] * max(x.shape[1], order.shape[1])))
    for k in range(0, n, step):
        some = x[order[k : k + step]]
        kept[k : k + step] = prune(np.where(order[k : k + step] >= 0, own[k : k + step], -1), some @ some.transpose(0, 2, 1), order[k : k + step])
    a, b = np.repeat(np.arange(n), kept.shape[1]), kept.reshape(-1)
    a, b = a[b >= 0], b[b >= 0]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = pairs // n, pairs % n
    nearest = np.lexsort((-cosines(x, a, b), a))
    return [v[: 2 * DEGREE] for v in np.split(b[nearest], np.searchsorted(a, np.arange(1, n)))]


def search(x: np.ndarray, lists: list[np.ndarray], least: float = LEAST, beam: int = BEAM, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes of a shard each asked node (all, unless given) finds within range, searching the graph from the medoid and itself, and how many
    cosines that took. All queries step together."""
    n = len(x)
    asked = np.arange(n) if asked is None else asked
    width = max(1, max(map(len, lists)))
    graph = np.full((n, width), -1)
    for i, v in enumerate(lists):
        graph[i, : len(v)] = v
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    m = len(asked)
    rows = np.arange(m)
    seen, waiting, found = (np.zeros((m, n), bool) for _ in range(3))  # waiting: in range, not yet expanded
    ids = np.full((m, beam), -1)
    cos = np.full((m, beam), -np.inf)
    done = np.ones((m, beam), bool)
    ids[:, 0], cos[:, 0], done[:, 0], seen[:, medoid] = medoid, cosines(x, asked, np.full(m, medoid)), False, True
    found[:, medoid] = cos[:, 0] >= least
    other = asked != medoid
    ids[other, 1], cos[other, 1], done[other, 1] = asked[other], 1.0, False
    seen[rows, asked] = True
    active = rows
    while len(active):
        # The beam first, the nearest open node; then what lies within range and left the beam.
        open_ = np.where(done[active], -np.inf, cos[active])
        pick = np.argmax(open_, axis=1)
        has = open_[np.arange(len(active)), pick] > -np.inf
        node = ids[active, pick]
        late = ~has
        if late.any():
            rest = active[late]
            node[late] = np.argmax(waiting[rest], axis=1)
            has[late] = waiting[rest, node[late]]
            active, pick, node, late = active[has], pick[has], node[has], late[has]
            if not len(active):
                break
        done[active[~late], pick[~late]] = True
        waiting[active, node] = False
        next_ = graph[node]
        fresh = (next_ >= 0) & ~seen[active[:, None], next_]
        at, where = np.nonzero(fresh)
        to = next_[at, where]
        seen[active[at], to] = True
        value = np.full(next_.shape, -np.inf)
        value[at, where] = cosines(x, asked[active[at]], to)
        hit = value[at, where] >= least
        found[active[at[hit]], to[hit]] = True
        waiting[active[at[hit]], to[hit]] = True
        all_cos = np.concatenate([cos[active], value], axis=1)
        top = np.argsort(-all_cos, axis=1, kind="stable")[:, :beam]
        cos[active] = np.take_along_axis(all_cos, top, axis=1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], next_], axis=1), top, axis=1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), top, axis=1)
    found[:, asked] |= found[:, asked].T
    found[rows, asked] = False
    return found, seen.sum(axis=1)


def roots_of(found: np.ndarray) -> np.ndarray:
    """The smallest position that each node reaches."""
    root = np.arange(len(found))
    a, b = np.nonzero(found)
    while True:
        now = root.copy()
        np.minimum.at(now, a, root[b])
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _level(cells: DataFrame, nodes: DataFrame, level: int, least: float) -> DataFrame | None:
    """``cells`` with the large ones dealt to cells of the next level, or marked dense; None if no cell is too large."""
    counts = cells.filter("not dense").groupBy("cell").agg(F.count(F.lit(1)).alias("c"))
    large = stage(counts.filter(F.col("c") > SHARD_ROWS), "graph-large")
    if not large.take(1):
        return None
    vectors = nodes.select("node", "vec")
    rows = cells.filter("not dense").join(large, "cell").join(vectors, "node")
    chance = F.pmod(F.xxhash64(F.lit(SEED + level), "node"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * SAMPLE_ROWS / F.col("c")
    parts = F.ceil(F.col("c") * F.size("vec") * 8 / F.lit(BLOCK_BYTES)).cast("bigint")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        wanted = int(min(BRANCHES, max(4, -(-3 * int(rows["c"].iloc[0]) // SHARD_ROWS))))
        c = apart(centres(np.stack(rows["vec"].to_list()), wanted, SEED + level), least)
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "parts": [int(rows["parts"].max())], "centres": [c.reshape(-1).tolist()], "alone": [len(c) < 2]})

    sample = rows.filter(chance).select("cell", "c", "node", "vec", parts.alias("parts"))
    learned = stage(sample.groupBy("cell").applyInPandas(learn, "cell string, parts bigint, centres array<double>, alone boolean"), "graph-centres")
    split = learned.filter("not alone")

    def deal(one: pd.DataFrame, learned: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(learned):
            return pd.DataFrame({"node": [], "cell": [], "near": []})
        x = np.stack(one["vec"].to_list())
        c = np.asarray(learned["centres"].iloc[0]).reshape(-1, x.shape[1])
        near = np.where(reached(x, c, least)[1], x @ c.T, -np.inf)
        best = np.argsort(-near, axis=1, kind="stable")[:, :OVERLAP]
        near = np.take_along_axis(near, best, axis=1)
        a, k = np.nonzero(np.isfinite(near))
        names = np.array([f"{one['cell'].iloc[0]}.{t}" for t in range(len(c))], object)
        return pd.DataFrame({"node": one["node"].to_numpy()[a], "cell": names[best[a, k]], "near": near[a, k]})

    # The centres of a cell travel once for each block of its vectors.
    parted = rows.join(split.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64(F.lit(SEED), "node"), F.col("parts")))
    centred = split.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    moved = parted.select("cell", "part", "node", "vec").groupBy("cell", "part").cogroup(centred.select("cell", "part", "centres").groupBy("cell", "part"))
    moved = moved.applyInPandas(deal, "node bigint, cell string, near double").withColumn("dense", F.lit(False))
    kept = cells.join(split.select("cell"), "cell", "left_anti").join(learned.filter("alone").select("cell", "alone"), "cell", "left")
    kept = kept.select("node", "cell", "near", (F.col("dense") | F.coalesce("alone", F.lit(False))).alias("dense"))
    return kept.unionByName(moved)


def shards(nodes: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(node, cell, own) twice: cells of ``SHARD_ROWS`` nodes at most, and denser ones for blocks. Every node is owned by one cell of the two tables."""
    cells = nodes.select("node", F.size("vec").cast("string").alias("cell"), F.lit(0.0).alias("near"), F.lit(False).alias("dense"))
    cells = stage(cells.withColumn("own", F.lit(True)), "graph-cells")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("near"), "cell"))
    for level in range(LEVELS):
        dealt = _level(cells, nodes, level, least)
        if dealt is None:
            break
        ranked = dealt.withColumn("rank", rank).filter(F.col("rank") <= OVERLAP)
        cells = stage(ranked.withColumn("own", F.col("rank") == 1).drop("rank"), "graph-cells")
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.join(counts, "cell").withColumn("dense", F.col("dense") | (F.col("c") > SHARD_ROWS))
    return tuple(cells.filter(kind).select("node", "cell", "own") for kind in ("not dense", "dense"))


def join_up(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the smallest position of each one's component) after the links a - b."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]


def links_between(x: np.ndarray, y: np.ndarray | None, copies: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links and roots of two blocks' nodes by all pairs between them, or of one block's by all its pairs. ``copies`` has x's first."""
    n = len(x)
    other, shift = (x, 0) if y is None else (y, n)
    links, root = np.zeros(len(copies)), np.arange(len(copies))
    for i in range(0, n, TILE):
        for j in range(i if y is None else 0, len(other), TILE):
            a, b = np.nonzero(x[i : i + TILE] @ other[j : j + TILE].T >= least)
            a, b = a + i, b + j + shift
            if y is None:
                a, b = a[a < b], b[a < b]
            if len(a):
                links += np.bincount(a, copies[b], len(links)) + np.bincount(b, copies[a], len(links))
                root = join_up(root, a, b)
    return links, root


def _block_links(whole: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(node, links, root) from all pairs of large cells: each two of a cell's blocks meet in one task. A block is one row."""
    counts = whole.groupBy("cell").agg(F.count(F.lit(1)).alias("c"))
    rows = whole.join(counts, "cell").join(nodes.select("node", "vec", "copies"), "node")
    rows = rows.withColumn("parts", F.greatest(F.when(F.col("c") > SHARD_ROWS, LEAST_BLOCKS).otherwise(1), F.ceil(F.col("c") * F.size("vec") * 8 / F.lit(BLOCK_BYTES))).cast("bigint"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(SEED), "node"), F.col("parts")))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        packed = {n: [rows[n].to_numpy(kind).tobytes()] for n, kind in (("node", "<i8"), ("own", "?"), ("copies", "<f8"))}
        return pd.DataFrame({n: [rows[n].iloc[0]] for n in ("cell", "parts", "part")} | packed | {"vec": [np.stack(rows["vec"].to_list()).tobytes()]})

    kinds = "cell string, parts bigint, part bigint, node binary, own binary, copies binary, vec binary"
    blocks = stage(rows.drop("c").groupBy("cell", "part").applyInPandas(pack, kinds), "graph-blocks")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    met = blocks.withColumn("other", other).withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")})

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows["a"].iloc[0] == rows["b"].iloc[0]
        ids, own, copies = (np.concatenate([np.frombuffer(v, kind) for v in rows[n]]) for n, kind in (("node", "<i8"), ("own", "?"), ("copies", "<f8")))
        if not own.any() or len(rows) < 2 and not one:  # nothing is asked, or the other block is empty
            return pd.DataFrame({"node": ids[:0], "links": ids[:0], "root": ids[:0]})
        x = [np.frombuffer(v, np.float64).reshape(len(n) // 8, -1) for v, n in zip(rows["vec"], rows["node"])]
        links, root = links_between(x[0], None if one else x[1], copies, least)
        some = links > 0
        return pd.DataFrame({"node": ids[some], "links": np.where(own, links, 0)[some].astype(np.int64), "root": ids[root][some]})

    return met.groupBy("cell", "a", "b").applyInPandas(compare, "node bigint, links bigint, root bigint")


def _links(nodes: DataFrame, least: float, exact: bool = False) -> DataFrame:
    """(node, links, root, looked) for each node of a shard, and for nodes with links in each two blocks; ``looked`` counts the cosines of a
    search, null in blocks. ``exact``: all pairs of vectors, without a graph."""
    looked = F.lit(None).cast("bigint").alias("looked")
    if exact:
        every = nodes.select("node", F.size("vec").cast("string").alias("cell"), F.lit(True).alias("own"))
        return stage(_block_links(every, nodes, least).select("*", looked), "graph-links")
    cells, whole = shards(nodes, least)
    cells = stage(cells.withColumn("cell", F.xxhash64("cell")), "graph-members")
    vectors = nodes.select("node", "vec", "copies")

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        ids, x = rows["node"].to_numpy(), np.stack(rows["vec"].to_list())
        lists = build(x, int(rows["cell"].iloc[0]) & 0xFFFFFFFF)
        close = [v[x[v] @ x[i] >= min(WIDE, least)] for i, v in enumerate(lists)]
        return pd.DataFrame({"node": ids, "next": [ids[v].tolist() for v in lists], "close": [ids[v].tolist() for v in close]})

    edges = stage(cells.join(vectors, "node").groupBy("cell").applyInPandas(make, "node bigint, next array<bigint>, close array<bigint>"), "graph-edges")
    lists = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("next", "close")]
    united = stage(edges.groupBy("node").agg(*lists), "graph-united")
    guests = cells.filter("own").join(united, "node").select("cell", F.explode("close").alias("node")).distinct()
    guests = guests.join(cells, ["cell", "node"], "left_anti").select("node", "cell", F.lit(False).alias("own"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        ids = rows["node"].to_numpy()
        asked = np.flatnonzero(rows["own"].to_numpy(bool))
        if not len(asked):
            return pd.DataFrame({"node": ids[:0], "links": ids[:0], "root": ids[:0], "looked": ids[:0]})
        place = {int(v): i for i, v in enumerate(ids)}
        lists = [np.array([place[v] for v in map(int, some) if v in place], np.int64) for some in rows["next"]]
        found, looked = search(np.stack(rows["vec"].to_list()), lists, least, asked=asked)
        # A node's links count in the shard that owns it.
        links, cosines = np.zeros((2, len(ids)), np.int64)
        links[asked], cosines[asked] = found @ rows["copies"].to_numpy().astype(np.float64), looked
        a, b = np.nonzero(found)
        return pd.DataFrame({"node": ids, "links": links, "root": ids[join_up(np.arange(len(ids)), asked[a], b)], "looked": cosines})

    full = cells.unionByName(guests).join(vectors, "node").join(united.select("node", "next"), "node")
    walked = full.groupBy("cell").applyInPandas(walk, "node bigint, links bigint, root bigint, looked bigint")
    return stage(walked.unionByName(_block_links(whole, nodes, least).select("*", looked)), "graph-links")


def audit(nodes: DataFrame, counted: DataFrame, least: float, rows: int = AUDIT_ROWS) -> float:
    """Share of the links of all asked nodes that were found, or the mean share of a node if that is less.

    All nodes are compared with the queries, ``rows`` of them at a time, so neither the driver nor a task holds more; where no node is asked, those ``rows`` of least hash are.
    """
    number = nodes.filter("asked").count()
    blocks = -(-number // rows)
    block = F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(max(blocks, 1)))
    parts = [nodes.filter("asked").filter(block == b) for b in range(blocks)] or [nodes.orderBy(F.xxhash64(F.lit(SEED), "node")).limit(rows)]
    true = [stage(t, "graph-audit") for p in parts if (t := _true_links(nodes, p.select("node", "vec").collect(), least)) is not None]
    if not true:
        return 1.0
    true = reduce(DataFrame.unionByName, true)
    found = F.least("true", F.coalesce("links", F.lit(0)))
    row = true.filter(F.col("true") > 0).join(counted, "node", "left").agg(F.sum("true").alias("t"), F.sum(found).alias("f"), F.avg(found / F.col("true")).alias("mean")).first()
    return min(row["f"] / row["t"], row["mean"]) if row["t"] else 1.0


def _true_links(nodes: DataFrame, asked: list, least: float) -> DataFrame | None:
    """Links of the asked nodes by comparing them with all nodes."""
    if not asked:
        return None
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["vec"]) for r in asked}:
        own = [r for r in asked if len(r["vec"]) == size]
        by_size[size] = np.array([r["node"] for r in own]), np.array([r["vec"] for r in own])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for size, (ids, queries) in by_size.items():
                some = frame[frame["vec"].map(len) == size]
                if len(some):
                    near = queries @ np.stack(some["vec"].to_list()).T >= least
                    near &= ids[:, None] != some["node"].to_numpy()[None, :]
                    yield pa.RecordBatch.from_pydict({"node": pa.array(ids), "true": pa.array((near @ some["copies"].to_numpy()).astype(np.int64))})

    return nodes.select("node", "vec", "copies").mapInArrow(compare, "node bigint, true bigint").groupBy("node").agg(F.sum("true").alias("true"))


def _nodes(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h1, h2; null where unusable) and distinct vectors (node, vec of length one, copies, first id)."""
    body = F.col(f"`{vector}`").cast("array<double>")
    good = usable(body)
    h1, h2 = F.xxhash64(body), F.xxhash64(F.lit(1), body, F.size(body))
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.when(good, h1).alias("h1"), F.when(good, h2).alias("h2"), F.when(good, body).alias("vec"))
    rows = stage(rows, "graph-rows")
    asked = F.max(F.coalesce(F.col("id") % 50 == 0, F.lit(False)))
    distinct = rows.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"), asked.alias("asked"), F.first("vec").alias("vec"))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scaled(values: pa.Array) -> pa.Array:
        return pa.array([unit(np.asarray(v.values, np.float64)[None, :])[0] for v in values], pa.list_(pa.float64()))

    return rows.drop("vec"), stage(distinct.withColumn("vec", scaled("vec")).withColumn("node", F.monotonically_increasing_id()), "graph-nodes")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """One row per vector: its id, ``n_links``, ``component_id`` and ``kept``."""
    prepared(vectors.sparkSession)
    rows, nodes = _nodes(vectors, key, vector)
    for exact in (False, True):
        links = _links(nodes, least, exact)
        counted = stage(links.groupBy("node").agg(F.sum("links").alias("links")), "graph-counts")
        recall = audit(nodes, counted, least)
        work = links.agg(F.sum("looked").alias("looked"), F.count_if(F.col("looked") > 0).alias("walked")).first()
        log.info("recall %.4f, %s nodes by the graph with %s cosines", recall, work["walked"], work["looked"])
        if recall >= LEAST_RECALL:
            break
    else:
        raise RuntimeError(f"recall {recall:.4f} stays below {LEAST_RECALL}")
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = stage(nodes.select("node", "h1", "h2", "id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "graph-roots")
    names = stage(rooted.groupBy("root").agg(F.min("id").alias("component")), "graph-names")
    known = rooted.join(names, "root").join(counted, "node", "left")
    known = stage(known.select("h1", "h2", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "graph-known")
    out = rows.join(known, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))
