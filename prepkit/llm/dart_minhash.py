"""Near-duplicate texts by DartMinHash signatures and banded joining.

A text is the set of its five-word shingles (A-Z lower-cased, signs of ASCII left out), each with a weight: 1, or its
count with ``weighted=True``. Darts are thrown by hashes of the shingle into a plane of weight and rank, cell by cell, the
number in a cell being Poisson; a dart hits if its weight lies below the shingle's. Every dart belongs to one of ``BANDS * ROWS`` coordinates, and each coordinate
keeps the hit of the lowest rank. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity, and
the work for a text is linear in its shingles plus its darts, of which only so many are thrown that each coordinate has one.

Texts that agree in a band share a bucket. Equal texts are one node from the start. Each bucket is led by its node
with the most company in all its buckets; the others are compared with it by exact Jaccard similarity, and what is similar makes components. Of
the pairs that share a bucket only those of different components can still matter. All of them are looked at, nodes outside of the
bucket's largest component against all its nodes, but only pairs that a bound leaves are listed and compared: a
text's parity sketch has one bit per hash range, the parity of its shingles there, so two sketches differ in no more bits than
the texts differ in shingles. The bound loses nothing. So every similar pair that shares a bucket ends in one class,
without all pairs of a group being listed.

A pair at similarity 0.8 shares no bucket with probability (1 - 0.8**5)**25, below 5e-5.

Defined results: a null text is a class of its own; texts without words are classes by exact equality; a text with fewer than five words is
one shingle; repeated rows are in one class and marked alike; the class id is the smallest doc_id (null only if all are).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.llm.common import fresh, prepared
from prepkit.llm.components import components
from prepkit.session import stage

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Bits of a parity sketch, kept in numbers of 64.
SKETCH_BITS = 1024
SEED = 8
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Word hashes that a worker keeps; others are hashed each time.
KEPT_WORDS = 200_000
#: Shingles whose darts a worker holds at a time, but for a single text of more.
HELD_SHINGLES = 200_000
#: The lowest rank cell is [0, 2**LOWEST); above it each cell doubles.
LOWEST = -6

class _Hashes(dict):
    """Hashes of words; a word not met before is hashed."""

    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = made
        return made


_HASHES = _Hashes()
_COUNTS: dict[float, np.ndarray] = {}
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a permutation of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingles(text: bytes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles of a whole text, and how often each occurs."""
    found = WORD.findall(text.lower())
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = max(1, len(codes) - words + 1)
    rolling = np.zeros(n, np.uint64)
    for k in range(min(words, len(codes))):
        rolling = mix(rolling * _ODD + codes[k : k + n])
    return np.unique(rolling, return_counts=True)


def _poisson(area: float, u: np.ndarray) -> np.ndarray:
    """Inverse Poisson distribution with mean ``area``."""
    if area not in _COUNTS:
        k = np.arange(int(area + 12 * math.sqrt(area) + 40))
        _COUNTS[area] = np.cumsum(np.exp(k * math.log(area) - area - np.array([math.lgamma(i + 1) for i in k])))
    return np.searchsorted(_COUNTS[area], u, side="right")


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], weighted: bool = False, size: int = BANDS * ROWS, seed: int = SEED) -> np.ndarray:
    """One row of ``size`` dart hashes per set of (element hashes, counts); zeros for an empty set. All sets go through each cell at once."""
    docs = len(sets)
    doc = np.repeat(np.arange(docs), [len(e) for e, _ in sets])
    element = np.concatenate([e for e, _ in sets]) if docs else np.zeros(0, np.uint64)
    weight = np.concatenate([c for _, c in sets]).astype(np.float64) if docs else np.zeros(0)
    if not weighted:
        weight = np.ones(len(element))
    total = np.bincount(doc, weight, docs)
    # Ranks up to here hold enough darts for nearly all coordinates; those left empty look further.
    need = np.full(docs, -np.inf)
    filled = total > 0
    need[filled] = np.ceil(np.log2(size * (math.log(size) + 2) / total[filled]))
    best_rank = np.full((docs, size), np.inf)
    best = np.zeros((docs, size), np.uint64)
    level, open_docs = LOWEST, filled.copy()
    while open_docs.any():
        low, high = (0.0, 2.0**LOWEST) if level == LOWEST else (2.0 ** (level - 1), 2.0**level)
        mine = np.flatnonzero(open_docs[doc])
        hits = _throw(element[mine], weight[mine], level, low, high, size, seed)
        if len(hits[0]):
            of, coordinate, rank, dart = doc[mine[hits[0]]], *hits[1:]
            place = of * size + coordinate
            order = np.lexsort((rank, place))
            place, rank, dart = place[order], rank[order], dart[order]
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            flat_rank, flat = best_rank.reshape(-1), best.reshape(-1)
            better = first[rank[first] < flat_rank[place[first]]]
            flat_rank[place[better]], flat[place[better]] = rank[better], dart[better]
        open_docs &= (level < need) | ~np.isfinite(best_rank).all(axis=1)
        level += 1
    return best


def signatures_by_parts(sets: list[tuple[np.ndarray, np.ndarray]], weighted: bool = False) -> np.ndarray:
    """``signatures`` of some sets after others, so that memory follows ``HELD_SHINGLES`` or the longest text and not the batch."""
    part = (np.cumsum([len(e) for e, _ in sets]) - 1) // HELD_SHINGLES
    cuts = np.flatnonzero(np.diff(part)) + 1
    return np.concatenate([signatures(sets[i:j], weighted) for i, j in zip([0, *cuts], [*cuts, len(sets)])])


def _throw(element, weight, level: int, low: float, high: float, size: int, seed: int):
    """Hits in one layer of ranks: (index of element, coordinate, rank, dart)."""
    found = []
    top = int(math.ceil(math.log2(weight.max()))) if len(weight) and weight.max() > 1 else 0
    for step in range(top + 1):
        w_low, w_high = (0.0, 1.0) if step == 0 else (2.0 ** (step - 1), 2.0**step)
        mine = np.arange(len(element)) if step == 0 else np.flatnonzero(weight > w_low)
        with np.errstate(over="ignore"):
            cell = mix(np.array([(seed << 32) + (step << 16) + level + 1024], np.uint64) * _ODD)[0]
            base = mix(element[mine] ^ cell)
            number = _poisson((high - low) * (w_high - w_low), _uniform(mix(base + _ODD)))
            hit = np.repeat(np.arange(len(mine)), number)
            nth = np.arange(len(hit)) - np.repeat(np.cumsum(number) - number, number)
            dart = mix(base[hit] + (nth.astype(np.uint64) + np.uint64(2)) * _ODD)
            inside = np.ones(len(hit), bool)
            if weight[mine].min(initial=1.0) < w_high or step:
                inside = w_low + (w_high - w_low) * _uniform(mix(dart ^ np.uint64(0x5851F42D4C957F2D))) < weight[mine][hit]
            hit, dart = hit[inside], dart[inside]
            rank = low + (high - low) * _uniform(mix(dart + np.uint64(1)))
            coordinate = (mix(dart + np.uint64(2)) % np.uint64(size)).astype(np.int64)
        found.append((mine[hit], coordinate, rank, dart))
    return tuple(np.concatenate(x) for x in zip(*found))


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band: its number and its darts."""
    parts = signature.reshape(len(signature), bands, rows)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _ODD), (len(signature), bands)).copy()
    for r in range(rows):
        with np.errstate(over="ignore"):
            keys = mix(keys * _ODD + parts[:, :, r])
    return keys.view(np.int64)


def _raw(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def parity_sketch(elements: np.ndarray, counts: np.ndarray, weighted: bool = False) -> np.ndarray:
    """Parity of the shingles (or of their counts) in each range of hashes."""
    places = (elements >> np.uint64(20)).astype(np.int64) % SKETCH_BITS
    sums = np.bincount(places, counts if weighted else None, SKETCH_BITS).astype(np.int64)
    return np.packbits((sums & 1).astype(np.uint8)).view("<i8")


def _keys_of(weighted: bool):
    numbers = T.ArrayType(T.LongType())

    @F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("bands", numbers), T.StructField("sketch", numbers)]))
    def keys(texts: pa.Array) -> pa.Array:
        sets = [shingles(_raw(t)) for t in texts]
        made = band_keys(signatures_by_parts(sets, weighted))
        sizes = pa.array([int(c.sum()) if weighted else len(e) for e, c in sets], pa.int64())
        full = np.array([len(e) > 0 for e, _ in sets], bool)
        offsets = pa.array(np.r_[0, np.cumsum(full * BANDS)].astype(np.int32), pa.int32())
        bands = pa.ListArray.from_arrays(offsets, pa.array(made[full].reshape(-1), pa.int64()))
        sketches = pa.array([parity_sketch(e, c, weighted) for e, c in sets], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([sizes, bands, sketches], names=["n", "bands", "sketch"])

    return keys


@F.arrow_udf(T.StructType([T.StructField("e", T.BinaryType()), T.StructField("c", T.BinaryType())]))
def _sets(texts: pa.Array) -> pa.Array:
    made = [(e.astype("<u8").tobytes(), c.astype("<u4").tobytes()) for e, c in (shingles(_raw(t)) for t in texts)]
    return pa.StructArray.from_arrays([pa.array([e for e, _ in made], pa.binary()), pa.array([c for _, c in made], pa.binary())], names=["e", "c"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weighted: bool = False) -> float:
    """Jaccard similarity of two sets, or of their counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if weighted:
        common = int(np.minimum(a[1][i], b[1][j]).sum())
        whole = int(a[1].sum()) + int(b[1].sum()) - common
    else:
        common, whole = len(i), len(a[0]) + len(b[0]) - len(i)
    return common / whole if whole else 0.0


def _similarities(weighted: bool):
    @F.arrow_udf(T.DoubleType())
    def of(ae: pa.Array, ac: pa.Array, be: pa.Array, bc: pa.Array) -> pa.Array:
        view = lambda e, c: (np.frombuffer(e.as_py(), "<u8"), np.frombuffer(c.as_py(), "<u4").astype(np.int64))
        return pa.array([similarity(view(p, q), view(r, s), weighted) for p, q, r, s in zip(ae, ac, be, bc)], pa.float64())

    return of


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text, F.length(text))


def _nodes(docs: DataFrame, text: str, key: str, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, h1, h2) and the distinct texts (node, h1, h2, doc, n, bands). Two hashes tell texts apart."""
    body = F.col(f"`{text}`")
    h1, h2 = _hashes(body)
    made = docs.filter(body.isNotNull()).select(F.col(f"`{key}`").alias("doc"), h1.alias("h1"), h2.alias("h2"), _keys_of(weighted)(body).alias("k"))
    rows = stage(made.select("doc", "h1", "h2", "k.n", "k.bands", "k.sketch"), "dart-signatures")
    once = [F.first(c).alias(c) for c in ("n", "bands", "sketch")]
    nodes = rows.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), *once)
    return rows.select("doc", "h1", "h2"), stage(nodes.withColumn("node", F.monotonically_increasing_id()), "dart-nodes")


def _possible(least: float) -> Column:
    """Whether nodes x and y can be similar: their texts differ in no fewer shingles than their sketches in bits."""
    apart = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        apart = apart + F.bit_count(F.get("xs", F.lit(i)).bitwiseXOR(F.get("ys", F.lit(i))))
    both = F.col("xn") + F.col("yn")
    return both - apart >= F.lit(least) * (both + apart) - F.lit(1e-9)


def similar_links(docs: DataFrame, nodes: DataFrame, text: str, key: str, weighted: bool, least: float) -> DataFrame:
    """Links (a, b) between nodes whose components are those of all similar pairs that share a bucket."""
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = stage(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "dart-buckets")
    members = stage(banded.join(shared, "bucket"), "dart-members")
    company = stage(members.groupBy("node").agg(F.sum("c").alias("company")), "dart-company")
    leaders = members.join(company, "node").groupBy("bucket").agg(F.max_by("node", "company").alias("leader"))
    led = stage(members.select("bucket", "node").join(stage(leaders, "dart-leaders"), "bucket"), "dart-led")

    active = stage(company.select("node").join(nodes, "node").select("node", "h1", F.col("doc").alias("d"), "n", "sketch"), "dart-active")
    body = F.col(f"`{text}`")
    texts = docs.filter(body.isNotNull()).select(F.col(f"`{key}`").alias("__d"), body.alias("__t"), _hashes(body)[0].alias("__h"))
    bodies = texts.join(active, (texts["__h"] == active["h1"]) & texts["__d"].eqNullSafe(active["d"])).select("node", _sets(F.col("__t")).alias("s"))
    sets = stage(bodies.select("node", "s.e", "s.c").dropDuplicates(["node"]), "dart-sets")

    def similar(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("e").alias("ae"), F.col("c").alias("ac"))
        b = sets.select(F.col("node").alias("b"), F.col("e").alias("be"), F.col("c").alias("bc"))
        judged = pairs.join(a, "a").join(b, "b").select("a", "b", _similarities(weighted)("ae", "ac", "be", "bc").alias("sim"))
        return stage(judged.filter(F.col("sim") >= least).select("a", "b"), "dart-similar")

    links = similar(led.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    roots = stage(components(links), "dart-roots")
    placed = led.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stage(placed, "dart-placed")
    # Buckets with several components, and the largest of each.
    sizes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    several = sizes.groupBy("bucket").agg(F.max_by("root", "c").alias("top"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    several = stage(several.filter("r1 <> r2").select("bucket", "top"), "dart-open")
    open_ = placed.join(several, "bucket").join(active.select("node", "n", "sketch"), "node")
    open_ = stage(open_, "dart-open")
    x = open_.filter("root <> top").select("bucket", F.col("node").alias("x"), F.col("root").alias("xr"), F.col("n").alias("xn"), F.col("sketch").alias("xs"))
    y = open_.select("bucket", F.col("node").alias("y"), F.col("root").alias("yr"), F.col("n").alias("yn"), F.col("sketch").alias("ys"))
    y = y.withColumnRenamed("bucket", "at")
    left = x.join(y, (F.col("bucket") == F.col("at")) & (F.col("xr") != F.col("yr")) & _possible(least))
    left = left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return links.unionByName(similar(left))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", weighted: bool = False, least: float = SIMILARITY) -> DataFrame:
    """One row per document: ``doc`` (its key), the two hashes of its text, ``class_id`` (smallest key of its class) and ``kept`` (that document)."""
    prepared(docs.sparkSession)
    rows, nodes = _nodes(docs, text, key, weighted)
    roots = components(similar_links(docs, nodes, text, key, weighted, least))
    rooted = nodes.select("node", "h1", "h2", "doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stage(rooted, "dart-rooted")
    # The text that stays: that of the smallest document, the smallest node among equals.
    chosen = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "node")).alias("best"))
    chosen = stage(chosen.select("root", F.col("best.doc").alias("class_id"), F.col("best.node").alias("best")), "dart-classes")
    classes = stage(rooted.join(chosen, "root").select("h1", "h2", "class_id", (F.col("node") == F.col("best")).alias("stays")), "dart-classes")
    found = rows.join(classes, ["h1", "h2"]).select("doc", "h1", "h2", "class_id", (F.col("stays") & F.col("doc").eqNullSafe(F.col("class_id"))).alias("kept"))
    empty = docs.filter(F.col(f"`{text}`").isNull()).select(F.col(f"`{key}`").alias("doc"))
    none = F.lit(None).cast("bigint")
    alone = empty.select("doc", none.alias("h1"), none.alias("h2"), F.col("doc").alias("class_id"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def survivors(docs: DataFrame, text: str = "text", key: str = "doc_id", weighted: bool = False, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class; rows with null texts all stay.

    The join and the removal of repeated rows go by the same four columns, so the texts are shuffled once.
    """
    found = near_duplicates(docs, text, key, weighted, least).filter(F.col("kept") & F.col("h1").isNotNull())
    body = F.col(f"`{text}`")
    marks = [fresh(f"__{n}", docs.columns) for n in ("h1", "h2", "doc", "none")]

    def marked(df: DataFrame, h1: Column, h2: Column, doc: Column) -> DataFrame:
        return df.withColumns(dict(zip(marks, (h1, h2, F.coalesce(doc, F.lit(0)), doc.isNull()))))

    kept = stage(marked(found, F.col("h1"), F.col("h2"), F.col("doc")).select(*marks).distinct(), "dart-kept")
    hashed = marked(docs.filter(body.isNotNull()), *_hashes(body), F.col(f"`{key}`"))
    staying = hashed.join(kept, marks, "left_semi").dropDuplicates(marks)
    return staying.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter(body.isNull()))
