"""Quality classifier: supervised subword embeddings.

A document is the bag of its words and of the character n-grams of each word, hashed into ``BUCKETS`` learned vectors. A word that
repeats the one before it stands as one and the same sign, so that runs of a word look alike whatever the word. The vectors are
averaged and a softmax layer gives the probability of each label; vectors and layer are trained together by plain stochastic
gradient descent in numpy on the driver.

Training takes a bounded sample: the ``TRAIN_ROWS`` labelled documents with the smallest hashes among those that are not held out. Tasks turn
them into bucket counts, so no text reaches the driver. Since the layer is linear in the average, scoring needs one number per bucket
(its vector times the layer) and a sum over the words; each worker keeps the sums of words it has met.

Defined results: a null or empty text scores like a document without features; without labels every score is 0.5; a doc_id labelled more than
once counts as its mean label, dropped when undecided; repeated documents count once in training and are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.llm.common import fresh, seeded, prepared

BUCKETS = 1 << 17
DIMENSIONS = 16
GRAMS = (3, 4, 5)
TRAIN_ROWS = 3000
EPOCHS = 8
RATE = 1.0
SEED = 33
#: Words whose sums a worker keeps, and the bytes of the longest such word; others are summed up each time.
KEPT_WORDS, KEPT_BYTES = 700_000, 64
#: Longer words (texts without blanks, long lines) are hashed by numpy, in pieces of so many bytes.
WORD_BYTES, PIECE_BYTES = 256, 1 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Stands for a word that repeats the one before it, and how many features it counts as: as many as a usual word has.
AGAIN, AGAIN_FEATURES = b"\x00", 12

_SUMS: dict[int, dict[bytes, tuple[float, int]]] = {}


def buckets_of(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams (of UTF-8 bytes, with marks for start and end)."""
    if word == AGAIN:
        return [zlib.crc32(AGAIN) % BUCKETS] * AGAIN_FEATURES
    marked = b"<" + word + b">"
    found = [zlib.crc32(marked + b"=")]
    for n in GRAMS:
        found += [zlib.crc32(marked[i : i + n]) for i in range(len(marked) - n + 1)]
    return [f % BUCKETS for f in found]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def long_buckets(word: bytes) -> Iterator[np.ndarray]:
    """The same as ``buckets_of``, in arrays of bounded size: crc32 of all n-grams at once."""
    marked = b"<" + word + b">"
    yield np.array([zlib.crc32(marked + b"=") % BUCKETS])
    signs = np.frombuffer(marked, np.uint8)
    for n in GRAMS:
        for start in range(0, len(signs) - n + 1, PIECE_BYTES):
            piece = signs[start : start + PIECE_BYTES + n - 1]
            m = len(piece) - n + 1
            crc = np.full(m, 0xFFFFFFFF, np.uint32)
            for k in range(n):
                crc = CRC[(crc ^ piece[k : k + m]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            yield (~crc % np.uint32(BUCKETS)).astype(np.int64)


def words_of(text: bytes) -> Counter:
    """Words with their counts, A-Z lower-cased; a word that repeats the one before it counts as the sign for that."""
    words = WORD.findall(text.lower())
    return Counter([AGAIN if w == last else w for w, last in zip(words, [b"", *words])])


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a whole text."""
    index, weight, long = [], [], []
    for word, n in words_of(text).items():
        if len(word) > WORD_BYTES:
            for found in long_buckets(word):
                some, counts = np.unique(found, return_counts=True)
                long.append((some, n * counts))
            continue
        found = buckets_of(word)
        index += found
        weight += [n] * len(found)
    every = np.concatenate([np.array(index, np.int64), *[b for b, _ in long]])
    weights = np.concatenate([np.array(weight, np.float64), *[w for _, w in long]])
    buckets, where = np.unique(every, return_inverse=True)
    return buckets.astype("<i4"), np.bincount(where, weights, len(buckets)).astype("<f4")


@dataclass
class Model:
    """``weights``: what a bucket adds to the logit, times its share of the document; ``bias`` is that of an empty text."""

    weights: np.ndarray
    bias: float

    def sum_of(self, word: bytes) -> tuple[float, int]:
        if len(word) > WORD_BYTES:
            sums = [(self.weights[found].sum(dtype=np.float64), len(found)) for found in long_buckets(word)]
            return float(sum(t for t, _ in sums)), sum(n for _, n in sums)
        found = buckets_of(word)
        return float(self.weights[found].sum(dtype=np.float64)), len(found)

    def score(self, text: bytes, known: dict[bytes, tuple[float, int]]) -> float:
        total, number = 0.0, 0
        for word, n in words_of(text).items():
            got = known.get(word)
            if got is None:
                got = self.sum_of(word)
                if len(known) < KEPT_WORDS and len(word) <= KEPT_BYTES:
                    known[word] = got
            total += n * got[0]
            number += n * got[1]
        return float(1 / (1 + np.exp(-(self.bias + (total / number if number else 0.0)))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = SEED, epochs: int = EPOCHS,
          dimensions: int = DIMENSIONS, rate: float = RATE) -> Model:
    """Stochastic gradient descent, one document at a time, with a falling rate."""
    if not bags:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, dimensions), np.float32) - 0.5) / dimensions).astype(np.float32)
    layer, bias = np.zeros((dimensions, 2), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            index, counts = bags[i]
            now = rate * (1 - step / steps)
            step += 1
            share = (counts / counts.sum())[:, None] if len(index) else np.zeros((0, 1), np.float32)
            rows = vectors[index]
            hidden = (share * rows).sum(axis=0)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = layer @ error
            layer -= now * np.outer(hidden, error)
            bias -= now * 0.1 * error
            # The share of a bucket in a document is small; the largest one is scaled to one, as in the update of a single word.
            if len(index):
                vectors[index] = rows - now * (share / share.max()) * back
    difference = layer[:, 1] - layer[:, 0]
    return Model((vectors @ difference).astype(np.float32), float(bias[1] - bias[0]))


def held_out(key: Column) -> Column:
    """Documents that training never sees: a third by crc32 of the id as text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [bag(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("place"), batch.column("y"), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([c.tobytes() for _, c in made], pa.binary())],
            names=["place", "y", "index", "counts"],
        )


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Train on the sampled rows of ``labels``."""
    prepared(docs.sparkSession)
    mean = F.avg(F.col(f"`{label}`"))
    known = labels.filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull() & ~held_out(F.col(f"`{key}`")))
    known = known.groupBy(F.col(f"`{key}`").alias("__key")).agg(mean.alias("mean")).filter("mean <> 0.5")
    present = known.join(docs.select(F.col(f"`{key}`").alias("__key")), "__key", "left_semi")
    sample = present.select("__key", (F.col("mean") > 0.5).cast("int").alias("y"), seeded(SEED, "__key").alias("place")).orderBy("place", "__key").limit(rows)
    sample = F.broadcast(sample)  # at most `rows` rows of three numbers
    texts = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("text")).join(sample, "__key")
    once = texts.groupBy("__key", "place", "y").agg(F.min("text").alias("text")).select("place", "y", "text")
    got = sorted(once.mapInArrow(_bags, "place bigint, y int, index binary, counts binary").collect())
    return train([(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["counts"], "<f4")) for r in got], [r["y"] for r in got])


def scorer(model: Model):
    """The score of a text column."""
    stamp = zlib.crc32(model.weights.tobytes() + repr(model.bias).encode())

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if stamp not in _SUMS:
            _SUMS.clear()
            _SUMS[stamp] = {}
        known = _SUMS[stamp]
        return pa.array([model.score(t.as_buffer().to_pybytes() if t.is_valid else b"", known) for t in texts], pa.float64())

    return score


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` of label 1 and ``predicted``. Columns of those names stay, ours get underscores."""
    model = fit(docs, labels, text, key, label, rows)
    out, score, predicted = (fresh(n, docs.columns) for n in ("held_out", "score", "predicted"))
    scored = docs.withColumns({out: held_out(F.col(f"`{key}`")), score: scorer(model)(F.col(f"`{text}`"))})
    return scored.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
