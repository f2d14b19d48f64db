"""Quality rules with thresholds that each language and source sets for itself.

Every document gets a few whole-number measures. Their distribution per language and source is kept in a
mergeable quantile sketch with logarithmic buckets (relative error ``ACCURACY``): a table of counts and sums per bucket,
summed on the map side, whose size depends on the range of a measure and not on the number of documents. Sketches
of groups add up to those of a language and of all documents. Documents that fail a base rule are not part of them.

A document is rejected where a measure lies above the upper fence of its group, median + reach * mean excess, or where it
fails one of the two base rules. The mean excess is what documents have above the median, averaged over all of the group: it tells
groups apart where median and quartiles are zero in all of them. Median and excess of a group are drawn to those of its
language, and a language's to those of all documents, as if the parent were ``PARENT_ROWS`` further documents. A group
whose documents hardly differ gets the measure's least distance from its median in place of the reach.

Defined results: a null or empty text has no words and fails the base rule. Null languages and sources form groups
of their own. Repeated rows are measured and judged alike, one row each. Input columns named like the operator's
own get an underscore in front.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.llm.common import aside, fresh, same, prepared
from prepkit.session import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = "\x20\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

ACCURACY = 0.02
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Documents that a parent's sketch counts as in its children's.
PARENT_ROWS = 50.0
#: Measure -> (SQL of the whole number, reach, least distance of the fence from the median).
MEASURES = {
    "symbol_rate": ("1000 * n_symbols div n_words", 1.5, 20.0),
    "dup_line_rate": ("1000 * n_dup_lines div n_lines", 40.0, 60.0),
    "repeat_rate": ("1000 * n_repeat_words div n_words", 35.0, 40.0),
    "word_length": ("100 * word_chars div n_words", 8.0, 25.0),
}
OWN = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "symbol_rate", "dup_line_rate", "repeat_rate",
       "word_length", "base_failed", "kept", "fence_symbol_rate", "fence_dup_line_rate", "fence_repeat_rate", "fence_word_length")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Sequence[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, the first place included.

    Windows are compared by a hash first; only those whose hash repeats are compared word by word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolling = np.zeros(n, np.uint64)
    for k in range(window):
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    order = np.sort(rolling)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    places = np.flatnonzero(np.isin(rolling, twice))
    found = Counter(tuple(words[p : p + window]) for p in places)
    covered = np.zeros(len(words) + 1, np.int64)
    for p in places:
        if found[tuple(words[p : p + window])] > 1:
            covered[p] += 1
            covered[p + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def features_of(text: str | None) -> dict[str, int]:
    """The counts of one text."""
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    lines = duplicates = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, BLANKS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_lines": lines,
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated_words(words),
    }


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in FEATURES]))
def _features(texts: pa.Array) -> pa.Array:
    return pa.array([features_of(t.as_py()) for t in texts], type=pa.struct([(n, pa.int64()) for n in FEATURES]))


def measure(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all unless given) with the counts, the measures and ``base_failed``, written once."""
    prepared(docs.sparkSession)
    docs = aside(docs if keep is None else docs.select(*{text: None, **dict.fromkeys(keep)}), OWN)
    kept = [c for c in docs.columns if keep is None or c != text or text in keep]
    own = fresh("counts", docs.columns)
    counted = docs.withColumn(own, _features(F.col(f"`{text}`")))
    counted = counted.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{own}.{n}") for n in FEATURES])
    rates = {m: F.when(F.col("n_words") > 0, F.expr(sql)) for m, (sql, _, _) in MEASURES.items()}
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return stage(counted.withColumns(rates | {"base_failed": failed}), "quality-measures")


def bucket(value: Column) -> Column:
    """Bucket of the sketch; zero has one of its own."""
    return F.when(value <= 0, F.lit(-1)).otherwise(F.ceil(F.ln(value.cast("double")) / F.lit(float(np.log(GAMMA)))).cast("int"))


def sketch(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts and sums per language, source, measure and bucket: the sketches, as a table."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES])).alias("p")
    long = measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), pairs).filter(F.col("p.value").isNotNull())
    return long.groupBy("lang", "source", F.col("p.measure").alias("measure"), bucket(F.col("p.value")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p.value").alias("total")
    )


def quantiles(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows, median, upper quartile and mean excess over the median of each measure in each group; sketches that share a group are merged."""
    keys = [*groups, "measure"]
    merged = sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    group = Window.partitionBy(*keys)
    placed = merged.withColumns({"up_to": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group)})

    def at(percent: int) -> Column:
        return F.min(F.when(F.col("up_to") * 100 >= F.col("all") * percent, F.col("bucket"))).over(group)

    def value(b: Column) -> Column:
        return F.when(b < 0, F.lit(0.0)).otherwise(F.lit(2 / (1 + GAMMA)) * F.pow(F.lit(GAMMA), b))

    def above(c: str) -> Column:
        return F.sum(F.when(F.col("bucket") > F.col("middle"), F.col(c)).otherwise(0)).cast("double")

    rows, mid = F.max("all"), F.max(value(F.col("middle")))
    return placed.withColumns({"middle": at(50), "upper": at(75)}).groupBy(*keys).agg(
        rows.alias("rows"), mid.alias("mid"), F.max(value(F.col("upper"))).alias("high"), ((above("total") - mid * above("n")) / rows).alias("excess"))


def fences(sketches: DataFrame) -> DataFrame:
    """One row per language and source with the upper fence of each measure."""
    own, by_lang, whole = (quantiles(sketches, g).drop("high") for g in (["lang", "source"], ["lang"], []))

    def drawn(child: DataFrame, parent: DataFrame, shared: Sequence[str]) -> DataFrame:
        """``child`` with its median and excess drawn to its parent's."""
        joined = child.join(parent.select(*[F.col(c).alias(f"parent_{c}") for c in parent.columns]), same_names(shared, "parent_"))
        weight = F.col("rows") / (F.col("rows") + F.lit(PARENT_ROWS))
        mixed = [(weight * F.col(c) + (1 - weight) * F.col(f"parent_{c}")).alias(c) for c in ("mid", "excess")]
        return joined.select(*[c for c in child.columns if c not in ("mid", "excess")], *mixed)

    known = drawn(own, drawn(by_lang, whole, ["measure"]), ["lang", "measure"])
    reach, least = (F.create_map(*[F.lit(x) for m, v in MEASURES.items() for x in (m, v[k])])[F.col("measure")] for k in (1, 2))
    # The median is known to ``ACCURACY`` only, so a group of equal documents must not reject them for it.
    fence = F.floor(F.col("mid") + F.greatest(reach * F.col("excess"), least + F.lit(2 * ACCURACY) * F.col("mid")))
    return known.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, fence)).alias(f"fence_{m}") for m in MEASURES])


def same_names(names: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of columns with those that carry a prefix."""
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"{prefix}{n}"))
    return condition


def judge(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with ``kept``: false for a failed base rule or a measure above its group's fence."""
    limits = stage(fences(stage(sketch(measured.filter("not base_failed"), lang, source), "quality-sketches")), "quality-fences")
    limits = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    over = F.lit(False)
    for m in MEASURES:
        over = over | F.coalesce(F.col(m) > F.col(f"fence_{m}"), F.lit(False))
    joined = measured.join(limits, same(measured, limits, [(lang, "__lang"), (source, "__source")]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("__lang", "__source")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                  keep: Sequence[str] | None = None) -> DataFrame:
    """Documents with their counts, measures, fences, ``base_failed`` and ``kept``."""
    return judge(measure(docs, text, keep), lang, source)
