"""URL filter: listed rules, and for the rest gradient-boosted trees on lexical features.

A URL's host and path are cut out by their signs alone. The longest rule whose host is the URL's host or a parent of it and whose
path starts the URL's path decides. URLs that a rule decides are the labelled ones: trees are trained on a bounded
sample of them, ``TRAIN_ROWS`` rows with the smallest hashes, with length, depth, digit ratio, entropy, parameter counts and statistics of the
host's last label. The statistics are counted over all labelled URLs and joined back. Scoring is an expression.

Defined results: a null URL and one without ``://`` have an empty host and path, fit no rule and are judged as the empty text or by their signs;
repeated rows are judged each; without labelled URLs everything else is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.llm.boost import Trees, train
from prepkit.llm.common import aside, seeded
from prepkit.session import stage

# The given rules, host and path in one text.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
TRAIN_ROWS = 20_000
SEED = 66
#: Pseudo-counts that draw the share of a rare host ending towards a half.
PRIOR = 20.0
FEATURES = ("f_length", "f_host", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_suffix", "f_seen")
OWN = ("host", "path", "rule", "verdict", "score", "suffix", *FEATURES)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")
    bits = F.aggregate(
        F.array_distinct(F.split(text, "")),
        F.lit(0.0),
        lambda total, c: total + (lambda k: F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(F.lit(0.0)))(n - F.length(F.replace(text, c))),
    )
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def _lexical(url: Column) -> dict[str, Column]:
    n = F.length(url)
    count = lambda sign: n - F.length(F.replace(url, F.lit(sign)))
    return {
        "f_length": n.cast("double"),
        "f_host": F.length("host").cast("double"),
        "f_depth": F.size(F.regexp_extract_all("path", F.lit("[^/]+"), F.lit(0))).cast("double"),
        "f_digits": (n - F.length(F.translate(url, "0123456789", ""))) / F.greatest(n, F.lit(1)),
        "f_entropy": entropy(url),
        "f_params": F.when(url.contains("?"), F.size(F.regexp_extract_all(F.substring_index(F.regexp_replace(url, r"^[^?]*\?", ""), "#", 1), F.lit("[^&]+"), F.lit(0)))).otherwise(F.lit(0)).cast("double"),
        "f_hyphens": count("-").cast("double"),
    }


def judged(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, suffix, rule and the rule's verdict. Input columns of those names get an underscore in front."""
    pages = aside(pages, OWN)
    host, path = parts(F.col(f"`{url}`"))
    found = pages.withColumns({"host": host, "path": path}).withColumn("suffix", F.substring_index("host", ".", -1))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return found.withColumns({"rule": rule, "verdict": verdict})


def _featured(found: DataFrame, suffixes: DataFrame, weights: tuple[float, float], url: str, own: Column | None = None, hidden: Column | None = None) -> DataFrame:
    """``found`` with features. ``weights`` make allowed and blocked labels count alike; a row's ``own`` label (0, 1, null) is left out of its ending's share;
    an ending that is unseen, or ``hidden`` from the row, has the neutral share of a half."""
    joined = found.withColumns(_lexical(F.coalesce(F.col(f"`{url}`"), F.lit("")))).join(suffixes, F.col("suffix") == F.col("__suffix"), "left")
    own = F.lit(None).cast("int") if own is None else own
    hidden = F.lit(False) if hidden is None else hidden
    allowed, blocked = F.coalesce(F.col("__n") - F.col("__blocked"), F.lit(0)), F.coalesce("__blocked", F.lit(0))
    allowed = F.when(hidden, 0).otherwise(allowed - F.coalesce(1 - own, F.lit(0))) * weights[0]
    blocked = F.when(hidden, 0).otherwise(blocked - F.coalesce(own, F.lit(0))) * weights[1]
    smooth = (blocked + F.lit(PRIOR / 2)) / (allowed + blocked + F.lit(PRIOR))
    return joined.withColumns({"f_suffix": smooth, "f_seen": F.log2(allowed + blocked + 1.0)}).drop("__suffix", "__n", "__blocked")


def fit(found: DataFrame, url: str = "url", key: str = "page_id", rows: int = TRAIN_ROWS) -> tuple[Trees, DataFrame, tuple[float, float]]:
    """Trees from labelled URLs, the table of host endings, and the weights of allowed and blocked labels.

    The endings' shares come from the labels that train the trees, so a row's own label is left out of its share, and every other row, by its hash, does not see its
    ending at all: the trees learn to do without an ending they have not met.
    """
    labelled = found.filter(F.col("verdict").isNotNull())
    blocks = F.sum((F.col("verdict") == "block").cast("bigint"))
    suffixes = labelled.groupBy(F.col("suffix").alias("__suffix")).agg(F.count(F.lit(1)).alias("__n"), blocks.alias("__blocked"))
    suffixes = stage(suffixes, "url-suffixes")
    total = suffixes.agg(F.sum("__n").alias("n"), F.sum("__blocked").alias("blocked")).first()
    n, blocked = total["n"] or 0, total["blocked"] or 0
    weights = (n / (2 * (n - blocked)), n / (2 * blocked)) if 0 < blocked < n else (1.0, 1.0)
    order = seeded(SEED, F.col(f"`{key}`"), F.col(f"`{url}`"))
    sample = labelled.select(F.col(f"`{url}`"), "host", "path", "suffix", (F.col("verdict") == "block").cast("int").alias("y"), order.alias("__order"))
    sample = sample.orderBy("__order").limit(rows)
    got = _featured(sample, suffixes, weights, url, F.col("y"), F.col("__order") % 2 == 0).select("__order", *FEATURES, "y").orderBy("__order").collect()
    if not got:
        return Trees(-10.0, []), suffixes, weights
    x, y = np.array([[r[f] for f in FEATURES] for r in got], np.float64), np.array([r["y"] for r in got])
    return train(x, y, np.where(y == 1, weights[1], weights[0])), suffixes, weights


def filter_urls(pages: DataFrame, url: str = "url", key: str = "page_id", rules: Sequence[tuple[str, str]] = RULES,
                rows: int = TRAIN_ROWS) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and the trees' score of being blocked."""
    found = judged(pages, url, rules)
    trees, suffixes, weights = fit(found, url, key, rows)
    scored = _featured(found, suffixes, weights, url).withColumn("score", trees.column([F.col(f) for f in FEATURES]))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.withColumn("verdict", verdict).drop("suffix", *FEATURES)
