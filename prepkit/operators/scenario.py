"""What-if scenarios: percent changes of features and the change they predict.

Names, inputs and outputs follow the forms and records of the client. How features are ranked, what makes
districts similar and how the change is predicted is our own definition, given with each function.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prepkit.functions import fixed_values as fv
from prepkit.functions.text import default_text, fixed_decimals, slug
from prepkit.functions.values import unit_hash
from prepkit.operators.aggregates import distinct_sorted
from prepkit.operators.columns import column, rename_strict, require
from prepkit.operators.filters import drop_null_rows
from prepkit.operators.joins import lookup_join
from prepkit.session import stage


def district_names(df: DataFrame, name: str) -> DataFrame:
    """All district names in order."""
    return distinct_sorted(df.where(column(name).isNotNull()), name)


def select_by_slug(df: DataFrame, name: str, wanted: str) -> DataFrame:
    """Rows of the district with this slug; case does not matter. Two districts with one slug are an error."""
    rows = df.where(F.lower(slug(name)) == F.lower(slug(F.lit(wanted))))
    found = rows.select(F.lower(column(name)).alias("n")).distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"several districts share the slug of {wanted!r}: {[r['n'] for r in found]}")
    return rows


def slug_collisions(df: DataFrame, name: str) -> DataFrame:
    """Slugs that stand for more than one name."""
    names = df.select(column(name).alias("name")).distinct()
    return (
        names.groupBy(F.lower(slug("name")).alias("slug"))
        .agg(F.countDistinct(F.lower("name")).alias("names"))
        .where("names > 1")
    )


def rank_features(df: DataFrame, target: str, levels: dict[str, tuple[Sequence[str], int]]) -> DataFrame:
    """The most important features per level: ``(level, rank, feature, score)``.

    Our measure is the absolute correlation with the target, as the root of ``regr_r2``: unlike ``corr`` that
    does not fail on a feature without variance, which has no score and comes last. All scores come from one
    aggregation; what follows has one row per feature.
    """
    features = [f for names, _ in levels.values() for f in names]
    require(df, [*features, target])
    y = column(target).cast("double")
    varies = F.min(y) < F.max(y)
    scores = df.agg(
        *[F.when(varies, F.sqrt(F.regr_r2(y, column(f).cast("double")))).alias(f) for f in features]
    )
    long = scores.unpivot([], [column(f) for f in features], "feature", "score")
    level, keep = F.lit(None).cast("string"), F.lit(0)
    for name, (names, k) in levels.items():
        level = F.when(F.col("feature").isin(list(names)), name).otherwise(level)
        keep = F.when(F.col("level") == name, k).otherwise(keep)
    scored = long.select(level.alias("level"), "feature", F.nanvl("score", F.lit(None)).alias("score"))
    order = W.partitionBy("level").orderBy(F.col("score").desc_nulls_last(), "feature")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= keep).select("level", "rank", "feature", "score")


def feature_lists(ranked: DataFrame, top: str, bottom: str) -> tuple[list[str], list[str]]:
    """The ranked names of two levels. They are column names of the frame, a dozen at most."""
    rows = ranked.orderBy("level", "rank").select("level", "feature").collect()
    return [r["feature"] for r in rows if r["level"] == top], [r["feature"] for r in rows if r["level"] == bottom]


def form_fields() -> tuple[list[str], list[str]]:
    """Names of the district and grade fields, each with the tag of its form."""
    district = [f"district_feature{i}" for i in range(1, fv.DISTRICT_FIELDS + 1)]
    grade = [f"grade_feature{i}" for i in range(1, fv.GRADE_FIELDS + 1)]
    return district, grade


def tag_fields(df: DataFrame, fields: Sequence[str], tag: str) -> DataFrame:
    """Put the tag of a form before its field names."""
    return rename_strict(df, {f: f"{tag}_{f}" for f in fields})


def bindings(fields: Sequence[str], top: Sequence[str], bottom: Sequence[str]) -> list[tuple[str, str]]:
    """Pair fields with feature names by position: ``(field, feature)``.

    District fields come first, then grade fields; top names first, then bottom names, spaces as
    underscores. What has no partner is left out, so with fewer than ten top names later district fields
    move on to bottom names. A feature named twice takes the later field.
    """
    names = [n.replace(" ", "_") for n in (*top, *bottom)]
    return [(field, feature) for feature, field in dict(zip(names, fields)).items()]


def bind_adjustments(scenarios: DataFrame, keys: Sequence[str], bound: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per scenario and bound feature: ``(keys, position, field, feature, pct)``. No shuffle."""
    entries = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"),
            F.lit(field).alias("field"),
            F.lit(feature).alias("feature"),
            column(field).cast("double").alias("pct"),
        )
        for i, (field, feature) in enumerate(bound)
    ]
    return scenarios.select(*[column(k) for k in keys], F.inline(F.array(*entries)))


def changed(value: Column, percent: Column) -> Column:
    """A value after a change by so many percent; our reading of an adjustment."""
    return value * (F.lit(1.0) + percent / F.lit(100.0))


def apply_adjustments(df: DataFrame, percents: dict[str, float]) -> DataFrame:
    """Change the named features of every row by one scenario."""
    require(df, percents)
    return df.withColumns({f: changed(column(f), F.lit(float(p))) for f, p in percents.items()})


def apply_adjustments_by_key(
    df: DataFrame, adjustments: DataFrame, key: str, features: Sequence[str]
) -> DataFrame:
    """Change each row by the scenario of its own key; ``adjustments`` is ``(key, position, feature, pct)``.

    A feature without an adjustment stays; of several for one feature the last position counts. The adjustments are folded to one row
    per key, then joined.
    """
    last = [F.max_by("pct", F.when(F.col("feature") == f, F.col("position"))).alias(f"__{i}") for i, f in enumerate(features)]
    wide = adjustments.groupBy(column(key)).agg(*last)
    joined = lookup_join(df, wide, [key])
    out = {f: changed(column(f), F.coalesce(F.col(f"__{i}"), F.lit(0.0))) for i, f in enumerate(features)}
    return joined.withColumns(out).select(*[column(c) for c in df.columns])


def random_scenarios(df: DataFrame, keys: Sequence[str], seed: int = 0, digits: int = 2) -> DataFrame:
    """A random record per row of ``df``: twelve texts, uniform in [-100, 100), two decimals.

    The numbers depend on the seed, the keys and the field only, so any run and any partitioning give the same. Two fields
    that follow each other share one digest.
    """
    fields = [f for group in form_fields() for f in group]
    width = fv.PERCENT_HIGH - fv.PERCENT_LOW

    def draw(i: int) -> Column:
        unit = unit_hash(F.lit(str(seed)), *[column(k) for k in keys], F.lit(fields[i - i % 2]), second=i % 2 == 1)
        return fixed_decimals(unit * F.lit(width) + F.lit(fv.PERCENT_LOW), digits).alias(fields[i])

    return df.select(*[column(k) for k in keys], *[draw(i) for i in range(len(fields))])


def district_totals(df: DataFrame, key: str, state: str, features: Sequence[str]) -> DataFrame:
    """Rows and feature sums per district and state, over the rows without nulls.

    Everything that compares districts works on this: one row per district instead of all observations.
    """
    used = drop_null_rows(df, [key, *features])
    return used.groupBy(column(key), column(state)).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(column(f).cast("double")).alias(f) for f in features]
    )


def profile(totals: DataFrame, key: str, features: Sequence[str], state: str | None = None) -> DataFrame:
    """Mean of each feature per district, from the totals; with ``state``, equal names in two states are two districts."""
    keys = [column(k) for k in (key, state) if k]
    return totals.groupBy(*keys).agg(*[(F.sum(column(f)) / F.sum("rows")).alias(f) for f in features])


def similar_districts(
    profiles: DataFrame, key: str, selected: str, features: Sequence[str], k: int, state: str | None = None, selected_state=None
) -> DataFrame:
    """The ``k`` districts nearest to the selected one: ``(key, distance)``, with the state if it is part of the key.

    Our measure is the Euclidean distance of standardised profiles; a feature that does not vary is left
    out. One district against all others is a single pass: its values and the deviations are a few numbers
    that enter as constants.
    """
    same = column(key).eqNullSafe(F.lit(selected))
    if state:
        same = same & column(state).eqNullSafe(F.lit(selected_state))
    row = profiles.agg(
        *[F.stddev_pop(column(f)).alias(f"s{i}") for i, f in enumerate(features)],
        *[F.max(F.when(same, column(f))).alias(f"v{i}") for i, f in enumerate(features)],
    ).first()
    parts = [
        F.pow((column(f) - F.lit(row[f"v{i}"])) / F.lit(row[f"s{i}"]), F.lit(2.0))
        for i, f in enumerate(features)
        if row[f"s{i}"] and row[f"v{i}"] is not None
    ]
    if not parts:
        raise ValueError(f"no profile of {selected!r} to compare with")
    names = [column(n) for n in (key, state) if n]
    ranked = profiles.where(~same).select(*names, F.sqrt(reduce(add, parts)).alias("distance"))
    return ranked.where(F.col("distance").isNotNull()).orderBy("distance", *names).limit(k)


@dataclass(frozen=True)
class LinearModel:
    """Intercept and one coefficient per feature."""

    intercept: float
    coefficients: dict[str, float]

    def predict(self) -> Column:
        """The prediction for a row."""
        terms = [column(f) * F.lit(c) for f, c in self.coefficients.items()]
        return reduce(add, terms, F.lit(self.intercept))


def fit(df: DataFrame, target: str, features: Sequence[str]) -> LinearModel:
    """Least squares over all rows without nulls; the sums are gathered in one distributed pass."""
    used = drop_null_rows(df.select(*[column(c).cast("double").alias(c) for c in (*features, target)]))
    vectors = VectorAssembler(inputCols=list(features), outputCol="__features").transform(used)
    model = LinearRegression(featuresCol="__features", labelCol=target, solver="normal").fit(vectors)
    return LinearModel(float(model.intercept), dict(zip(features, map(float, model.coefficients))))


class Moments:
    """Counts, means and co-moments of numbers per district and state, from one pass over the observations.

    Rows are also told apart by which of their numbers are null. So whatever numbers are chosen later, the rows that hold all of
    them are a choice of groups, and ranking, fit, profiles and sums follow from the groups alone. The table is written once; it has
    a row per district, state and pattern of nulls.
    """

    def __init__(self, df: DataFrame, key: str, state: str, names: Sequence[str]) -> None:
        self.names = list(dict.fromkeys(names))
        self.key, self.state = key, state
        require(df, [*self.names, key, state])
        values = [column(n).cast("double").alias(f"v{i}") for i, n in enumerate(self.names)]
        absent = F.array_join(F.array(*[F.when(column(n).isNull(), "1").otherwise("0") for n in self.names]), "").alias("absent")
        rows = df.select(column(key).alias("district"), column(state).alias("state"), absent, *values)
        groups = rows.groupBy("district", "state", "absent").agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            *[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(self.names))],
            *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i in range(len(self.names)) for j in range(i + 1)],
        )
        self.groups = stage(groups, "moments")

    def _holding(self, names: Sequence[str]) -> Column:
        """Groups whose rows have all of these numbers."""
        held = F.lit(True)
        for n in names:
            held = held & (F.substring("absent", self.names.index(n) + 1, 1) == "0")
        return held

    def together(self, sets: Sequence[Sequence[str]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Rows, means and co-moments over all rows that hold a set of numbers, for several sets: two small aggregates for all of them."""
        def sums(k: int, names: Sequence[str], value: Column) -> Column:
            return F.coalesce(F.sum(F.when(self._holding(names), value)), F.lit(0.0))

        n, at = F.col("n"), self.names.index
        first = self.groups.agg(
            *[sums(k, names, n).alias(f"n{k}") for k, names in enumerate(sets)],
            *[sums(k, names, n * F.col(f"m{at(x)}")).alias(f"s{k}_{x_}") for k, names in enumerate(sets) for x_, x in enumerate(names)],
        ).first()
        out, exprs = [], []
        for k, names in enumerate(sets):
            rows = first[f"n{k}"]
            means = np.array([first[f"s{k}_{i}"] / rows if rows else np.nan for i in range(len(names))])
            out.append((rows, means))
            for i, x in enumerate(names):
                for j, y in enumerate(names[: i + 1]):
                    a, b = max(at(x), at(y)), min(at(x), at(y))
                    apart = (F.col(f"m{at(x)}") - F.lit(float(means[i]))) * (F.col(f"m{at(y)}") - F.lit(float(means[j])))
                    exprs.append(sums(k, names, n * (F.col(f"c{a}_{b}") + apart)).alias(f"c{k}_{i}_{j}"))
        second = self.groups.agg(*exprs).first()
        full = []
        for k, (names, (rows, means)) in enumerate(zip(sets, out)):
            c = np.array([[second[f"c{k}_{max(i, j)}_{min(i, j)}"] for j in range(len(names))] for i in range(len(names))]).reshape(len(names), len(names))
            full.append((rows, means, c))
        return full

    def rank(self, target: str, levels: dict[str, tuple[Sequence[str], int]]) -> dict[str, list[str]]:
        """The most important features per level by absolute correlation with the target, as ``rank_features`` defines it."""
        features = [f for names, _ in levels.values() for f in names]
        found = self.together([(f, target) if f != target else (f,) for f in features])
        score: dict[str, float] = {}
        for f, (rows, _, c) in zip(features, found):
            fits = rows > 0 and len(c) == 2 and c[0, 0] > 0 and c[1, 1] > 0
            score[f] = abs(c[0, 1]) / (c[0, 0] * c[1, 1]) ** 0.5 if fits else float(f == target) or -1.0
        return {level: sorted(dict.fromkeys(names), key=lambda f: (-round(score[f], 12), f))[:k] for level, (names, k) in levels.items()}

    def fit(self, target: str, features: Sequence[str]) -> LinearModel:
        """Least squares over all rows that hold the features and the target; a feature that does not vary gets no weight."""
        features = list(dict.fromkeys(features))
        ((rows, means, c),) = self.together([(*features, target)])
        spread = np.sqrt(np.maximum(np.diag(c)[:-1], 0))
        varies = spread > 0
        weights = np.zeros(len(features))
        if rows and varies.any():
            scaled = c[:-1, :-1][np.ix_(varies, varies)] / np.outer(spread[varies], spread[varies])
            solved = np.linalg.lstsq(scaled, c[:-1, -1][varies] / spread[varies], rcond=1e-10)[0]
            weights[varies] = solved / spread[varies]
        if not rows:
            raise ValueError("no row holds all features and the target")
        return LinearModel(float(means[-1] - weights @ means[:-1]), dict(zip(features, map(float, weights))))

    def totals(self, features: Sequence[str]) -> DataFrame:
        """Rows and feature sums per district and state, over rows that hold the features."""
        held = self.groups.where(self._holding(features) & F.col("district").isNotNull())
        sums = [F.sum(F.col("n") * F.col(f"m{self.names.index(f)}")).alias(f) for f in features]
        return held.groupBy(F.col("district").alias(self.key), F.col("state").alias(self.state)).agg(F.sum("n").alias("rows"), *sums)


GRAINS = ("district", "similar_districts", "state")


def grain_sums(totals: DataFrame, features: Sequence[str], selected: Column, similar: Column, in_state: Column) -> DataFrame:
    """Rows and feature sums of the district, the similar districts and the state, each given by a condition on the totals."""
    masks = dict(zip(GRAINS, (selected, similar, in_state)))
    return totals.agg(
        *[
            F.sum(F.when(mask, column(c))).cast("double").alias(f"{grain}__{c}")
            for grain, mask in masks.items()
            for c in ["rows", *features]
        ]
    )


def percent_increase(
    scenarios: DataFrame,
    keys: Sequence[str],
    bound: Sequence[tuple[str, str]],
    model: LinearModel,
    sums: DataFrame,
) -> DataFrame:
    """Predicted change in percent for the three grains, per scenario, as text.

    The prediction is linear, so its total over a grain follows from the feature totals of that grain:
    thirty-odd numbers that enter as constants. Scenarios are then scored row by row, without a join,
    and the features are read once however many scenarios there are. Nothing to compare with gives N/A.
    A change that is rounded to zero keeps its sign, as an adjustment of -0.00 does; features without weight add nothing.
    """
    total = sums.first().asDict()
    field_of = {feature: field for field, feature in bound}
    out = []
    for grain in GRAINS:
        values = {f: total[f"{grain}__{f}"] or 0.0 for f in model.coefficients}
        rows = total[f"{grain}__rows"] or 0.0
        base = model.intercept * rows + sum(c * values[f] for f, c in model.coefficients.items())
        moved = [
            column(field_of[f.replace(" ", "_")]).cast("double") / F.lit(100.0) * F.lit(c * values[f])
            for f, c in model.coefficients.items()
            if f.replace(" ", "_") in field_of and c * values[f]
        ]
        # No sum from 0.0 on: 0.0 + -0.0 is 0.0.
        text = (
            fixed_decimals(F.lit(100.0) * reduce(add, moved or [F.lit(0.0)]) / F.lit(base))
            if base
            else F.lit(None).cast("string")
        )
        out.append(default_text(text).alias(f"{grain}_percent_increase"))
    return scenarios.select(*[column(k) for k in keys], *out)


def performance(df: DataFrame, measures: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean of the measures per group, our content for the performance heading."""
    return df.groupBy(*[column(b) for b in by]).agg(*[F.avg(column(m)).alias(f"mean_{m}") for m in measures])


