"""Score adjustments of a district's features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.operators.columns import column
from prepkit.operators.scenario import (
    Moments,
    bindings,
    form_fields,
    grain_sums,
    percent_increase,
    profile,
    select_by_slug,
    similar_districts,
)
from prepkit.operators.validate import gate


def what_if(
    features: DataFrame,
    scenarios: DataFrame,
    scenario_keys: Sequence[str],
    district: str,
    target: str,
    top: tuple[Sequence[str], int],
    bottom: tuple[Sequence[str], int],
    district_column: str,
    state_column: str,
    similar: int = 5,
    state=None,
) -> tuple[DataFrame, DataFrame]:
    """Predicted change per valid scenario, and the rejected scenarios.

    ``features`` has one row per observation, ``scenarios`` one record of twelve texts per row. Both may be
    large. The observations are read once, into moments per district and state, from which ranking, fit, profiles and sums
    follow. The scenarios are mapped row by row. Districts of one name in two states are two districts; which one
    is meant is said by ``state``.
    """
    moments = Moments(features, district_column, state_column, [*top[0], *bottom[0], target])
    ranked = moments.rank(target, {"top": top, "bottom": bottom})
    top_names, bottom_names = ranked["top"], ranked["bottom"]
    used = list(dict.fromkeys([*top_names, *bottom_names]))
    fields = [f for group in form_fields() for f in group]
    bound = bindings(fields, top_names, bottom_names)
    valid, rejected = gate(scenarios, fields)

    model = moments.fit(target, used)
    totals = moments.totals(used)
    found = select_by_slug(totals, district_column, district)
    if state is not None:
        found = found.where(column(state_column) == F.lit(state))
    rows = found.select(district_column, state_column).limit(2).collect()
    if not rows:
        raise ValueError(f"no such district: {district}")
    if len(rows) > 1:
        raise ValueError(f"{district} lies in several states, say which: {[r[state_column] for r in rows]}")
    name, home = rows[0]
    profiles = profile(totals, district_column, used, state_column)
    near = similar_districts(profiles, district_column, name, used, similar, state_column, home)

    def is_district(one, where):
        return column(district_column).eqNullSafe(F.lit(one)) & column(state_column).eqNullSafe(F.lit(where))

    is_near = F.lit(False)
    for r in near.collect():  # at most ``similar`` names
        is_near = is_near | is_district(r[district_column], r[state_column])
    in_state = F.coalesce(column(state_column) == F.lit(home), F.lit(False))
    sums = grain_sums(totals, used, is_district(name, home), is_near, in_state)
    return percent_increase(valid, scenario_keys, bound, model, sums), rejected
