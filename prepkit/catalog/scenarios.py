"""Feature ranking, binding, adjustments, similar districts and scenario scoring."""

from pyspark.sql import functions as F

from prepkit.catalog import Registry, table
from prepkit.operators import scenario as s
from prepkit.plans.what_if import what_if as score
from prepkit.session import stage

registry = Registry()

DISTRICT, GRADE = s.form_fields()
FIELDS = DISTRICT + GRADE


def draw_sql(seed, key, field, at=1):
    """The random number of a field, as text: 13 digits of a digest, from the first or the 14th on."""
    digest = f"md5(concat_ws('|', '{seed}', cast({key} AS varchar), {field}))"
    return f"printf('%.2f', cast('0x' || substr({digest}, {at}, 13) AS bigint)::double / 4503599627370496.0 * 200.0 - 100.0)"


def observations(spark, folder):
    """Line items as observations of districts (suppliers) in states (nations)."""
    lines = table(spark, folder, "lineitem")
    supplier = table(spark, folder, "supplier")
    return lines.join(supplier, lines["l_suppkey"] == supplier["s_suppkey"]).select(
        F.col("s_name").alias("district"),
        F.col("s_nationkey").alias("state"),
        F.col("l_extendedprice").alias("unit price"),
        F.col("l_discount").alias("discount"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
    )


OBSERVATIONS = """
    obs AS (SELECT s_name AS district, s_nationkey AS state, l_extendedprice AS x1, l_discount AS x2, l_quantity AS x3,
                   l_tax AS x4, l_extendedprice * (1 - l_discount) AS y
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
"""
MODEL = """
    m AS (SELECT avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay, covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22,
                 covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM obs),
    c AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
                 (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m),
    b AS (SELECT b1, b2, ay - b1 * a1 - b2 * a2 AS b0 FROM c)
"""
PROFILE = """
    p AS (SELECT district, avg(x1) AS x1, avg(x2) AS x2 FROM obs GROUP BY district),
    d AS (SELECT stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM p),
    q AS (SELECT x1 AS v1, x2 AS v2 FROM p WHERE district = 'Supplier#000000001'),
    near AS (SELECT p.district, sqrt(((p.x1 - v1) / s1) * ((p.x1 - v1) / s1) + ((p.x2 - v2) / s2) * ((p.x2 - v2) / s2))
                    AS distance
             FROM p, d, q WHERE p.district <> 'Supplier#000000001' ORDER BY 2, 1 LIMIT 5)
"""


@registry.add(f"""
    WITH {OBSERVATIONS},
    r AS (SELECT 'top' AS level, 'unit price' AS feature, abs(corr(x1, y)) AS score FROM obs
          UNION ALL SELECT 'top', 'quantity', abs(corr(x3, y)) FROM obs
          UNION ALL SELECT 'bottom', 'discount', abs(corr(x2, y)) FROM obs
          UNION ALL SELECT 'bottom', 'tax', abs(corr(x4, y)) FROM obs),
    n AS (SELECT level, row_number() OVER (PARTITION BY level ORDER BY score DESC, feature) AS rank, feature, score FROM r)
    SELECT level, rank, feature, round(score, 8) AS score FROM n WHERE rank <= CASE level WHEN 'top' THEN 2 ELSE 1 END
""")
def feature_ranking(spark, folder):
    levels = {"top": (["unit price", "quantity"], 2), "bottom": (["discount", "tax"], 1)}
    ranked = s.rank_features(observations(spark, folder), "net", levels)
    return ranked.withColumn("score", F.round("score", 8))


@registry.add("SELECT DISTINCT s_name FROM supplier ORDER BY s_name")
def district_names(spark, folder):
    return s.district_names(table(spark, folder, "supplier"), "s_name")


@registry.add("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_name = 'red ring'")
def select_by_slug(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    return s.select_by_slug(part, "p_name", "Red-Ring")


@registry.add("""
    SELECT regexp_replace(lower(name), ' +', '-', 'g') AS slug, count(DISTINCT lower(name)) AS names
    FROM (SELECT CASE WHEN p_size > 25 THEN replace(p_name, ' ', '-') WHEN p_size > 20 THEN upper(p_name) ELSE p_name END AS name
          FROM part)
    GROUP BY 1 HAVING count(DISTINCT lower(name)) > 1
""")
def slug_collisions(spark, folder):
    name, size = F.col("p_name"), F.col("p_size")
    hyphen = F.replace(name, F.lit(" "), F.lit("-"))
    names = F.when(size > 25, hyphen).when(size > 20, F.upper(name)).otherwise(name)
    return s.slug_collisions(table(spark, folder, "part").select(names.alias("name")), "name")


_DRAWS = ", ".join(
    f"{draw_sql(7, 'o_orderkey', repr(first), at)} AS {field}"
    for first, second in zip(FIELDS[::2], FIELDS[1::2])
    for field, at in ((first, 1), (second, 14))
)


@registry.add(f"SELECT o_orderkey, {_DRAWS} FROM orders")
def scenario_sweep(spark, folder):
    return s.random_scenarios(table(spark, folder, "orders"), ["o_orderkey"], seed=7)


# Eight top names and three bottom names; one of them twice, so its later field counts.
_TOP = ["unit price", "quantity", "tax", "ship mode", "line status", "order age", "part size", "quantity"]
_BOTTOM = ["discount", "grade level", "past last field"]
_BOUND = s.bindings(FIELDS, _TOP, _BOTTOM)
_PAIRS = """
    (0, 'district_feature1', 'unit_price', 'district_feature1', 1), (1, 'district_feature8', 'quantity', 'district_feature7', 14),
    (2, 'district_feature3', 'tax', 'district_feature3', 1), (3, 'district_feature4', 'ship_mode', 'district_feature3', 14),
    (4, 'district_feature5', 'line_status', 'district_feature5', 1), (5, 'district_feature6', 'order_age', 'district_feature5', 14),
    (6, 'district_feature7', 'part_size', 'district_feature7', 1), (7, 'district_feature9', 'discount', 'district_feature9', 1),
    (8, 'district_feature10', 'grade_level', 'district_feature9', 14), (9, 'grade_feature1', 'past_last_field', 'grade_feature1', 1)
"""


@registry.add(f"""
    SELECT c_custkey, position, field, feature, cast({draw_sql(3, 'c_custkey', 'digest', 'start')} AS double) AS pct
    FROM customer, (VALUES {_PAIRS}) AS n(position, field, feature, digest, start)
""")
def bind_adjustments(spark, folder):
    sweep = s.random_scenarios(table(spark, folder, "customer"), ["c_custkey"], seed=3)
    return s.bind_adjustments(sweep, ["c_custkey"], _BOUND).withColumn("position", F.col("position").cast("int"))


@registry.add("""
    SELECT l_orderkey, l_linenumber, round(l_quantity * (1 + 10.0::double / 100), 6) AS l_quantity,
           round(l_extendedprice * (1 - 12.5::double / 100), 6) AS l_extendedprice, l_tax
    FROM lineitem
""")
def apply_adjustments(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    moved = s.apply_adjustments(lines, {"l_quantity": 10, "l_extendedprice": -12.5})
    return moved.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_extendedprice")})


@registry.add("""
    WITH a AS (SELECT s_suppkey, s_suppkey % 4 AS position, CASE s_suppkey % 2 WHEN 0 THEN 'l_quantity' ELSE 'l_tax' END AS feature, s_acctbal / 100 AS pct
               FROM supplier
               UNION ALL SELECT s_suppkey, 2, CASE s_suppkey % 2 WHEN 0 THEN 'l_quantity' ELSE 'l_tax' END, s_nationkey + 0.5 FROM supplier WHERE s_suppkey % 4 <> 2
               UNION ALL SELECT s_suppkey, 9, 'l_quantity', -20.0 FROM supplier WHERE s_suppkey % 5 = 0),
         w AS (SELECT s_suppkey, arg_max(pct, position) FILTER (feature = 'l_quantity') AS q, arg_max(pct, position) FILTER (feature = 'l_tax') AS t
               FROM a GROUP BY s_suppkey)
    SELECT l_orderkey, l_linenumber, round(l_quantity * (1 + coalesce(q, 0) / 100::double), 6) AS l_quantity,
           round(l_tax * (1 + coalesce(t, 0) / 100::double), 6) AS l_tax
    FROM lineitem LEFT JOIN w ON l_suppkey = s_suppkey
""")
def apply_adjustments_last(spark, folder):
    """Several adjustments of one feature: the last position counts."""
    supplier = table(spark, folder, "supplier")
    key, turn = F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") % 4).cast("int")
    feature = F.when(F.col("s_suppkey") % 2 == 0, "l_quantity").otherwise("l_tax").alias("feature")
    first = supplier.select(key, turn.alias("position"), feature, (F.col("s_acctbal") / 100).alias("pct"))
    second = supplier.where(turn != 2).select(key, F.lit(2).alias("position"), feature, (F.col("s_nationkey") + F.lit(0.5)).alias("pct"))
    third = supplier.where("s_suppkey % 5 = 0").select(key, F.lit(9).alias("position"), F.lit("l_quantity").alias("feature"), F.lit(-20.0).alias("pct"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_tax")
    moved = s.apply_adjustments_by_key(lines, first.unionByName(second).unionByName(third), "l_suppkey", ["l_quantity", "l_tax"])
    return moved.select(
        "l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax")
    )


@registry.add("""
    SELECT l_orderkey, l_linenumber, round(l_quantity * (1 + s_acctbal / 10000), 6) AS l_quantity,
           round(CASE WHEN s_nationkey > 9 THEN l_tax * (1 + s_nationkey::double / 100) ELSE l_tax END, 6) AS l_tax
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
""")
def apply_adjustments_by_key(spark, folder):
    supplier = table(spark, folder, "supplier")
    key = F.col("s_suppkey").alias("l_suppkey")
    long = supplier.select(key, F.lit(0).alias("position"), F.lit("l_quantity").alias("feature"), (F.col("s_acctbal") / 100).alias("pct")).union(
        supplier.where("s_nationkey > 9").select(key, F.lit(1), F.lit("l_tax"), F.col("s_nationkey").cast("double"))
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_tax")
    moved = s.apply_adjustments_by_key(lines, long, "l_suppkey", ["l_quantity", "l_tax"])
    return moved.select(
        "l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax")
    )


@registry.add(f"""
    WITH {OBSERVATIONS}, {MODEL}
    SELECT state, round(avg(b0 + b1 * x1 + b2 * x2), 4) AS predicted, round(avg(y), 4) AS actual FROM obs, b GROUP BY state
""")
def linear_model(spark, folder):
    obs = observations(spark, folder)
    model = s.fit(obs, "net", ["unit price", "discount"])
    return obs.groupBy("state").agg(
        F.round(F.avg(model.predict()), 4).alias("predicted"), F.round(F.avg("net"), 4).alias("actual")
    )


@registry.add(f"WITH {OBSERVATIONS}, {PROFILE} SELECT district, round(distance, 8) AS distance FROM near")
def similar_districts(spark, folder):
    names = ["unit price", "discount"]
    profiles = s.profile(s.district_totals(observations(spark, folder), "district", "state", names), "district", names)
    near = s.similar_districts(profiles, "district", "Supplier#000000001", names, 5)
    return near.withColumn("distance", F.round("distance", 8))


@registry.add("""
    SELECT o_orderpriority, cast(year(o_orderdate) AS int) AS year, round(avg(o_totalprice), 6) AS mean_total,
           round(avg(o_custkey), 6) AS mean_customer
    FROM orders GROUP BY 1, 2
""")
def group_performance(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderpriority",
        F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("total"),
        F.col("o_custkey").alias("customer"),
    )
    means = s.performance(orders, ["total", "customer"], ["o_orderpriority", "year"])
    return means.withColumns({c: F.round(c, 6) for c in ("mean_total", "mean_customer")})


def _scored(spark, folder):
    """Two features scored for a random scenario per order; those of some orders are not numbers."""
    orders = table(spark, folder, "orders")
    sweep = s.random_scenarios(orders, ["o_orderkey", "o_orderstatus"], seed=11)
    first = F.when(F.col("o_orderstatus") == "P", F.lit("much")).otherwise(F.col("district_feature1"))
    return score(
        observations(spark, folder),
        stage(sweep.withColumn("district_feature1", first), "scenarios"),
        ["o_orderkey"],
        district="Supplier#000000001",
        target="net",
        top=(["unit price", "quantity"], 1),
        bottom=(["discount", "tax"], 1),
        district_column="district",
        state_column="state",
        similar=5,
    )


def _draw2(at):
    digest = "md5(concat_ws('|', '11', cast(o_orderkey AS varchar), o_orderstatus, 'district_feature1'))"
    value = f"cast('0x' || substr({digest}, {at}, 13) AS bigint)::double / 4503599627370496.0 * 200.0 - 100.0"
    return f"cast(printf('%.2f', {value}) AS double)"


def _percent(grain):
    return (
        f"printf('%.2f', 100.0::double * (p1 / 100.0::double * b1 * {grain}_1 + p2 / 100.0::double * b2 * {grain}_2)"
        f" / (b0 * {grain}_n + b1 * {grain}_1 + b2 * {grain}_2))"
    )


def _sums(grain, mask):
    return (
        f"count(CASE WHEN {mask} THEN 1 END) AS {grain}_n, sum(CASE WHEN {mask} THEN x1 END) AS {grain}_1, "
        f"sum(CASE WHEN {mask} THEN x2 END) AS {grain}_2"
    )


@registry.add(f"""
    WITH {OBSERVATIONS}, {MODEL}, {PROFILE},
    t AS (SELECT {_sums('d', "district = 'Supplier#000000001'")},
                 {_sums('s', "district IN (SELECT district FROM near)")},
                 {_sums('a', "state = (SELECT s_nationkey FROM supplier WHERE s_name = 'Supplier#000000001')")}
          FROM obs),
    sc AS (SELECT o_orderkey, {_draw2(1)} AS p1, {_draw2(14)} AS p2
           FROM orders WHERE o_orderstatus <> 'P')
    SELECT o_orderkey, {_percent('d')} AS district_percent_increase,
           {_percent('s')} AS similar_districts_percent_increase, {_percent('a')} AS state_percent_increase
    FROM sc, t, b
""")
def what_if(spark, folder):
    scored, _ = _scored(spark, folder)
    return scored


_SHARED = OBSERVATIONS.replace("s_name AS district", "s_nationkey % 5 AS district")
_SHARED_NEAR = """
    p AS (SELECT district, state, avg(x1) AS x1 FROM obs GROUP BY district, state),
    q AS (SELECT x1 AS v1 FROM p WHERE district = 3 AND state = 8),
    near AS (SELECT district, state FROM p, q WHERE NOT (district = 3 AND state = 8) ORDER BY abs(x1 - v1), district, state LIMIT 2)
"""


@registry.add(f"""
    WITH {_SHARED}, {_SHARED_NEAR},
    m AS (SELECT covar_pop(x1, y) / var_pop(x1) AS b1, avg(y) - covar_pop(x1, y) / var_pop(x1) * avg(x1) AS b0 FROM obs),
    t AS (SELECT {{}} FROM obs),
    sc AS (SELECT c_custkey, cast({draw_sql(13, 'c_custkey', repr('district_feature1'))} AS double) AS p1 FROM customer)
    SELECT c_custkey, {{}} FROM sc, t, m
""".format(
    ", ".join(
        f"count(CASE WHEN {mask} THEN 1 END) AS {g}_n, sum(CASE WHEN {mask} THEN x1 END) AS {g}_1"
        for g, mask in {"d": "district = 3 AND state = 8", "s": "(district, state) IN (SELECT (district, state) FROM near)", "a": "state = 8"}.items()
    ),
    ", ".join(
        f"printf('%.2f', 100.0::double * (p1 / 100.0::double * b1 * {g}_1) / (b0 * {g}_n + b1 * {g}_1)) AS {name}_percent_increase"
        for g, name in {"d": "district", "s": "similar_districts", "a": "state"}.items()
    ),
))
def what_if_shared_name(spark, folder):
    """Five district names shared by all states: the one in state 8 is scored, and no other adds to it."""
    obs = observations(spark, folder).withColumn("district", (F.col("state") % 5).cast("string"))
    sweep = s.random_scenarios(table(spark, folder, "customer"), ["c_custkey"], seed=13)
    scored, _ = score(
        obs, sweep, ["c_custkey"], district="3", target="net", top=(["unit price"], 1), bottom=([], 0),
        district_column="district", state_column="state", similar=2, state=8,
    )
    return scored


@registry.add("""
    SELECT o_orderkey, 'district_feature1: Must be a number' AS reason FROM orders WHERE o_orderstatus = 'P'
""")
def what_if_rejected(spark, folder):
    _, rejected = _scored(spark, folder)
    return rejected.select("o_orderkey", "reason")
