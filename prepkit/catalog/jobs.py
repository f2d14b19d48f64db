"""Whole jobs over the given tables, shaped to the inputs the jobs expect."""

from pyspark.sql import functions as F

from prepkit.catalog import Registry, table
from prepkit.plans import clean_sample as cleaning
from prepkit.plans import identify as identification
from prepkit.plans import index_join as joining
from prepkit.plans import table_view as viewing
from prepkit.session import scratch_path
from prepkit.sources import csv, tables

registry = Registry()


def _measures(spark, folder):
    """Index, subdomain and population measures: suppliers as places, regions as states, nations as counties."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("geoid10"), F.year("l_shipdate").alias("year"), "l_quantity", "l_returnflag"
    )
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = (
        table(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("geoid10"),
            F.col("n_regionkey").alias("state_fips"),
            (F.col("n_regionkey") * 1000 + F.col("n_nationkey")).alias("county_fips"),
            F.concat("n_name", F.lit(" County , "), "r_name").alias("county_name"),
            F.col("s_name").alias("in100"),
            F.col("n_name").alias("metro_type"),
            F.col("r_name").alias("state_name"),
        )
    )
    keys = ["geoid10", "year"]
    index = (
        lines.groupBy(*keys)
        .agg(
            F.sum("l_quantity").alias("r_ed_stt"),
            F.count(F.lit(1)).alias("z_ed_stt"),
            F.max("l_quantity").alias("r_ed_nat"),
            F.min("l_quantity").alias("r_ed_met"),
            F.avg("l_quantity").alias("c5_ed_stt"),
        )
        .join(places, "geoid10")
    )
    subdomains = (
        lines.where(F.col("l_returnflag") == "R")
        .groupBy(*keys)
        .agg(F.sum("l_quantity").alias("r_soc_stt"), F.count(F.lit(1)).alias("z_soc_stt"))
        .where("z_soc_stt % 2 = 0")
        .join(places.select("geoid10", "state_fips", "county_name"), "geoid10")
    )
    population = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("geoid10"), F.year("o_orderdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("pop_total"))
        .withColumn("state_fips", F.col("pop_total") * 10)
    )
    index_dictionary = spark.createDataFrame(
        [
            ("r_ed_stt", "Index, Education Domain, state"),
            ("z_ed_stt", "Index, Education Domain, state"),
            ("r_ed_nat", "Index, Education Domain, nation"),
            ("c5_ed_stt", "Index, Education Domain, group"),
        ],
        "`Column` string, `Label` string",
    )
    subdomain_dictionary = spark.createDataFrame(
        [("r_soc_stt", "Part, Social and Economic Opportunity"), ("z_soc_stt", "Part, Social and Economic Opportunity")],
        "`Column` string, `Label` string",
    )
    return index, subdomains, population, index_dictionary, subdomain_dictionary


_JOINED = """
    WITH l AS (SELECT l_suppkey AS geoid10, cast(year(l_shipdate) AS int) AS year, l_quantity, l_returnflag FROM lineitem),
         i AS (SELECT geoid10, year, sum(l_quantity) AS q, count(*) AS n FROM l GROUP BY 1, 2),
         d AS (SELECT geoid10, year, sum(l_quantity) AS q, count(*) AS n FROM l WHERE l_returnflag = 'R'
               GROUP BY 1, 2 HAVING count(*) % 2 = 0),
         p AS (SELECT o_custkey AS geoid10, cast(year(o_orderdate) AS int) AS year, count(*) AS pop_total FROM orders
               GROUP BY 1, 2),
         j AS (SELECT i.geoid10, i.year, i.q AS edu_dmn, i.n AS edu_dmn_std, n_regionkey AS state_fips,
                      n_nationkey AS county_fips, n_name || ' County ' AS county_name,
                      d.q AS soc_econ_oppty, d.n AS soc_econ_oppty_std, p.pop_total, p.pop_total * 10 AS state_fips_right
               FROM i JOIN supplier ON s_suppkey = i.geoid10 JOIN nation ON n_nationkey = s_nationkey
                    LEFT JOIN d ON d.geoid10 = i.geoid10 AND d.year = i.year
                    LEFT JOIN p ON p.geoid10 = i.geoid10 AND p.year = i.year
               WHERE n_regionkey = 1)
"""


@registry.add(_JOINED + "SELECT * FROM j")
def index_join_three(spark, folder):
    # All sides have one row per key, so there is nothing to split.
    return joining.index_join(*_measures(spark, folder), unique=True)


@registry.add(_JOINED + "SELECT count(DISTINCT county_name) AS counties FROM j")
def index_county_report(spark, folder):
    return joining.county_report(joining.index_join(*_measures(spark, folder), unique=True))


@registry.add(
    _JOINED + 'SELECT row_number() OVER (ORDER BY geoid10, year) - 1 AS "ID", j.* REPLACE (cast(year AS bigint) AS year,'
    " cast(state_fips AS bigint) AS state_fips, cast(county_fips AS bigint) AS county_fips) FROM j"
)
def index_join_to_table(spark, folder):
    """The whole job from CSV files to a table and a CSV folder."""
    paths = []
    for i, measures in enumerate(_measures(spark, folder)):
        paths.append(scratch_path(spark, f"measures-{i}"))
        csv.write_csv(measures, paths[-1])
    target = {"path": scratch_path(spark, "index-table")}
    joining.run(spark, *paths, target, scratch_path(spark, "index-csv"), table_format="parquet")
    return tables.read_table(spark, target, fmt="parquet")


def _districts(spark, folder):
    """Customers as districts; orders as the list of counties a district lies in."""
    districts = table(spark, folder, "customer").select(
        F.concat(F.upper("c_name"), F.lit(" CITY")).alias("LEANM"),
        F.col("c_nationkey").alias("YEAR"),
        F.col("c_acctbal").alias("MATH"),
    )
    counties = table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("State FIPS"),
        F.col("o_orderstatus").alias("State Postal Code"),
        F.concat(
            F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" City City School District")
        ).alias("School District Name"),
        F.concat(F.lit("st. o'neal-"), F.lower("o_orderpriority")).alias("County Names"),
    )
    return districts, counties


@registry.add(r"""
    SELECT c_name || ' City' AS leanm, c_nationkey AS year, c_acctbal AS math,
           array_to_string(list_transform(regexp_extract_all('st. o''neal-' || lower(o_orderpriority),
               '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)'), lambda x: upper(x[1]) || x[2:]), '') AS county_names
    FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON o_custkey = c_custkey
""")
def identify_districts(spark, folder):
    return identification.identify(*_districts(spark, folder))


@registry.add("""
    WITH n AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F')
    SELECT 'left_rows' AS metric, count(*) AS value FROM n
    UNION ALL SELECT 'right_rows', count(*) FROM customer
    UNION ALL SELECT 'left_keys', count(DISTINCT o_custkey) FROM n
    UNION ALL SELECT 'right_keys', count(*) FROM customer
    UNION ALL SELECT 'matched_keys', count(DISTINCT o_custkey) FROM n WHERE o_custkey IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'left_only_rows', count(*) FROM n WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'counties', count(DISTINCT o_orderpriority) FROM n
""")
def identify_match_report(spark, folder):
    return identification.match_report(*_districts(spark, folder))


@registry.add("""
    SELECT event_id, ts AS timestamp, value, value * 1.1::double AS adjusted_value FROM events WHERE event_type <> 'error'
""")
def clean_sample(spark, folder):
    raw = table(spark, folder, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )
    source, target = scratch_path(spark, "raw-sample"), scratch_path(spark, "clean-sample")
    csv.write_csv(raw, source)
    cleaning.run(spark, source, target)
    schema = "event_id bigint, timestamp timestamp_ntz, value double, adjusted_value double"
    return csv.read_csv_strict(spark, target, schema)


_VIEW = [("o_orderkey", "Order"), ("o_orderpriority", "Priority"), ("o_totalprice", "Total")]


@registry.add(r"""
    SELECT o_orderkey AS "Order", o_totalprice AS "Total" FROM orders
    WHERE lower(o_orderstatus) = 'f' AND (contains(cast(o_orderkey AS varchar), '99')
        OR contains(lower(o_orderpriority), '99') OR contains(cast(o_totalprice AS varchar), '99'))
    ORDER BY o_orderkey LIMIT 10 OFFSET 10
""")
def table_view(spark, folder):
    return viewing.table_view(
        table(spark, folder, "orders"),
        "f",
        order=["o_orderkey"],
        term="99",
        hidden=["Priority"],
        number=1,
        district_column="o_orderstatus",
        columns=_VIEW,
    )


@registry.add(r"""
    SELECT o_orderkey AS "Order", o_orderpriority AS "Priority", o_totalprice AS "Total" FROM orders
    WHERE lower(o_orderstatus) = 'o' AND (contains(cast(o_orderkey AS varchar), 'urg')
        OR contains(lower(o_orderpriority), 'urg') OR contains(cast(o_totalprice AS varchar), 'urg'))
    ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20
""")
def table_view_from_csv(spark, folder):
    """The view of a CSV file, sorted by another column, on its third page."""
    path = scratch_path(spark, "orders-view")
    csv.write_csv(table(spark, folder, "orders"), path)
    view = viewing.run(
        spark, path, "O", ["o_totalprice", "o_orderkey"], term="URG", number=2, district_column="o_orderstatus", columns=_VIEW
    )
    return view.withColumn("Order", F.col("Order").cast("bigint"))


@registry.add(r"""
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE lower(o_orderstatus) = 'o' AND (contains(cast(o_orderkey AS varchar), 'high')
        OR contains(lower(o_orderpriority), 'high') OR contains(cast(o_totalprice AS varchar), 'high'))
""")
def table_view_rows(spark, folder):
    """All rows behind the view, before paging."""
    rows = viewing.view_rows(table(spark, folder, "orders"), "O", "HIGH", "o_orderstatus", _VIEW)
    return rows.select("o_orderkey", "o_totalprice")
