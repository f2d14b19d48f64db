"""Joins, distinct values, counts, reports, sorting and paging."""

from pyspark.sql import functions as F

from prepkit.catalog import Registry, table
from prepkit.operators import aggregates as a
from prepkit.operators import joins as j
from prepkit.operators.changes import cell_changes as compare_cells
from prepkit.operators.columns import drop_suffix
from prepkit.operators.row_id import with_row_id

registry = Registry()


def _line_totals(spark, folder, key):
    """Rows and quantity of the line items per key, under shared names."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


_TOTALS = """
    WITH s AS (SELECT l_suppkey AS k, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1),
         p AS (SELECT l_partkey AS k, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)
"""


@registry.add(_TOTALS + "SELECT p.k, p.n, p.qty FROM p LEFT JOIN s ON p.k = s.k")
def left_join_suffix(spark, folder):
    joined = j.left_join(_line_totals(spark, folder, "l_partkey"), _line_totals(spark, folder, "l_suppkey"), ["k"], unique=True)
    return drop_suffix(joined, ["_right", "_left"])


@registry.add(_TOTALS + "SELECT p.k, p.n, p.qty, s.n AS n_right, s.qty AS qty_right FROM p LEFT JOIN s ON p.k = s.k")
def left_join_keep_right(spark, folder):
    left, right = _line_totals(spark, folder, "l_partkey"), _line_totals(spark, folder, "l_suppkey")
    return j.left_join(left, right, ["k"], unique=True)  # one row per key on the right


@registry.add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 25 OFFSET 5000")
def page_deep(spark, folder):
    """A page far down a descending order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return a.page(lines, [F.col("l_quantity").desc(), "l_orderkey", "l_linenumber"], 200, 25)


@registry.add("""
    SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
""")
def inner_join_diff_keys(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return j.inner_join(orders, customer, [("o_custkey", "c_custkey")])


@registry.add("""
    SELECT o_orderkey, o_totalprice, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
""")
def left_join_fanout(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return j.left_join(orders, lines, [("o_orderkey", "l_orderkey")])


@registry.add("""
    SELECT s_suppkey, s_name, event_id, value FROM supplier LEFT JOIN
        (SELECT event_id, value, CASE WHEN event_type = 'error' THEN user_id ELSE 1 END AS k FROM events) e
        ON s_suppkey = k
""")
def left_join_frequent_key(spark, folder):
    """Most events carry one key: the inner join that gives the matches can split it."""
    key = F.when(F.col("event_type") == "error", F.col("user_id")).otherwise(F.lit(1)).alias("k")
    events = table(spark, folder, "events").select("event_id", "value", key)
    joined = j.left_join(table(spark, folder, "supplier"), events, [("s_suppkey", "k")])
    return joined.select("s_suppkey", "s_name", "event_id", "value")


@registry.add("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_keys(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return j.semi_join(documents, a.distinct_values(table(spark, folder, "labels"), "doc_id"), ["doc_id"])


@registry.add("""
    SELECT event_id, event_type FROM
        (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN user_id ELSE 1 END AS k FROM events)
    WHERE k IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
""")
def semi_join_frequent_key(spark, folder):
    """Most events carry one key: the known keys are written, so that the join can split it."""
    key = F.when(F.col("event_type") == "error", F.col("user_id")).otherwise(F.lit(1)).alias("k")
    events = table(spark, folder, "events").select("event_id", "event_type", key)
    supplier = table(spark, folder, "supplier").where(F.col("s_acctbal") > 0)
    return j.semi_join(events, supplier, [("k", "s_suppkey")]).select("event_id", "event_type")


@registry.add("""
    WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN user_id ELSE 1 END AS k, value FROM events),
         t AS (SELECT k, count(*) AS n, max(value) AS top FROM e GROUP BY k)
    SELECT event_id, e.k, n, top FROM e LEFT JOIN t ON e.k = t.k
""")
def lookup_join_frequent_key(spark, folder):
    """Each event with the totals of its key, where most events carry one key."""
    key = F.when(F.col("event_type") == "error", F.col("user_id")).otherwise(F.lit(1)).alias("k")
    events = table(spark, folder, "events").select("event_id", key, "value")
    totals = events.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return j.lookup_join(events.select("event_id", "k"), totals, ["k"])


@registry.add("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return j.anti_join(documents, table(spark, folder, "labels"), ["doc_id"])


@registry.add("""
    SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS position, s_name, c_name
    FROM supplier JOIN (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer) c
      ON c.position = (SELECT count(*) FROM supplier s2 WHERE s2.s_suppkey < supplier.s_suppkey)
""")
def pair_by_position(spark, folder):
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name")
    paired = j.pair_by_position(supplier, customer, "s_suppkey", "c_custkey")
    return paired.select("position", "s_name", "c_name")


@registry.add("SELECT DISTINCT p_type FROM part")
def distinct_values(spark, folder):
    return a.distinct_values(table(spark, folder, "part"), "p_type")


@registry.add("SELECT DISTINCT nullif(p_brand, 'Brand#2') AS p_brand FROM part ORDER BY 1 NULLS FIRST")
def distinct_sorted(spark, folder):
    part = table(spark, folder, "part").select(F.nullif(F.col("p_brand"), F.lit("Brand#2")).alias("p_brand"))
    return a.distinct_sorted(part, "p_brand")


@registry.add("SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY user_id ORDER BY first_seen")
def distinct_first_seen(spark, folder):
    return a.distinct_first_seen(table(spark, folder, "events"), "user_id", "event_id")


@registry.add("""
    SELECT count(DISTINCT nullif(o_orderstatus, 'P')) + max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS statuses,
           count(DISTINCT o_custkey) AS customers
    FROM orders
""")
def distinct_count_with_null(spark, folder):
    orders = table(spark, folder, "orders").withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return orders.agg(
        a.distinct_count("o_orderstatus").alias("statuses"), a.distinct_count("o_custkey").alias("customers")
    )


@registry.add("SELECT count(*) AS rows FROM lineitem")
def row_count(spark, folder):
    return a.row_count(table(spark, folder, "lineitem"))


@registry.add("""
    SELECT 'left_rows' AS metric, count(*) AS value FROM documents
    UNION ALL SELECT 'right_rows', count(*) FROM labels
    UNION ALL SELECT 'left_keys', count(DISTINCT doc_id) FROM documents
    UNION ALL SELECT 'right_keys', count(DISTINCT doc_id) FROM labels
    UNION ALL SELECT 'matched_keys', count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'left_only_rows', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def reconciliation_report(spark, folder):
    return a.reconcile(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id", "doc_id")


@registry.add("""
    WITH r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
         x AS (SELECT o_orderkey, coalesce(n, 0) AS n FROM orders LEFT JOIN r ON o_orderkey = k)
    SELECT 'rows_in' AS metric, count(*) AS value FROM x
    UNION ALL SELECT 'rows_out', cast(sum(greatest(n, 1)) AS bigint) FROM x
    UNION ALL SELECT 'rows_added', cast(sum(greatest(n, 1)) - count(*) AS bigint) FROM x
    UNION ALL SELECT 'keys_with_several_matches', count(CASE WHEN n > 1 THEN 1 END) FROM x
""")
def fanout_report(spark, folder):
    return a.fanout(table(spark, folder, "orders"), table(spark, folder, "lineitem"), "o_orderkey", "l_orderkey")


@registry.add("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders ORDER BY status DESC NULLS LAST, o_orderkey")
def sort_nulls_last(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status")
    )
    return a.sort_rows(orders, "status", ties=["o_orderkey"], ascending=False)


@registry.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30")
def page_offset(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return a.page(orders, [F.col("o_totalprice").desc(), "o_orderkey"], 3)


@registry.add("SELECT event_id, event_type, value FROM events WHERE event_id > 777 ORDER BY event_id LIMIT 10")
def page_keyset(spark, folder):
    return a.page_after(table(spark, folder, "events").select("event_id", "event_type", "value"), "event_id", 777)


@registry.add("""
    SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS "ID", o_orderkey, o_orderstatus FROM orders)
    WHERE "ID" BETWEEN 500 AND 509
""")
def page_by_row_number(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return a.page_by_id(with_row_id(orders, ["o_orderkey"]), 50)


@registry.add("""
    SELECT count(*) AS rows, cast(ceil(count(*) / 10.0) AS bigint) AS pages, true AS has_previous,
           count(*) > 30 AS has_next
    FROM orders
""")
def page_state(spark, folder):
    return a.page_state(table(spark, folder, "orders"), 2)


_NEXT_ORDERS = """
    SELECT CASE WHEN o_orderkey % 1013 = 1 THEN o_orderkey + 1000000000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
           CASE WHEN o_orderkey % 997 = 5 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 499 = 7 THEN o_custkey + 1 ELSE 0 END AS o_shift,
           CASE WHEN o_orderkey % 1009 = 2 THEN upper(o_orderpriority) || '!' ELSE o_orderpriority END AS o_orderpriority
    FROM orders WHERE o_orderkey % 1511 <> 3
"""
_THESE_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, 0 AS o_shift, o_orderpriority FROM orders"


def _cells(name):
    return f"""SELECT o_orderkey, 'changed' AS change, '{name}' AS "column", cast(o.{name} AS varchar) AS old, cast(n.{name} AS varchar) AS new
        FROM o JOIN n USING (o_orderkey) WHERE o.{name} IS DISTINCT FROM n.{name}"""


@registry.add(f"""
    WITH o AS ({_THESE_ORDERS}), n AS ({_NEXT_ORDERS})
    {" UNION ALL ".join(_cells(c) for c in ("o_custkey", "o_orderstatus", "o_shift", "o_orderpriority"))}
    UNION ALL SELECT o_orderkey, 'removed', NULL, NULL, NULL FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)
    UNION ALL SELECT o_orderkey, 'added', NULL, NULL, NULL FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)
""")
def cell_changes(spark, folder):
    orders = table(spark, folder, "orders")
    shifted = F.when(F.col("o_orderkey") % 499 == 7, F.col("o_custkey") + 1).otherwise(0).cast("bigint")
    old = orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(0).cast("bigint").alias("o_shift"), "o_orderpriority")
    new = orders.filter(F.col("o_orderkey") % 1511 != 3).select(
        F.when(F.col("o_orderkey") % 1013 == 1, F.col("o_orderkey") + 1000000000000).otherwise(F.col("o_orderkey")).alias("o_orderkey"), "o_custkey",
        F.when(F.col("o_orderkey") % 997 != 5, F.col("o_orderstatus")).alias("o_orderstatus"), shifted.alias("o_shift"),
        F.when(F.col("o_orderkey") % 1009 == 2, F.concat(F.upper("o_orderpriority"), F.lit("!"))).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return compare_cells(old, new, ["o_orderkey"])
