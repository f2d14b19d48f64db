"""Columns, names, schemas and row filters."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.catalog import Registry, table
from prepkit.operators import columns as c
from prepkit.operators import filters as f
from prepkit.operators import schemas
from prepkit.operators.union import union_relaxed

registry = Registry()


@registry.add("SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem")
def select_by_name_rules(spark, folder):
    kept = c.select_not(table(spark, folder, "lineitem"), suffixes=["key"], prefixes=["l_ship"])
    return c.drop_strict(kept, "l_linestatus")


@registry.add("""
    SELECT p_partkey AS part_id, p_name AS "Part Name", p_brand, p_type, p_size AS size, p_retailprice AS price FROM part
""")
def rename_from_dictionary(spark, folder):
    names = spark.createDataFrame(
        [(1, "p_partkey", "part_id"), (2, "p_name", "first try"), (3, "p_name", "Part Name"), (4, "p_size", "size")],
        "n int, `Column` string, `New Label` string",
    )
    renamed = c.rename_from_dictionary(table(spark, folder, "part"), names, order_by="n")
    return c.rename_strict(renamed, {"p_retailprice": "price"})


@registry.add("""
    SELECT p_partkey, string_split(p_name, ' ')[1] AS colour, string_split(p_name, ' ')[2] AS item,
           string_split(p_name, ' ')[3] AS rest, p_size
    FROM part
""")
def unnest_split(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    return c.unnest_split(part, "p_name", " ", ["colour", "item", "rest"])


@registry.add(r"""
    SELECT doc_id, string_split(text, ',')[1] AS a,
           regexp_replace(string_split(text, ',')[2], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS b,
           string_split(text, ',')[3] AS c
    FROM documents
""")
def unnest_document_parts(spark, folder):
    parts = c.unnest_split(table(spark, folder, "documents").select("doc_id", "text"), "text", ",", ["a", "b", "c"])
    return c.strip_column(parts, "b")


@registry.add('SELECT n_nationkey AS "N_NATIONKEY", n_name AS "N_NAME", n_regionkey AS "N_REGIONKEY" FROM nation')
def names_upper(spark, folder):
    return c.names_upper(table(spark, folder, "nation"))


@registry.add("SELECT s_suppkey AS supplier_key, s_name AS supplier_name, s_acctbal AS account__balance FROM supplier")
def names_snake(spark, folder):
    labels = [("s_suppkey", "Supplier Key"), ("s_name", "SUPPLIER NAME"), ("s_acctbal", "Account  Balance")]
    return c.names_snake(c.project_labels(table(spark, folder, "supplier"), labels))


@registry.add("""
    SELECT c_custkey, c_name, CASE WHEN c_nationkey > 4 THEN c_acctbal END AS some FROM customer
""")
def drop_all_null_columns(spark, folder):
    customer = table(spark, folder, "customer").select(
        "c_custkey",
        F.nullif(F.col("c_mktsegment"), F.col("c_mktsegment")).alias("none"),
        "c_name",
        F.when(F.col("c_custkey") >= 0, float("nan")).alias("nan"),
        F.when(F.col("c_nationkey") > 4, F.col("c_acctbal")).alias("some"),
    )
    return c.drop_all_null_columns(customer)


@registry.add("""
    SELECT 'o_orderkey' AS "column", count(o_orderkey) AS non_null FROM orders
    UNION ALL SELECT 'o_orderstatus', count(nullif(o_orderstatus, 'P')) FROM orders
    UNION ALL SELECT 'o_totalprice', count(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) FROM orders
""")
def non_null_counts(spark, folder):
    status = F.col("o_orderstatus")
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(status == "F", F.col("o_totalprice")).otherwise(float("nan")).alias("o_totalprice"),
        F.nullif(status, F.lit("P")).alias("o_orderstatus"),
    )
    return c.non_null_counts(orders)


@registry.add('SELECT o_orderkey AS "Order", o_totalprice AS "Total Price" FROM orders')
def labelled_projection(spark, folder):
    labels = [("o_orderkey", "Order"), ("o_orderstatus", "Status"), ("o_totalprice", "Total Price")]
    return c.visible(c.project_labels(table(spark, folder, "orders"), labels), ["Status"])


@registry.add("SELECT s_suppkey, lower(s_name) AS supplier, s_acctbal * 2 AS doubled FROM supplier")
def derive_key(spark, folder):
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name", (F.col("s_acctbal") * 2).alias("doubled"))
    return c.derive_key(supplier, "s_name", "supplier")


@registry.add("""
    SELECT cast(event_id AS int) AS event_id, try_cast(substr(props, 7, length(props) - 7) AS int) AS k,
           CASE WHEN value = floor(value) THEN cast(value AS int) END AS value,
           cast(user_id AS varchar) AS user_id, cast(NULL AS double) AS missing, ts
    FROM events
""")
def conform_schema(spark, folder):
    events = table(spark, folder, "events").withColumn("k", F.expr("substr(props, 7, length(props) - 7)"))
    target = "event_id int, k int, value int, user_id string, missing double, ts timestamp_ntz"
    return schemas.conform(events, T.DataType.fromDDL(target))


@registry.add("""
    SELECT cast(year(o_orderdate) AS int) AS "Year", o_orderpriority AS "System", o_orderstatus AS "School",
           cast(NULL AS varchar) AS "Gender", cast(NULL AS varchar) AS "Race", cast(NULL AS varchar) AS "Ethnicity",
           cast(NULL AS varchar) AS "Sub_Population", cast(o_custkey AS double) AS "Demographic_Count",
           o_totalprice AS "Total_Count", cast(NULL AS double) AS "Demographic_Rate"
    FROM orders
""")
def conform_declared_table(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("extra"),
        F.col("o_totalprice").alias("Total_Count"),
        F.col("o_custkey").cast("string").alias("Demographic_Count"),
        F.col("o_orderstatus").alias("School"),
        F.col("o_orderpriority").alias("System"),
        F.year("o_orderdate").cast("string").alias("Year"),
        F.concat(F.lit("about "), F.col("o_orderstatus")).alias("Demographic_Rate"),
    )
    return schemas.conform(orders, schemas.declared("TEACHER_DEMOGRAPHICS"))


def _declared_sql(name, source, given):
    """Each declared column: the given SQL, or null, in its declared type."""
    kinds = {"int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    fields = [column.split() for column in schemas.DECLARED[name].split(",")]
    return "SELECT " + ", ".join(f'cast({given.get(c, "NULL")} AS {kinds[kind]}) AS "{c}"' for c, kind in fields) + f" FROM {source}"


@registry.add(_declared_sql("SCHOOL_ACCOUNTABILITY", "orders", {"Year": "year(o_orderdate)", "School": "o_orderstatus", "Score": "o_totalprice"}))
def conform_school_accountability(spark, folder):
    given = table(spark, folder, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("Year"), F.col("o_orderstatus").alias("School"), F.col("o_totalprice").cast("string").alias("Score")
    )
    return schemas.conform(given, schemas.declared("SCHOOL_ACCOUNTABILITY"))


@registry.add(_declared_sql("SCHOOL_EDUNOMICS", "supplier", {
    "state": "s_nationkey", "distname": "s_name", "ncesenroll": "s_suppkey", "pp_fed_raw_AL": "s_acctbal",
    "level": "CASE WHEN s_acctbal = floor(s_acctbal) THEN s_acctbal END"}))
def conform_school_edunomics(spark, folder):
    given = table(spark, folder, "supplier").select(
        F.col("s_acctbal").alias("level"), F.col("s_acctbal").alias("pp_fed_raw_AL"), F.col("s_suppkey").cast("string").alias("ncesenroll"),
        F.col("s_name").alias("distname"), F.col("s_nationkey").alias("state"),
    )
    return schemas.conform(given, schemas.declared("SCHOOL_EDUNOMICS"))


@registry.add(_declared_sql("STUDENT_DEMOGRAPHICS", "customer", {
    "System": "c_name", "Total_Student_Count": "c_custkey", "White_Pct": "c_acctbal", "Asian": "CASE WHEN c_nationkey > 4 THEN c_nationkey END"}))
def conform_student_demographics(spark, folder):
    asian = F.when(F.col("c_nationkey") > 4, F.col("c_nationkey").cast("string")).otherwise("*").alias("Asian")
    given = table(spark, folder, "customer").select(
        F.col("c_acctbal").alias("White_Pct"), asian, F.col("c_custkey").alias("Total_Student_Count"), F.col("c_name").alias("System")
    )
    return schemas.conform(given, schemas.declared("STUDENT_DEMOGRAPHICS"))


@registry.add(_declared_sql("TEACHER_EFFECTIVENESS", "part", {"School_Code": "p_partkey", "School": "p_name", "Educator_Effectiveness_Score": "p_retailprice"}))
def conform_teacher_effectiveness(spark, folder):
    given = table(spark, folder, "part").select(
        F.col("p_partkey").cast("double").alias("School_Code"), F.col("p_name").alias("School"), F.col("p_retailprice").alias("Educator_Effectiveness_Score")
    )
    return schemas.conform(given, schemas.declared("TEACHER_EFFECTIVENESS"))


@registry.add(_declared_sql("TEACHER_EXPERIENCE", "events", {"System": "event_type", "Total_Count": "value", "Year": "user_id"}))
def conform_teacher_experience(spark, folder):
    given = table(spark, folder, "events").select(
        F.col("event_type").alias("System"), F.col("user_id").alias("Year"), F.col("value").cast("string").alias("Total_Count"), "props"
    )
    return schemas.conform(given, schemas.declared("TEACHER_EXPERIENCE"))


@registry.add("""
    SELECT 'event_id' AS name, 'kept' AS state, count(event_id) AS cells, 0::bigint AS cells_lost FROM events
    UNION ALL SELECT 'value', 'cast', count(value), count(CASE WHEN value <> floor(value) THEN 1 END) FROM events
    UNION ALL SELECT 'props', 'cast', count(props), count(props) - count(try_cast(props AS double)) FROM events
    UNION ALL SELECT 'grade', 'missing', 0, 0
    UNION ALL SELECT 'ts', 'extra', count(ts), 0 FROM events
    UNION ALL SELECT 'user_id', 'extra', count(user_id), 0 FROM events
    UNION ALL SELECT 'event_type', 'extra', count(event_type), 0 FROM events
""")
def conform_report(spark, folder):
    target = T.DataType.fromDDL("event_id bigint, value int, props double, grade string")
    return schemas.conform_report(table(spark, folder, "events"), target)


@registry.add("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F'")
def filter_equals(spark, folder):
    kept = f.equals(table(spark, folder, "orders"), "o_orderstatus", "F")
    return kept.select("o_orderkey", "o_totalprice", "o_orderdate")


@registry.add("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' AND NOT regexp_matches(p_name, 're')")
def filter_suffix_not_contains(spark, folder):
    return table(spark, folder, "part").where(f.suffix_not_contains("p_name", "ring", "re")).select("p_partkey", "p_name")


@registry.add("SELECT c_custkey, c_name FROM customer WHERE lower(coalesce(nullif(c_mktsegment, 'MACHINERY'), '')) = 'building'")
def filter_ci_equals(spark, folder):
    customer = table(spark, folder, "customer")
    customer = customer.withColumn("c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")))
    return customer.where(f.equals_ignore_case("c_mktsegment", "Building")).select("c_custkey", "c_name")


@registry.add(r"""
    SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
    WHERE contains(regexp_replace(cast(o_totalprice AS varchar), '\.0$', ''), '5.0')
       OR contains(lower(coalesce(nullif(o_orderpriority, '2-HIGH'), '')), '5.0')
       OR contains(cast(floor(o_totalprice / 2) AS bigint)::varchar, '5.0')
""")
def search_any_column(spark, folder):
    orders = table(spark, folder, "orders").withColumns(
        {
            "o_orderpriority": F.nullif(F.col("o_orderpriority"), F.lit("2-HIGH")),
            "half": F.floor(F.col("o_totalprice") / 2).cast("double"),
        }
    )
    found = f.search(orders, ["o_totalprice", "o_orderpriority", "half"], "5.0")
    return found.select("o_orderkey", "o_totalprice", "o_orderstatus")


@registry.add("""
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice < 200000
""")
def drop_null_rows(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") < 200000, F.col("o_totalprice")).alias("o_totalprice"),
    )
    return f.drop_null_rows(orders)


@registry.add("""
    SELECT cast(s_suppkey AS varchar) AS id, s_name AS name, s_acctbal AS amount, NULL AS segment FROM supplier
    UNION ALL
    SELECT c_mktsegment || '-' || c_custkey, c_name, cast(c_nationkey AS double), c_mktsegment FROM customer
    UNION ALL
    SELECT cast(n_nationkey AS varchar), NULL, cast(CASE WHEN n_regionkey > 2 THEN 1 ELSE 0 END AS double), NULL FROM nation
""")
def union_relaxed_frames(spark, folder):
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount")
    )
    customer = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("amount"),
        F.concat("c_mktsegment", F.lit("-"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_name").alias("name"),
    )
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("id"), (F.col("n_regionkey") > 2).alias("amount")
    )
    return union_relaxed([supplier, customer, nation])
