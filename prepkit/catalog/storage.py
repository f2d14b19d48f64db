"""Sources, sinks and row numbers."""

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prepkit.catalog import Registry, table
from prepkit.operators.row_id import with_row_id
from prepkit.plans import bulk_load, consolidate, ledger
from prepkit.session import scratch_path
from prepkit.sources import csv, files, tables

registry = Registry()


@registry.add("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_type = 'ECONOMY'")
def csv_scan_pruned(spark, folder):
    part = table(spark, folder, "part")
    path = scratch_path(spark, "part-csv")
    csv.write_csv(part, path)
    rows = csv.scan_csv(spark, path, part.schema)
    return rows.where(F.col("p_type") == "ECONOMY").select("p_partkey", "p_name", "p_retailprice")


@registry.add("""
    SELECT p_partkey, p_name, CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_size END AS p_size, p_retailprice
    FROM part
""")
def csv_tolerant(spark, folder):
    part = table(spark, folder, "part")
    size = F.col("p_size").cast("string")
    spoilt = part.withColumn("p_size", F.when(F.col("p_type") == "SMALL", F.concat(size, F.lit(" cm"))).otherwise(size))
    path = scratch_path(spark, "part-spoilt")
    csv.write_csv(spoilt, path)
    return csv.read_csv_tolerant(spark, path, part.schema).select("p_partkey", "p_name", "p_size", "p_retailprice")


@registry.add("""
    SELECT p_partkey, CASE WHEN p_partkey >= 100 AND p_size = 7 THEN NULL ELSE cast(p_size AS bigint) END AS p_size
    FROM part
""")
def csv_head_infer(spark, folder):
    part = table(spark, folder, "part")
    late = (F.col("p_partkey") >= 100) & (F.col("p_size") == 7)
    spoilt = part.withColumn("p_size", F.when(late, F.lit("seven")).otherwise(F.col("p_size").cast("string")))
    path = scratch_path(spark, "part-late")
    csv.write_csv(spoilt, path)
    # Types come from all rows: the late misfits make the column text.
    rows = csv.read_csv_tolerant(spark, path)
    return rows.select("p_partkey", F.col("p_size").try_cast("bigint").alias("p_size"))


_DOCUMENTS = "SELECT doc_id, text, lang, source, n_chars FROM documents"


@registry.add(f"""
    SELECT 'tolerant' AS reader, * FROM ({_DOCUMENTS}) UNION ALL SELECT 'strict', * FROM ({_DOCUMENTS})
    UNION ALL SELECT 'null_set', * FROM ({_DOCUMENTS})
""")
def csv_documents_round_trip(spark, folder):
    """Texts with line breaks and quotes, read back by each reader without any option."""
    path = scratch_path(spark, "documents-csv")
    csv.write_csv(table(spark, folder, "documents"), path)
    readers = {"tolerant": csv.read_csv_tolerant, "strict": csv.read_csv_strict, "null_set": csv.read_csv_null_set}
    frames = [read(spark, path).withColumn("reader", F.lit(name)) for name, read in readers.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@registry.add("""
    SELECT c_custkey, c_nationkey, c_acctbal, 'scan' AS reader FROM customer
    UNION ALL SELECT c_custkey, c_nationkey, c_acctbal, 'strict' FROM customer
""")
def csv_schema_by_name(spark, folder):
    """The schema names columns in another order than the file has them, and leaves some out."""
    path = scratch_path(spark, "customer-by-name")
    customer = table(spark, folder, "customer")
    csv.write_csv(customer.select("c_acctbal", "c_name", "c_nationkey", "c_custkey"), path)
    schema = "c_custkey bigint, c_nationkey int, c_acctbal double"
    scanned = csv.scan_csv(spark, path, schema).withColumn("reader", F.lit("scan"))
    return scanned.unionByName(csv.read_csv_strict(spark, path, schema).withColumn("reader", F.lit("strict")))


@registry.add("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 997 = 500 THEN 'odd' ELSE cast(o_custkey AS varchar) END AS o_custkey, files
    FROM orders, (VALUES (1), (16)) f(files)
""")
def csv_same_types_any_split(spark, folder):
    """Misfits beyond the first rows turn the column into text, whether the rows lie in one file or in sixteen."""
    orders = table(spark, folder, "orders")
    odd = F.when(F.col("o_orderkey") % 997 == 500, "odd").otherwise(F.col("o_custkey").cast("string"))
    frames = []
    for parts in (1, 16):
        path = scratch_path(spark, f"orders-{parts}")
        csv.write_csv(orders.select("o_orderkey", odd.alias("o_custkey")).repartition(parts), path)
        frames.append(csv.read_csv_tolerant(spark, path).withColumn("files", F.lit(parts)))
    return frames[0].unionByName(frames[1])


@registry.add("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_strict(spark, folder):
    customer = table(spark, folder, "customer")
    path = scratch_path(spark, "customer-csv")
    csv.write_csv(customer, path)
    return csv.read_csv_strict(spark, path, customer.schema)


@registry.add("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'P' END AS o_orderstatus,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority,
           o_totalprice
    FROM orders
""")
def csv_null_markers(spark, folder):
    orders = table(spark, folder, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    marked = orders.select(
        "o_orderkey",
        F.when(status == "F", "NA").when(status == "O", "null").otherwise(status).alias("o_orderstatus"),
        F.when(priority == "5-LOW", "N/A").otherwise(priority).alias("o_orderpriority"),
        "o_totalprice",
    )
    path = scratch_path(spark, "orders-marked")
    csv.write_csv(marked, path)
    return csv.read_csv_null_set(spark, path)


@registry.add("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_dynamic_typed(spark, folder):
    path = scratch_path(spark, "part-dynamic")
    csv.write_csv(table(spark, folder, "part"), path)
    ready, _ = files.exists_or_skip(spark, path)
    rows = csv.read_csv_dynamic(spark, path) if ready else None
    return rows.withColumns({"p_partkey": F.col("p_partkey").cast("bigint")})


@registry.add("""
    SELECT 'S-' || s_suppkey AS id, s_name AS name, s_acctbal AS amount, NULL AS segment FROM supplier
    UNION ALL
    SELECT cast(c_custkey AS varchar), c_name, cast(c_nationkey AS double), c_mktsegment FROM customer
    UNION ALL
    SELECT cast(n_nationkey AS varchar), n_name, NULL, NULL FROM nation
""")
def consolidate_files(spark, folder):
    root = scratch_path(spark, "raw")
    supplier, customer, nation = (table(spark, folder, n) for n in ("supplier", "customer", "nation"))
    target = f"{root}/school/edunomics"
    csv.write_csv(
        supplier.select(
            F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("id"),
            F.col("s_name").alias("name"),
            F.col("s_acctbal").alias("amount"),
        ),
        f"{target}/a",
    )
    csv.write_csv(
        customer.select(
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("amount"),
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
        ),
        f"{target}/b/deeper",
    )
    csv.write_csv(nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")), f"{target}/c")
    # Not UTF-8: reported and left out.
    nation.select("n_name").write.option("header", "true").option("encoding", "UTF-16").csv(f"{target}/d")
    found = files.discover(spark, root)
    rows, _, _ = consolidate.consolidate(spark, found[("school", "edunomics")])
    return rows.select("id", "name", "amount", "segment")


@registry.add("""
    SELECT 'S-' || s_suppkey AS id, s_name AS name, s_acctbal AS amount, 'school' AS level FROM supplier
    UNION ALL SELECT cast(c_custkey AS varchar), c_name, cast(c_nationkey AS double), 'school' FROM customer
    UNION ALL SELECT cast(o_orderkey AS varchar), o_orderstatus, o_totalprice, 'teacher' FROM orders
""")
def consolidate_to_folders(spark, folder):
    """The whole job: one written folder per level; the level without input is skipped."""
    raw, out = scratch_path(spark, "raw-levels"), scratch_path(spark, "out-levels")
    name, amount = F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount")
    supplier, customer, orders = (table(spark, folder, n) for n in ("supplier", "customer", "orders"))
    csv.write_csv(
        supplier.select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("id"), name, amount),
        f"{raw}/school/edunomics/a",
    )
    csv.write_csv(customer.toDF("id", "name", "amount", "x", "y").select("amount", "id", "name"), f"{raw}/school/edunomics/b")
    renamed = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_totalprice").alias("amount"))
    csv.write_csv(renamed, f"{raw}/teacher/edunomics")
    written = consolidate.run(spark, raw, out)
    frames = [
        csv.read_csv_strict(spark, f"{out}/{level}_{category}", "id string, name string, amount double").withColumn(
            "level", F.lit(level)
        )
        for level, category in written
    ]
    return frames[0].unionByName(frames[1])


@registry.add("""
    SELECT doc_id, text, cast(lang AS varchar) AS tag FROM documents
    UNION ALL SELECT page_id, url, cast(page_id AS varchar) FROM pages
""")
def consolidate_documents(spark, folder):
    """Files with line breaks in cells and differing headers; one more is broken far beyond its first rows and left out."""
    root = scratch_path(spark, "raw-documents")
    documents, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    target = f"{root}/school/edunomics"
    csv.write_csv(documents.select("doc_id", "text", F.col("lang").alias("tag")), f"{target}/a")
    csv.write_csv(pages.select(F.col("page_id").alias("tag"), F.col("url").alias("text"), F.col("page_id").alias("doc_id")), f"{target}/b")
    lines = spark.range(150).select(F.concat(F.col("id").cast("string"), F.lit(",x,t")).alias("value"))
    lines = spark.sql("SELECT 'doc_id,text,tag' AS value").unionByName(lines).unionByName(spark.sql("SELECT '1,é,t' AS value"))
    broken = f"{root}/broken"
    # One file, in an encoding that is no UTF-8 from its last line on.
    lines.coalesce(1).write.option("header", "false").option("quote", "").option("sep", "|").option("encoding", "ISO-8859-1").csv(broken)
    listed = files.list_csv(spark, target).unionByName(files.list_csv(spark, broken))
    rows, _, _ = consolidate.consolidate(spark, listed)
    return rows.select("doc_id", "text", "tag")


@registry.add("""
    SELECT o_orderkey AS id, o_totalprice AS amount, o_orderstatus AS name, n FROM orders, (SELECT count(DISTINCT o_orderpriority) AS n FROM orders)
    WHERE o_orderpriority <> '3-MEDIUM'
    UNION ALL SELECT o_orderkey, 0.5, 'new', n FROM orders, (SELECT count(DISTINCT o_orderpriority) AS n FROM orders) WHERE o_orderpriority = '3-MEDIUM'
    UNION ALL SELECT c_custkey, NULL, c_name, n FROM customer, (SELECT count(DISTINCT o_orderpriority) AS n FROM orders)
""")
def consolidate_changes(spark, folder):
    """Files by priority of orders: a second run reads one changed file, drops the removed suppliers, and keeps the rest; ``n`` counts the files it did not read."""
    raw, out = scratch_path(spark, "raw-ledger"), scratch_path(spark, "ledger")
    orders = table(spark, folder, "orders")
    orders = orders.select("o_orderpriority", F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("name"))
    kinds = sorted(r[0] for r in orders.select("o_orderpriority").distinct().collect())
    for kind in kinds:
        csv.write_csv(orders.where(F.col("o_orderpriority") == kind).drop("o_orderpriority").coalesce(1), f"{raw}/orders/{kind}")
    csv.write_csv(table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")).coalesce(1), f"{raw}/customer")
    csv.write_csv(table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")).coalesce(1), f"{raw}/supplier")
    ledger.update(spark, raw, out, "first")
    changed = orders.where("o_orderpriority = '3-MEDIUM'").select("id", F.lit(0.5).alias("amount"), F.lit("new").alias("name"))
    csv.write_csv(changed.coalesce(1), f"{raw}/orders/3-MEDIUM")
    csv.write_csv(table(spark, folder, "supplier").limit(0), f"{raw}/supplier")
    kept = ledger.update(spark, raw, out, "second").where("action = 'keep'").count()
    return ledger.current(spark, out).select("id", "amount", "name", F.lit(kept).cast("bigint").alias("n"))


@registry.add("SELECT 1 AS late, 1 AS blank, 0 AS good FROM nation LIMIT 1")
def consolidate_errors(spark, folder):
    """Number of reported files: one as long as orders with a broken last row, one blank, and none of the good ones."""
    root = scratch_path(spark, "raw-errors")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    csv.write_csv(orders, f"{root}/good")
    csv.write_csv(orders.limit(0).select(F.col("o_orderstatus").alias(" ")), f"{root}/blank")
    late = orders.unionByName(spark.sql("SELECT 0L AS o_orderkey, 'é' AS o_orderstatus"))
    late.coalesce(1).write.option("header", "true").option("encoding", "ISO-8859-1").csv(f"{root}/late")
    _, errors, _ = consolidate.consolidate(spark, files.list_csv(spark, root))
    place = F.regexp_extract("path", "/([a-z]+)/[^/]+$", 1)
    return errors.agg(*[F.count_if(place == n).cast("int").alias(n) for n in ("late", "blank", "good")])


@registry.add("""
    SELECT * FROM (VALUES ('b', 3::bigint), ('c', 1::bigint)) f(folder, failed)
""")
def unreadable_files(spark, folder):
    """Two of three tables are written in an encoding that cannot be read."""
    root = scratch_path(spark, "unreadable")
    csv.write_csv(table(spark, folder, "nation"), f"{root}/a")
    for name, source, parts in (("b", "customer", 3), ("c", "supplier", 1)):
        rows = table(spark, folder, source).repartition(parts)
        rows.write.option("header", "true").option("encoding", "UTF-16").csv(f"{root}/{name}")
    errors = files.file_errors(files.file_heads(files.list_csv(spark, root)))
    place = F.regexp_extract("path", "/([a-z])/[^/]+$", 1).alias("folder")
    return errors.groupBy(place).agg(F.count("message").alias("failed"))


@registry.add("""
    SELECT * FROM (VALUES (3, 2::bigint, 's_suppkey,s_name,s_acctbal'), (4, 5::bigint, 'c_custkey,c_name,c_acctbal,c_nationkey'),
                          (2, 1::bigint, 'n_nationkey,n_name')) f(n_columns, found, header)
""")
def file_column_profile(spark, folder):
    root = scratch_path(spark, "profile")
    csv.write_csv(table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal").repartition(2), f"{root}/a")
    csv.write_csv(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey").repartition(5), f"{root}/b")
    csv.write_csv(table(spark, folder, "nation").select("n_nationkey", "n_name").repartition(1), f"{root}/c")
    profile = files.file_profile(files.file_heads(files.list_csv(spark, root)))
    return profile.groupBy(F.col("n_columns").cast("int").alias("n_columns"), "header").agg(F.count(F.lit(1)).alias("found"))


@registry.add("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def table_read(spark, folder):
    return tables.read_table(spark, {"path": f"{folder}/supplier.parquet"}, fmt="parquet")


@registry.add("""
    SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS "ID", o_orderkey, o_custkey, o_totalprice FROM orders
""")
def table_replace_with_id(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    target = {"path": scratch_path(spark, "replaced")}
    tables.write_table_replace(orders.select("o_orderkey"), target, fmt="parquet")
    tables.write_table_replace(orders, target, order_by=["o_orderkey"], fmt="parquet")
    return tables.read_table(spark, target, fmt="parquet")


@registry.add("""
    SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer
""")
def table_append_twice(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    target = {"path": scratch_path(spark, "appended")}
    for _ in range(2):
        tables.write_table_append(rows, target, fmt="parquet")
    return tables.read_table(spark, target, fmt="parquet")


@registry.add("""
    SELECT c_custkey, c_name, c_acctbal, 'added' AS kind FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'replaced' FROM supplier
""")
def table_committed(spark, folder):
    """Batches that run twice, a job that fails after tasks have written, and a replaced table: each row once."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal").toDF(*customer.columns)
    added, replaced = ({"path": scratch_path(spark, name)} for name in ("added", "replaced"))
    half = F.col("c_custkey") % 2 == 0
    for _ in range(2):
        tables.write_table_append(customer.where(half), added, tables.COMMITTED, batch="even")
        tables.write_table_replace(customer, replaced, fmt=tables.COMMITTED, batch="all customers")
    last = customer.agg(F.max("c_custkey")).first()[0]
    late = customer.withColumn("c_name", F.when(F.col("c_custkey") == last, F.raise_error(F.lit("late"))).otherwise(F.col("c_name")))
    for target in (added, replaced):
        try:
            tables.write_table_append(late, target, tables.COMMITTED, batch="fails")
        except PySparkException:
            pass
    tables.write_table_append(customer.where(~half), added, tables.COMMITTED, batch="odd")
    tables.write_table_replace(supplier, replaced, fmt=tables.COMMITTED, batch="suppliers")
    tables.write_table_replace(customer, replaced, fmt=tables.COMMITTED, batch="all customers")  # a late second run
    frames = [tables.read_table(spark, t, fmt=tables.COMMITTED).withColumn("kind", F.lit(k)) for t, k in ((added, "added"), (replaced, "replaced"))]
    return frames[0].unionByName(frames[1])


@registry.add("SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id, event_id, user_id, value FROM events")
def row_id_contiguous(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    return with_row_id(events, ["event_id"], "row_id")


@registry.add("""
    SELECT c_custkey AS "C_CUSTKEY", c_name AS "C_NAME", CASE WHEN c_nationkey > 4 THEN c_acctbal END AS "C_ACCTBAL"
    FROM customer
""")
def bulk_load_table(spark, folder):
    customer = table(spark, folder, "customer")
    marker = F.element_at(F.array(*[F.lit(m) for m in ("NA", "null", "N/A", "")]), F.pmod("c_custkey", F.lit(4)).cast("int") + 1)
    raw = customer.select(
        "c_custkey",
        "c_name",
        F.when(F.col("c_nationkey") > 4, F.col("c_acctbal").cast("string")).otherwise("NaN").alias("c_acctbal"),
        marker.alias("all_missing"),
        F.lit(None).cast("string").alias("all_empty"),
    )
    path, target = scratch_path(spark, "bulk"), {"path": scratch_path(spark, "bulk-table")}
    csv.write_csv(raw, path)
    bulk_load.run(spark, path, target, table_format="parquet")
    loaded = tables.read_table(spark, target, fmt="parquet")
    return loaded
