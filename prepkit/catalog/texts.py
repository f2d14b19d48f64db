"""Text, number and time functions, and checks of text fields."""

from pyspark.sql import functions as F

from prepkit.catalog import Registry, table
from prepkit.functions import fixed_values as fv
from prepkit.functions import text as t
from prepkit.functions import values as v
from prepkit.operators import validate

registry = Registry()


# What the SQL replaces, written out here and not taken from the code it checks.
_INDEX_SQL = (
    ("and", ""), ("  ", " "), ("domain", "dmn"), ("environment", "environ"), ("education", "edu"), ("social", "soc"),
    ("economic", "econ"), ("opportunity", "oppty"), ("child ", ""), (" ", "_"),
)
_SUBDOMAIN_SQL = (
    ("and", ""), ("  ", " "), ("domain", "dmn"), ("environment", "environ"), ("educational", "edu"), ("education", "edu"),
    ("social", "soc"), ("economic", "econ"), ("opportunity", "oppty"), ("child ", ""), (" ", "_"),
)
_DISTRICT_SQL = (("school district", ""), ("st. ", "st "), ("city city", "city"))


def _chain(value, rules):
    """Rules as nested SQL calls."""
    for pattern, replacement in rules:
        value = f"regexp_replace({value}, '{pattern}', '{replacement}', 'g')"
    return value


_LABEL = "p_type || ', Educational and  Social Domain ' || p_name || ', ' || p_brand"
_PART = r"regexp_replace(string_split({0}, ',')[2], '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')".format(_LABEL)
_MARKED = f"lower(CASE WHEN regexp_matches(p_name, 'ri') THEN {_PART} || ' std' ELSE {_PART} END)"


def _labels(spark, folder, rules):
    part = table(spark, folder, "part")
    label = F.concat(
        "p_type", F.lit(", Educational and  Social Domain "), "p_name", F.lit(", "), "p_brand"
    )
    middle = t.strip_chars(t.split_part_exact(label, ",", 1))
    marked = t.append_when(t.contains_text("p_name", "ri"), middle, fv.STANDARDISED_SUFFIX)
    return part.select("p_partkey", t.apply_rules(F.lower(marked), rules).alias("label"))


@registry.add(f"SELECT p_partkey, {_chain(_MARKED, _INDEX_SQL)} AS label FROM part")
def label_rules_index(spark, folder):
    return _labels(spark, folder, fv.INDEX_LABEL_RULES)


@registry.add(f"SELECT p_partkey, {_chain(_MARKED, _SUBDOMAIN_SQL)} AS label FROM part")
def label_rules_subdomain(spark, folder):
    return _labels(spark, folder, fv.SUBDOMAIN_LABEL_RULES)


@registry.add(f"SELECT doc_id, {_chain('lower(text)', _SUBDOMAIN_SQL)} AS label FROM documents")
def label_rules_documents(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", t.apply_rules(F.lower("text"), fv.SUBDOMAIN_LABEL_RULES).alias("label"))


_DISTRICT = "chr(9) || 'Trusts. ' || c_name || ' City City School District' || chr(160)"


@registry.add(
    "SELECT c_custkey, regexp_replace("
    + _chain(f"lower({_DISTRICT})", _DISTRICT_SQL)
    + r", '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS district FROM customer"
)
def district_name_rules(spark, folder):
    name = F.concat(F.lit("\tTrusts. "), "c_name", F.lit(" City City School District "))
    cleaned = t.strip_chars(t.apply_rules(F.lower(name), fv.DISTRICT_NAME_RULES))
    return table(spark, folder, "customer").select("c_custkey", cleaned.alias("district"))


@registry.add(r"""
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)'),
           lambda x: CASE x[1] WHEN 'ß' THEN 'SS' ELSE upper(x[1]) END || x[2:]), '') AS title
    FROM documents
""")  # the SQL engine leaves a sharp s as it is; its upper-case form is SS
def title_case(spark, folder):
    return table(spark, folder, "documents").select("doc_id", t.title_case("text").alias("title"))


@registry.add("SELECT event_id, ts, CASE WHEN event_type <> 'error' THEN ts END AS lenient FROM events")
def parse_timestamp(spark, folder):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    spoilt = F.when(F.col("event_type") == "error", F.concat(F.lit("about "), text)).otherwise(text)
    return table(spark, folder, "events").select(
        "event_id", v.checked_timestamp(text).alias("ts"), v.checked_timestamp(spoilt, strict=False).alias("lenient")
    )


@registry.add("SELECT event_id, value * 1.1::double AS adjusted_value FROM events")
def scale_value(spark, folder):
    return table(spark, folder, "events").select("event_id", v.scale("value").alias("adjusted_value"))


@registry.add("""
    SELECT o_orderkey, o_orderkey % 1000 AS code, ((o_orderkey - 7000) % 1000 + 1000) % 1000 AS shifted FROM orders
""")
def modulo_code(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", v.modulo("o_orderkey").alias("code"), v.modulo(F.col("o_orderkey") - 7000).alias("shifted")
    )


@registry.add(r"SELECT doc_id, regexp_replace(text, '[\s\p{Z}]+', '-', 'g') AS slug FROM documents")
def slug(spark, folder):
    return table(spark, folder, "documents").select("doc_id", t.slug("text").alias("slug"))


@registry.add("""
    SELECT p_partkey, replace(p_name, ' ', '_') AS feature, 'grade_' || p_type AS key,
           coalesce(nullif(CASE WHEN p_size > 25 THEN p_brand WHEN p_size > 10 THEN '' END, ''), 'N/A') AS shown,
           printf('%.2f', p_retailprice / 3) AS price
    FROM part
""")
def small_text_functions(spark, folder):
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        "p_partkey",
        t.underscore("p_name").alias("feature"),
        t.prefix_key("grade_", "p_type").alias("key"),
        t.default_text(F.when(size > 25, F.col("p_brand")).when(size > 10, "")).alias("shown"),
        t.fixed_decimals(F.col("p_retailprice") / 3).alias("price"),
    )


@registry.add(r"""
    SELECT l_orderkey, l_linenumber, regexp_replace(cast(l_extendedprice AS varchar), '\.0$', '') AS price,
           cast(cast(l_quantity AS bigint) AS varchar) AS quantity,
           coalesce(regexp_replace(cast(nullif(l_tax, 0) AS varchar), '\.0$', ''), '') AS tax
    FROM lineitem
""")
def displayed_numbers(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        t.number_text("l_extendedprice").alias("price"),
        t.number_text("l_quantity").alias("quantity"),
        t.display_text(F.nullif(F.col("l_tax"), F.lit(0.0)), "double").alias("tax"),
    )


def _records(spark, folder):
    """Text records with one field that is a number, one that often is not, and one that may be blank."""
    value, kind = F.col("value"), F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id",
        F.format_string("%.2f", value).alias("feature1"),
        F.when(kind == "error", F.lit("0x10"))
        .when(kind == "view", F.concat(F.lit(" "), value.cast("string"), F.lit("e1 ")))
        .when(kind == "click", F.lit("5d"))
        .otherwise(F.concat(F.lit("-"), value.cast("string")))
        .alias("feature2"),
        F.when(value < 20, F.lit("")).when(value < 40, F.lit("  ")).when(value >= 60, F.lit("-7.")).alias("feature3"),
    )


_FIELDS = """
    SELECT event_id, value, printf('%.2f', value) AS feature1,
           CASE event_type WHEN 'error' THEN '0x10' WHEN 'view' THEN ' ' || cast(value AS varchar) || 'e1 ' WHEN 'click' THEN '5d'
                ELSE '-' || cast(value AS varchar) END AS feature2,
           CASE WHEN value < 20 THEN '' WHEN value < 40 THEN '  ' WHEN value >= 60 THEN '-7.' END AS feature3
    FROM events
"""
_NUMBER = r"regexp_matches(trim({0}), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$')"


def _rule(name):
    return f"""CASE WHEN coalesce({name}, '') = '' THEN '{name}: This field is required.'
                    WHEN NOT {_NUMBER.format(name)} THEN '{name}: Must be a number' END"""


_REASON = f"nullif(concat_ws('; ', {_rule('feature1')}, {_rule('feature2')}, {_rule('feature3')}), '')"


@registry.add(f"WITH r AS ({_FIELDS}) SELECT event_id, feature2, feature3, {_REASON} AS reason FROM r")
def validate_numbers(spark, folder):
    checked = validate.check_records(_records(spark, folder), ["feature1", "feature2", "feature3"])
    return checked.select("event_id", "feature2", "feature3", "reason")


@registry.add(f"""
    WITH r AS ({_FIELDS}) SELECT event_id, cast(feature1 AS double) AS feature1,
           cast(trim(feature2) AS double) AS feature2, cast(feature3 AS double) AS feature3
    FROM r WHERE {_REASON} IS NULL
""")
def validated_records(spark, folder):
    valid, _ = validate.gate(_records(spark, folder), ["feature1", "feature2", "feature3"])
    return valid


@registry.add("""
    SELECT event_id, CASE WHEN round(value, 2) NOT BETWEEN -100 AND 100 THEN 'feature1: Must be between -100 and 100' END AS reason
    FROM events
""")
def validate_range(spark, folder):
    records = _records(spark, folder).select("event_id", "feature1")
    return validate.check_records(records, ["feature1"], low=-100.0, high=100.0).select("event_id", "reason")
