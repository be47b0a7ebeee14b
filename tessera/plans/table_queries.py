"""Queries over sources, rows, joins, aggregates and order (families A to G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import quality, relational, rows
from ..sources import readers, writers
from .base import query, table

RULES = [
    {"field": "o_custkey", "rule": "NOT_NULL", "severity": "critical"},
    {"field": "o_totalprice", "rule": "RANGE", "min": 1000, "max": 400000, "severity": "warning"},
    {"field": "o_orderstatus", "rule": "IN_SET", "values": ["O", "F"], "severity": "error"},
]


@query(
    "flagship",
    """
    WITH ok AS (SELECT * FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice BETWEEN 1000 AND 400000 AND o_orderstatus IN ('O', 'F')),
    last AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT c_mktsegment, coalesce(round(sum(o_totalprice), 2), 0) AS total, coalesce(round(avg(o_totalprice), 4), 0) AS average, count(o_totalprice) AS customers, min(o_totalprice) AS smallest, max(o_totalprice) AS largest
    FROM last LEFT JOIN (SELECT c_custkey, upper(trim(c_mktsegment)) AS c_mktsegment FROM customer) ON o_custkey = c_custkey GROUP BY 1
    """,
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, validate, keep each customer's last order, join, aggregate per segment."""
    orders = quality.with_violations(rows.standardize(table(spark, sf_dir, "orders")), RULES).filter(F.size("_violations") == 0).drop("_violations")
    last = relational.dedup(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "last")
    customer = rows.field_transform(table(spark, sf_dir, "customer"), {"c_mktsegment": ["TRIM", "UPPER"]})
    joined = relational.join(last, customer, ["o_custkey"], ["c_custkey"], "left", ["c_mktsegment", "o_totalprice"])
    out = relational.aggregate(joined, ["c_mktsegment"], [("o_totalprice", f, a) for f, a in (("SUM", "total"), ("AVG", "average"), ("COUNT", "customers"), ("MIN", "smallest"), ("MAX", "largest"))])
    return out.withColumns({"total": F.round("total", 2), "average": F.round("average", 4)})


# -- A, B: sources and sinks


@query("a03_read_parquet", "SELECT p_partkey, p_brand FROM part")
def read_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_parquet(spark, f"{sf_dir}/part.parquet", ["p_partkey", "p_brand"])


@query("a05_extract_table", "SELECT o_orderkey, o_totalprice FROM orders")
def extract_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.extract_table(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"])


@query("a06_extract_incremental", "SELECT max(o_orderdate) AS next_value, count(*) AS rows FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'")
def extract_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = readers.extract_incremental(table(spark, sf_dir, "orders"), "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz"))
    return readers.next_watermark(new, "o_orderdate")


@query("a07_extract_query", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY c_mktsegment")
def extract_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.extract_query(spark, {"x_customer": table(spark, sf_dir, "customer")}, "SELECT c_mktsegment, count(*) AS n FROM x_customer WHERE c_acctbal > :least GROUP BY c_mktsegment", {"least": 100})


@query("a08_read_dataset", "SELECT s_suppkey, s_name FROM supplier")
def read_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "supplier").createOrReplaceTempView("dataset_supplier")
    return spark.table("dataset_supplier").select("s_suppkey", "s_name")


@query("a13_row_ids", "SELECT 'lineitem:' || l_orderkey || ':' || l_linenumber AS _row_id, l_quantity FROM lineitem")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.add_row_ids(table(spark, sf_dir, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]).select("_row_id", "l_quantity")


@query("a14_infer_schema", """SELECT unnest(['c_custkey', 'c_name', 'c_acctbal', 'flag', 'day', 'mixed']) AS "column", unnest(['integer', 'string', 'float', 'boolean', 'date', CASE WHEN (SELECT count(*) FILTER (c_acctbal > 0) FROM customer) > 0.8 * (SELECT count(*) FROM customer) THEN 'float' ELSE 'string' END]) AS inferred""")
def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    texts = c.select(*[F.col(x).cast("string").alias(x) for x in ("c_custkey", "c_name", "c_acctbal")], (F.col("c_custkey") % 2 == 0).cast("string").alias("flag"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).cast("string").alias("day"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise("none").alias("mixed"))
    return readers.infer_types(texts)


UPSERT_SQL = """
    WITH src AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0
                 UNION ALL SELECT c_custkey + 1000000000, c_name, c_acctbal FROM customer WHERE c_custkey % 5 = 0)
    SELECT * FROM (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM src)) UNION ALL SELECT * FROM src
"""


@query("b05_upsert", UPSERT_SQL)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = target.filter("c_custkey % 3 = 0").withColumns({"c_name": F.concat("c_name", F.lit("*")), "c_acctbal": F.col("c_acctbal") + 1})
    return writers.upsert(target, changed.unionByName(target.filter("c_custkey % 5 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000000)), ["c_custkey"])


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey") % 6
    words = F.element_at(F.array(*map(F.lit, ["Connection refused", "unique constraint", "cannot parse date", "timeout of a task", "io error"])), k.cast("int"))
    return writers.classify_errors(writers.dead_letter(o, F.when(k > 0, words), F.col("o_orderkey")))


LETTERS_SQL = """SELECT o_orderkey AS row_number, CASE o_orderkey % 6 WHEN 1 THEN 'connection' WHEN 2 THEN 'constraint' WHEN 3 THEN 'format' WHEN 4 THEN 'timeout' ELSE 'io' END AS category,
    o_orderkey % 6 IN (1, 4) AS transient FROM orders WHERE o_orderkey % 6 > 0"""


@query("b10_dead_letter", """SELECT o_orderkey AS row_number, 0 AS retry_count, ['Connection refused', 'unique constraint', 'cannot parse date', 'timeout of a task', 'io error'][(o_orderkey % 6)::INT] AS message,
    '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS payload FROM orders WHERE o_orderkey % 6 > 0""")
def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).select("row_number", "retry_count", "message", "payload")


@query("b11_dlq_stats", f"SELECT category, count(*) AS rows, min(row_number) AS first_row, max(row_number) AS last_row FROM ({LETTERS_SQL}) GROUP BY category")
def dlq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.dlq_stats(_letters(spark, sf_dir))


@query("b12_dlq_reprocess", "SELECT o_orderkey AS row_number, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS retry_count FROM orders WHERE o_orderkey % 6 IN (1, 4)")
def dlq_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = writers.dlq_reprocess(_letters(spark, sf_dir), F.col("category").isin("connection", "timeout"), lambda df: df, F.when(F.col("row_number") % 2 == 0, "again"))
    return good.select("row_number", F.lit(None).cast("int").alias("retry_count")).unionByName(bad.select("row_number", "retry_count"))


@query("b13_dlq_read", f"SELECT row_number, category FROM ({LETTERS_SQL}) WHERE category = 'format' ORDER BY row_number LIMIT 20 OFFSET 10")
def dlq_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.dlq_read(_letters(spark, sf_dir), "format", 10, 20).select("row_number", "category")


@query("b14_classify_errors", LETTERS_SQL)
def classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).select("row_number", "category", "transient")


# -- C, D: rows


@query("c01_field_transform", "SELECT p_partkey, lower(replace(p_type, ' ', '_')) AS p_type, split_part(p_brand, '#', 2) AS p_brand, substring(p_name, 2, 4) AS p_name, round(p_retailprice, 1) AS p_retailprice FROM part")
def field_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = {
        "p_type": ["TRIM", {"op": "REGEX", "pattern": " ", "replacement": "_"}, "LOWER"],
        "p_brand": [{"op": "SPLIT", "delimiter": "#", "index": 1}],
        "p_name": [{"op": "SUBSTRING", "start": 1, "length": 4}],
        "p_retailprice": [{"op": "ROUND", "decimals": 1}],
    }
    return rows.field_transform(table(spark, sf_dir, "part"), chains).select("p_partkey", *chains)


@query("c02_multi_field_ops", "SELECT c_custkey, c_name || '/' || c_mktsegment AS label, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS pick, c_acctbal * 2 AS doubled FROM customer")
def multi_field_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("seg", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")))
    chains = {"label": [{"op": "CONCAT", "separator": "/", "fields": ["c_name", "c_mktsegment"]}], "pick": [{"op": "COALESCE", "fields": ["seg", "c_name"]}], "doubled": [{"op": "CUSTOM", "expression": "c_acctbal * 2"}]}
    return rows.field_transform(c, chains).select("c_custkey", "label", "pick", "doubled")


@query("c03_modification_counts", "SELECT 'c_name' AS field, count(*) FILTER (lower(c_name) <> c_name) AS changed, count(*) AS rows FROM customer UNION ALL SELECT 'c_mktsegment', 0, count(*) FROM customer")
def modification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.modification_counts(table(spark, sf_dir, "customer"), {"c_name": ["LOWER"], "c_mktsegment": ["TRIM"]})


TREE = {"type": "or", "conditions": [
    {"type": "and", "conditions": [{"type": "gt", "field": "c_acctbal", "value": 5000}, {"type": "in", "field": "c_mktsegment", "value": ["BUILDING", "MACHINERY"]}]},
    {"type": "not", "condition": {"type": "contains", "field": "c_name", "value": "1"}},
]}


@query("c04_conditions", "SELECT c_custkey FROM customer WHERE (c_acctbal > 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')) OR NOT contains(c_name, '1')")
def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.filter(rows.condition(c, TREE)).select("c_custkey")


ROUTES = [
    {"name": "rich", "priority": 5, "condition": {"type": "gte", "field": "c_acctbal", "value": 8000}},
    {"name": "auto", "priority": 9, "condition": {"type": "equals", "field": "c_mktsegment", "value": "AUTOMOBILE"}},
    {"name": "off", "priority": 10, "enabled": False, "condition": {"type": "always"}},
]


@query("c05_route", "SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'auto' WHEN c_acctbal >= 8000 THEN 'rich' ELSE 'rest' END AS route FROM customer")
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.route(table(spark, sf_dir, "customer"), ROUTES, "rest").select("c_custkey", "route")


@query("c06_route_stats", "SELECT 'rich' AS route, count(*) FILTER (c_acctbal >= 8000) AS rows FROM customer UNION ALL SELECT 'auto', count(*) FILTER (c_mktsegment = 'AUTOMOBILE') FROM customer UNION ALL SELECT 'unmatched', count(*) FILTER (c_acctbal < 8000 AND c_mktsegment <> 'AUTOMOBILE') FROM customer")
def route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.route_stats(table(spark, sf_dir, "customer"), ROUTES[:2])


@query("c06_route_matrix", "SELECT c_custkey, c_acctbal >= 8000 AS match_rich, c_mktsegment = 'AUTOMOBILE' AS match_auto FROM customer")
def route_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.route_matrix(table(spark, sf_dir, "customer"), ROUTES[:2]).select("c_custkey", "match_rich", "match_auto")


@query("c07_set_remove_field", "SELECT r_regionkey, 'x' AS tag FROM region")
def set_remove_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").withColumn("tag", F.lit("x")).drop("r_name")


MAPPING = [("c_name", "label", 0.6), ("c_mktsegment", "label", 0.97), ("c_acctbal", "balance", 0.99), ("c_nationkey", "nation", 0.4)]


@query("c08_map_fields", "SELECT c_mktsegment AS label, c_acctbal AS balance, c_nationkey AS nation, c_custkey FROM customer")
def map_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.map_fields(table(spark, sf_dir, "customer"), MAPPING, "highest_confidence", True)


@query("c09_semantic_map", "SELECT c_mktsegment AS label, c_acctbal AS balance, c_custkey, c_name, c_nationkey FROM customer")
def semantic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.semantic_map(table(spark, sf_dir, "customer"), MAPPING)


@query("c10_compose_mappings", "SELECT 'a_' || p_partkey AS source, 'b_' || p_partkey AS target, p_brand || '|' || p_partkey AS term, round(0.9 * (1.0 / p_size), 9) AS confidence FROM part WHERE p_partkey % 3 = 0")
def compose_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("term", F.concat_ws("|", "p_brand", "p_partkey"))
    a = p.select(F.concat(F.lit("a_"), "p_partkey").alias("field"), "term", F.lit(0.9).alias("confidence"))
    b = p.filter("p_partkey % 3 = 0").select(F.concat(F.lit("b_"), "p_partkey").alias("field"), "term", (1.0 / F.col("p_size")).alias("confidence"))
    return rows.compose_mappings(a, b).withColumn("confidence", F.round("confidence", 9))


@query("c10_mapping_coverage", "SELECT p_brand AS vendor, count(*) AS fields, count(*) FILTER (p_size > 10) AS mapped, round(count(*) FILTER (p_size > 10) / count(*), 6) AS coverage FROM part GROUP BY 1")
def mapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a brand's fields, the larger ones mapped, some twice."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("vendor"), F.col("p_partkey").alias("field"), "p_size")
    mapped = p.filter("p_size > 10").unionByName(p.filter("p_size > 30"))
    return rows.mapping_coverage(p.select("vendor", "field"), mapped).withColumn("coverage", F.round("coverage", 6))


@query("c11_confidence_gate", "SELECT c_custkey, c_acctbal >= 3000 AS passed FROM customer")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes, no = rows.confidence_gate(table(spark, sf_dir, "customer"), "c_acctbal", 3000)
    return yes.select("c_custkey", F.lit(True).alias("passed")).unionByName(no.select("c_custkey", F.lit(False).alias("passed")))


@query("c12_lookup_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS status FROM orders")
def lookup_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.lookup_values(table(spark, sf_dir, "orders"), "o_orderstatus", {"O": "open", "F": "filled"}, "status", "other").select("o_orderkey", "status")


@query("c13_page", "SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'econ') ORDER BY p_type, p_partkey LIMIT 25 OFFSET 5")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.page(table(spark, sf_dir, "part").select("p_partkey", "p_type"), ["p_type", "p_partkey"], 5, 25, ("p_type", "Econ"))


@query("d01_standardize", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit("\t")).alias("c_name"), "c_mktsegment")
    return rows.standardize(padded)


@query("d02_coerce", "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'balance: not double' END AS first_error FROM customer")
def coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ID"), F.when(F.col("c_custkey") % 7 == 0, "abc").otherwise(F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))).alias("Balance"), F.concat(F.lit(" "), "c_name").alias("name"))
    target = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("balance", T.DoubleType()), T.StructField("name", T.StringType(), False)])
    return rows.coerce(raw, target, {"name": 40}).select("id", "balance", "name", F.get("_errors", F.lit(0)).alias("first_error"))


@query("d03_validate_required", "SELECT 'o_orderkey' AS \"column\", 0 AS missing UNION ALL SELECT 'status', count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT 'absent', count(*) FROM orders")
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("O")))
    return rows.validate_required(o, ["o_orderkey", "status", "absent"])


@query("d04_assign_ids", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS id FROM lineitem")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.assign_ids(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("d05_flatten_multi_valued", "SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) AS value FROM part")
def flatten_multi_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.flatten_multi_valued(table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("words")), ["p_partkey"], "words")[1]


@query("d06_denormalize", "SELECT o_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def denormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    wide = rows.denormalize(table(spark, sf_dir, "orders").select("o_orderkey"), child, ["o_orderkey"], ["l_linenumber", "l_partkey"])
    return wide.select("o_orderkey", F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["l_linenumber"], c["l_partkey"])), ",").alias("lines"))


@query("d07_convert_units", "SELECT p_partkey, p_size * 2.54::DOUBLE + 1 AS size_cm FROM part")
def convert_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.convert_units(table(spark, sf_dir, "part"), "p_size", 2.54, 1.0, "size_cm").select("p_partkey", "size_cm")


@query("d08_convert_coordinates", """
    WITH p AS (SELECT c_custkey, 48 + (c_custkey % 100) / 1000.0::DOUBLE AS lat, 11 + (c_custkey % 77) / 1000.0::DOUBLE AS lon, 500.0::DOUBLE AS alt FROM customer),
    k AS (SELECT 6378137.0::DOUBLE AS a, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2),
    x AS (SELECT *, a / sqrt(1 - e2 * sin(radians(lat)) * sin(radians(lat))) AS n, a / sqrt(1 - e2 * sin(radians(48.0)) * sin(radians(48.0))) AS n0 FROM p, k),
    d AS (SELECT *, (n + alt) * cos(radians(lat)) * cos(radians(lon)) - (n0 + 500) * cos(radians(48.0)) * cos(radians(11.0)) AS dx,
                 (n + alt) * cos(radians(lat)) * sin(radians(lon)) - (n0 + 500) * cos(radians(48.0)) * sin(radians(11.0)) AS dy,
                 (n * (1 - e2) + alt) * sin(radians(lat)) - (n0 * (1 - e2) + 500) * sin(radians(48.0)) AS dz FROM x)
    SELECT c_custkey, round(-sin(radians(11.0)) * dx + cos(radians(11.0)) * dy, 3) AS east,
      round(-sin(radians(48.0)) * cos(radians(11.0)) * dx - sin(radians(48.0)) * sin(radians(11.0)) * dy + cos(radians(48.0)) * dz, 3) AS north FROM d""")
def convert_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", (48 + (k % 100) / 1000.0).alias("lat"), (11 + (k % 77) / 1000.0).alias("lon"), F.lit(500.0).alias("alt"))
    return rows.to_tangent_plane(p, "lat", "lon", "alt", (48.0, 11.0, 500.0)).select("c_custkey", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"))


@query("d08_helmert", """WITH r AS (SELECT radians(1.5 / 3600) AS rx, radians(-0.75 / 3600) AS ry, radians(2.25 / 3600) AS rz, 1 + 4.5e-6::DOUBLE AS m),
    p AS (SELECT c_custkey, 4000000.0::DOUBLE + c_custkey AS x, 800000.0::DOUBLE - c_custkey AS y, 4900000.0::DOUBLE + c_acctbal AS z FROM customer)
    SELECT c_custkey, round(100 + m * (x - rz * y + ry * z), 3) AS x2, round(-50 + m * (rz * x + y - rx * z), 3) AS y2, round(25 + m * (-ry * x + rx * y + z), 3) AS z2 FROM p, r""")
def helmert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k, (4000000.0 + k).alias("x"), (800000.0 - k).alias("y"), (4900000.0 + F.col("c_acctbal")).alias("z"))
    moved = rows.helmert(p, ["x", "y", "z"], [100.0, -50.0, 25.0], [1.5, -0.75, 2.25], 4.5)
    return moved.select("c_custkey", *[F.round(c, 3).alias(c) for c in ("x2", "y2", "z2")])


@query("d09_parse_date_multi", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def parse_date_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return o.select("o_orderkey", rows.parse_date_multi(text, ["yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy"]).alias("day"))


@query("d10_unify_sources", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 'customer' AS _source FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier")
def unify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.unify_sources({
        "customer": (table(spark, sf_dir, "customer"), {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"}),
        "supplier": (table(spark, sf_dir, "supplier"), {"s_suppkey": "id", "s_name": "name"}),
    })


@query("d11_cast_by_xsd", "SELECT o_orderkey, o_totalprice::BIGINT * 0 + floor(o_totalprice)::BIGINT AS price, o_orderdate::DATE AS day, NULL::BOOLEAN AS flag FROM orders")
def cast_by_xsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit("maybe").alias("flag"))
    return rows.cast_by_xsd(o, {"price": "xsd:integer", "day": "xsd:date", "flag": "xsd:boolean"})


@query("d12_conversion_report", """
    SELECT 'c_acctbal' AS "column", 'double' AS source_type, 'int' AS target_type, 'lossy' AS verdict, 0 AS failing, count(*) FILTER (trunc(c_acctbal) <> c_acctbal) AS losing FROM customer
    UNION ALL SELECT 'c_name', 'string', 'bigint', 'lossy', count(*), 0 FROM customer UNION ALL SELECT 'c_custkey', 'bigint', 'string', 'safe', 0, 0""")
def conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.conversion_report(table(spark, sf_dir, "customer"), {"c_acctbal": "int", "c_name": "bigint", "c_custkey": "string"})


@query("d13_resolve_references", """
    WITH known AS (SELECT row_number() OVER (ORDER BY b) AS id, b FROM (SELECT DISTINCT p_brand AS b FROM part WHERE p_size % 2 = 0)),
    new AS (SELECT row_number() OVER (ORDER BY b) + (SELECT coalesce(max(id), 0) FROM known) AS id, b FROM (SELECT DISTINCT p_brand AS b FROM part WHERE p_brand NOT IN (SELECT b FROM known)))
    SELECT p_partkey, id AS brand_id FROM part JOIN (SELECT * FROM known UNION ALL SELECT * FROM new) ON p_brand = b""")
def resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    known = rows.assign_ids(p.filter("p_size % 2 = 0").select(F.col("p_brand").alias("brand")).distinct(), ["brand"], "brand_id").select("brand", F.col("brand_id").cast("bigint"))
    return rows.resolve_references(p.select("p_partkey", "p_brand"), "p_brand", known, "brand", "brand_id")[0].select("p_partkey", "brand_id")


# -- E: joins


def _join(name: str, kind: str) -> None:
    """Half of the customers, and of the orders those of a third, have keys that the other side lacks."""
    c, o = "CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey END", "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END"

    @query(name, f"SELECT c, k AS o_orderkey FROM (SELECT {c} AS c FROM customer) {kind} JOIN (SELECT {o} AS o, o_orderkey AS k FROM orders) ON c = o")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return relational.join(table(spark, sf_dir, "customer").select(F.expr(c).alias("c")), table(spark, sf_dir, "orders").select(F.expr(o).alias("o"), "o_orderkey"), ["c"], ["o"], kind.lower(), ["c", "o_orderkey"])


for _name, _kind in (("e01_join_inner", "INNER"), ("e02_join_left", "LEFT"), ("e03_join_right", "RIGHT"), ("e04_join_full", "FULL")):
    _join(_name, _kind)


@query("e05_feature_join", """
    SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(spent, 0) AS spent, n IS NOT NULL AS has_orders, coalesce(urgent, 0) AS urgent, CASE WHEN coalesce(spent, 0) > 500000 THEN 'high' ELSE 'low' END AS label
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    df = relational.feature_join(table(spark, sf_dir, "customer").select("c_custkey"), {"orders": (orders, {"n_orders": 0, "spent": 0.0, "urgent": 0})}, "c_custkey")
    return df.withColumn("label", F.when(F.col("spent") > 500000, "high").otherwise("low"))


@query("e06_reconcile_keys", """
    SELECT coalesce(a, b) AS o_orderkey, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'unexpected' ELSE 'matched' END AS status
    FROM (SELECT o_orderkey AS a FROM orders) FULL JOIN (SELECT CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey ELSE o_orderkey END AS b FROM orders) ON a = b""")
def reconcile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    return relational.reconcile_keys(o, o.select(F.when(k % 7 == 0, -k).otherwise(k).alias("o_orderkey")), ["o_orderkey"])


@query("e07_as_of_join", """
    WITH v AS (SELECT user_id, event_id AS version, ts AS tx_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tx_to FROM events WHERE event_id % 2 = 0)
    SELECT e.event_id, v.version FROM events e LEFT JOIN v ON e.user_id = v.user_id AND v.tx_from <= e.ts AND (v.tx_to IS NULL OR e.ts < v.tx_to) WHERE e.event_id % 2 = 1""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = e.filter("event_id % 2 = 0").select("user_id", F.col("event_id").alias("version"), F.col("ts").alias("tx_from"))
    v = relational.close_versions(v, ["user_id"], tie=["version"])
    return relational.as_of_join(e.filter("event_id % 2 = 1").select("event_id", "user_id", "ts"), v, ["user_id"], "ts").select("event_id", "version")


@query("e09_reference_join", "SELECT 'nation/' || n_nationkey AS s, 'in' AS p, 'region/' || r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey")
def reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = relational.join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), ["n_regionkey"], ["r_regionkey"])
    return j.select(F.concat(F.lit("nation/"), "n_nationkey").alias("s"), F.lit("in").alias("p"), F.concat(F.lit("region/"), "r_name").alias("o"))


@query("e10_exclude_held", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def exclude_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    holds = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.exclude_held(table(spark, sf_dir, "customer").select("c_custkey"), holds, "c_custkey")


@query("e11_enrich_by_ids", "SELECT o_orderkey, string_agg(p_partkey || '=' || p_brand, ',' ORDER BY p_partkey) AS parts FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1")
def enrich_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("ids"))
    df = relational.enrich_by_ids(ids, "ids", table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", "parts")
    return df.select("o_orderkey", F.array_join(F.transform("parts", lambda p: F.concat_ws("=", p["p_partkey"], p["p_brand"])), ",").alias("parts"))


# -- F: aggregates


def _aggregate(name: str, function: str, sql: str) -> None:
    @query(name, f"SELECT l_returnflag, {sql} AS v FROM lineitem GROUP BY l_returnflag")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.concat(F.lit(" "), F.col("l_extendedprice").cast("string"))).alias("x"))
        return relational.aggregate(df, ["l_returnflag"], [("x", function, "v")]).withColumn("v", F.round("v", 2))


_X = "CASE WHEN l_linenumber <> 7 THEN l_extendedprice END"
for _name, _function, _sql in (
    ("f01_sum", "SUM", f"round(coalesce(sum({_X}), 0), 2)"), ("f02_avg", "AVG", f"round(coalesce(avg({_X}), 0), 2)"), ("f03_count", "COUNT", f"count({_X})"), ("f04_min", "MIN", f"min({_X})"), ("f04_max", "MAX", f"max({_X})"),
    ("f05_stddev", "STDDEV", f"round(stddev_pop({_X}), 2)"), ("f05_variance", "VARIANCE", f"round(var_pop({_X}), 2)"), ("f06_median", "MEDIAN", f"round(median({_X}), 2)"),
):
    _aggregate(_name, _function, _sql)


@query("f07_default_alias", "SELECT coalesce(nullif(o_orderstatus, 'O'), '') AS status, count(o_totalprice) AS o_totalprice_count FROM orders GROUP BY 1")
def default_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("O")))
    return relational.aggregate(o, ["status"], [("o_totalprice", "COUNT")])


@query("f08_global_aggregate", "SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders")
def global_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.aggregate(table(spark, sf_dir, "orders"), [], [("o_totalprice", "SUM", "total"), ("o_totalprice", "COUNT", "n")]).withColumn("total", F.round("total", 2))


@query("f09_top_values", "SELECT p_brand AS value, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM part) AS percentage FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_values(table(spark, sf_dir, "part"), "p_brand")


@query("f10_distinct_count", "SELECT count(DISTINCT l_partkey) AS distinct_values FROM lineitem")
def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.distinct_count(table(spark, sf_dir, "lineitem"), "l_partkey", exact=True)


@query("f12_count_by_type", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").count().orderBy(F.desc("count"), "event_type")


@query("f13_hourly", "SELECT date_trunc('hour', ts) AS bucket, event_type, round(avg(value), 6) AS average, count(value) AS n FROM events GROUP BY 1, 2")
def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.hourly(table(spark, sf_dir, "events"), "ts", ["event_type"], "value").withColumn("average", F.round("average", 6))


@query("f14_fuse_confidences", """SELECT l_orderkey, round(sum((1 - l_discount) * l_quantity) / sum(l_quantity), 9) AS weighted_average, round(exp(avg(ln(1 - l_discount))), 9) AS geometric_mean,
    CASE WHEN count(*) FILTER (1 - l_discount >= 0.95) * 2 > count(*) THEN 0.9 ELSE 0.1 END::DOUBLE AS majority FROM lineitem GROUP BY l_orderkey""")
def fuse_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("c", 1 - F.col("l_discount"))  # noqa: E741
    return relational.fuse_confidences(l, ["l_orderkey"], "c", "l_quantity", 0.95).withColumns({"weighted_average": F.round("weighted_average", 9), "geometric_mean": F.round("geometric_mean", 9)})


@query("f15_weighted_vote", "SELECT l_orderkey, l_linenumber, round(l_discount * 0.6 + l_tax * 0.4, 9) AS vote FROM lineitem")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(relational.weighted_vote({"l_discount": 0.6, "l_tax": 0.4}), 9).alias("vote"))


# -- G: windows, order, sets


def _dedup(name: str, keep: str, direction: str) -> None:
    @query(name, f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {direction}, o_orderkey {direction}) = 1")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return relational.dedup(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], keep).select("o_orderkey", "o_custkey", "o_totalprice")


_dedup("g01_dedup_first", "first", "ASC")
_dedup("g02_dedup_last", "last", "DESC")


@query("g03_dedup_merge", """SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) AS price FROM orders GROUP BY o_custkey""")
def dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("price"))
    return relational.dedup(o, ["o_custkey"], ["o_orderkey"], "merge")


@query("g04_dedup_highest_quality", """SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN '' END AS priority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN 1.5 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END DESC, o_orderkey) = 1""")
def dedup_highest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(k % 2 == 0, F.col("o_orderpriority")).when(k % 3 == 0, "").alias("priority"))
    return relational.dedup(o, ["o_custkey"], ["o_orderkey"], "highest_quality")


@query("g05_dedup_normalized", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(text))")
def dedup_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return relational.dedup(d, [relational.normalized_key(F.col("text"))], ["doc_id"]).select("doc_id")


@query("g08_dedup_stats", "SELECT count(*) AS input, count(DISTINCT o_custkey) AS kept, count(*) - count(DISTINCT o_custkey) AS duplicates, (count(*) - count(DISTINCT o_custkey)) * 100.0::DOUBLE / count(*) AS rate FROM orders")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.dedup_stats(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("g09_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("g10_top_k_per_group", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 2")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_k_per_group(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 2).select("l_orderkey", "l_linenumber", "rank")


@query("g11_distinct_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.distinct_union([table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))])


@query("g12_set_difference", "SELECT coalesce(a, b) AS k, CASE WHEN b IS NULL THEN 'left' WHEN a IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT DISTINCT l_partkey AS a FROM lineitem) FULL JOIN (SELECT DISTINCT p_partkey AS b FROM part) ON a = b")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.set_difference(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), ["k"])


@query("g13_since_previous", "SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS seconds FROM events")
def since_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.since_previous(table(spark, sf_dir, "events"), ["user_id"], "ts", ["event_id"]).select("event_id", "seconds")


@query("g14_close_versions", "SELECT event_id, ts AS tx_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tx_to FROM events")
def close_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("tx_from"))
    return relational.close_versions(e, ["user_id"], tie=["event_id"]).select("event_id", "tx_from", "tx_to")
