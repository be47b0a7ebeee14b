"""Queries that write tables as files, logs, tables and streams into the shared folder and read them back, and user functions
(families A, B, I, J, Q)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..operators import privacy
from ..sources import change_log, readers, writers
from ..streaming import cdc
from .base import checkpoint_folder, query, table
from .governance_queries import EVENTS, FIELDS, ROW, _envelopes, _subject
from .quality_queries import _values

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def _place(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; its path is a pattern, as it may not be one file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def _csv(spark: SparkSession, sf_dir: str, header: bool) -> str:
    at = _place(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "orders"), at, header)
    return at


# -- A, B: files and tables


@query("a01_read_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a header and a schema."""
    return readers.read_csv(spark, _csv(spark, sf_dir, True), schema=ORDERS)


@query("b01_write_csv", "SELECT o_orderkey::VARCHAR AS column_1, o_custkey::VARCHAR AS column_2, o_orderstatus AS column_3, o_orderpriority AS column_6 FROM orders")
def write_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a header, as text columns."""
    return readers.read_csv(spark, _csv(spark, sf_dir, False), has_header=False).select("column_1", "column_2", "column_3", "column_6")


@query("a02_sniff_csv", "SELECT '|' AS delimiter, true AS has_header, 3 AS fields, c_custkey, c_name, c_acctbal FROM customer")
def sniff_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with bars between their fields, read as their first lines suggest."""
    at = _place(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("sep", "|").option("header", True).csv(at)
    found = readers.sniff_csv(spark, at)
    df = readers.read_csv(spark, at, found["delimiter"], found["has_header"], found["encoding"])
    said = [F.lit(found[k]).alias(k) for k in ("delimiter", "has_header", "fields")]
    return df.select(*said, F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query("a04_read_json", "SELECT event_id, user_id, event_type, value, props FROM events")
def read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON with a schema."""
    at = _place(spark, "json")
    writers.write_json(table(spark, sf_dir, "events"), at)
    return readers.read_json(spark, at, schema="event_id bigint, user_id bigint, event_type string, value double, props string")


@query("b03_write_json", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice FROM part")
def write_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON whose schema is inferred."""
    at = _place(spark, "json")
    writers.write_json(table(spark, sf_dir, "part"), at)
    return readers.read_json(spark, at).select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("b02_write_parquet", "SELECT o_orderkey, o_totalprice, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day FROM orders WHERE year(o_orderdate) >= 1997")
def write_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In folders of days, of which a filter reads some."""
    at = _place(spark, "parquet")
    writers.write_parquet(table(spark, sf_dir, "orders"), at, "o_orderdate")
    return readers.read_parquet(spark, at, ["o_orderkey", "o_totalprice", "year", "month", "day"]).filter("year >= 1997")


@query("b04_load_insert", "SELECT s_suppkey, s_name, 2::BIGINT AS copies FROM supplier")
def load_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is loaded twice."""
    name, df = f"loaded_{uuid.uuid4().hex}", table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    for _ in range(2):
        writers.load_table(df, name)
    return spark.table(name).groupBy("s_suppkey", "s_name").agg(F.count(F.lit(1)).alias("copies"))


@query("b06_load_replace", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def load_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of all suppliers, replaced by some of them."""
    name, df = f"loaded_{uuid.uuid4().hex}", table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    writers.load_table(df, name)
    writers.load_table(df.filter("s_acctbal > 0"), name, "replace")
    return spark.table(name)


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as triples: a quoted name, a typed size, a brand in a language and a link."""
    p = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    t = lambda name, o, datatype=none, lang=none: F.struct(F.lit(f"urn:p:{name}").alias("p"), o.alias("o"), datatype.alias("datatype"), lang.alias("lang"))
    made = F.array(
        t("name", F.concat(F.lit('say "'), "p_name", F.lit('" \\ once'))), t("size", F.col("p_size").cast("string"), F.lit("urn:int")),
        t("brand", F.col("p_brand"), none, F.lit("en")), t("type", F.concat(F.lit("urn:type:"), F.length("p_type"))),
    )
    return p.select(F.concat(F.lit("urn:part:"), "p_partkey").alias("s"), F.inline(made))


TRIPLES = """SELECT 'urn:part:' || p_partkey AS s, 'urn:p:name' AS p, 'say "' || p_name || '" \\ once' AS o, NULL::VARCHAR AS datatype, NULL::VARCHAR AS lang FROM part
    UNION ALL SELECT 'urn:part:' || p_partkey, 'urn:p:size', p_size::VARCHAR, 'urn:int', NULL FROM part UNION ALL SELECT 'urn:part:' || p_partkey, 'urn:p:brand', p_brand, NULL, 'en' FROM part
    UNION ALL SELECT 'urn:part:' || p_partkey, 'urn:p:type', 'urn:type:' || length(p_type), NULL, NULL FROM part"""


@query("a09_read_ntriples", TRIPLES)
def read_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "triples")
    writers.write_ntriples(_triples(spark, sf_dir), at)
    return readers.read_ntriples(spark, at)


@query("b08_write_ntriples", r"""SELECT '<urn:part:' || p_partkey || '> <urn:p:name> "say \"' || p_name || '\" \\ once" .' AS value FROM part
    UNION ALL SELECT '<urn:part:' || p_partkey || '> <urn:p:size> "' || p_size || '"^^<urn:int> .' FROM part UNION ALL SELECT '<urn:part:' || p_partkey || '> <urn:p:brand> "' || p_brand || '"@en .' FROM part
    UNION ALL SELECT '<urn:part:' || p_partkey || '> <urn:p:type> <urn:type:' || length(p_type) || '> .' FROM part""")
def write_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines themselves."""
    at = _place(spark, "triples")
    writers.write_ntriples(_triples(spark, sf_dir), at)
    return spark.read.text(at)


# -- A, B, I: streams


@query("a11_read_log", f"SELECT operation, o_orderkey, o_orderstatus, o_totalprice FROM {EVENTS}")
def read_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events from a log with offsets, which a stream reads to its end."""
    at = _place(spark, "log")
    change_log.append_log(_envelopes(spark, sf_dir).select(F.get_json_object("value", "$.op").alias("key"), "value"), at)
    stream = change_log.read_log_stream(spark, at)
    stream.writeStream.format("parquet").option("path", f"{at}-out").option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start().awaitTermination()
    return cdc.parse_cdc(spark.read.parquet(f"{at}-out"), ROW).select("operation", *FIELDS)


@query("b09_write_log", "SELECT event_id::VARCHAR AS key, event_type, value FROM events")
def write_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of rows into a log, as JSON under a key, and the log's messages."""
    at = _place(spark, "log")
    sent = change_log.messages(_stream(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id")
    change_log.write_log_stream(sent, at, f"{at}-state").trigger(availableNow=True).start().awaitTermination()
    row = F.from_json("value", "event_id bigint, event_type string, value double")
    return change_log.replay(spark, at).select("key", row.alias("r")).select("key", "r.event_type", "r.value")


@query("i14_micro_batches", f"SELECT operation, o_orderkey, o_orderstatus, o_totalprice FROM {EVENTS}")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of change events, two files a batch."""
    at = _place(spark, "changes")
    _envelopes(spark, sf_dir).repartition(4).write.text(f"{at}/in")
    changes = cdc.parse_cdc(readers.read_cdc_files(spark, f"{at}/in", 2), ROW).select("operation", *FIELDS)
    changes.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def _routed(spark: SparkSession, sf_dir: str) -> tuple[str, object]:
    """Orders as a stream, routed by price; those of status P are errors."""
    at = _place(spark, "routes")
    to = lambda name: lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{at}/{name}/epoch={epoch}")
    routes = [{"name": "dear", "condition": {"type": "gte", "field": "o_totalprice", "value": 200000}}, {"name": "cheap", "condition": {"type": "lt", "field": "o_totalprice", "value": 200000}}]
    error = F.when(F.col("o_orderstatus") == "P", "pending")
    q = cdc.route_stream(_stream(spark, sf_dir, "orders").select(*FIELDS), routes, {r["name"]: to(r["name"]) for r in routes}, error, to("letters"), f"{at}/state", F.col("o_orderkey")).trigger(availableNow=True).start()
    q.awaitTermination()
    return at, q


@query("i15_route_stream", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'letters' WHEN o_totalprice >= 200000 THEN 'dear' ELSE 'cheap' END AS sink FROM orders")
def route_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, _ = _routed(spark, sf_dir)
    sink = lambda name, key: spark.read.parquet(f"{at}/{name}").select(F.col(key).alias("o_orderkey"), F.lit(name).alias("sink"))
    return sink("dear", "o_orderkey").unionByName(sink("cheap", "o_orderkey")).unionByName(sink("letters", "row_number"))


@query("i16_stream_statistics", "SELECT count(*) AS rows, 0::BIGINT AS late FROM orders")
def stream_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the stream of :func:`route_stream`, which reads its one file in one batch and has no watermark."""
    got = cdc.stream_statistics(_routed(spark, sf_dir)[1])
    return spark.createDataFrame([(got["rows"], got["late"])], "rows long, late long")


# -- J, Q: user code, exports


@query("j01_register_function", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def register_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised function, called by name in SQL."""
    models.register_function(spark, "tessera_net", lambda price, discount: price * (1 - discount), "double")
    return readers.extract_query(spark, {"x_lineitem": table(spark, sf_dir, "lineitem")}, "SELECT l_orderkey, l_linenumber, tessera_net(l_extendedprice, l_discount) AS net FROM x_lineitem")


@query("j02_text_function", "SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN reverse(p_name) END AS turned FROM part")
def text_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User code that fails for some rows."""

    def turn(text: str) -> str:
        size, name = text.split("|", 1)
        if int(size) % 5 == 0:
            raise ValueError(size)
        return name[::-1]

    return table(spark, sf_dir, "part").select("p_partkey", models.text_function(turn)(F.concat_ws("|", "p_size", "p_name")).alias("turned"))


@query("j05_custom_rule", "SELECT o_custkey AS entity, 'status' AS field, min(o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN 'K' ELSE '' END) AS value FROM orders GROUP BY 1")
def custom_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least of a customer's values, over the different ones."""
    values = _values(spark, sf_dir).select("entity", "field", "value").distinct()
    return models.resolve_by(values, ["entity", "field"], lambda pdf: min(pdf["value"]))


def _exported(spark: SparkSession, sf_dir: str, kind: str) -> str:
    at = _place(spark, f"subject-{kind}")
    privacy.export_subject(privacy.discover_subject(_subject(spark, sf_dir)), at, kind)
    return at


EXPORTED = """SELECT 'customer' AS "table", c_custkey AS id FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey = 7"""


@query("q08_export_json", EXPORTED)
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is held about a person, from the export's lines."""
    value = F.from_json("value", "table string, row struct<c_custkey: bigint, o_orderkey: bigint>")
    return spark.read.text(_exported(spark, sf_dir, "json")).select(value.alias("v")).select("v.table", F.coalesce("v.row.c_custkey", "v.row.o_orderkey").alias("id"))


def _rows(df: DataFrame) -> DataFrame:
    row = F.from_json("row", "c_custkey bigint, o_orderkey bigint")
    return df.select("table", row.alias("r")).select("table", F.coalesce("r.c_custkey", "r.o_orderkey").alias("id"))


@query("q08_export_csv", EXPORTED)
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark.read.option("header", True).csv(_exported(spark, sf_dir, "csv")))


@query("q08_export_xml", EXPORTED)
def export_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark.read.format("xml").option("rowTag", "record").schema("table string, row string").load(_exported(spark, sf_dir, "xml")))
