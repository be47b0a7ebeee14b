"""Queries over streams' batch twins, models, lineage, time, privacy, facts, reconciliation and contracts (I, J, O to U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import models
from ..operators import bitemporal, contracts, facts, lineage, privacy, reconcile, relational
from ..sources import change_log
from ..streaming import cdc
from ..streaming.buckets import BucketedState
from .base import checkpoint_folder, query, table
from .quality_queries import FREQUENCY, _values


def _checkpoints(spark: SparkSession) -> None:
    checkpoint_folder(spark)


# -- I: change streams, as batches

ROW = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
FIELDS = ["o_orderkey", "o_orderstatus", "o_totalprice"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events (e) of orders: creates for all, updates where the key divides by 3, deletes where it divides by 10."""
    o = table(spark, sf_dir, "orders").select(*FIELDS)
    row, newer = F.struct(*FIELDS), F.struct("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    none = F.when(F.lit(False), row)
    e = lambda op, before, after, ts: F.struct(before.alias("before"), after.alias("after"), F.lit(op).alias("op"), F.lit(ts).alias("ts_ms"))
    k = F.col("o_orderkey")
    events = F.array_compact(F.array(e("c", none, row, 1), F.when(k % 3 == 0, e("u", row, newer, 2)), F.when(k % 10 == 0, e("d", row, none, 3))))
    return o.select(F.explode(events).alias("e"))


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.to_json("e").alias("value"))


EVENTS = """(SELECT o_orderkey, 'create' AS operation, o_orderstatus, o_totalprice, 1 AS ts_ms FROM orders UNION ALL SELECT o_orderkey, 'update', 'X', o_totalprice + 1, 2 FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, 'delete', o_orderstatus, o_totalprice, 3 FROM orders WHERE o_orderkey % 10 = 0)"""


@query("i01_parse_cdc", f"SELECT operation, o_orderkey, o_orderstatus, o_totalprice FROM {EVENTS}")
def parse_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.parse_cdc(_envelopes(spark, sf_dir), ROW).select("operation", *FIELDS)


@query("i02_changed_fields", "SELECT o_orderkey, 'o_orderstatus,o_totalprice' AS changed FROM orders WHERE o_orderkey % 3 = 0")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = cdc.parse_cdc(_envelopes(spark, sf_dir), ROW).filter("operation = 'update'")
    return cdc.changed_fields(changes, FIELDS).select("o_orderkey", F.array_join("changed", ",").alias("changed"))


@query("i03_apply_cdc", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 0")
def apply_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = cdc.parse_cdc(_envelopes(spark, sf_dir), ROW)
    target = table(spark, sf_dir, "orders").select(*FIELDS).filter("o_orderkey % 10 = 0")
    return cdc.apply_changes(target, changes, ["o_orderkey"], ["ts_ms"], FIELDS)


def _streamed(spark: SparkSession, sf_dir: str, name: str, operator) -> DataFrame:  # noqa: ANN001
    """What an operator makes of a table that is read as a stream to its end."""
    import uuid

    at = f"{checkpoint_folder(spark)}/streamed-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")  # a pattern, as a stream's path may not be one file
    operator(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def _logged(spark: SparkSession, sf_dir: str) -> tuple[str, dict]:
    """A log to which the creations of orders are appended, then their updates and deletions, and the position between."""
    import uuid

    at = f"{checkpoint_folder(spark)}/log-{uuid.uuid4().hex}"
    e, key = _events(spark, sf_dir), F.coalesce("e.after.o_orderkey", "e.before.o_orderkey").cast("string").alias("key")
    send = lambda which: change_log.append_log(e.filter(which).select(key, F.to_json("e").alias("value")), at)
    send("e.op = 'c'")
    between = change_log.log_position(at)
    send("e.op != 'c'")
    return at, between


@query("a12_replay_from", f"SELECT operation, o_orderkey, o_orderstatus, o_totalprice FROM {EVENTS} WHERE operation <> 'create'")
def replay_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log holds from a stored position on."""
    at, between = _logged(spark, sf_dir)
    return cdc.parse_cdc(change_log.replay(spark, at, between), ROW).select("operation", *FIELDS)


@query("i03_apply_cdc_stream", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 0")
def apply_cdc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log read as a stream into buckets: a batch of creations, and after a restart the updates and deletions."""
    at, between = _logged(spark, sf_dir)
    for end in (between, "latest"):
        stream = change_log.read_log_stream(spark, at, ending_offsets=end)
        q = cdc.apply_cdc_stream(cdc.parse_cdc(stream, ROW), f"{at}/state", ["o_orderkey"], ["ts_ms"], FIELDS, f"{at}/check", buckets=8)
        q.trigger(availableNow=True).start().awaitTermination()
    return BucketedState(spark, f"{at}/state", ["o_orderkey"], FIELDS).frame()


@query("i04_watermark", "SELECT time_bucket(INTERVAL 1 hour, ts) AS bucket, count(*) AS n FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 10 minute FROM events)")
def watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that are over for a watermark of ten minutes."""
    hours = lambda s: cdc.with_watermark(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return _streamed(spark, sf_dir, "events", hours).select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n")


@query("i05_ttl_dedup", "SELECT event_id, user_id, event_type, value FROM events")
def ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice."""
    twice = lambda s: s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_again")
    return _streamed(spark, sf_dir, "events", lambda s: cdc.ttl_dedup(twice(s), ["event_id"], "ts", "1 hour")).select("event_id", "user_id", "event_type", "value")


@query("i06_windowed_dedup", "SELECT time_bucket(INTERVAL 1 day, ts) AS window_start, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def windowed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return cdc.windowed_dedup(e, ["user_id"], "ts", "1 day", ["event_id"]).select("window_start", "user_id", "event_id")


@query("i07_keyed_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def keyed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.keyed_dedup(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("i08_incremental_aggregate", "SELECT user_id, count(value) AS n, round(sum(value), 4) AS total, min(value) AS smallest, max(value) AS largest FROM events GROUP BY 1")
def incremental_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.incremental_aggregate(table(spark, sf_dir, "events"), ["user_id"], "value").select("user_id", "n", F.round("total", 4).alias("total"), "smallest", "largest")


ENOUGH = f"SELECT f.* FROM ({FREQUENCY}) f JOIN (SELECT o_custkey AS entity FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 2) USING (entity)"


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.resolve_batch(_values(spark, sf_dir))


@query("i09_resolve_entities", ENOUGH)
def resolve_stream_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("entity", "value", F.round("confidence", 6).alias("confidence"), "severity")


@query("i10_conflicts", f"SELECT entity, value FROM ({ENOUGH}) WHERE severity IS NOT NULL")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.conflicts(_resolved(spark, sf_dir)).select("entity", "value")


@query("i11_conflict_counts", f"SELECT severity, count(*) AS n FROM ({ENOUGH}) WHERE severity IS NOT NULL GROUP BY 1")
def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.conflict_counts(_resolved(spark, sf_dir))


@query("i12_critical_conflicts", f"SELECT entity FROM ({ENOUGH}) WHERE severity = 'High'")
def critical_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.critical_conflicts(_resolved(spark, sf_dir)).select("entity")


@query("i13_tag_fields", "SELECT event_id, 'ts=date,user_id=id' AS tags FROM events")
def tag_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cdc.tag_fields(table(spark, sf_dir, "events"), {"ts": "date", "user_id": "id", "absent": "x"})
    return e.select("event_id", F.array_join(F.transform("_tags", lambda t: F.concat_ws("=", t["field"], t["kind"])), ",").alias("tags"))


PIPE_RULES = [{"field": "value", "rule": "RANGE", "min": 0, "max": 50, "severity": "warning"}]


@query("i17_governed_lineage", "SELECT event_id::VARCHAR AS key, 'governed' AS job, 2::BIGINT AS read, 1::BIGINT AS dropped FROM events")
def governed_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return cdc.governed_outcome(e.unionByName(e), ["event_id"], "ts", PIPE_RULES)["lineage"]


@query("i17_governed_pipeline", "SELECT event_id, CASE WHEN value BETWEEN 0 AND 50 THEN 1.0 ELSE 0.95 END::DOUBLE AS quality, 1.0::DOUBLE AS completeness FROM events")
def governed_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return cdc.governed_pipeline(e.unionByName(e), ["event_id"], "ts", "1 hour", PIPE_RULES).select("event_id", "quality", "completeness")


@query("i18_idempotent_events", "SELECT event_id, value FROM events WHERE event_id % 3 <> 0")
def idempotent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that comes twice to a table that has a third of it."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return cdc.new_events(e.unionByName(e), "event_id", e.filter("event_id % 3 = 0")).select("event_id", "value")


# -- J: rules and models


@query("j03_heuristic", "SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN 0.8 ELSE 0.2 END::DOUBLE AS confidence, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN 'accept' ELSE 'reject' END AS decision FROM customer")
def heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", models.heuristic({"field": "c_acctbal", "kind": "range", "min": 0, "max": 5000, "confidence": 0.8}).alias("h"))
    return c.select("c_custkey", F.round("h.confidence", 6).alias("confidence"), "h.decision")


@query("j03_unique_rule", """SELECT o_orderkey, CASE WHEN n = 1 THEN 0.95 ELSE 0.05 END::DOUBLE AS confidence, CASE WHEN n = 1 THEN 'accept' ELSE 'reject' END AS decision, CASE WHEN o_totalprice IS NOT NULL THEN 'accept' ELSE 'reject' END AS priced
    FROM orders JOIN (SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL) USING (o_custkey, o_orderdate)""")
def unique_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are their customer's only one of the day."""
    o = table(spark, sf_dir, "orders").withColumn("visit", F.concat_ws("|", "o_custkey", "o_orderdate"))
    h = models.heuristics(o, {"h": {"field": "visit", "kind": "unique", "confidence": 0.95}, "p": {"field": "o_totalprice", "kind": "not_null"}})
    return h.select("o_orderkey", F.round("h.confidence", 6).alias("confidence"), "h.decision", F.col("p.decision").alias("priced"))


def _linear(x):  # noqa: ANN001, ANN202
    import numpy as np

    score = 1 / (1 + np.exp(-(x[:, 0] / 20 - x[:, 1] * 10)))
    return np.column_stack([(score >= 0.5).astype(float), np.maximum(score, 1 - score)])


@query("j04_predict", "SELECT l_orderkey, l_linenumber, (s >= 0.5)::INT::DOUBLE AS prediction, CASE WHEN greatest(s, 1 - s) >= 0.6 THEN 'accept' ELSE 'manual_review' END AS decision FROM (SELECT *, 1 / (1 + exp(-(l_quantity / 20 - l_discount * 10))) AS s FROM lineitem)")
def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.predict(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], _linear, 0.6).select("l_orderkey", "l_linenumber", "prediction", "decision")


@query("j06_embed")
def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.embed(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", 32).select("p_partkey", "vector")


# -- O: lineage


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer -> orders."""
    e = lambda df, s, sk, d, dk, job: df.select(F.concat(F.lit(s), sk).alias("src"), F.concat(F.lit(d), dk).alias("dst"), F.lit(job).alias("job"))
    return (
        e(table(spark, sf_dir, "nation"), "r", "n_regionkey", "n", "n_nationkey", "load_nation")
        .unionByName(e(table(spark, sf_dir, "customer"), "n", "c_nationkey", "c", "c_custkey", "load_customer"))
        .unionByName(e(table(spark, sf_dir, "orders"), "c", "o_custkey", "o", "o_orderkey", "load_orders"))
    )


EDGES = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'load_nation' AS job FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'load_customer' FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'load_orders' FROM orders)"""
DOWN = f"""WITH RECURSIVE {EDGES}, t AS (SELECT r AS start, r AS node, 0 AS hops FROM (SELECT 'r' || r_regionkey AS r FROM region) UNION ALL SELECT t.start, e.dst, hops + 1 FROM t JOIN e ON t.node = e.src)"""
UP = f"""WITH RECURSIVE {EDGES}, t AS (SELECT o AS start, o AS node, 0 AS hops FROM (SELECT 'o' || o_orderkey AS o FROM orders) UNION ALL SELECT t.start, e.src, hops + 1 FROM t JOIN e ON t.node = e.dst)"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("start"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("start"))


@query("o01_capture_rows", "SELECT o_orderkey::VARCHAR AS row_id, CASE WHEN o_orderkey % 4 = 0 THEN 'filtered' WHEN o_orderkey % 5 = 0 THEN 'validation_failed' ELSE 'processed' END AS outcome FROM orders")
def capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey")
    failed = o.filter("o_orderkey % 5 = 0 AND o_orderkey % 4 != 0").select("id", F.lit("bad").alias("message"))
    return lineage.capture_rows(o, o.filter("o_orderkey % 4 != 0 AND o_orderkey % 5 != 0"), "id", "j", failed).select("row_id", "outcome")


@query("o02_dedup_lineage", "SELECT min(o_orderkey) OVER (PARTITION BY o_custkey) AS kept, o_orderkey AS removed FROM orders QUALIFY kept <> removed")
def dedup_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.dedup_lineage(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_orderkey"]).select("kept", "removed")


@query("o03_row_journey", "SELECT user_id, row_number() OVER w AS n, event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def row_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.row_journey(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", ["event_id"]).select("user_id", "n", "event_type", "seconds")


def _row_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("row_id"), F.concat(F.lit("job"), k % 3).alias("job"), F.when(k % 4 == 0, "filtered").otherwise("processed").alias("outcome"))


@query("o04_job_statistics", "SELECT 'job' || o_orderkey % 3 AS job, count(*) AS total, count(*) FILTER (o_orderkey % 4 <> 0) AS processed, count(*) FILTER (o_orderkey % 4 = 0) AS filtered FROM orders GROUP BY 1")
def job_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.job_statistics(_row_log(spark, sf_dir)).select("job", "total", "processed", "filtered")


@query("o05_filtered_rows", "SELECT o_orderkey AS row_id FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 4 = 0")
def filtered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.search_rows(_row_log(spark, sf_dir), "job1", "filtered").select("row_id")


@query("o06_search_rows", "SELECT o_orderkey AS row_id FROM orders WHERE contains(o_orderkey::VARCHAR, '77')")
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.search_rows(_row_log(spark, sf_dir), key_part="77").select("row_id")


@query("o08_upstream", f"{UP} SELECT start, node, min(hops) AS hops FROM t WHERE hops > 0 GROUP BY 1, 2")
def upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return lineage.trace(_edges(spark, sf_dir), _orders(spark, sf_dir), "upstream")


@query("o09_downstream_impact", f"{DOWN} SELECT t.start, count(DISTINCT t.node) AS affected, count(DISTINCT e.job) AS jobs, max(hops) AS depth FROM t JOIN e ON t.node = e.dst WHERE hops > 0 GROUP BY 1")
def downstream_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return lineage.impact(_edges(spark, sf_dir), _regions(spark, sf_dir))


@query("o10_critical_dependencies", f"{DOWN} SELECT start, 'dim_' || node AS node FROM t WHERE hops = 1")
def critical_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    reached = lineage.trace(_edges(spark, sf_dir), _regions(spark, sf_dir), max_hops=2)
    return lineage.critical_dependencies(reached.withColumn("node", F.when(F.col("hops") == 1, F.concat(F.lit("dim_"), "node")).otherwise(F.col("node")))).select("start", "node")


RING = "(SELECT o_orderkey AS k, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


@query("o11_cycles", f"SELECT 'o' || k AS node, n AS length FROM {RING}")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer in a ring, with lines that lead in and nowhere."""
    _checkpoints(spark)
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.lead("o_orderkey").over(w), F.first("o_orderkey").over(w)).alias("next"))
    ring = o.select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("o"), "next").alias("dst"))
    return lineage.cycles(ring.unionByName(_edges(spark, sf_dir).select("src", "dst"))).select("node", F.col("length").cast("bigint").alias("length"))


@query("o12_depth", f"{DOWN} SELECT max(hops) AS depth, false AS cyclic FROM t")
def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return lineage.depth(_edges(spark, sf_dir))


def _lineage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), k).alias("record_id"), F.array(F.concat(F.lit("c"), "o_custkey")).alias("source_refs"), F.array(F.concat(F.lit("m"), k % 4)).alias("model_refs"), F.lit("orders").alias("dataset"), F.concat(F.lit("run"), F.year("o_orderdate")).alias("run_id"), F.col("o_orderdate").alias("ts"))


@query("o13_record_graph", "SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders")
def record_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.record_edges(_lineage_events(spark, sf_dir)).select("src", "dst")


@query("o14_models_in_chain", "SELECT DISTINCT 'm' || o_orderkey % 4 AS model FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def models_in_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models behind the orders above the mean price."""
    o = table(spark, sf_dir, "orders")
    records = o.join(F.broadcast(o.agg(F.avg("o_totalprice").alias("mean")))).filter("o_totalprice > mean").select(F.concat(F.lit("o"), "o_orderkey").alias("record_id"))  # one row
    return lineage.models_in_chain(_lineage_events(spark, sf_dir), records)


@query("o15_source_impact", "SELECT count(*) AS records, count(DISTINCT 1) AS datasets, count(DISTINCT o_orderkey % 4)::INT AS models, CASE WHEN count(DISTINCT o_orderkey % 4) > 1 THEN 'high' WHEN count(*) > 100 THEN 'medium' ELSE 'low' END AS risk FROM orders WHERE o_custkey = 7")
def source_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.source_impact(_lineage_events(spark, sf_dir), "c7")


@query("o16_root_causes", f"{UP} SELECT start, node, hops FROM t WHERE hops > 0 AND node NOT IN (SELECT dst FROM e)")
def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return lineage.root_causes(_edges(spark, sf_dir), _orders(spark, sf_dir)).select("start", "node", "hops")


@query("o17_simulate_change", f"{DOWN} SELECT t.start, count(DISTINCT t.node) AS affected, CASE WHEN count(DISTINCT t.node) > 10 THEN 'high' ELSE 'medium' END AS risk FROM t WHERE hops > 0 GROUP BY 1")
def simulate_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return lineage.simulate_change(_edges(spark, sf_dir), _regions(spark, sf_dir), "schema").select("start", "affected", "risk")


@query("o18_stale_predictions", "SELECT event_id FROM events WHERE event_id % 3 <> 2")
def stale_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model_id"), (F.col("event_id") % 3).alias("model_version"))
    return lineage.stale_predictions(e, e.groupBy("model_id").agg(F.max("model_version").alias("model_version"))).select("event_id")


@query("o19_run_lineage", "SELECT 'o' || o_orderkey AS record_id FROM orders WHERE year(o_orderdate) = 1996 AND o_orderdate >= TIMESTAMP '1996-06-01'")
def run_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.run_lineage(_lineage_events(spark, sf_dir), "ts", F.lit("1996-06-01").cast("timestamp_ntz"), run="run1996").select("record_id")


@query("o20_openlineage", "SELECT 'run' || event_id AS run_id, event_type AS job, 'in' || user_id AS first_input FROM events")
def openlineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.lit("COMPLETE").alias("event_type"), F.col("ts").alias("event_time"), F.concat(F.lit("run"), "event_id").alias("run_id"), F.lit("ns").alias("namespace"), F.col("event_type").alias("job"), F.array(F.concat(F.lit("in"), "user_id")).alias("inputs"), F.array(F.lit("out")).alias("outputs"))
    return lineage.from_openlineage(lineage.to_openlineage(runs)).select("run_id", "job", F.get("inputs", F.lit(0)).alias("first_input"))


def _schemas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the parts' attributes as table schemas: brands are tables, parts are columns."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    row = lambda kind: p.select(F.col("p_brand").alias("table"), k.cast("string").alias("column"), kind.alias("type"), (k % 2 == 0).alias("nullable"), k)
    old, new = row(F.lit("int")).filter("p_partkey % 7 != 0"), row(F.when(k % 5 == 0, "string").otherwise("int")).filter("p_partkey % 11 != 0")
    return old.drop("p_partkey"), new.drop("p_partkey")


DIFF = """SELECT p_brand AS "table", p_partkey::VARCHAR AS "column", CASE WHEN p_partkey % 11 = 0 AND p_partkey % 7 <> 0 THEN 'drop_column' WHEN p_partkey % 7 = 0 AND p_partkey % 11 <> 0 THEN 'add_column' WHEN p_partkey % 5 = 0 THEN 'change_type' END AS change FROM part
    WHERE NOT (p_partkey % 7 = 0 AND p_partkey % 11 = 0) AND (p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 5 = 0)"""


@query("o21_schema_diff", DIFF)
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.schema_diff(*_schemas(spark, sf_dir))


@query("o22_breaking", f"SELECT *, change <> 'add_column' AS breaking FROM ({DIFF})")
def breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.flag_breaking(lineage.schema_diff(*_schemas(spark, sf_dir)))


@query("o23_drift_severity", f"SELECT \"table\", count(*) AS changes, count(*) FILTER (change <> 'add_column') AS breaking, CASE WHEN count(*) FILTER (change <> 'add_column') >= 3 THEN 'critical' WHEN count(*) FILTER (change <> 'add_column') > 0 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'low' END AS severity FROM ({DIFF}) GROUP BY 1")
def drift_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.drift_severity(lineage.schema_diff(*_schemas(spark, sf_dir)))


@query("o24_schema_changes", f"SELECT \"column\" FROM ({DIFF}) WHERE change = 'drop_column' AND \"table\" LIKE 'Brand#1%'")
def schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.schema_diff(*_schemas(spark, sf_dir)).filter(F.col("change") == "drop_column").filter(F.col("table").like("Brand#1%")).select("column")


@query("o25_migration_risk", f"SELECT d.\"column\", CASE WHEN change = 'add_column' THEN 'low' WHEN \"column\"::BIGINT % 2 = 0 THEN 'high' ELSE 'medium' END AS risk FROM ({DIFF}) d")
def migration_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.concat_ws(".", "p_brand", "p_partkey").alias("src"), F.lit("report").alias("dst"))
    return lineage.migration_risk(lineage.schema_diff(*_schemas(spark, sf_dir)), reads).select("column", "risk")


@query("o26_coverage", "SELECT 'job' || o_orderkey % 3 AS job, count(*) AS rows, count(*) FILTER (o_orderkey % 4 <> 0) AS traced FROM orders GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.coverage(_row_log(spark, sf_dir), ["job"], F.col("outcome") == "processed").select("job", "rows", "traced")


@query("o27_reverse_lineage", f"{UP} SELECT start, node, (substring(node, 2)::INT % 2 = 0)::BIGINT AS fusions FROM t WHERE hops > 0 AND node NOT IN (SELECT dst FROM e)")
def reverse_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    fusions = table(spark, sf_dir, "region").filter("r_regionkey % 2 = 0").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("e1").alias("entity"))
    return lineage.reverse_lineage(_edges(spark, sf_dir), _orders(spark, sf_dir), fusions).select("start", "node", "fusions")


# -- P: bitemporal


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.col("value").alias("object"), F.col("ts").alias("tx_from"), "event_id")
    closed = relational.close_versions(e, ["subject", "predicate"], tie=["event_id"])
    return closed.withColumns({"valid_from": F.date_sub(F.col("tx_from").cast("date"), 1).cast("timestamp_ntz"), "valid_to": F.lit(None).cast("timestamp_ntz")})


FACTS = "(SELECT user_id AS subject, event_type AS predicate, value AS object, ts AS tx_from, event_id, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS tx_to, (ts::DATE - 1)::TIMESTAMP AS valid_from FROM events)"


@query("p01_current", f"SELECT subject, predicate, event_id FROM {FACTS} WHERE tx_to IS NULL")
def current_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitemporal.current(_facts(spark, sf_dir)).select("subject", "predicate", "event_id")


@query("p02_as_of", f"SELECT event_id FROM {FACTS}, (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS m FROM events) WHERE tx_from <= m AND (tx_to IS NULL OR m < tx_to) AND valid_from <= m")
def facts_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = table(spark, sf_dir, "events").agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("m"))
    return bitemporal.as_of(_facts(spark, sf_dir).join(F.broadcast(middle)), F.col("m"), F.col("m")).select("event_id")


@query("p03_version_chain", "SELECT event_id FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    return bitemporal.version_chain(f, f.agg(F.min("subject")).first()[0]).select("event_id")


@query("p04_history", "SELECT subject, predicate, object, tx_from, lead(tx_from) OVER (PARTITION BY subject, predicate ORDER BY tx_from, event_id) AS tx_to FROM (SELECT user_id AS subject, event_type AS predicate, floor(value / 40) AS object, ts AS tx_from, event_id, lag(floor(value / 40)) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE n = 1 OR b IS DISTINCT FROM object")
def fact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.floor(F.col("value") / 40).cast("double").alias("object"), F.col("ts").alias("tx_from"), "event_id")
    return bitemporal.history(w, ["event_id"]).drop("event_id")


@query("p04_supersede", f"""SELECT subject, predicate, object, tx_from, coalesce(tx_to, CASE WHEN subject % 2 = 0 THEN TIMESTAMP '2100-01-01' END) AS tx_to FROM {FACTS} UNION ALL SELECT subject, predicate, -1.0, TIMESTAMP '2100-01-01', NULL FROM {FACTS} WHERE tx_to IS NULL AND subject % 2 = 0""")
def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir).select("subject", "predicate", "object", "tx_from", "tx_to")
    writes = bitemporal.current(f).select("subject", "predicate", F.when(F.col("subject") % 2 == 0, -1.0).otherwise(F.col("object")).alias("object"), F.lit("2100-01-01").cast("timestamp_ntz").alias("tx_from"))
    return bitemporal.supersede(f, writes)


@query("p05_audit_trail", f"SELECT subject, predicate, event_id, tx_from, tx_to, valid_from FROM {FACTS}")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("subject", "predicate", "event_id", "tx_from", "tx_to", "valid_from")


@query("p06_chain_statistics", "SELECT count(*) AS chains, round(avg(n), 6) AS average, max(n) AS longest, count(*) FILTER (n > 5) AS long_chains FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)")
def chain_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitemporal.chain_statistics(_facts(spark, sf_dir), 5).withColumn("average", F.round("average", 6))


@query("p07_archivable", f"SELECT event_id FROM {FACTS}, (SELECT max(ts) - INTERVAL 3 days AS m FROM events) WHERE tx_to < m")
def archivable(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").agg((F.max("ts") - F.expr("INTERVAL 3 DAYS")).alias("m"))
    return bitemporal.archivable(_facts(spark, sf_dir).join(F.broadcast(last)), F.col("m")).select("event_id")


@query("p08_verify_chain", "SELECT user_id, event_id, 'time_regression' AS problem FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END AS t FROM events)) WHERE p > t")
def verify_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with sound hashes; times that go back are found."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    h = F.sha2(F.concat_ws("|", "event_id", "value"), 256)
    e = table(spark, sf_dir, "events").withColumn("prev_hash", F.coalesce(F.lag(h).over(w), F.lit("0" * 64))).withColumn("hash", h)
    e = e.withColumn("t", F.when(F.col("event_id") % 7 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts")))
    found = bitemporal.verify_chain(e, ["user_id"], "event_id", "t", ["value"])
    return found.filter("problem != 'wrong_hash'")


@query("p09_merkle_roots", """WITH RECURSIVE l(batch, leaves, hs) AS (
        SELECT event_type, count(*), list(sha256(event_id || '|' || user_id) ORDER BY event_id) FROM events GROUP BY 1
        UNION ALL SELECT batch, leaves, list_transform(range((len(hs) + 1) // 2), lambda k: sha256(hs[2 * k + 1] || coalesce(hs[2 * k + 2], hs[2 * k + 1]))) FROM l WHERE len(hs) > 1)
    SELECT batch, hs[1] AS root, leaves FROM l WHERE len(hs) = 1""")
def merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    leaf = F.sha2(F.concat_ws("|", "event_id", "user_id"), 256)
    return bitemporal.merkle_roots(table(spark, sf_dir, "events"), "event_type", "event_id", leaf)


@query("p10_entity_state", f"SELECT subject, predicate, object FROM {FACTS} WHERE tx_to IS NULL")
def entity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitemporal.current(_facts(spark, sf_dir)).select("subject", "predicate", "object")


# -- Q: privacy


def _private(name: str, sql: str, make) -> None:  # noqa: ANN001
    @query(name, f"SELECT c_custkey, {sql} AS v FROM customer")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "customer").select("c_custkey", make().alias("v"))


_private("q01_hash", "sha256(c_name || 'salt')", lambda: privacy.hash_with_salt(F.col("c_name"), "salt"))
_private("q02_mask", "repeat('*', length(c_name) - 4) || right(c_name, 4)", lambda: privacy.mask(F.col("c_name")))
_private("q03_generalize_age", "(c_custkey % 90 // 10 * 10)::VARCHAR || '-' || (c_custkey % 90 // 10 * 10 + 9)::VARCHAR", lambda: privacy.generalize((F.col("c_custkey") % 90).cast("string"), "age"))
_private("q06_mask_email", "'c' || repeat('*', length('c' || c_custkey) - 1) || '@example.org'", lambda: privacy.mask_email(F.concat(F.lit("c"), "c_custkey", F.lit("@example.org"))))
_private("q06_mask_phone", "'555' || repeat('*', length(c_custkey::VARCHAR))", lambda: privacy.mask_phone(F.concat(F.lit("(555) "), "c_custkey")))


@query("q03_generalize_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS v FROM orders")
def generalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", privacy.generalize(F.col("o_orderdate").cast("string"), "month").alias("v"))


@query("q04_random_pseudonym", "SELECT count(*) AS n, count(*) AS well_formed FROM customer")
def random_pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "customer").select("c_custkey", privacy.random_pseudonym().alias("u"))
    return u.agg(F.count_distinct("u").alias("n"), F.count_if(F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("well_formed"))


@query("q05_pseudonyms", "SELECT c_custkey, 'S' || dense_rank() OVER (ORDER BY c_mktsegment) AS pseudonym FROM customer")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pseudonyms(table(spark, sf_dir, "customer"), "c_mktsegment", "S").select("c_custkey", "pseudonym")


def _subject(spark: SparkSession, sf_dir: str) -> dict:
    return {"customer": (table(spark, sf_dir, "customer"), F.col("c_custkey") == 7), "orders": (table(spark, sf_dir, "orders"), F.col("o_custkey") == 7)}


@query("q07_discover_subject", "SELECT 'customer' AS \"table\", count(*) AS rows FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey = 7 HAVING count(*) > 0")
def discover_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.subject_summary(privacy.discover_subject(_subject(spark, sf_dir))).select("table", "rows")


@query("q09_erasure_plan", "SELECT 'customer' AS \"table\", count(*) AS rows, count(*) FILTER (c_custkey = 7) AS affected FROM customer UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_custkey = 7) FROM orders")
def erasure_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.erasure_plan(_subject(spark, sf_dir))


@query("q09_erase", "SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS c_name, c_custkey % 9 = 0 AS _erased FROM customer")
def erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.erase(table(spark, sf_dir, "customer"), F.col("c_custkey") % 9 == 0, "tombstone", ["c_name"]).select("c_custkey", "c_name", "_erased")


@query("q10_retention", "SELECT o_orderkey, CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1998-08-02') < 365 THEN 'keep' WHEN date_diff('day', o_orderdate::DATE, DATE '1998-08-02') > 1500 THEN 'must_delete' ELSE 'may_delete' END AS decision FROM orders")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.retention(table(spark, sf_dir, "orders"), "o_orderdate", F.lit("1998-08-02").cast("date"), 365, 1500).select("o_orderkey", "decision")


@query("q11_legal_hold", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) OR o_orderpriority = '1-URGENT' AS blocked FROM orders")
def legal_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.lit("subject").alias("kind"), F.col("c_custkey").cast("string").alias("value"))
    holds = subjects.unionByName(spark.range(1).select(F.lit("category").alias("kind"), F.lit("1-URGENT").alias("value")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("who"), "o_orderpriority")
    return privacy.apply_holds(o, holds, "who", "o_orderpriority").select("o_orderkey", "blocked")


@query("q12_verify_erasure", """SELECT 'customer' AS "table", 0 AS "left", true AS clean UNION ALL SELECT 'orders', count(*), count(*) = 0 FROM orders WHERE o_custkey % 9 = 0 AND o_totalprice < 100000""")
def verify_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An erasure that was done, and one that left the small orders."""
    mine, theirs = F.col("c_custkey") % 9 == 0, F.col("o_custkey") % 9 == 0
    done = privacy.erase(table(spark, sf_dir, "customer"), mine, "delete")
    half = privacy.erase(table(spark, sf_dir, "orders"), theirs & (F.col("o_totalprice") >= 100000), "delete")
    return privacy.verify_erasure({"customer": (done, mine), "orders": (half, theirs)})


@query("q13_consented", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM (SELECT user_id, arg_max(value, (ts, CASE WHEN value > 20 THEN 'granted' ELSE 'denied' END)) AS v FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1) WHERE v > 20)")
def consented(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    purpose = e.agg(F.min("event_type")).first()[0]
    consents = e.select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("purpose"), F.when(F.col("value") > 20, "granted").otherwise("denied").alias("status"), "ts")
    return privacy.consented(table(spark, sf_dir, "customer"), consents, "c_custkey", purpose).select("c_custkey")


# -- R: facts


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.to_triples(table(spark, sf_dir, "customer"), facts.template("c/{c_custkey}", ["c_custkey"]), ["Customer"], {"name": (F.col("c_name"), "string"), "nation": (F.concat(F.lit("n/"), "c_nationkey"), None), "segment": (F.col("c_mktsegment"), "string")}, "customers")
    n = facts.to_triples(table(spark, sf_dir, "nation"), F.concat(F.lit("n/"), "n_nationkey"), ["Nation"], {"name": (F.col("n_name"), "string"), "region": (F.concat(F.lit("r/"), "n_regionkey"), None)}, "places")
    return c.unionByName(n)


TRIPLES = """(SELECT 'c/' || c_custkey AS s, unnest(['type', 'name', 'nation', 'segment']) AS p, unnest(['Customer', c_name, 'n/' || c_nationkey, c_mktsegment]) AS o, 'customers' AS graph FROM customer
    UNION ALL SELECT 'n/' || n_nationkey, unnest(['type', 'name', 'region']), unnest(['Nation', n_name, 'r/' || n_regionkey]), 'places' FROM nation)"""


@query("r06_to_triples", f"SELECT s, p, o, graph FROM {TRIPLES}")
def to_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(spark, sf_dir).select("s", "p", "o", "graph")


@query("r01_match", f"SELECT s FROM {TRIPLES} WHERE p = 'segment' AND o = 'BUILDING' AND graph = 'customers'")
def match_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.match(_triples(spark, sf_dir), p="segment", o="BUILDING", graph="customers").select("s")


@query("r01_ask", f"SELECT count(*) > 0 AS answer FROM {TRIPLES} WHERE p = 'segment' AND o = 'NONE'")
def ask_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.ask(_triples(spark, sf_dir), p="segment", o="NONE")


BGP = "SELECT 'c/' || c_custkey AS c, c_name AS name, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query("r02_graph_pattern", f"{BGP} WHERE n_regionkey = 1")
def graph_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.graph_pattern(_triples(spark, sf_dir), [("?n", "region", "r/1"), ("?n", "name", "?country"), ("?c", "nation", "?n"), ("?c", "name", "?name")]).select("c", "name", "country")


@query("e08_pattern_join", f"{BGP} WHERE c_mktsegment = 'BUILDING'")
def pattern_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.graph_pattern(_triples(spark, sf_dir), [("?c", "segment", "BUILDING"), ("?c", "nation", "?n"), ("?c", "name", "?name")], [("?n", "name", "?country")]).select("c", "name", "country")


@query("r03_delete_where", f"SELECT s, p, o FROM {TRIPLES} WHERE NOT (p = 'segment' AND graph = 'customers')")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.delete_where(_triples(spark, sf_dir), p="segment", graph="customers").select("s", "p", "o")


@query("r04_entity_attributes", f"SELECT p, o FROM {TRIPLES} WHERE s = 'c/7'")
def entity_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.match(_triples(spark, sf_dir), s="c/7").select("p", "o")


@query("r05_neighbourhood", f"SELECT DISTINCT s, p, o FROM {TRIPLES} WHERE s = 'c/7' OR s IN (SELECT o FROM {TRIPLES} WHERE s = 'c/7')")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.neighbourhood(_triples(spark, sf_dir), "c/7", 2).select("s", "p", "o")


@query("r07_annotated", f"SELECT s, o FROM {TRIPLES} WHERE p = 'name' AND length(o) % 10 >= 8")
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _triples(spark, sf_dir).withColumn("confidence", (F.length("o") % 10) / 10)
    return facts.match(marked, p="name").filter("confidence >= 0.8").select("s", "o")


@query("r08_count_by_graph", f"SELECT graph, count(*) AS triples FROM {TRIPLES} WHERE graph <> 'places' GROUP BY 1")
def count_by_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.count_by_graph(facts.clear_graph(_triples(spark, sf_dir), "places"))


@query("r09_time_series", "SELECT ts, value FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.join(F.broadcast(e.agg(F.min("user_id").alias("user_id"))), "user_id").orderBy("ts").select("ts", "value")


@query("r10_schema_triples", """SELECT 'orders' AS s, 'hasColumn' AS p, unnest(['orders.o_orderkey', 'orders.o_orderstatus', 'orders.o_totalprice']) AS o UNION ALL SELECT 'orders', 'rowCount', count(*)::VARCHAR FROM orders
    UNION ALL SELECT 'orders.o_orderstatus', 'nullCount', count(*) FILTER (o_orderstatus = 'F')::VARCHAR FROM orders UNION ALL SELECT 'orders.o_orderstatus', 'distinctCount', count(DISTINCT o_orderstatus) FILTER (o_orderstatus <> 'F')::VARCHAR FROM orders
    UNION ALL SELECT unnest(['orders.o_orderkey', 'orders.o_totalprice']), 'nullCount', '0'""")
def schema_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"), "o_totalprice")
    few = (F.col("p") != "distinctCount") | (F.col("s") == "orders.o_orderstatus")
    return facts.schema_triples(o, "orders").filter(F.col("p").isin("hasColumn", "rowCount", "nullCount", "distinctCount") & few)


@query("r11_refresh", f"SELECT s, p, CASE WHEN p = 'name' AND graph = 'customers' AND substring(s, 3)::BIGINT % 2 = 0 THEN upper(o) || '!' ELSE o END AS o FROM {TRIPLES}")
def refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _triples(spark, sf_dir).select("s", "p", "o", "graph")
    mine = (F.col("graph") == "customers") & (F.substring("s", 3, 20).try_cast("bigint") % 2 == 0)
    new = t.filter(mine).withColumn("o", F.when(F.col("p") == "name", F.concat(F.upper("o"), F.lit("!"))).otherwise(F.col("o")))
    return facts.refresh(t, t.filter(mine), new).select("s", "p", "o")


@query("a10_filter_entities", "SELECT 'c/' || c_custkey AS s FROM customer WHERE c_mktsegment = 'MACHINERY'")
def filter_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.graph_pattern(_triples(spark, sf_dir), [("?s", "type", "Customer"), ("?s", "segment", "MACHINERY")]).select("s")


# -- T: reconciliation


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    actual = o.filter(k % 13 != 0).select("o_orderkey", F.when(k % 3 == 0, F.col("o_totalprice") + 0.4).when(k % 5 == 0, F.col("o_totalprice") + 2).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.lit("now").alias("changed_at"))
    return o, actual


COMPARED = """SELECT o_orderkey, 'o_totalprice' AS field, CASE WHEN o_orderkey % 13 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'passed' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'passed' END AS status FROM orders
    UNION ALL SELECT o_orderkey, 'o_orderstatus', CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 7 = 0 THEN 'failed' ELSE 'passed' END FROM orders"""


@query("t01_compare_scalars", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'warning' ELSE 'passed' END AS status FROM orders")
def compare_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", reconcile.compare(p.cast("string"), F.when(F.col("o_orderkey") % 3 == 0, p + 1).otherwise(p).cast("string")).alias("status"))


@query("t02_coerce_scalar", "SELECT o_orderkey, ['number', 'boolean', 'date', 'timestamp', 'text'][(o_orderkey % 5)::INT + 1] AS kind FROM orders")
def coerce_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.element_at(F.array(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")), F.lit("TRUE"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.col("o_orderpriority")), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", reconcile.coerce_scalar(text)["kind"].alias("kind"))


@query("t03_compare_records", COMPARED)
def compare_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.compare_records(*_both(spark, sf_dir), ["o_orderkey"], 0.5).filter("field != 'changed_at'").select("o_orderkey", "field", "status")


@query("t03_record_status", f"SELECT o_orderkey, max(status = 'failed') AS failed FROM ({COMPARED}) GROUP BY 1")
def record_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reconcile.compare_records(*_both(spark, sf_dir), ["o_orderkey"], 0.5).filter("field != 'changed_at'")
    return reconcile.record_status(c, ["o_orderkey"]).select("o_orderkey", (F.col("status") == "failed").alias("failed"))


@query("t04_table_summary", f"SELECT field, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, array_to_string(list_slice(list_sort(list(o_orderkey::VARCHAR) FILTER (status = 'failed')), 1, 5), ',') AS examples FROM ({COMPARED}) GROUP BY 1")
def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reconcile.compare_records(*_both(spark, sf_dir), ["o_orderkey"], 0.5).filter("field != 'changed_at'")
    return reconcile.table_summary(c, ["o_orderkey"]).select("field", "passed", "failed", F.array_join("examples", ",").alias("examples"))


ACTUAL = "(SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 0.4 WHEN o_orderkey % 5 = 0 THEN o_totalprice + 2 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 13 <> 0)"


@query("t05_compare_aggregates", f"""WITH v AS (SELECT (SELECT count(*) FROM orders) AS n, (SELECT count(*) FROM {ACTUAL}) AS m, (SELECT sum(o_totalprice) FROM orders) AS x, (SELECT sum(p) FROM {ACTUAL}) AS y, (SELECT max(o_totalprice) FROM orders) AS h, (SELECT max(p) FROM {ACTUAL}) AS j)
    SELECT 'n' AS name, n::DOUBLE AS expected, m::DOUBLE AS actual, CASE WHEN abs(n - m) <= 0.5 THEN 'passed' ELSE 'failed' END AS status FROM v UNION ALL SELECT 'total', round(x, 2), round(y, 2), CASE WHEN abs(x - y) <= 0.5 THEN 'passed' ELSE 'failed' END FROM v
    UNION ALL SELECT 'largest', round(h, 2), round(j, 2), CASE WHEN abs(h - j) <= 0.5 THEN 'passed' ELSE 'failed' END FROM v""")
def compare_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, a = (d.agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("largest")) for d in _both(spark, sf_dir))
    c = reconcile.compare_aggregates(e, a, ["n", "total", "largest"], 0.5)
    return c.select("name", *[F.round(F.col(x).cast("double"), 2).alias(x) for x in ("expected", "actual")], "status")


@query("t06_integrity", r"""SELECT count(*) AS rows, sum(('0x' || substring(md5(l_orderkey::VARCHAR || chr(31) || l_linenumber::VARCHAR || chr(31) || l_returnflag || chr(31) || l_linestatus), 1, 15))::BIGINT)::VARCHAR AS checksum FROM lineitem""")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return reconcile.integrity(l, ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]).select("rows", F.col("checksum").cast("string").alias("checksum"))


@query("t06_manifest", "SELECT count(*) AS rows, true AS intact FROM orders")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy whose rows lie in another order against the original's count and checksum."""
    o = table(spark, sf_dir, "orders")
    noted = reconcile.integrity(o).first()
    return reconcile.check_manifest(o.repartition(7, "o_custkey"), noted["rows"], noted["checksum"]).select("rows", "intact")


@query("t07_evidence_rows", f"SELECT 'control' AS kind, o_orderkey::VARCHAR AS key, field, status AS severity FROM ({COMPARED}) UNION ALL SELECT 'exception', o_orderkey::VARCHAR, field, 'error' FROM ({COMPARED}) WHERE status = 'failed'")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reconcile.compare_records(*_both(spark, sf_dir), ["o_orderkey"], 0.5).filter("field != 'changed_at'")
    return reconcile.evidence_rows(c, ["o_orderkey"]).select("kind", "key", "field", "severity")


@query("t08_latest_artifacts", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def latest_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.latest_artifacts(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("t11_rebuild", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view that grew in three steps; replaying the log at once (t08) gives the same."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    keys, order, view = ["user_id", "event_type"], ["ts", "event_id"], None
    for i in range(3):
        step = e.filter(F.col("event_id") % 3 == i)
        view = reconcile.latest_artifacts(step, keys, order) if view is None else reconcile.advance_view(view, step, keys, order)
    return view.select("user_id", "event_type", "event_id")


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k, F.col("user_id").cast("string").alias("object_id"), F.when(k % 3 > 0, F.concat(F.lit("f"), k % 3)).alias("field"), F.col("event_type").alias("kind"))


@query("t09_explain_value", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'object' ELSE 'field' END AS scope FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND event_id % 3 < 2")
def explain_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    return reconcile.explain_value(_artifacts(spark, sf_dir), str(least), "f1").select("event_id", "scope")


@query("t10_artifacts_by_object", "SELECT user_id::VARCHAR AS object_id, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def artifacts_by_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _artifacts(spark, sf_dir).groupBy("object_id", "kind").agg(F.count(F.lit(1)).alias("n"))


# -- U: contracts


def _interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as interfaces, sizes as systems, types as fields."""
    p = table(spark, sf_dir, "part")
    g = p.groupBy(F.col("p_brand").alias("interface"), F.col("p_type").alias("field")).agg(F.min("p_size").alias("m"), F.max("p_partkey").alias("k")).filter("k % 7 != 0")  # some lack a field
    enum = F.when(F.col("k") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("k") % 3 == 1, F.array(F.lit("c"), F.lit("b"), F.lit("a")))
    return g.select("interface", F.concat(F.lit("s"), F.substring("interface", 7, 1)).alias("system"), "field", F.when(F.col("k") % 4 == 0, "string").otherwise("int").alias("type"), (F.col("m") % 2 == 0).alias("required"), enum.alias("enum"))


FIELDS_SQL = "f AS (SELECT p_brand AS interface, 's' || substring(p_brand, 7, 1) AS system, p_type AS field, CASE WHEN max(p_partkey) % 4 = 0 THEN 'string' ELSE 'int' END AS type, min(p_size) % 2 = 0 AS required, max(p_partkey) % 3 AS enum FROM part GROUP BY p_brand, p_type HAVING max(p_partkey) % 7 <> 0)"
PAIRED = "q AS (SELECT DISTINCT a.interface AS producer, b.interface AS consumer FROM f a JOIN f b ON a.field = b.field AND a.interface <> b.interface AND a.system <> b.system)"
ISSUES = """i AS (SELECT * FROM (SELECT coalesce(p.producer, c.producer) AS producer, coalesce(p.consumer, c.consumer) AS consumer, coalesce(p.field, c.field) AS field,
    CASE WHEN p.field IS NULL THEN CASE WHEN c.required THEN 'missing_required' END WHEN c.field IS NULL THEN 'extra_field' WHEN p.type <> c.type THEN 'type_mismatch' WHEN c.enum < 2 AND (p.enum = 2 OR p.enum > c.enum) THEN 'enum_broadening' WHEN c.required AND NOT p.required THEN 'requiredness_weakened' END AS issue
    FROM (SELECT q.*, f.field, f.type, f.required, f.enum FROM q JOIN f ON f.interface = producer) p FULL JOIN (SELECT q.*, f.field, f.type, f.required, f.enum FROM q JOIN f ON f.interface = consumer) c ON p.producer = c.producer AND p.consumer = c.consumer AND p.field = c.field) WHERE issue IS NOT NULL)"""


@query("u01_compatibility", f"WITH {FIELDS_SQL}, {PAIRED}, {ISSUES} SELECT * FROM i")
def compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _interfaces(spark, sf_dir)
    return contracts.compatibility(f, contracts.interface_pairs(f))


@query("u02_matrix", f"WITH {FIELDS_SQL}, {PAIRED}, {ISSUES}, n AS (SELECT producer, consumer, count(*) FILTER (issue IN ('missing_required', 'type_mismatch', 'enum_broadening')) AS b, count(*) FILTER (issue NOT IN ('missing_required', 'type_mismatch', 'enum_broadening')) AS o FROM i GROUP BY 1, 2) SELECT producer, consumer, round(greatest(0, 1 - coalesce(b, 0) * 0.3::DOUBLE - coalesce(o, 0) * 0.1::DOUBLE), 6) AS score, CASE WHEN b > 0 THEN 'incompatible' WHEN o > 0 THEN 'degraded' ELSE 'compatible' END AS state FROM q LEFT JOIN n USING (producer, consumer)")
def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.matrix(_interfaces(spark, sf_dir))


@query("u03_dependency_graph", f"WITH {FIELDS_SQL}, {PAIRED} SELECT DISTINCT system AS src, interface AS dst, 'exposes' AS kind FROM f UNION ALL SELECT DISTINCT 'k' || interface, interface, 'governs' FROM f UNION ALL SELECT producer, consumer, 'integrates' FROM q")
def dependency_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _interfaces(spark, sf_dir)
    return contracts.dependency_graph(f, f.select("interface").distinct().withColumn("contract", F.concat(F.lit("k"), "interface")))


@query("u04_transformable", f"WITH {FIELDS_SQL}, {PAIRED}, {ISSUES} SELECT producer, consumer, field, starts_with(field, 'S') AS covered FROM i WHERE issue = 'missing_required'")
def transformable(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _interfaces(spark, sf_dir)
    issues = contracts.compatibility(f, contracts.interface_pairs(f))
    mapping = issues.filter(F.col("field").startswith("S")).select("producer", "consumer", F.col("field").alias("target"))
    return contracts.transformable(issues, mapping).select("producer", "consumer", "field", "covered")


@query("u05_unit_compatibility", "SELECT p_partkey::VARCHAR AS \"column\", CASE p_partkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'convertible' WHEN 2 THEN 'over_budget' ELSE 'incompatible' END AS state FROM part")
def unit_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("column"), F.lit("m").alias("from_unit"), F.element_at(F.array(*map(F.lit, ["m", "ft", "mi", "kg"])), (k + 1).cast("int")).alias("to_unit"), F.lit(0.01).alias("budget"))
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit("m").alias("from_unit"), F.lit(u).alias("to_unit"), F.lit(e).alias("error")) for u, e in (("ft", 0.001), ("mi", 0.5))])))
    return contracts.unit_compatibility(pairs, rules).select("column", "state")


@query("u06_binding_coverage", "SELECT p_partkey::VARCHAR AS term, CASE p_partkey % 4 WHEN 0 THEN 'covered' WHEN 1 THEN 'stale' WHEN 2 THEN 'unmapped' ELSE 'missing' END AS state FROM part")
def binding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    term = k.cast("string").alias("term")
    bindings = p.filter(k % 4 < 3).select(term, F.when(k % 4 < 2, F.concat(F.lit("col"), k % 4)).alias("column"), F.lit(True).alias("active"))
    return contracts.binding_coverage(p.select(term), bindings, spark.range(1).select(F.lit("col0").alias("column")))


@query("u07_validation_history", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events QUALIFY n <= 3")
def validation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.validation_history(table(spark, sf_dir, "events"), "user_id", "ts", F.col("value") > 20, 3, "event_id").select("user_id", "event_id", "n")
