"""Change streams and streaming operators. All take and give DataFrames, streaming or not, unless they say otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import golden, relational, rows
from ..sources import writers
from .buckets import BUCKETS, KEEP, BucketedState

OPERATIONS = {"c": "create", "u": "update", "d": "delete", "r": "read"}


def parse_cdc(stream: DataFrame, fields: str, column: str = "value") -> DataFrame:
    """operation, before, after, ts_ms, and the fields of after (of before for a delete) at the top; ``fields`` is a DDL."""
    shape = f"before struct<{fields}>, after struct<{fields}>, op string, ts_ms bigint"
    e = stream.select(F.from_json(column, shape).alias("e"))
    names = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])
    e = e.select(names[F.col("e.op")].alias("operation"), "e.before", "e.after", "e.ts_ms").withColumn("_row", F.coalesce("after", "before"))
    return e.select("operation", "before", "after", "ts_ms", "_row.*")


def changed_fields(changes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``changed``: names whose values differ between before and after."""
    diff = [F.when(~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}")), F.lit(f)) for f in fields]
    return changes.withColumn("changed", F.array_compact(F.array(*diff)))


def latest_changes(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), F.struct(*order)).alias("r")).select("r.*")


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The target after a batch of changes: the last change of a key wins, deleted keys go."""
    last = latest_changes(changes, keys, order)
    rest = target.join(last.select(*keys), list(keys), "left_anti")
    return rest.select(*fields).unionByName(last.filter("operation != 'delete'").select(*fields))


def apply_cdc_stream(changes: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], checkpoint: str, buckets: int = BUCKETS, keep: int = KEEP):  # noqa: ANN201
    """Keeps the latest state at ``path`` (:class:`.buckets.BucketedState`): each batch rewrites the buckets of its keys and
    is a version; the last ``keep`` versions stay. A batch that runs again after a failure gives the same version."""
    state = None

    def merge(batch: DataFrame, epoch: int) -> None:
        nonlocal state
        state = state or BucketedState(batch.sparkSession, path, keys, fields, buckets, keep)
        state.apply(batch, order, epoch)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def with_watermark(stream: DataFrame, column: str, delay: str = "10 minutes", processing_time: bool = False) -> DataFrame:
    """Event time, or the time of processing; rows later than ``delay`` may be dropped by what follows."""
    if processing_time:
        stream = stream.withColumn(column, F.current_timestamp())
    return stream.withWatermark(column, delay)


def ttl_dedup(stream: DataFrame, keys: Sequence[str], time: str, ttl: str) -> DataFrame:
    """Drops a key that was seen within ``ttl``; older keys are forgotten."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(list(keys))


def windowed_dedup(df: DataFrame, keys: Sequence[str], time: str, window: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in each window; on a stream give the time a watermark first."""
    g = df.groupBy(F.window(time, window).alias("_w"), *keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return g.select(F.col("_w.start").alias("window_start"), "_r.*")


def keyed_dedup(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keeps the first row of each key; on a stream the state holds all keys (:func:`ttl_dedup` bounds it)."""
    return stream.dropDuplicates(list(keys))


def incremental_aggregate(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, sum, avg, min and max per key; on a stream use output mode ``update``."""
    v = F.col(value)
    return stream.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("average"), F.min(v).alias("smallest"), F.max(v).alias("largest"))


class _Resolver(StatefulProcessor):
    """Buffers an entity's values; emits when enough different sources have come, or when the time is over."""

    def __init__(self, min_sources: int, max_wait_ms: int):
        self.min_sources, self.max_wait_ms = min_sources, max_wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getListState("values", "field string, value string, source string")

    def _emit(self, key: tuple, why: str) -> Iterator[pd.DataFrame]:
        got = list(self.values.get())
        self.values.clear()
        if not got:
            return
        df = pd.DataFrame(got, columns=["field", "value", "source"])
        out = []
        for field, part in df.groupby("field", sort=True):
            counts = part["value"].value_counts()
            top = sorted(counts[counts == counts.max()].index)[0]
            confidence = float(counts.max() / counts.sum())
            severity = None if len(counts) == 1 else "High" if confidence <= 0.5 else "Medium" if confidence < 0.7 else "Low"
            out.append((key[0], field, top, confidence, int(len(counts)), severity, why))
        yield pd.DataFrame(out, columns=["entity", "field", "value", "confidence", "candidates", "severity", "reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        had = self.values.exists()
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                self.values.appendValue((r.field, r.value, r.source))
        sources = {v[2] for v in self.values.get()}
        if len(sources) >= self.min_sources:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            yield from self._emit(key, "sources")
        elif not had:
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.max_wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._emit(key, "timeout")

    def close(self) -> None:
        pass


RESOLVED = "entity string, field string, value string, confidence double, candidates int, severity string, reason string"


def resolve_stream(stream: DataFrame, min_sources: int = 2, max_wait_ms: int = 5000, time: str = "ts") -> DataFrame:
    """(entity, field, value, source, ts) resolved by frequency, an entity at a time. Needs the RocksDB state store."""
    return stream.withWatermark(time, f"{max_wait_ms} milliseconds").groupBy("entity").transformWithStateInPandas(_Resolver(min_sources, max_wait_ms), RESOLVED, "Append", "EventTime")


def resolve_batch(df: DataFrame, min_sources: int = 2) -> DataFrame:
    """The same over a table: entities with enough sources, by frequency."""
    enough = df.groupBy("entity").agg(F.count_distinct("source").alias("n")).filter(F.col("n") >= min_sources).select("entity")
    return golden.frequency_vote(df.join(enough, "entity", "left_semi")).select("entity", "field", "value", "confidence", F.col("candidates").cast("int").alias("candidates"), "severity")


def conflicts(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("severity").isNotNull())


def conflict_counts(resolved: DataFrame) -> DataFrame:
    return conflicts(resolved).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def critical_conflicts(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("severity").isin("High", "Critical"))


def tag_fields(stream: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    """``_tags``: the kinds of the stream's fields, the same for all its rows."""
    return stream.withColumn("_tags", F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind")) for f, k in tags.items() if f in stream.columns]))


def route_stream(stream: DataFrame, routes: Sequence[Mapping], sinks: Mapping[str, Callable[[DataFrame, int], None]], error: Column, letters: Callable[[DataFrame, int], None], checkpoint: str, row_number: Column | None = None):  # noqa: ANN201
    """Routes each batch to its sinks; rows with an ``error`` go to the dead letters. Sinks should be idempotent by epoch."""

    def handle(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            letters(writers.dead_letter(batch, error, row_number if row_number is not None else F.monotonically_increasing_id()), epoch)
            routed = rows.route(writers.passed(batch, error), routes)
            for name, sink in sinks.items():
                sink(routed.filter(F.col("route") == name), epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def new_events(batch: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """One event of each key that ``known`` lacks."""
    return batch.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def idempotent_append(events: DataFrame, key: str, path: str, checkpoint: str):  # noqa: ANN201
    """Appends events whose key the table at ``path`` lacks, so that a retry adds nothing, that of the first batch included."""

    def append(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(batch.schema).parquet(path) if writers.path_exists(spark, path) else batch.filter("false")
        new_events(batch, key, known).select(*batch.columns).write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def stream_statistics(query) -> dict:  # noqa: ANN001
    """Of a query's last batch: rows, rate, duration; of all of its batches: rows that came later than the watermark
    (``late``); ``lag_ms``: how far the newest event lies behind the batch's start, where the query has an event time."""
    p = query.lastProgress
    if p is None:
        return {}
    late = sum(s.get("numRowsDroppedByWatermark", 0) for r in query.recentProgress for s in r["stateOperators"])
    newest = next((r["eventTime"]["max"] for r in reversed(query.recentProgress) if "max" in (r["eventTime"] or {})), None)
    lag = None if newest is None else (pd.Timestamp(p["timestamp"]) - pd.Timestamp(newest)) / pd.Timedelta(milliseconds=1)
    return {"rows": p["numInputRows"], "rows_per_second": p["processedRowsPerSecond"], "batch": p["batchId"], "ms": p["durationMs"].get("triggerExecution"), "late": late, "lag_ms": lag}


def governed_pipeline(df: DataFrame, keys: Sequence[str], time: str, ttl: str, rules: Sequence[Mapping]) -> DataFrame:
    """Standardise, drop repeats, score quality and completeness: the whole dataflow, batch or stream. A batch keeps of a key
    the first row by time, and of equal times by its other columns."""
    from ..operators import quality

    clean = rows.standardize(df)
    once = ttl_dedup(clean, keys, time, ttl) if df.isStreaming else relational.dedup(clean, keys, [time, *[c for c in df.columns if c != time and c not in keys]], keep="first")
    marked = quality.with_violations(once, rules)
    return marked.withColumns({"quality": quality.quality_score(F.col("_violations")), "completeness": quality.completeness_ratio(df, df.columns)})


def governed_outcome(df: DataFrame, keys: Sequence[str], time: str, rules: Sequence[Mapping], job: str = "governed") -> dict[str, DataFrame]:
    """:func:`governed_pipeline` of a table with its last two steps: ``rows``; ``profile`` of the rows that are left, a row a
    column; ``lineage``: for each key the rows that came and the rows that were dropped for it (key, job, read, dropped)."""
    from ..operators import profile

    left = governed_pipeline(df, keys, time, "0 seconds", rules)
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("key")
    lineage = rows.standardize(df).groupBy(key).agg(F.count(F.lit(1)).alias("read")).select("key", F.lit(job).alias("job"), "read", (F.col("read") - 1).alias("dropped"))
    return {"rows": left, "profile": profile.profile(left, df.columns), "lineage": lineage}


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
