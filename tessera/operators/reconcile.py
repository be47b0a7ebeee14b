"""Comparison of expected and actual data, integrity, and evidence read models."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = {"passed": 0, "not_run": 1, "warning": 2, "failed": 3}


def coerce_scalar(c: Column) -> Column:
    """(kind, number, moment, text) of a text: the first of number, boolean, timestamp, date, text that it is."""
    x = F.trim(c).try_cast("double")
    flag = F.lower(F.trim(c)).isin("true", "false")
    moment = F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    kind = F.when(c.isNull(), "null").when(x.isNotNull(), "number").when(flag, "boolean").when(moment.isNotNull() & F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(moment.isNotNull(), "timestamp").otherwise("text")
    return F.struct(kind.alias("kind"), x.alias("number"), moment.alias("moment"), c.alias("text"))


def compare(expected: Column, actual: Column, tolerance: float | None = None) -> Column:
    """passed, warning, failed or not_run for two texts. Numbers: within the tolerance or failed; without one unequal numbers
    are a warning. Others must be equal. Kinds that differ fail; nothing expected is not run; nothing actual fails."""
    e, a = F.trim(expected).try_cast("double"), F.trim(actual).try_cast("double")
    numeric = F.when(F.abs(e - a) <= tolerance, "passed").otherwise("failed") if tolerance is not None else F.when(e == a, "passed").otherwise("warning")
    lowered = F.lower(F.trim(expected)).isin("true", "false") & F.lower(F.trim(actual)).isin("true", "false")
    return (
        F.when(expected.isNull(), "not_run").when(actual.isNull(), "failed").when(e.isNotNull() & a.isNotNull(), numeric).when(e.isNotNull() != a.isNotNull(), "failed")
        .when(lowered, F.when(F.lower(F.trim(expected)) == F.lower(F.trim(actual)), "passed").otherwise("failed")).when(expected == actual, "passed").otherwise("failed")
    )


def rank(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[status]


def worst(status: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (v, k)])
    return names[F.max(rank(status))]


def _long(df: DataFrame, keys: Sequence[str], fields: Sequence[str], to: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(to)) for f in fields])
    return df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")


def compare_records(expected: DataFrame, actual: DataFrame, keys: Sequence[str], tolerance: float | None = None) -> DataFrame:
    """(keys, field, expected, actual, status) for each field of each key: one full outer join of whole rows. A row or field
    that is missing fails; what is only in ``actual`` is unexpected."""
    fe, fa = [c for c in expected.columns if c not in keys], [c for c in actual.columns if c not in keys]
    e = expected.select(*keys, F.struct(*fe).alias("_e"))
    a = actual.select(*keys, F.struct(*fa).alias("_a"))
    j = e.join(a, list(keys), "full")
    rows = []
    for f in dict.fromkeys([*fe, *fa]):
        x = F.col(f"_e.{f}").cast("string") if f in fe else F.lit(None).cast("string")
        y = F.col(f"_a.{f}").cast("string") if f in fa else F.lit(None).cast("string")
        status = F.when(F.col("_e").isNull(), "unexpected").when(F.col("_a").isNull(), "failed").otherwise(compare(x, y, tolerance) if f in fe else F.lit("unexpected"))
        rows.append(F.struct(F.lit(f).alias("field"), x.alias("expected"), y.alias("actual"), status.alias("status")))
    return j.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def record_status(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The worst status of each key; unexpected fields don't count."""
    return compared.groupBy(*keys).agg(F.coalesce(worst(F.when(F.col("status") != "unexpected", F.col("status"))), F.lit("unexpected")).alias("status"))


def table_summary(compared: DataFrame, keys: Sequence[str], examples: int = 5) -> DataFrame:
    """(field, passed, warning, failed, unexpected, examples): counts, and the least keys that failed. Examples are the
    report's own limit: each task keeps its few before the shuffle."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = compared.groupBy("field").agg(n("passed"), n("warning"), n("failed"), n("unexpected"))
    from .relational import top_k_per_group

    bad = top_k_per_group(compared.filter("status = 'failed'").select("field", F.concat_ws(",", *keys).alias("k")), ["field"], [F.col("k")], examples)
    return counts.join(bad.groupBy("field").agg(F.array_sort(F.collect_list("k")).alias("examples")), "field", "left")


def compare_aggregates(expected: DataFrame, actual: DataFrame, names: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """(name, expected, actual, status) of two one-row tables."""
    e = expected.select(*[F.col(n).cast("string").alias(f"e_{n}") for n in names])
    a = actual.select(*[F.col(n).cast("string").alias(f"a_{n}") for n in names])
    rows = [F.struct(F.lit(n).alias("name"), F.col(f"e_{n}").alias("expected"), F.col(f"a_{n}").alias("actual"), compare(F.col(f"e_{n}"), F.col(f"a_{n}"), tolerance).alias("status")) for n in names]
    return e.join(F.broadcast(a)).select(F.inline(F.array(*rows)))


def integrity(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and a checksum that no order of the rows changes: the sum of 60 bits of each row's MD5. Unlike an exclusive
    or, equal rows don't cancel. The bits are summed in three parts of 20, which are long integers up to 8 trillion rows."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns or df.columns])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
    parts = df.select(bits.alias("_b")).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.shiftright("_b", 20 * i).bitwiseAND((1 << 20) - 1)).alias(f"_{i}") for i in range(3)])
    whole = [F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("decimal(20,0)") * F.lit(1 << 20 * i).cast("decimal(13,0)") for i in range(3)]
    return parts.select("rows", (whole[0] + whole[1] + whole[2]).cast("decimal(38,0)").alias("checksum"))


def check_manifest(df: DataFrame, rows: int, checksum: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """:func:`integrity` with whether it is as a manifest says."""
    got = integrity(df, columns)
    ok = F.col("rows") == rows if checksum is None else (F.col("rows") == rows) & (F.col("checksum") == checksum)
    return got.withColumn("intact", ok)


def file_checksums(spark, path: str) -> DataFrame:  # noqa: ANN001
    """(path, length, sha256) of each file under ``path``. Spark reads no empty files: these come from its list of files, which
    the driver holds anyway."""
    files = spark.read.format("binaryFile").load(path)
    listed = [(re.sub("^file:/+", "file:/", unquote(f)),) for f in files.inputFiles()]
    read = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    empty = spark.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti")
    return read.unionByName(empty.select("path", F.lit(0).cast("bigint").alias("length"), F.sha2(F.lit(b""), 256).alias("sha256")))


def evidence_rows(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(kind, key, field, severity, category): a control for each comparison, and an exception for each that failed or warned."""
    key = F.concat_ws(":", *keys)
    severity = F.when(F.col("status") == "failed", "error").when(F.col("status") == "warning", "warning")
    made = F.array_compact(F.array(
        F.struct(F.lit("control").alias("kind"), F.col("status").alias("severity"), F.lit("verification").alias("category")),
        F.when(severity.isNotNull(), F.struct(F.lit("exception").alias("kind"), severity.alias("severity"), F.lit("verification_delta").alias("category"))),
    ))
    return compared.select(key.alias("key"), "field", F.explode(made).alias("m")).select("m.kind", "key", "field", "m.severity", "m.category")


def latest_artifacts(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last event of each artifact: the read model that a replay of the whole log gives."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("r")).select("r.*")


def advance_view(view: DataFrame, events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A read model with more of the log: what :func:`latest_artifacts` gives for the log up to there, in any cut."""
    return latest_artifacts(view.unionByName(events), keys, order)


def explain_value(artifacts: DataFrame, object_id: str, field: str) -> DataFrame:
    """Artifacts of (object, field), and those of the object as a whole (field null)."""
    return artifacts.filter((F.col("object_id") == object_id) & (F.col("field").isNull() | (F.col("field") == field))).withColumn("scope", F.when(F.col("field").isNull(), "object").otherwise("field"))
