"""What the third round's reviewer found, in small."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.operators import golden, match, profile, sketches, vectors
from tessera.sources import readers


def test_sniff_after_a_header_alone(spark, tmp_path):
    """A task without rows writes its file's header."""
    (tmp_path / "part-0.csv").write_text("key|name\n")
    (tmp_path / "part-1.csv").write_text("key|name\n1|a\n2|b\n")
    assert readers.sniff_csv(spark, str(tmp_path)) == {"delimiter": "|", "has_header": True, "fields": 2, "encoding": "UTF-8"}
    (tmp_path / "part-1.csv").write_text("")
    assert readers.sniff_csv(spark, str(tmp_path))["fields"] == 2


def test_several_surest(spark):
    rows = [("e", "f", "b", 0.9, 1), ("e", "f", "a", 0.9, 2), ("e", "f", "a", 0.1, 0), ("e", "g", "x", None, 1)]
    df = spark.createDataFrame(rows, "entity string, field string, value string, confidence double, n int")
    assert {r.field: r.strategy for r in golden.suggest_strategy(df).collect()} == {"f": "primary", "g": "first"}


def test_first_of_the_surest(spark):
    rows = [("e", "f", "b", 0.9, 1), ("e", "f", "a", 0.9, 2), ("e", "f", "c", 0.1, 0)]
    df = spark.createDataFrame(rows, "entity string, field string, value string, confidence double, n int")
    assert golden.resolve_conflicts(df, "coalesce", first=["n"]).first()["value"] == "b"
    assert golden.resolve_conflicts(df, "coalesce").first()["value"] == "a"


@pytest.mark.parametrize("few", [1, 5, 25])
def test_few_values_in_very_many(spark, few):
    """Hardly any of the few values are in the sketch of the many."""
    many = spark.range(120_000).select("id")
    tables = {"a": (many, ["id"]), **{f"b{i}": (spark.range(i * few, (i + 1) * few).select(F.col("id").alias("k")), ["k"]) for i in range(8)}}
    got = {(r.left_column, r.right_column) for r in sketches.sketched_overlap(tables, 0.6).collect()}
    exact = match.value_overlap(tables).filter("common >= 0.6 * least(left_distinct, right_distinct)").collect()
    assert got == {(r.left_column, r.right_column) for r in exact} and len(got) == 8


def test_dedup_without_chains(spark):
    """1 is near 2 and 2 near 3, but 1 not near 3."""
    at = [math.radians(d) for d in (0, 15, 30, 90)]
    df = spark.createDataFrame([(i + 1, [math.cos(a), math.sin(a)]) for i, a in enumerate(at)], "k long, v array<double>")
    got = {r.k: (r["class"], r.links, r.kept) for r in vectors.semantic_dedup(df, "k", "v", 0.95, chains=False).collect()}
    assert got == {1: (1, 1, True), 2: (1, 2, False), 3: (2, 1, False), 4: (4, 0, True)}
    assert {r.k: (r.links, r.least_link) for r in vectors.link_counts(df, "k", "v", 0.95).collect()} == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (0, None)}


def test_top_k_by_brute_force(spark, monkeypatch):
    """Copies tie by key; vectors without a cosine take no part; ids are texts, too."""
    monkeypatch.setattr(match, "BLOCK", 100)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 10)).astype(np.float32)
    x[300:] = x[:100] * 2
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    c = np.round(unit @ unit.T, 10)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 10), (1002, [float("nan")] * 10), (1003, [1.0]), (1005, [None] * 10)]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    got = {(r.query, r.rank): r.k for r in match.vector_top_k(df.filter("k % 5 = 0"), df, "k", "v", 4, block=30).collect()}
    assert got == {(q, n + 1): i for q in range(0, 400, 5) for n, i in enumerate([int(j) for j in np.lexsort((np.arange(400), -c[q])) if j != q][:4])}
    named = df.withColumn("k", F.concat(F.lit("n"), "k"))
    found = {(r.query, r.k) for r in match.vector_top_k(named.filter("k LIKE '%7'"), named, "k", "v", 2**31 - 1, 0.5).collect()}
    assert found == {(f"n{q}", f"n{j}") for q in range(7, 400, 10) for j in range(400) if j != q and c[q, j] >= 0.5}


def test_few_pairs_compared_one_by_one(spark):
    """Vectors whose first components say little: a product of blocks in single precision leaves hardly more pairs than links."""
    x = np.random.default_rng(6).normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    pairs, compared = vectors.compared_share(vectors.similarity_links(df, "k", "v", 0.7)[1]).first()
    assert compared < pairs / 200


def test_rule_over_many_small_groups(spark):
    """Null keys are a group, numbers keep all digits, a group may span batches; as with a batch a group."""
    big = 2**60 + 1
    rows = [(big + i // 3, ("a", None)[i % 2], f"v{i}", None if i % 7 == 0 else big + i) for i in range(500)] + [(None, None, "x", 1), (None, None, "y", 2)]
    df = spark.createDataFrame(rows, "k long, field string, value string, n long")
    rule = lambda p: f"{len(p)} {min(p['value'])} {p['n'].dropna().max():.0f} {p.columns.tolist()}"
    want = sorted(map(str, df.groupBy("k", "field").applyInPandas(lambda key, p: p.head(1)[["k", "field"]].assign(value=rule(p)), "k long, field string, value string").select("value").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = models.resolve_by(df, ["k", "field"], rule).collect()
        one = models.resolve_by(df, ["k", "field"], lambda p: p["n"].dtype.name).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(str(r) for r in spark.createDataFrame(got).select("value").collect()) == want
    assert {(r.k, r.field) for r in got} == {(r[0], r[1]) for r in rows} and {r.value for r in one} == {"int64", "float64"}


def test_embedding_splits_a_text_once(spark):
    plan = models.embed(spark.range(3).select(F.concat(F.lit("a b "), "id").alias("s")), "s", 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_distinct_values_by_column(spark):
    """No row is copied for each column, nor are values ranked for medians that nobody wants."""
    df = spark.createDataFrame([(i % 7, f"n{i % 5}" if i % 3 else " NA ", [float("nan"), 0.0, -0.0, None][i % 4]) for i in range(60)], "a int, b string, c double")
    got = profile.profile(df, exact=True, medians=False)
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.column: (r.distinct_values, r.nulls, r.median) for r in got.collect()} == {"a": (7, 0, None), "b": (5, 20, None), "c": (2, 15, None)}
    assert {r.column: r.cardinality for r in got.collect()} == {"a": 7 / 60, "b": 5 / 40, "c": 2 / 45}
    assert {r.column: r.median for r in profile.profile(df.limit(0), exact=True).collect()} == {"a": None, "b": None, "c": None}


def test_cycles_by_numbers(spark, monkeypatch):
    """Lines lead into rings and out of them; a first numbering that gives two nodes the same is not taken. What rounds store
    stays small."""
    from pathlib import Path

    from tessera.operators import lineage, shared

    real = lineage._numbered
    monkeypatch.setattr(lineage, "_numbered", lambda c, seed: F.length(c).cast("bigint") if seed == 0 else real(c, seed))
    size = lambda: sum(f.stat().st_size for f in Path(shared.checkpoint_folder(spark).removeprefix("file:")).rglob("*") if f.is_file())
    i, before = spark.range(12_000).withColumn("r", F.col("id") - F.col("id") % 6), size()
    ring = i.select(F.concat(F.lit("o"), "id").alias("src"), F.concat(F.lit("o"), F.col("r") + (F.col("id") + 1) % 6).alias("dst"))
    line = i.select(F.concat(F.lit("c"), "r").alias("src"), F.concat(F.lit("o"), "id").alias("dst"))
    more = spark.createDataFrame([("a", "c0"), ("o0", "z"), ("z", "y"), ("s", "s"), ("o0", "b"), ("b", "o0"), (None, "o1"), ("o1", None)], "src string, dst string")
    got = {(r.node, r.length) for r in lineage.cycles(ring.unionByName(line).unionByName(line).unionByName(more)).collect()}
    assert got == {(f"o{n}", 2 if n == 0 else 6) for n in range(12_000)} | {("s", 1), ("b", 2)}
    assert size() - before < 300 * 36_000


def test_log_in_arrow_batches(spark, tmp_path):
    """Equal keys are in one partition, also those of batches that are split; nulls count as empty keys."""
    import zlib

    from pyspark.sql.datasource import DataSourceArrowWriter

    from tessera.sources import change_log

    i, at = spark.range(30_000, numPartitions=2), str(tmp_path / "log")
    change_log.append_log(i.select(F.when(F.col("id") % 10 != 0, F.concat(F.lit("ké"), F.col("id") % 100)).alias("key"), F.col("id").cast("string").alias("value")), at, partitions=3)
    rows = change_log.replay(spark, at).collect()
    assert sorted(int(r.value) for r in rows) == list(range(30_000)) and len({(r.partition, r.offset) for r in rows}) == 30_000
    assert all(r.partition == zlib.crc32((r.key or "").encode()) % 3 for r in rows) and sum(r.key is None for r in rows) == 3_000
    assert isinstance(change_log.LogWriter({}), DataSourceArrowWriter)


def test_state_in_several_tasks_a_bucket(spark, tmp_path, monkeypatch):
    from tessera.streaming import buckets

    monkeypatch.setattr(buckets, "ROWS_A_TASK", 100, raising=False)
    state = buckets.BucketedState(spark, str(tmp_path / "state"), ["id"], ["id", "v"], buckets=2)
    rows = lambda v, op, n, ts: spark.range(n).select("id", F.lit(v).alias("v"), F.lit(op).alias("operation"), F.lit(ts).alias("ts_ms"))
    state.apply(rows("a", "create", 2_000, 1), ["ts_ms"], 0)
    state.apply(rows("b", "update", 700, 2).unionByName(rows("b", "delete", 100, 3)), ["ts_ms"], 1)
    assert len(list((tmp_path / "state/data/version=1").rglob("part-*.parquet"))) > 4
    assert sorted((r.id, r.v) for r in state.frame().collect()) == [(n, "b" if n < 700 else "a") for n in range(100, 2_000)]
