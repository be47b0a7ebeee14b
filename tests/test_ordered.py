"""Order within hot groups: sweeps, numbers and chains against plain windows and hashes by hand."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import bitemporal, ordered, relational


@pytest.fixture(scope="module")
def hot(spark):
    """9,000 rows, a third of them of one key, nulls and ties."""
    k = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.col("id") % 50)
    t = F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)))
    df = spark.range(9000).select("id", k.alias("k"), t.alias("t")).persist()
    yield df
    df.unpersist()


def rows(df):
    return sorted(map(str, df.collect()))


def test_order_in_ranges(spark, hot):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = hot.withColumns({"n": F.row_number().over(w).cast("bigint") - 1, "p": F.lag("id").over(w)})
    got = ordered.numbered(hot, ["k"], ["t", "id"], "n")
    assert rows(got) == rows(want.drop("p"))
    got = ordered.with_previous(hot, ["k"], ["t", "id"], ["id"])
    assert rows(got.select("id", "k", "t", F.col("_prev.id").alias("p"))) == rows(want.drop("n"))
    some = hot.withColumn("v", F.when(F.col("id") % 5 == 0, F.col("id")))
    last = F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    assert rows(ordered.with_last(some, ["k"], ["t", "id"], "v")) == rows(some.withColumn("_last", last))


def test_hot_group_is_dealt_out(spark, hot):
    parts = ordered.ranged(hot, ["k"], ["t", "id"]).filter("k = 7").groupBy("_part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 0.8 * hot.filter("k = 7").count()


def test_as_of_sweep(spark, hot):
    versions = relational.close_versions(hot.filter("id % 2 = 0 AND t IS NOT NULL").select("k", F.col("id").alias("version"), F.col("t").alias("tx_from")), ["k"], tie=["version"])
    versions = versions.withColumn("tx_to", F.when((F.col("version") % 10 == 0) & F.coalesce(F.col("tx_to") > F.col("tx_from"), F.lit(True)), F.col("tx_from") + 1).otherwise(F.col("tx_to")))  # gaps
    asks = hot.filter("id % 2 = 1")
    got = relational.as_of_join(asks, versions, ["k"], "t").select("id", "version", "tx_from")
    once = versions.filter("tx_to IS NULL OR tx_to > tx_from")
    want = relational.as_of_join(asks, once, ["k"], "t", disjoint=False).select("id", "version", "tx_from")
    assert rows(got) == rows(want) and got.filter("version IS NULL").count() > 0
    assert relational.as_of_join(asks.limit(0), versions, ["k"], "t").count() == 0
    assert relational.as_of_join(asks, versions.limit(0), ["k"], "t").filter("version IS NOT NULL").count() == 0


def test_long_chain(spark):
    """One chain of 4,000 entries over several ranges, with a fault of each kind at known places."""
    prev, entries = "0" * 64, []
    for i in range(4000):
        value, t = f"v{i}", i
        h = hashlib.sha256(f"{prev}|{i}|{value}".encode()).hexdigest()
        entries.append(("c", i, t, value, prev, h))
        prev = h
    bad = [list(e) for e in entries]
    bad[1000][3] = "forged"
    bad[2000][4] = "f" * 64
    bad[2000][5] = hashlib.sha256(f"{'f' * 64}|2000|v2000".encode()).hexdigest()
    bad[3000][2] = 5
    bad.append(list(bad[3500]))
    df = spark.createDataFrame([tuple(b) for b in bad], "chain string, seq long, t long, value string, prev_hash string, hash string")
    found = {(r.seq, r.problem) for r in bitemporal.verify_chain(df, ["chain"], "seq", "t", ["value"]).collect()}
    assert found == {(1000, "wrong_hash"), (2000, "broken_link"), (2001, "broken_link"), (3000, "time_regression"), (3500, "duplicate"), (3500, "broken_link")}
    sound = spark.createDataFrame(entries, df.schema)
    assert bitemporal.verify_chain(sound, ["chain"], "seq", "t", ["value"]).count() == 0


def merkle(leaves):
    level = list(leaves)
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + (level[i + 1] if i + 1 < len(level) else level[i])).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0]


def test_merkle_roots(spark):
    sizes = {"one": 1, "two": 2, "odd": 5, "round": 256, "more": 257, "long": 1025}
    data = [(b, i, f"{b}{i}") for b, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "b string, i long, v string")
    got = {r.batch: (r.root, r.leaves) for r in bitemporal.merkle_roots(df, "b", "i", F.sha2("v", 256)).collect()}
    want = {b: (merkle([hashlib.sha256(f"{b}{i}".encode()).hexdigest() for i in range(n)]), n) for b, n in sizes.items()}
    assert got == want
    assert bitemporal.merkle_roots(df.limit(0), "b", "i", F.sha2("v", 256)).count() == 0
