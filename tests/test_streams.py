"""Change logs with offsets, and states in buckets: restarts, replays, late starts."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import change_log
from tessera.streaming import cdc
from tessera.streaming.buckets import BucketedState


def messages(spark, ids, word):
    return spark.createDataFrame([(str(i), f"{word}{i}") for i in ids], "key string, value string")


def drain(stream, check, out):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)
    return sorted(r.value for r in stream.sparkSession.read.parquet(out).collect())


def test_log_replay(spark, tmp_path):
    """Start, stop and go on; replay from a stored position; start late; offsets are consecutive in each partition."""
    at = str(tmp_path / "log")
    change_log.append_log(messages(spark, range(50), "a"), at)
    stream = change_log.read_log_stream(spark, at)
    assert drain(stream, str(tmp_path / "c1"), str(tmp_path / "o1")) == sorted(f"a{i}" for i in range(50))
    stored = change_log.log_position(at)
    change_log.append_log(messages(spark, range(30), "b"), at)
    change_log.append_log(messages(spark, range(5), "c"), at)
    late = [*[f"b{i}" for i in range(30)], *[f"c{i}" for i in range(5)]]
    again = drain(change_log.read_log_stream(spark, at), str(tmp_path / "c1"), str(tmp_path / "o1"))  # goes on where it stopped
    assert again == sorted([f"a{i}" for i in range(50)] + late)
    assert drain(change_log.read_log_stream(spark, at, stored), str(tmp_path / "c2"), str(tmp_path / "o2")) == sorted(late)
    assert sorted(r.value for r in change_log.replay(spark, at, stored).collect()) == sorted(late)
    assert sorted(r.value for r in change_log.replay(spark, at, "earliest", stored).collect()) == sorted(f"a{i}" for i in range(50))
    rows = change_log.replay(spark, at).collect()
    by = {}
    for r in rows:
        by.setdefault(r.partition, []).append(r.offset)
    assert all(sorted(o) == list(range(len(o))) for o in by.values()) and sum(map(len, by.values())) == 85
    assert len({(r.key, r.partition) for r in rows}) == 50  # a key stays in its partition
    started = drain(change_log.read_log_stream(spark, at, "latest"), str(tmp_path / "c3"), str(tmp_path / "o3"))
    change_log.append_log(messages(spark, [1], "d"), at)
    assert started == [] and drain(change_log.read_log_stream(spark, at, "latest"), str(tmp_path / "c3"), str(tmp_path / "o3")) == ["d1"]


def test_log_stream_writer(spark, tmp_path):
    """A stream into the log; a batch whose commit is lost by the query but not by the log is not written twice."""
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    change_log.append_log(messages(spark, range(20), "x"), first)
    write = lambda check: change_log.write_log_stream(change_log.read_log_stream(spark, first), second, check, "copy").trigger(availableNow=True).start().awaitTermination(120)
    write(str(tmp_path / "c1"))
    write(str(tmp_path / "c2"))  # a fresh checkpoint: batch 0 once more
    assert sorted(r.value for r in change_log.replay(spark, second).collect()) == sorted(f"x{i}" for i in range(20))
    log = change_log.Folder(second)
    files = [f.base_name for f in log.files.get_file_info(change_log.fs.FileSelector(f"{log.root}/segments"))]
    assert len(files) == len(log.commit(log.commits()[0])["segments"])
    with pytest.raises(Exception, match="partitions"):
        change_log.append_log(messages(spark, [1], "y"), second, partitions=9)


def test_log_reads_by_offset(spark, tmp_path):
    """Segments of many row batches are cut at any offset; nulls stay."""
    at = str(tmp_path / "log")
    df = spark.range(25_000).select(F.when(F.col("id") % 2 == 0, F.lit("k")).alias("key"), F.when(F.col("id") != 7, F.col("id").cast("string")).alias("value"))
    change_log.append_log(df, at, partitions=1)
    got = change_log.replay(spark, at, {"0": 9_990}, {"0": 10_020})
    assert [r.offset for r in got.orderBy("offset").collect()] == list(range(9_990, 10_020))
    whole = change_log.replay(spark, at)
    assert whole.count() == 25_000 and whole.filter("key IS NULL").count() == 12_500 and whole.filter("value IS NULL").count() == 1


def state_of(spark, path):
    return BucketedState(spark, path, ["id"], ["id", "v"])


def test_state_rewrites_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "state")
    state = BucketedState(spark, path, ["id"], ["id", "v"], buckets=64)
    changes = lambda rows: spark.createDataFrame(rows, "id long, v string, operation string, ts_ms long")
    assert len(state.apply(changes([(i, f"v{i}", "create", 1) for i in range(1000)]), ["ts_ms"], 0)) == 64
    before = state.manifest(0)
    touched = state.apply(changes([(5, "w", "update", 2), (5, "x", "update", 3)]), ["ts_ms"], 1)
    after = state.manifest(1)
    assert len(touched) == 1 and [b for b in after if after[b] != before[b]] == touched
    written = [p for p in (tmp_path / "state/data/version=1").iterdir() if p.name.startswith("_bucket")]
    assert len(written) == 1
    got = {r.id: r.v for r in state.frame().collect()}
    assert len(got) == 1000 and got[5] == "x" and {r.id: r.v for r in state.frame(0).collect()}[5] == "v5"
    assert state.apply(changes([(5, "again", "update", 9)]), ["ts_ms"], 1) == []  # a batch that runs again
    reopened = BucketedState(spark, path, ["id"], ["id", "v"], buckets=8)
    assert reopened.buckets == 64
    reopened.apply(changes([(None, "n", "create", 3), (5, None, "delete", 4)]), ["ts_ms"], 2)
    assert len(reopened.versions()) == 2  # the first version is gone, and its file of the rewritten bucket
    assert not (tmp_path / f"state/data/version=0/_bucket={touched[0]}").exists()
    got = {r.id: r.v for r in reopened.frame().collect()}
    assert 5 not in got and got[None] == "n" and len(got) == 1000
    reopened.apply(changes([(i, None, "delete", 9) for i in [None, *range(1000)]]), ["ts_ms"], 3)
    assert reopened.frame().count() == 0 and reopened.frame().columns == ["id", "v"]
    reopened.apply(changes([(1, "back", "create", 10)]), ["ts_ms"], 4)
    assert [(r.id, r.v) for r in reopened.frame().collect()] == [(1, "back")]


def test_state_after_a_crash(spark, tmp_path):
    """Files without a manifest don't count; the batch that runs again writes the same state."""
    path = str(tmp_path / "state")
    changes = lambda rows: spark.createDataFrame(rows, "id long, v string, operation string, ts_ms long")
    state = BucketedState(spark, path, ["id"], ["id", "v"], buckets=4)
    state.apply(changes([(1, "a", "create", 1)]), ["ts_ms"], 0)
    state.apply(changes([(1, "b", "update", 2), (2, "c", "create", 2)]), ["ts_ms"], 1)
    (tmp_path / "state/manifest/version=1/_SUCCESS").unlink()
    again = state_of(spark, path)
    assert again.versions() == [0] and [(r.id, r.v) for r in again.frame().collect()] == [(1, "a")]
    again.apply(changes([(1, "b", "update", 2), (2, "c", "create", 2)]), ["ts_ms"], 1)
    assert sorted((r.id, r.v) for r in again.frame().collect()) == [(1, "b"), (2, "c")]


def test_stream_of_the_log_into_buckets(spark, tmp_path):
    """Log, stream, state, stop, more messages, restart."""
    at = str(tmp_path / "log")

    def send(events):
        change_log.append_log(spark.createDataFrame([("k", json.dumps(e)) for e in events], "key string, value string"), at)

    def step():
        changes = cdc.parse_cdc(change_log.read_log_stream(spark, at), "id bigint, v string")
        q = cdc.apply_cdc_stream(changes, str(tmp_path / "state"), ["id"], ["ts_ms"], ["id", "v"], str(tmp_path / "check"), buckets=4).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.id, r.v) for r in state_of(spark, str(tmp_path / "state")).frame().collect())

    send([{"op": "c", "before": None, "after": {"id": i, "v": "x"}, "ts_ms": 1} for i in range(6)])
    assert step() == [(i, "x") for i in range(6)] == step()
    send([{"op": "u", "before": None, "after": {"id": 1, "v": "z"}, "ts_ms": 2}, {"op": "d", "before": {"id": 2, "v": "x"}, "after": None, "ts_ms": 2}])
    assert step() == [(0, "x"), (1, "z"), (3, "x"), (4, "x"), (5, "x")]


def test_statistics_count_late_rows(spark, tmp_path):
    def put(name, times):
        spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id long, t string").select("id", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    put("a", ["2024-01-01 10:00:00", "2024-01-01 12:00:00"])
    counts = lambda: cdc.with_watermark(spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "in/*")), "ts", "10 minutes").groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    start = lambda: counts().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    start().awaitTermination(120)
    put("b", ["2024-01-01 09:00:00", "2024-01-01 12:30:00"])
    q = start()
    q.awaitTermination(120)
    got = cdc.stream_statistics(q)
    assert got["late"] == 1 and got["lag_ms"] > 0


def test_governed_outcome(spark):
    df = spark.createDataFrame([(1, 2.0, "2024-01-02"), (1, 1.0, "2024-01-01"), (1, 0.5, "2024-01-01"), (2, 99.0, "2024-01-01")], "id long, v double, ts string")
    out = cdc.governed_outcome(df, ["id"], "ts", [{"field": "v", "rule": "RANGE", "min": 0, "max": 50, "severity": "warning"}])
    assert sorted((r.id, r.v) for r in out["rows"].collect()) == [(1, 0.5), (2, 99.0)]  # of equal times the least row
    assert {r.column for r in out["profile"].collect()} == {"id", "v", "ts"}
    assert sorted(tuple(r) for r in out["lineage"].collect()) == [("1", "governed", 3, 2), ("2", "governed", 1, 0)]
