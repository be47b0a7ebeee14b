"""Edge rows: nulls, blanks, ties, empty input, errors; files; streams against their batch twins."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import functions
from tessera.functions import models
from tessera.operators import bitemporal, golden, lineage, match, privacy, profile, quality, reconcile, relational, rows, vectors
from tessera.sources import readers, writers
from tessera.streaming import cdc
from tessera.streaming.buckets import BucketedState


def one(spark, template):
    functions.register(spark)
    return spark.range(1).select(functions.expression(template).alias("v")).first()["v"]


def test_function_traps(spark):
    assert one(spark, "LENGTH('é')") == 2
    assert one(spark, "SUBSTRING('hello', 0, 2)") == "he"
    assert one(spark, "SUBSTRING('hello', -1, 2)") == ""
    assert one(spark, "COALESCE('', 'x')") == "x"
    assert one(spark, "CONCAT('a', NULL)") == "a"
    assert one(spark, "ROUND(-2.5, 0)") == -3.0
    assert one(spark, "REGEX_EXTRACT('abc', '[0-9]')") is None
    assert one(spark, "AND_NULL(false, NULL)") is None
    assert one(spark, "AND(false, NULL)") is False
    assert one(spark, "NOT_TRUTHY(NULL)") is True
    assert one(spark, "MASK('abcd', '*', 2, 2)") == "abcd"
    assert one(spark, "LESS('9', '18')") is False
    assert one(spark, "EQUALS(NULL, NULL)") is True
    assert one(spark, "LIKE('a_c', 'a_c')") is True and one(spark, "LIKE('abc', 'a_c')") is False
    assert one(spark, "IS_NUMERIC(' 1')") is False
    assert one(spark, "TITLE_CASE('  hello   wORLD ')") == "Hello World"
    for bad in ("SQRT(-1.0)", "SPLIT_PART('a', ',', 0)", "TO_INTEGER('x')", "DIVIDE(1, 0)", "MOD(1, 0)"):
        with pytest.raises(Exception):
            one(spark, bad)


def test_date_patterns():
    assert functions.java_date_pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"
    with pytest.raises(ValueError):
        functions.java_date_pattern("%Q")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    writers.write_csv(df, str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c")).count() == 2
    (tmp_path / "x.csv").write_text("# made by hand\n# twice\nid;name\n1;a\n2;b\n")
    got = readers.read_csv(spark, str(tmp_path / "x.csv"), ";", True, skip_rows=2)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [("1", "a"), ("2", "b")] and got.columns == ["id", "name"]
    (tmp_path / "y.csv").write_text("id|n\n1|2\n3|4\n")
    assert readers.sniff_csv(spark, str(tmp_path / "y.csv")) == {"delimiter": "|", "has_header": True, "fields": 2, "encoding": "UTF-8"}
    assert readers.read_csv(spark, str(tmp_path / "y.csv"), "|", False).columns == ["column_1", "column_2"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-02-03")], "id int, day string").withColumn("day", F.to_date("day"))
    writers.write_parquet(df, str(tmp_path / "p"), "day")
    back = spark.read.parquet(str(tmp_path / "p")).filter("year = 2024 AND month = 2")
    assert back.count() == 1
    writers.write_json(df, str(tmp_path / "j"))
    assert readers.read_json(spark, str(tmp_path / "j")).count() == 2
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert readers.read_json(spark, str(tmp_path / "a.json"), array=True).count() == 2
    t = spark.createDataFrame([("http://x/a", "http://x/p", 'say "hi"', "", "en"), ("http://x/a", "http://x/q", "http://x/b", None, None)], "s string, p string, o string, datatype string, lang string").withColumn("datatype", F.nullif("datatype", F.lit("")))
    writers.write_ntriples(t, str(tmp_path / "n"))
    assert sorted(map(str, readers.read_ntriples(spark, str(tmp_path / "n")).collect())) == sorted(map(str, t.collect()))
    writers.load_table(df, "t_loaded")
    writers.load_table(df, "t_loaded")
    assert spark.table("t_loaded").count() == 4
    writers.load_table(df, "t_loaded", "replace")
    assert spark.table("t_loaded").count() == 2


def test_rows(spark):
    df = spark.createDataFrame([(1, " A ", "12"), (2, "", "x"), (3, None, None)], "id int, s string, n string")
    got = {r.id: r.s for r in rows.field_transform(df, {"s": ["TRIM", {"op": "IF_NULL", "default": "-"}]}).collect()}
    assert got == {1: "A", 2: "-", 3: "-"}
    assert [r.id for r in df.filter(rows.condition(df, {"type": "gt", "field": "n", "value": 5})).collect()] == [1]
    with pytest.raises(Exception):
        rows.condition(df, {"type": "exists", "field": "absent"})
    assert sorted(r.id2 for r in rows.assign_ids(df, ["id"], "id2").collect()) == [1, 2, 3]
    assert rows.assign_ids(df.limit(0), ["id"], "id2").count() == 0
    with pytest.raises(ValueError):
        rows.map_fields(df, [("s", "t", 1.0), ("n", "t", 1.0)], "error")


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a", None, 1), (2, "a", "x", 2), (3, "b", "", 3), (4, None, "y", 4), (5, None, "z", 5)], "id int, k string, v string, at int")
    ids = lambda keep: sorted(r.id for r in relational.dedup(df, ["k"], ["at"], keep).collect())
    assert ids("first") == [1, 3, 4] and ids("last") == [2, 3, 5] and ids("highest_quality") == [2, 3, 4]
    merged = {r.k: (r.id, r.v) for r in relational.dedup(df, ["k"], ["at"], "merge").collect()}
    assert merged["a"] == (1, "x")
    assert relational.dedup(df.limit(0), ["k"], ["at"]).count() == 0


def test_aggregate_traps(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), (None, None)], "g string, v string")
    got = {r.g: (r.v_sum, r.v_count, r.v_min) for r in relational.aggregate(df, ["g"], [("v", "SUM"), ("v", "COUNT"), ("v", "MIN")]).collect()}
    assert got == {"a": (1.0, 1, 1.0), "": (0.0, 0, None)}
    assert relational.aggregate(df.limit(0), [], [("v", "SUM")]).first()[0] == 0.0


def test_quality(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "q"}',), ("no",)], "j string")
    got = [r["_errors"] for r in quality.validate_json(df, "j", {"properties": {"a": {"type": "integer"}, "b": {"type": "string", "enum": ["x"]}}, "required": ["b"]}).collect()]
    assert got == [[], ["a: not integer", "b: missing"], ["not JSON"]]
    marked = quality.with_violations(spark.createDataFrame([(1, None)], "id int, v string"), [{"field": "v", "rule": "NOT_NULL", "severity": "critical"}] * 4)
    assert marked.select(quality.quality_score(F.col("_violations"))).first()[0] == 0.0


def test_profile(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111",), ("4111 1111 1111 1112",), ("NA",)], "card string")
    shares = {r.kind: r.share for r in profile.match_shares(df, ["card"]).collect()}
    assert shares["credit_card"] == 0.5
    assert profile.profile(df.limit(0), ["card"]).first()["rows"] == 0
    named = profile.type_by_name(spark.createDataFrame([("Email_Address",), ("x",)], "column string"))
    assert {r.column: r.kind for r in named.collect()} == {"Email_Address": "email", "x": None}


def test_kinds_by_name(spark):
    """Each listed name, ending and part; the first kind of those that share one; nulls and clashing columns stay."""
    want = {w: (kind, 0.9) for kind, words in reversed(profile.COLUMN_KINDS.items()) for w in words.split() if w[0] not in "_*"}
    want |= {"Ship-To.City": ("city", 0.7), "order price": ("currency_amount", 0.7), "my_hotel_id": ("phone", 0.7), "old_credit_card_no": ("credit_card", 0.7), "x": (None, None), "": (None, None), "LAST_STATE": ("state", 0.7)}
    df = spark.createDataFrame([(w, "k") for w in want] + [(None, "k")], "column string, _other string")
    got = {r["column"]: (r.kind, r.confidence) for r in profile.kinds_by_name(df).collect()}
    assert got == want | {None: (None, None)}
    assert len(profile.COLUMN_KINDS) > 20 and profile.kinds_by_name(df.limit(0)).columns == ["column", "_other", "kind", "confidence"]


def test_match(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("", ""), ("a", None), ("dixon", "dicksonx")], "a string, b string")
    got = [r[0] for r in df.select(match.jaro_winkler(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.9611, abs=1e-3) and got[1] == 1.0 and pd.isna(got[2]) and got[3] == pytest.approx(0.8133, abs=1e-3)
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    comp = {r.node: r.component for r in match.connected_components(links).collect()}
    assert {comp[i] for i in range(31)} == {0} and comp[101] == 100
    assert match.connected_components(links.limit(0)).count() == 0


def test_votes_tie(spark):
    df = spark.createDataFrame([("e", "f", "b", "s1"), ("e", "f", "a", "s2")], "entity string, field string, value string, source string")
    r = golden.frequency_vote(df).first()
    assert (r["value"], r["confidence"], r["severity"]) == ("a", 0.5, "High")


def test_votes_tie_with_prefixes(spark):
    """Batch and stream take the least of equal values."""
    df = spark.createDataFrame([("e", "f", "ab", "s1", 0.5), ("e", "f", "a", "s2", 0.5), ("e", "g", "", "s1", None), ("e", "g", "b", "s2", None)], "entity string, field string, value string, source string, confidence double")
    assert {r.field: r.value for r in golden.frequency_vote(df).collect()} == {"f": "a", "g": ""}
    assert {r.field: r.value for r in golden.resolve_conflicts(df, "coalesce").collect()} == {"f": "a", "g": ""}
    assert {r.field: r.strategy for r in golden.suggest_strategy(df).collect()}["f"] == "coalesce"
    more = df.unionByName(df.limit(1).withColumn("confidence", F.lit(0.9)))
    assert {r.field: r.strategy for r in golden.suggest_strategy(more).collect()}["f"] == "primary"


def test_percentiles_by_brute_force(spark):
    import numpy as np

    from tessera.operators.percentiles import percentiles

    rng = np.random.default_rng(6)
    rows = [("a", float(x)) for x in rng.integers(50, size=501)] + [(None, float(x)) for x in rng.normal(size=40)] + [("b", 7.0)] * 300 + [("c", None), ("d", -1.5)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.lo, r.mid, r.hi) for r in percentiles(df, ["g"], F.col("x"), {"lo": 0.1, "mid": 0.5, "hi": 1.0}).collect()}
    want = {}
    for g in ("a", None, "b", "d"):
        want[g] = tuple(np.quantile([x for k, x in rows if k == g], q) for q in (0.1, 0.5, 1.0))
    assert set(got) == set(want) and all(np.allclose(got[g], want[g]) for g in want)
    assert percentiles(df, [], F.col("x"), {"mid": 0.5}).first()["mid"] == pytest.approx(np.median([x for _, x in rows if x is not None]))
    assert percentiles(df.limit(0), ["g"], F.col("x"), {"mid": 0.5}).count() == 0
    medians = relational.aggregate(df, ["g"], [("x", "MEDIAN"), ("x", "MAX", "top")])
    assert medians.columns == ["g", "x_median", "top"] and {r.g: r.x_median for r in medians.collect()}["c"] is None
    assert relational.aggregate(df, [], [("x", "MEDIAN", "m")]).count() == 1


def test_unique_rule(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "b")], "id int, v string")
    marked = quality.with_violations(df, [{"field": "v", "rule": "UNIQUE"}])
    assert marked.columns == ["id", "v", "_violations"] and {r.id for r in marked.filter(F.size("_violations") > 0).collect()} == {3, 4}


def test_checksum_sees_pairs(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    a, b = reconcile.integrity(df(1, 1, 2)).first(), reconcile.integrity(df(3, 3, 2)).first()
    assert a["checksum"] != b["checksum"] and reconcile.check_manifest(df(2, 1, 1), 3, a["checksum"]).first()["intact"]
    assert reconcile.integrity(df(1).limit(0)).first()["checksum"] == 0


def test_enrich_repeats(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "x"]), (1, ["b", "a", "b", "x"]), (2, []), (3, None)], "k int, ids array<string>")
    art = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    got = relational.enrich_by_ids(df, "ids", art, "id", "found").orderBy("k").collect()
    assert [[tuple(x) for x in r.found] if r.found else None for r in got] == [[("a", 1), ("b", 2)]] * 2 + [None, None]


def test_cosine_of_texts_by_brute_force(spark):
    """A word that all texts have joins nothing that is not similar."""
    import itertools
    import math
    import random

    rnd = random.Random(3)
    texts = {i: "the " + " ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for i in range(60)}
    v = match.tf_vectors(spark.createDataFrame(list(texts.items()), "k long, t string"), "k", "t")
    got = {(r.a, r.b): r.cosine for r in match.tf_cosine(v.withColumnRenamed("k", "a"), v.withColumnRenamed("k", "b"), "a", "b", 0.7).filter("a < b").collect()}
    want = {}
    for x, y in itertools.combinations(texts, 2):
        p, q = texts[x].split(), texts[y].split()
        dot = sum(p.count(w) * q.count(w) for w in set(p))
        c = dot / math.sqrt(sum(p.count(w) ** 2 for w in set(p)) * sum(q.count(w) ** 2 for w in set(q)))
        if c >= 0.7:
            want[x, y] = c
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want


def test_similarity_classes_by_brute_force(spark):
    import numpy as np

    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(25, 12))
    x = np.concatenate([middle[rng.integers(25, size=500)] + 0.25 * rng.normal(size=(500, 12)), np.repeat(middle[:1], 120, axis=0), rng.normal(size=(100, 12))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        grown = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (grown == label).all():
            break
        label = grown
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 12), (9003, [1.0]), (None, [1.0] * 12)], "k long, v array<double>").withColumn("home", F.lit(1))
    got = {r.k: (r["class"], r.links) for r in vectors.similarity_classes(df, "k", "v", 0.9).collect()}
    assert got == {i: (int(label[i]), int(near[i].sum())) for i in range(len(x))}
    assert vectors.semantic_dedup(df, "k", "v", 0.9).filter("kept").count() == len(set(label.tolist()))
    assert vectors.similarity_classes(df.limit(0), "k", "v").count() == 0
    few = match.vector_top_k(df.filter("k < 5"), df.filter("k < 600"), "k", "v", 3, block=2)
    assert {(r.query, r.rank): r.k for r in few.collect()} == {(q, n + 1): int(i) for q in range(5) for n, i in enumerate([j for j in np.lexsort((np.arange(600), -np.round(unit[q] @ unit[:600].T, 12))) if j != q][:3])}


def test_view_in_any_cut(spark):
    e = spark.createDataFrame([(i % 3, i * 7 % 10, i) for i in range(20)], "k int, t int, v int")
    whole = sorted(map(tuple, reconcile.latest_artifacts(e, ["k"], ["t", "v"]).collect()))
    view = reconcile.latest_artifacts(e.limit(0), ["k"], ["t", "v"])
    for part in (e.filter("v >= 12"), e.filter("v < 5"), e.filter("v BETWEEN 5 AND 11"), e.filter("v < 5")):
        view = reconcile.advance_view(view, part, ["k"], ["t", "v"])
    assert sorted(map(tuple, view.collect())) == whole


def test_jdbc_round_trip(spark, tmp_path):
    """Against an embedded database: load, extract by ranges, by query and from the last value."""
    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(100).selectExpr("id", "CAST(id * 1.5 AS DOUBLE) AS v")
    writers.write_jdbc(df, url, "t", properties=options)
    writers.write_jdbc(df.filter("id < 5").withColumn("id", F.col("id") + 100), url, "t", properties=options)
    ranged = readers.read_jdbc(spark, url, "t", partition_column="id", bounds=(0, 100), partitions=4, properties=options)
    assert ranged.count() == 105 and ranged.rdd.getNumPartitions() == 4
    late = readers.extract_incremental(ranged, "id", 99)
    assert late.count() == 5 and "PushedFilters: [*IsNotNull(id), *GreaterThan(id,99)]" in late._jdf.queryExecution().executedPlan().toString()
    assert readers.read_jdbc(spark, url, sql='SELECT COUNT(*) AS n FROM t WHERE "id" < 10', properties=options).first()[0] == 10
    writers.write_jdbc(df.limit(3), url, "t", mode="overwrite", properties=options)
    assert readers.read_jdbc(spark, url, "t", properties=options).count() == 3


@pytest.mark.parametrize("encoding", ["UTF-8", "UTF-16LE", "windows-1252"])
def test_sniff_encoding(spark, tmp_path, encoding):
    mark = {"UTF-16LE": b"\xff\xfe"}.get(encoding, b"")
    (tmp_path / "x.csv").write_bytes(mark + "name;n\ncafé;1\nñandú;2\n".encode(encoding))
    assert readers.sniff_csv(spark, str(tmp_path / "x.csv")) == {"delimiter": ";", "has_header": True, "fields": 2, "encoding": encoding}
    assert readers.detect_encoding(b"\xef\xbb\xbfa") == "UTF-8" and readers.detect_encoding(b"") == "UTF-8"


def test_late_rows(spark, tmp_path):
    """Rows behind the watermark are dropped, by event time; by processing time none is late."""
    rows_of = lambda *times: spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("ts"))
    for i, part in enumerate((rows_of("2024-01-01 10:00:00", "2024-01-01 12:00:00"), rows_of("2024-01-01 12:01:00"), rows_of("2024-01-01 10:30:00", "2024-01-01 11:55:00", "2024-01-01 14:00:00"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    (tmp_path / "all").mkdir()
    for i in range(3):
        next((tmp_path / f"in{i}").glob("*.parquet")).rename(tmp_path / "all" / f"{i}.parquet")
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    hours = lambda s: s.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.hour("w.start").alias("h"), "n")
    run_stream(hours(cdc.with_watermark(stream, "ts", "10 minutes")), "hours")
    assert sorted(map(tuple, spark.table("hours").collect())) == [(10, 1), (11, 1), (12, 2)]


def test_append_retried(spark, tmp_path):
    """The first batch, run again as after a failure, appends nothing."""
    df = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    df.write.parquet(str(tmp_path / "in"))
    for check in ("c1", "c2"):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        cdc.idempotent_append(stream, "id", str(tmp_path / "log"), str(tmp_path / check)).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_error_words(spark):
    said = ["Connection refused", "could not connect", "unique constraint", "duplicate key", "cannot parse", "timeout", "timed out", "transform failed", "no such file", "odd", None]
    got = writers.classify_errors(spark.createDataFrame([(m,) for m in said], "message string")).collect()
    assert [(r.category, r.transient) for r in got] == [("connection", True)] * 2 + [("constraint", False)] * 2 + [("format", False), ("timeout", True), ("unknown", False), ("transformation", False), ("io", False), ("unknown", False), ("unknown", False)]


def test_lineage_cycle_and_depth(spark):
    e = spark.createDataFrame([("a", "b", "j"), ("b", "c", "j"), ("c", "a", "j")], "src string, dst string, job string")
    got = {(r.node, r.hops) for r in lineage.trace(e, spark.createDataFrame([("a",)], "start string")).collect()}
    assert got == {("b", 1), ("c", 2)}
    assert {(r.node, r.length) for r in lineage.cycles(e).collect()} == {("a", 3), ("b", 3), ("c", 3)}
    ev = spark.createDataFrame([("COMPLETE", "2024-01-01", "r", "n", "j", ["i"], ["o"])], "event_type string, event_time string, run_id string, namespace string, job string, inputs array<string>, outputs array<string>")
    assert lineage.from_openlineage(lineage.to_openlineage(ev)).first() == ev.first()
    assert lineage.column_edges("j", [(["a", "b"], "c", "concat")], spark).count() == 2


def test_long_lineage(spark):
    """Longer than ten hops; a shortcut doesn't make a chain shorter; a cycle of twelve; what leads into a cycle."""
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(14)] + [("n0", "n13")], "src string, dst string")
    starts = spark.createDataFrame([("n0",)], "start string")
    assert lineage.trace(chain, starts).agg(F.max("hops"), F.count("node")).first() == (12, 14)
    assert lineage.trace(chain.filter("dst != 'n13' OR src = 'n12'"), starts).agg(F.max("hops")).first()[0] == 14
    assert lineage.trace(chain, starts, max_hops=1).count() == 2
    assert tuple(lineage.depth(chain).first()) == (14, False)
    ring = spark.createDataFrame([(f"r{i}", f"r{(i + 1) % 12}") for i in range(12)] + [("r3", "r3"), ("a", "r0"), ("r0", "b"), ("b", "c")], "src string, dst string")
    assert {(r.node, r.length) for r in lineage.cycles(ring).collect()} == {(f"r{i}", 1 if i == 3 else 12) for i in range(12)}
    assert lineage.cycles(chain).count() == 0 and tuple(lineage.depth(ring).first()) == (1, True)


def test_edges_of_a_frame(spark, tmp_path):
    """Column lineage from the plan of joins, casts, expressions, aggregates, unions and generators."""
    spark.createDataFrame([(1, "a", 2.0)], "k int, name string, x double").write.parquet(str(tmp_path / "left.parquet"))
    spark.createDataFrame([(1, "p,q")], "id int, tags string").write.parquet(str(tmp_path / "right"))
    a, b = spark.read.parquet(str(tmp_path / "left.parquet")), spark.read.parquet(str(tmp_path / "right"))
    j = a.join(b, a.k == b.id).filter("x > 0").select("k", F.col("name").alias("n"), F.col("x").cast("int").alias("i"), (F.col("x") * F.col("id")).alias("y"), F.explode(F.split("tags", ",")).alias("tag"))
    got = {(r.src, r.dst, r.kind) for r in lineage.frame_edges(j, "j").collect()}
    assert got == {("left.k", "k", "copy"), ("left.name", "n", "rename"), ("left.x", "i", "cast"), ("left.x", "y", "derive"), ("right.id", "y", "derive"), ("right.tags", "tag", "derive")}
    g = j.groupBy("n").agg(F.sum("y").alias("s"))
    got = {(r.src, r.dst, r.kind, r.reversible) for r in lineage.frame_edges(g.unionByName(g), "j").collect()}
    assert got == {("left.name", "n", "rename", True), ("left.x", "s", "aggregate", False), ("right.id", "s", "aggregate", False)}


def test_half_open(spark):
    f = spark.sql("SELECT 's' subject, 'p' predicate, 1 object, TIMESTAMP '2024-01-01' tx_from, TIMESTAMP '2024-01-02' tx_to UNION ALL SELECT 's', 'p', 2, TIMESTAMP '2024-01-02', NULL")
    at = lambda t: bitemporal.as_of(f, F.lit(t).cast("timestamp")).first()["object"]
    assert at("2024-01-01 23:59:59") == 1 and at("2024-01-02") == 2


def test_merkle(spark):
    import hashlib

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    df = spark.createDataFrame([("b", i, str(i)) for i in range(3)], "batch string, seq int, v string")
    want = h(h(h("0") + h("1")) + h(h("2") + h("2")))
    assert bitemporal.merkle_roots(df, "batch", "seq", F.sha2(F.col("v"), 256)).first()["root"] == want


def test_privacy(spark, tmp_path):
    df = spark.createDataFrame([("ab",), ("abcdef",), (None,)], "s string")
    assert [r[0] for r in df.select(privacy.mask(F.col("s"))).collect()] == ["**", "**cdef", None]
    found = privacy.discover_subject({"t": (df, F.col("s") == "ab")})
    for kind in ("json", "csv", "xml"):
        privacy.export_subject(found, str(tmp_path / kind), kind)
        assert any((tmp_path / kind).iterdir())
    assert privacy.erase(df, F.col("s") == "ab", "delete").count() == 2


def test_compare(spark):
    df = spark.createDataFrame([("1", "1.4"), ("1", "2"), ("x", "x"), ("1", "x"), (None, "1"), ("1", None), ("TRUE", "true")], "e string, a string")
    assert [r[0] for r in df.select(reconcile.compare(F.col("e"), F.col("a"), 0.5)).collect()] == ["passed", "failed", "passed", "failed", "not_run", "failed", "passed"]
    assert df.limit(2).select(reconcile.compare(F.col("e"), F.col("a"))).first()[0] == "warning"


def test_models(spark):
    df = spark.createDataFrame([("ab",), (None,)], "s string")
    assert [r[0] for r in df.select(models.text_function(str.upper)(F.col("s"))).collect()] == ["AB", None]
    assert [r[0] for r in df.select(models.text_function(lambda x: x[9])(F.col("s"))).collect()] == [None, None]
    models.register_function(spark, "twice", lambda s: s * 2, "long")
    assert spark.sql("SELECT twice(id) AS x FROM range(3)").agg(F.sum("x")).first()[0] == 6
    votes = spark.createDataFrame([("e", "f", "b"), ("e", "f", "a")], "entity string, field string, value string")
    assert models.resolve_by(votes, ["entity", "field"], lambda p: max(p["value"])).first()["value"] == "b"
    v = models.embed(df, "s", 8).select("vector").first()[0]
    assert sum(x * x for x in v) == pytest.approx(1.0)


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream_dedup_and_aggregate(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:05", 1.0), (2, "2024-01-01 00:00:06", 3.0)], "id int, t string, v double").select("id", F.to_timestamp("t").alias("ts"), "v")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    run_stream(cdc.ttl_dedup(stream, ["id"], "ts", "1 minute"), "once")
    assert spark.table("once").count() == 2
    run_stream(cdc.incremental_aggregate(stream, ["id"], "v"), "sums", "complete")
    twin = cdc.incremental_aggregate(e, ["id"], "v")
    assert sorted(map(str, spark.table("sums").collect())) == sorted(map(str, twin.collect()))


def test_stream_cdc_restart(spark, tmp_path):
    def put(name, events):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, events)))

    def step():
        changes = cdc.parse_cdc(readers.read_cdc_files(spark, str(tmp_path / "in")), "id bigint, v string")
        q = cdc.apply_cdc_stream(changes, str(tmp_path / "state"), ["id"], ["ts_ms"], ["id", "v"], str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.id, r.v) for r in BucketedState(spark, str(tmp_path / "state"), ["id"], ["id", "v"]).frame().collect())

    put("a.json", [{"op": "c", "before": None, "after": {"id": 1, "v": "x"}, "ts_ms": 1}, {"op": "c", "before": None, "after": {"id": 2, "v": "y"}, "ts_ms": 1}])
    assert step() == [(1, "x"), (2, "y")]
    put("b.json", [{"op": "u", "before": {"id": 1, "v": "x"}, "after": {"id": 1, "v": "z"}, "ts_ms": 2}, {"op": "d", "before": {"id": 2, "v": "y"}, "after": None, "ts_ms": 2}])
    assert step() == [(1, "z")]


def test_stream_resolution(spark, tmp_path):
    cdc.use_rocksdb(spark)
    df = spark.createDataFrame([("e1", "f", "a", "s1"), ("e1", "f", "a", "s2"), ("e2", "f", "b", "s1")], "entity string, field string, value string, source string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run_stream(cdc.resolve_stream(stream), "resolved")
    got = [(r.entity, r.value, r.confidence) for r in spark.table("resolved").collect()]
    assert ("e1", "a", 1.0) in got
    assert [(r.entity, r.value) for r in cdc.resolve_batch(df).collect()] == [("e1", "a")]


def test_stream_routes(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, v int")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    to = lambda name: lambda b, epoch: b.write.mode("overwrite").parquet(str(tmp_path / name / f"epoch={epoch}"))
    routes = [{"name": "big", "condition": {"type": "gte", "field": "v", "value": 10}}]
    q = cdc.route_stream(stream, routes, {"big": to("big")}, F.when(F.col("v").isNull(), "no value"), to("dead"), str(tmp_path / "check"), F.col("id")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "big")).collect()] == [3]
    assert [r.row_number for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == [2]
    assert cdc.stream_statistics(q)["rows"] == 3
    q = cdc.idempotent_append(stream, "id", str(tmp_path / "log"), str(tmp_path / "check2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
