"""Operators that must not meet all pairs or walk all ways: against brute force, with counts of what they met."""

import itertools
import random
from collections import deque

import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from tessera.operators import contracts, lineage, match, sketches, vectors


def brute_links(x, least):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    c = x @ x.T
    np.fill_diagonal(c, -2)
    return (c >= least - 1e-12).sum(axis=1)


def test_prefix_bound(spark):
    """sf0.1's vectors and near copies of some: links as by brute force; under a third of the pairs compared in full."""
    rows = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).collect()
    x = np.array([r.e for r in rows])
    x = np.concatenate([x, x[:200] + np.random.default_rng(1).normal(scale=0.02, size=(200, x.shape[1]))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for least in (0.9, 0.95):
        want = brute_links(x, least)
        got = {r.id: r.links for r in vectors.similarity_classes(df, "id", "v", least).collect()}
        assert [got[i] for i in range(len(x))] == want.tolist() and want.sum() > 300
        pairs, compared = vectors.compared_share(vectors.similarity_links(df, "id", "v", least)[1]).first()
        assert compared < pairs / 3


def test_blocks_meet_once(spark, monkeypatch):
    """Unclustered vectors in several blocks, and clustered ones at their pivots: links as by brute force."""
    monkeypatch.setattr(vectors, "BLOCK", 150)
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(700, 24))
    flat[500:] = flat[:200] + rng.normal(scale=0.1, size=(200, 24))
    tight = np.repeat(rng.normal(size=(30, 24)), 20, axis=0) + rng.normal(scale=0.05, size=(600, 24))
    for x in (flat, tight):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
        got = {r.id: r.links for r in vectors.similarity_classes(df, "id", "v", 0.93).collect()}
        assert [got[i] for i in range(len(x))] == brute_links(x, 0.93).tolist()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_by_segments(spark):
    """One block of names of many lengths and edits: the pairs that brute force finds."""
    rng = random.Random(5)
    names = {"".join(rng.choice("abcd") for _ in range(rng.randrange(0, 14))) for _ in range(220)}
    for n in rng.sample(sorted(names), 120):
        n = list(n)
        for _ in range(rng.randrange(1, 4)):
            n[rng.randrange(len(n) + 1) :][:1] = []
            n.insert(rng.randrange(len(n) + 1), rng.choice("abcdé"))
            if n and rng.random() < 0.6:
                del n[rng.randrange(len(n))]
        names.add("".join(n))
    names = sorted(names)
    df = spark.createDataFrame(list(enumerate(names)) + [(9999, names[3]), (9998, None)], "id long, name string")
    for t in (0.6, 0.85):
        got = sorted((r.a, r.b) for r in match.fuzzy_pairs(df, "id", "name", F.lit(1), t).collect())
        want = [(i, j) for i, j in itertools.combinations(range(len(names)), 2) if 1 - distance(names[i], names[j]) / max(len(names[i]), len(names[j]), 1) >= t]
        assert got == want


def test_fuzzy_block_of_20000(spark):
    """A block of 20,000 names with planted variants: few pairs meet, all planted ones are found."""
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    names = ["".join(letters[rng.integers(26, size=16)]) for _ in range(19_000)]
    names += [n[:k] + "z" + n[k + 1 :] for n, k in zip(names, rng.integers(0, 16, size=1000))]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    texts = df.select(F.lit(1).alias("block"), F.col("name").alias("text"), F.col("id").alias("key"))
    assert match._segment_pairs(texts, 0.9).count() < 500_000  # of 200 million
    got = {(r.a, r.b) for r in match.fuzzy_pairs(df, "id", "name", F.lit(1), 0.9).collect()}
    assert {(i, 19_000 + i) for i in range(1000) if names[i] != names[19_000 + i]} <= got


def test_soundex_blocks(spark):
    df = spark.createDataFrame([(1, "Robert"), (2, "Rupert"), (3, "Rubin"), (4, "O'Brien"), (5, "Obrian")], "id long, name string")
    pairs = match.fuzzy_pairs(df, "id", "name", match.soundex_block("name"), 0.7, match.jaro_winkler)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (4, 5)}


def shortest_cycles(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for s in after:
        seen, queue = {}, deque((n, 1) for n in after[s])
        while queue:
            n, d = queue.popleft()
            if n in seen:
                continue
            seen[n] = d
            queue.extend((m, d + 1) for m in after.get(n, ()))
        if s in seen:
            out[s] = seen[s]
    return out


def edge_frame(spark, edges):
    return spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")


def test_cycles_at_random(spark):
    """Rings, loops, chains between branching nodes, components that lead to others: as by walks from each node."""
    rng = random.Random(8)
    edges = [(f"r{i}", f"r{(i + 1) % 37}") for i in range(37)] + [("l", "l"), ("l", "r3"), ("q1", "q2"), ("q2", "q1"), ("q1", "q1")]
    for k in range(6):  # branching nodes joined by chains of various lengths
        hubs = [f"{k}h{i}" for i in range(4)]
        for c in range(7):
            a, b, n = rng.choice(hubs), rng.choice(hubs), rng.randrange(0, 6)
            way = [a, *[f"{k}c{c}_{j}" for j in range(n)], b]
            edges += list(zip(way, way[1:]))
    edges += [(f"{k}h0", f"{k + 1}h1") for k in range(5)] + [("x", "0h0"), ("5h2", "y")]
    want = {str(n): d for n, d in shortest_cycles(edges).items()}
    got = {r.node: r.length for r in lineage.cycles(edge_frame(spark, edges)).collect()}
    assert got == want
    component = {r.node: r.component for r in lineage.strong_components(edge_frame(spark, edges)).collect()}
    assert component.keys() == shortest_cycles([(a, b) for a, b in edges if a != b]).keys()
    assert component["r0"] == component["r36"] and component["q1"] == component["q2"] != component["r0"]


def test_large_ring(spark):
    edges = [(i, (i + 1) % 5000) for i in range(5000)] + [(7, 7_000_000)]
    got = lineage.cycles(edge_frame(spark, edges))
    assert got.count() == 5000 and got.select("length").distinct().first()[0] == 5000
    assert lineage.cycles(edge_frame(spark, [(1, 2), (2, 3)])).count() == 0


def test_interface_classes(spark):
    """10,000 interfaces of 50 schemas: 2,500 comparisons of classes, whatever the members."""
    fields = spark.range(10_000).select(F.concat(F.lit("i"), "id").alias("interface"), F.concat(F.lit("s"), F.col("id") % 10).alias("system"), (F.col("id") % 50).alias("c"))
    fields = fields.select("interface", "system", F.explode(F.array(F.lit("id"), F.concat(F.lit("f"), F.col("c") % 7))).alias("field"), F.when(F.col("c") % 2 == 0, "int").otherwise("string").alias("type"), (F.col("c") < 25).alias("required"), F.array(F.col("c").cast("string")).alias("enum"))
    shapes, of = contracts.schema_classes(fields)
    assert shapes.select("class").distinct().count() == 50 and contracts.class_pairs(of).count() == 2500
    m = contracts.class_matrix(fields)
    assert m.count() == 2500 and m.filter("state = 'compatible'").count() == 50 and m.filter("p_class = c_class AND score = 1").count() == 50


def test_enum_broadening(spark):
    rows = [("p", "a", "x", "string", True, ["1", "2"]), ("c", "b", "x", "string", True, ["1"]), ("d", "c", "x", "string", True, ["2", "1", "3"]), ("e", "d", "x", "string", False, None)]
    f = spark.createDataFrame(rows, "interface string, system string, field string, type string, required boolean, enum array<string>")
    got = {(r.producer, r.consumer): r.issue for r in contracts.compatibility(f, contracts.interface_pairs(f)).collect()}
    broad = {("p", "c"), ("d", "c"), ("d", "p"), ("e", "p"), ("e", "c"), ("e", "d")}
    assert {k for k, v in got.items() if v == "enum_broadening"} == broad
    assert ("p", "d") not in got and ("p", "e") not in got
    plain = contracts.schema_rows(spark.createDataFrame([(1, "x")], "id long, name string"), "i", "s")
    assert plain.filter("field = 'id' AND type = 'bigint' AND NOT required").count() == 1


def test_frequent_values(spark):
    """Exact counts with room for few values; where bounds leave the first k open, all values are counted."""
    rng = np.random.default_rng(9)
    hot = [str(v) for v in range(12) for _ in range(400 + 10 * v)]
    cold = [f"c{v}" for v in rng.integers(0, 5000, size=9000)]
    rows = [*hot, *cold, None]
    rng.shuffle(rows)
    df = spark.createDataFrame([(r,) for r in rows], "x string").repartition(3)
    for values in (df, spark.createDataFrame([(f"v{i % 900:03d}",) for i in range(3000)], "x string")):
        want = values.filter("x IS NOT NULL").groupBy("x").count().orderBy(F.desc("count"), "x").limit(5).collect()
        got = sketches.frequent_values(values, "x", 5, room=40).collect()
        assert [(r.value, r["count"]) for r in got] == [(r.x, r["count"]) for r in want]
    assert sketches.frequent_values(df.limit(0), "x").count() == 0


def test_quantiles_of_batches(spark):
    df = spark.range(50_000).select((F.col("id") % 10).alias("day"), (F.pow(F.rand(3), 3) * 1000).alias("v")).persist()
    stored = sketches.quantile_sketches(df, F.col("day"), "v").checkpoint()
    for r in sketches.merged_quantiles(stored, [0.01, 0.25, 0.5, 0.99]).collect():
        assert r.n == 50_000 and abs(df.filter(F.col("v") <= r.value).count() / 50_000 - r.p) <= sketches.RANK_ERROR
    none = sketches.quantile_sketches(df.withColumn("v", F.lit(None).cast("double")), F.col("day"), "v")
    assert [(r.value, r.n) for r in sketches.merged_quantiles(none, [0.5]).collect()] == [(None, 0)]


def test_sketched_overlap(spark):
    """Finalists by sketches are those of the exact overlap; a shared kind raises a relation's confidence."""
    a = spark.range(20_000).select(F.col("id").alias("user_uuid"), (F.col("id") + 15_000).alias("other"), (F.col("id") % 50).alias("few"))
    b = spark.range(0, 40_000, 2).select(F.col("id").alias("uuid"), (F.col("id") % 10).alias("ten"))
    tables = {"a": (a, a.columns), "b": (b, b.columns)}
    exact = match.value_overlap(tables).filter("common >= 0.45 * least(left_distinct, right_distinct)")
    got = sketches.sketched_overlap(tables, 0.45)
    assert sorted(map(str, got.collect())) == sorted(map(str, exact.collect())) and got.count() >= 3
    assert sketches.sketched_overlap({"a": (a, ["other"]), "b": (b.limit(0), ["uuid"])}, 0.5).count() == 0
    kinds = spark.createDataFrame([("a.user_uuid", "uuid"), ("b.uuid", "uuid")], "column string, kind string")
    plain = {(r.left_column, r.right_column): r.confidence for r in match.discover_relationships(got, 0.0).collect()}
    more = {(r.left_column, r.right_column): r.confidence for r in match.discover_relationships(got, 0.0, kinds).collect()}
    pair = ("a.user_uuid", "b.uuid")
    assert abs(more[pair] - (plain[pair] * 2.5 + 0.85 * 0.8) / 3.3) < 1e-9 and all(more[p] == plain[p] for p in plain if p != pair)
