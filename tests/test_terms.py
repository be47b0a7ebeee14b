"""Terms for fields against a plain loop over all pairs; uniqueness, classes and file checksums on edge rows."""

import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.operators import quality, reconcile, terms


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i))
    return row[-1]


def words(name):
    return [w for w in re.split(r"[^a-z0-9]+", re.sub("([A-Z])", r" \1", name).lower()) if len(w) > 1]


def cosine(a, b):
    dot = sum(a.count(w) * b.count(w) for w in set(a))
    return dot / math.sqrt(sum(a.count(w) ** 2 for w in set(a)) * sum(b.count(w) ** 2 for w in set(b))) if dot else 0.0


def brute(names, labels):
    """{(field, term, strategy): confidence} of words, edits and the registry, from all pairs."""
    out = {}
    for (f, (t, label)) in itertools.product(names, labels):
        plain, low = re.sub("[^a-z0-9]", "", f.lower()), label.lower()
        if not plain or not low:
            continue
        c, s = cosine(words(f), words(label)), 1 - edits(plain, low) / max(len(plain), len(low))
        if c >= 0.3 - 1e-9:
            out[f, t, "statistical"] = 0.7 + (c - 0.3) / 0.7 * 0.15
        if s >= 0.6 - 1e-9:
            out[f, t, "lexical"] = 0.65 + (s - 0.6) * 0.375
        if plain == low:
            out[f, t, "registry"] = 0.9
        elif c >= 0.4 - 1e-9:
            out[f, t, "registry"] = 0.75 + (c - 0.4) * 0.25
        elif s >= 0.7 - 1e-9:
            out[f, t, "registry"] = 0.75 + (s - 0.7) * 0.5
        elif low in plain or plain in low:
            out[f, t, "registry"] = 0.76
    return out


def test_strategies_against_all_pairs(spark):
    rng = random.Random(4)
    parts = ["user", "order", "total", "ship", "date", "line", "item", "code", "note", "ref", "x"]
    names = sorted({rng.choice(["", "my_"]) + "".join(w.title() if rng.random() < 0.4 else rng.choice(["_", ""]) + w for w in rng.sample(parts, rng.randint(1, 3))) for _ in range(60)})
    labels = sorted({(f"t{i}", "".join(rng.choice([" ", ""]) + w for w in rng.sample(parts, rng.randint(1, 3))).strip()) for i in range(50)})
    f = spark.createDataFrame([(n,) for n in names + names[:5] + [None, "", "__"]], "field string")
    t = spark.createDataFrame(labels + labels[:5] + [("empty", ""), ("none", None), (None, "user")], "term string, label string")
    found = terms.strategy_matches(f, t)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()
    got = {(r.field, r.term, r.strategy): r.confidence for r in found.filter("strategy != 'heuristic'").collect()}
    want = brute(names, labels)
    assert got.keys() == want.keys() and len(want) > 300
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_weights_values_vectors_manual(spark):
    t = spark.createDataFrame([("http://schema.org/email", "email", "schema.org"), ("own:mail", "contact", "own")], "term string, label string, namespace string")
    values = spark.createDataFrame([(f"a{i}@b.org", "2024-01-0%d" % (i % 9 + 1) if i % 2 else "soon") for i in range(10)] + [(None, "NA")], "user_email string, due string")
    f = spark.createDataFrame([("user_email",), ("due",), ("boss",)], "field string")
    fv, tv = spark.createDataFrame([("due", [1.0, 0.0])], "field string, vector array<double>"), spark.createDataFrame([("own:mail", [0.9, 0.1]), ("http://schema.org/email", [0.0, 1.0])], "term string, vector array<double>")
    m = terms.strategy_matches(f, t, values, fv, tv, spark.createDataFrame([("boss", "own:boss")], "field string, term string"))
    got = {(r.field, r.strategy): r.confidence for r in m.collect()}
    assert got["user_email", "pattern"] == 0.95 and ("due", "pattern") not in got  # half of its values are dates
    assert abs(got["user_email", "heuristic"] - 0.75) < 1e-9 and abs(got["due", "semantic"] - (0.8 + (0.9 / math.sqrt(0.82) - 0.7) * 0.33)) < 1e-9
    best = {r.field: r for r in terms.map_to_terms(m, k=1).collect()}
    a = {s: got["user_email", s] for s in best["user_email"].strategies}
    assert set(a) >= {"pattern", "heuristic", "statistical"}
    assert abs(best["user_email"].confidence - sum(terms.WEIGHTS[s] * c for s, c in a.items()) / sum(terms.WEIGHTS[s] for s in a)) < 1e-9
    assert (best["boss"].term, best["boss"].confidence, best["boss"].strategies) == ("own:boss", 1.0, ["manual"])
    assert terms.map_to_terms(terms.strategy_matches(f.limit(0), t)).count() == 0


def test_unique_rule(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, v string").withColumn("_n", F.lit(0))
    got = models.heuristics(df, {"u": {"field": "v", "kind": "unique"}, "e": {"field": "v", "kind": "length", "min": 1, "max": 1}})
    assert got.columns == ["id", "v", "_n", "u", "e"]
    rows = {r.id: (r.u.decision, r.e.decision) for r in got.collect()}
    assert rows == {1: ("reject", "accept"), 2: ("reject", "accept"), 3: ("reject", "reject"), 4: ("reject", "reject"), 5: ("accept", "accept")}
    assert models.heuristics(df.limit(0), {"u": {"field": "v", "kind": "unique"}}).count() == 0
    with pytest.raises(ValueError):
        models.heuristic({"field": "v", "kind": "unique"})


def test_class_shape(spark):
    triples = spark.createDataFrame([("m1", "type", "Model"), ("m1", "on", "d1"), ("m1", "on", "d2"), ("m2", "type", "Model"), ("d1", "type", "Data"), ("d2", "type", "Other"), ("m3", "on", "d2")], "s string, p string, o string")
    got = quality.validate_shapes(triples, "Model", [{"path": "on", "class": "Data", "minCount": 1}]).collect()
    assert sorted((r.s, r.path, r.constraint, r.value) for r in got) == [("m1", "on", "class", "d2"), ("m2", "on", "minCount", "0")]


def test_file_checksums(spark, tmp_path):
    for name, data in {"a.bin": b"x" * 1000, "b.bin": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in reconcile.file_checksums(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": (1000, hashlib.sha256(b"x" * 1000).hexdigest()), "b.bin": (0, hashlib.sha256(b"").hexdigest())}
