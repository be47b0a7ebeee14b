"""Operators 1, 2, 3, 7 and 8, and the pipeline: held-out accuracy, exact round trips, brute force, edge cases."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, language_id, mixing, near_dedup, pieces, quality, registry
from tessera.llm.common import stash

MEDIUM = "/root/testdata/sf0.01"


def test_forward_backward_by_hand():
    rng = np.random.default_rng(1)
    k, counts = 3, [1, 70, 0, 33, 5]
    score, trans, start = rng.normal(size=(sum(counts), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    got, want = language_id.posteriors(score, offsets, trans, start), []
    for a, b in zip(offsets[:-1], offsets[1:]):
        e, t = np.exp(score[a:b]), np.exp(trans)
        fore, back = [], [np.ones(k)]
        for i in range(b - a):
            fore.append((np.exp(start) if i == 0 else fore[-1] @ t) * e[i])
            fore[-1] /= fore[-1].sum()
        for i in range(b - a - 1, 0, -1):
            x = t @ (e[i] * back[0])
            back.insert(0, x / x.sum())
        want += [f * g / (f * g).sum() for f, g in zip(fore, back)]
    assert np.allclose(got, np.array(want))


def test_gradient():
    rng = np.random.default_rng(2)
    p, gold, trans, start = rng.normal(size=(2, 5, 3)), rng.integers(3, size=(2, 5)), rng.normal(size=(3, 3)), rng.normal(size=3)

    def loss(t):
        total = 0.0
        for x, y in zip(p, gold):
            path = start[y[0]] + sum(x[i, y[i]] for i in range(5)) + sum(t[y[i], y[i + 1]] for i in range(4))
            a = start + x[0]
            for i in range(1, 5):
                a = np.log(np.exp(a[:, None] + t).sum(axis=0)) + x[i]
            total += path - np.log(np.exp(a).sum())
        return total

    _, g, _ = language_id._gradient(p, gold, trans, start)
    step = np.zeros((3, 3))
    step[0, 1] = 1e-5
    assert g[0, 1] == pytest.approx((loss(trans + step) - loss(trans - step)) / 2e-5, rel=1e-4)


def test_language(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = language_id.learn(docs)
    out = registry.QUERIES["op1_language_id"](spark, MEDIUM)
    j = out.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert j.filter("lang = lang_pred").count() / j.count() > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the and of thing " * 5000)], "doc_id long, text string").selectExpr("*", "'x' as lang_pred", "1 as score")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"
    assert language_id.identify(odd.limit(0), model).count() == 0 and language_id.identify(odd, None).filter("lang_pred = 'und'").count() == 4
    t = docs.filter("lang = 'en'").first()["text"][:300] + " " + docs.filter("lang = 'de'").first()["text"][:300]
    spans = language_id.label_words(spark.createDataFrame([(t,)], "text string"), model).first()["lang_spans"]
    assert [s["lang"] for s in spans][0] == "en" and [s["lang"] for s in spans][-1] == "de"
    again = docs.limit(50).unionByName(docs.limit(50))
    twice = language_id.identify(again, model)
    assert twice.count() == 100 and twice.groupBy("doc_id").agg(F.count_distinct("lang_pred", "score").alias("n")).filter("n > 1").count() == 0


def test_quality(spark):
    out = registry.QUERIES["op2_quality"](spark, MEDIUM)
    j = out.filter("held_out").join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id")
    assert j.filter("predicted = quality").count() / j.count() > 0.9
    assert out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    odd = spark.createDataFrame([(None,), ("",), (" ",), ("x" * 100_000,)], "text string").withColumn("score", F.lit(9.0))
    trees = quality.grow(np.array([quality.statistics(t) for t in ("a b c. d", "e e e e") * 30]), np.array([1.0, 0.0] * 30))
    assert quality.score_quality(odd, trees).filter("score BETWEEN 0 AND 1").count() == 4
    assert quality.grow(np.zeros((0, 25)), np.zeros(0)) is None and quality.score_quality(odd, None).first()["score"] == 0.5


def test_quality_repeats_and_empty(spark):
    docs = spark.createDataFrame([(i, "good words here. " * (i % 3 + 1) if i % 2 else "zz zz zz") for i in range(60)] * 2 + [(None, "x")], "doc_id long, text string").withColumn("y", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    trees = quality.learn(docs, labels)
    out = quality.score_quality(docs, trees)
    assert out.count() == 121 and out.columns == ["doc_id", "text", "y", "score"]
    assert out.groupBy("text").agg(F.count_distinct("score").alias("n")).filter("n > 1").count() == 0
    assert quality.score_quality(docs.limit(0), trees).count() == 0 and quality.learn(docs.limit(0), labels) is None and quality.learn(docs, labels.limit(0)) is None


def test_trees_score_as_one_by_one():
    """The flattened arrays against a walk down each tree."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    trees = quality.grow(x, (x[:, 1] + x[:, 2] > 0).astype(float))
    inner = trees.feature.shape[1]
    for row, got in zip(x[:50], trees.score(x[:50])):
        raw = trees.base
        for t in range(len(trees.feature)):
            node = 0
            while node < inner:
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.bound[t, node])
            raw += trees.value[t, node - inner]
        assert got == pytest.approx(1 / (1 + np.exp(-raw)))


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.grow(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97


HARD = ["a  b   c\n\n \t é😀 ▁x ▁▁ ", " ", "  lead", "x▁", "\0abc\0", "", "thethethe" * 40 + " " + "x" * 1000, "12 3456"]


def test_pieces_match_the_library_without_dropout():
    import sentencepiece

    v = pieces.load_vocabulary()
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.Encoder(v, dropout=0.0).encode(HARD, [0] * len(HARD))
    for t, ids in zip(HARD, got):
        assert pieces.decode_ids(ids.tolist(), v) == t
        if "▁" not in t:
            assert ids.tolist() == lib.encode(t)


def test_pieces_matrix_equals_heap():
    v = pieces.load_vocabulary()
    units = [" the", " international", "ungheit", "   x", "▁y", "é😀", " " * 20, " Wortzusammensetzung", "9", "\n"]
    flat, size = pieces.Cutter(v, 5, 0.3).cut(units, np.arange(len(units)) % 4)
    ends = np.cumsum(size)
    for i, u in enumerate(units):
        assert flat[ends[i] - size[i] : ends[i]].tolist() == pieces.cut_unit(u, i % 4, v, 5, 0.3)


def test_pieces(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(99, None), (None, "a b"), (0, HARD[0])], "doc_id long, text string").selectExpr("*", "1 as piece_ids", "'d' as decoded", "'k' as _other")
    out = pieces.encoded_with_check(df)
    assert out.count() == len(HARD) + 3 and out.filter("NOT lossless").count() == 0
    same = out.filter("doc_id = 0").select("piece_ids").collect()
    assert same[0] == same[1]
    assert pieces.encoded_with_check(df.limit(0)).count() == 0
    back = pieces.decode(pieces.encode(df))
    assert back.filter("NOT (decoded <=> text)").count() == 0
    text = "international thinking about something " * 40
    one = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    cuts = {tuple(r.piece_ids) for r in pieces.encode(one).collect()}
    other = {tuple(r.piece_ids) for r in pieces.encode(one, seed=6).collect()}
    assert len(cuts) == 6 and not cuts & other and len({tuple(r.piece_ids) for r in pieces.encode(one, dropout=0.0).collect()}) == 1


def plain_cut(unit, draw, v, seed, dropout):
    """Merge-dropout without an agenda: in each step all neighbours are looked at, and of those that have a piece and aren't
    skipped the best, leftmost pair becomes one."""
    from hashlib import blake2b

    word = 1 << 64

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % word
        x = (x ^ x >> 27) * 0x94D049BB133111EB % word
        return x ^ x >> 31

    key = int.from_bytes(blake2b(digest_size=8, key=seed.to_bytes(8, "little", signed=True)).digest(), "little")
    skipped = lambda at, piece: mixed(mixed(key ^ draw) ^ mixed((at * 0x9E3779B97F4A7C15 + v.ids[piece]) % word)) < int(dropout * word)
    parts = [(i, "\u2581" if c == " " else c if c != "\u2581" else "\0\u2581") for i, c in enumerate(unit)]
    while True:
        pairs = [(-v.ranks[a + b], i, n) for n, ((i, a), (_, b)) in enumerate(zip(parts, parts[1:])) if a + b in v.ranks and not skipped(i, a + b)]
        if not pairs:
            break
        _, i, n = min(pairs)
        parts[n : n + 2] = [(i, parts[n][1] + parts[n + 1][1])]
    return [i for _, p in parts for i in ([v.ids[p]] if p in v.ids else [v.bytes[b] for b in p.lstrip("\0").encode()])]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 0.9])
def test_dropout_as_without_an_agenda(dropout):
    v = pieces.load_vocabulary()
    units = [" the", " international", "ungheit", "   x", "\u2581y", "\u00e9\U0001f600", " " * 20, " Wortzusammensetzung", "9", "abababababab", " antidisestablishmentarianism"]
    for seed in (5, -3):
        for draw in range(20):
            for u in units:
                assert pieces.cut_unit(u, draw, v, seed, dropout) == plain_cut(u, draw, v, seed, dropout)


def test_pieces_vary_by_occurrence():
    """Each occurrence has draws of its own: the encoder gives what the heap gives for it, more than four cuts of a word come
    out, and one merge is skipped as often as dropout says."""
    v = pieces.load_vocabulary()
    encoder = pieces.Encoder(v, dropout=0.3)
    for word in (" the", " a", " international", "x" * 40, " y▁é😀"):
        text = word * 300
        units, draws = encoder.units(" " + text), encoder._draws([len(encoder.units(" " + text))], [3])
        cuts = [pieces.cut_unit(u, d, v, 5, 0.3) for u, d in zip(units, draws.tolist())]
        want = [i for c in cuts for i in c]
        assert encoder.encode([text, "a the", text], [3, 4, 3])[2].tolist() == pieces.Encoder(v, dropout=0.3).encode([text], [3])[0].tolist() == want
        if word == " international":
            assert len({tuple(c) for u, c in zip(units, cuts) if u == word}) > 4
    docs = encoder.encode([" a" * 200] * 40, list(range(40)))
    one = v.ids["▁a"]
    assert abs(np.mean([(d == one).sum() / 200 for d in docs]) - 0.7) < 0.02 and len({d.tobytes() for d in docs}) == 40


def brute(vectors, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = (x * x[q]).sum(axis=1) / (n * n[q])
        keep = ids != ids[q]
        out[int(ids[q])] = [int(ids[i]) for i in np.lexsort((ids, -s)) if keep[i]][:k]
    return out


def clustered(n, centers, dim=32, seed=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, dim))
    return (middle[rng.integers(centers, size=n)] + 0.25 * rng.normal(size=(n, dim))).tolist()


def test_share_is_small_for_clusters_and_large_without():
    """Under a tenth of the entries where vectors have clusters."""
    shares = []
    for x in (clustered(4000, 60), np.random.default_rng(9).normal(size=(4000, 32)).tolist()):
        x = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
        rng = np.random.default_rng(1)
        books = ann.Codebooks(32, ann.kmeans(x[:, :16], ann.CENTROIDS, rng), ann.kmeans(x[:, 16:], ann.CENTROIDS, rng))
        shares.append(ann.needed_share(x, books, 5, ann.RECALL))
    assert shares[0] < 0.1 < 0.2 < shares[1] < 1


def test_neighbours_of_clusters(spark):
    rows = [(i, v) for i, v in enumerate(clustered(3000, 50))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute(rows, 5), {}
    for r in ann.search(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(set(want[q]) & got[q]) for q in want) / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_neighbours_recall(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, got = brute(rows, 5), {}
    for r in registry.QUERIES["op7_ann"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = sum(len(set(want[q]) & set(got[q])) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.9


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, float("nan")]), (7, [1.0, None]), (8, [1.0]), (None, [1.0, 1.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as i", "3 as j")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, df.filter("vec_id % 50 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, [0.3, 0.1, 0.7]) for i in range(300)], "vec_id long, embedding array<float>")
    got = ann.search(copies, copies.filter("vec_id = 50")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_neighbours_of_repeated_ids(spark):
    """Of queries that repeat an id one is searched; candidates that repeat one count each."""
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.1]), (1, [2.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 2)]


def words(rng, n):
    return [f"w{int(x)}" for x in rng.integers(4000, size=n)]


def near_classes(texts):
    """Components of order-respecting similarity of 0.8, by comparing all pairs."""
    seqs = []
    for t in texts:
        w = (t or "").lower().split()
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        seen, out = {}, []
        for g in grams:
            seen[g] = seen.get(g, -1) + 1
            out.append((g, seen[g]))
        seqs.append(out)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = seqs[i], seqs[j]
            n = lcs(a, b) if a and b else 0
            if (not a and not b) or (a and b and n / (len(a) + len(b) - n) >= 0.8):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    return comp


def test_near_dedup_by_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(6):
        base = words(rng, 60)
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 4, 9):
            w = list(base)
            for at in rng.integers(60, size=edits):
                w[at] = f"x{int(rng.integers(10**6))}"
            texts.append(" ".join(w))
    texts += ["", None, " \n", "a b", "A  b", "a b c", "one two three four five six", " ".join(words(rng, 3000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "'d' as digest", "1 as row", "2 as n")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    want = near_classes(texts)
    assert got == dict(enumerate(want))
    kept = near_dedup.keep_one_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == df.columns
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_near_dedup_repeats(spark):
    t = "a b c d e f g h i j"
    df = spark.createDataFrame([(2, t), (2, t), (None, t), (1, t + " k")], "doc_id long, text string")
    got = near_dedup.near_duplicates(df)
    assert got.count() == 4 and got.filter("kept").count() == 1 and {r.class_id for r in got.collect()} == {1}
    assert near_dedup.keep_one_of_each(spark.createDataFrame([(2, t), (2, t)], "doc_id long, text string")).count() == 1


def test_near_dedup_of_long_texts(spark):
    """Texts of 12,000 words: a copy with 200 words changed all over is near (some 0.85), one with a third of them is not, and one
    whose halves are exchanged is not, as order counts."""
    rng = np.random.default_rng(12)
    base = words(rng, 12_000)
    few, many = list(base), list(base)
    for at in range(30, 12_000, 60):
        few[at] = f"x{at}"
    for at in range(0, 12_000, 3):
        many[at] = f"y{at}"
    texts = [base, few, many, base[6_000:] + base[:6_000]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_hot_group(spark):
    """A third of all rows in one group of near copies stays one class."""
    rng = np.random.default_rng(5)
    base = words(rng, 80)
    rows = [(i, " ".join(base[:i % 70] + [f"y{i}"] + base[i % 70 + 1 :])) for i in range(150)] + [(1000 + i, " ".join(words(rng, 40))) for i in range(300)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.filter("doc_id < 1000").select("class_id").distinct().count() == 1 and out.filter("class_size = 1").count() == 300


def similarity(a, b):
    """Aligned over all labelled k-mers, by a longest increasing run."""
    from bisect import bisect_left

    def grams(t):
        w, seen, out = t.lower().split(), {}, []
        for g in (tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w):
            seen[g] = seen.get(g, -1) + 1
            out.append((g, seen[g]))
        return out

    x, y = grams(a), grams(b)
    at, tails = {g: i for i, g in enumerate(y)}, []
    for g in x:
        if g in at:
            k = bisect_left(tails, at[g])
            tails[k : k + 1] = [at[g]]
    return len(tails) / max(1, len(x) + len(y) - len(tails))


def test_spread_group(spark):
    """A group whose members are 0.6 to 0.9 alike, in which many links stand near the threshold: as by brute force."""
    rng = np.random.default_rng(12)
    base, spare = words(rng, 100), words(rng, 30)
    texts = []
    for _ in range(260):
        w = list(base)
        for _ in range(int(rng.integers(1, 5))):
            at = int(rng.integers(len(w)))
            w[at : at + 1] = [] if rng.random() < 0.4 else [spare[int(rng.integers(30))]]
        texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    comp = list(range(len(texts)))
    alike = []
    for i in range(len(texts)):
        for j in range(i):
            s = similarity(texts[i], texts[j])
            alike.append(s)
            if s >= 0.8:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    assert 0.1 < np.mean(np.array(alike) >= 0.8) < 0.6 and len(set(comp)) > 10
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(comp))


def test_signatures_bound_the_distance():
    rng = np.random.default_rng(13)
    for n in (20, 200, 2000):
        a = rng.integers(1 << 32, size=n, dtype=np.uint32)
        b = np.concatenate([a[: int(n * 0.9)], rng.integers(1 << 32, size=int(n * 0.15), dtype=np.uint32)])
        differ = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in near_dedup.signature(a) ^ near_dedup.signature(b))
        assert differ <= len(np.setxor1d(a, b))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "pieces"]
    step, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SMALL)
        assert step.columns == docs.columns
        step = step.cache()
        sizes.append(step.count())
    assert sizes[0] <= docs.count() and sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] > 0
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() == sizes[3] and out.filter("NOT lossless").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def naive_language(model, text):
    """A language and its share of the letters, by forward-backward a word at a time."""
    words = language_id.WORD.findall((text or "").lower())
    if not words:
        return "und", 0.0
    e, t = np.exp(language_id.emissions(model, words).astype(float)), np.exp(model.trans)
    fore, back = [], [np.ones(len(model.labels))]
    for i in range(len(words)):
        x = (np.exp(model.start) if i == 0 else fore[-1] @ t) * e[i]
        fore.append(x / x.sum())
    for i in range(len(words) - 1, 0, -1):
        x = t @ (e[i] * back[0])
        back.insert(0, x / x.sum())
    mass = sum(len(w) * (f * g / (f * g).sum()) for w, f, g in zip(words, fore, back))
    return model.labels[int(mass.argmax())], float(mass.max() / mass.sum())


def test_pipeline_stages_by_brute_force(spark):
    """Each stage over what its predecessor keeps, with null ids, null and empty texts, repeats, copies and a clashing column,
    against plain Python or the mixing operator's SQL."""
    import re

    import duckdb

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    some = docs.orderBy("doc_id").limit(120)
    odd = some.limit(6)
    docs = stash(
        some.unionByName(odd).unionByName(odd.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.withColumns({"doc_id": F.col("doc_id") + 10_000, "text": F.concat(F.upper("text"), F.lit(" \t end"))}))
        .unionByName(odd.limit(3).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("une seule phrase sans numero ici et la the and of")}))
        .unionByName(odd.limit(2).withColumns({"doc_id": F.col("doc_id") + 20_000, "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
        .withColumn("digest", F.lit("clash"))
    )
    key = lambda rows: sorted(map(repr, rows))
    rows_in = [tuple(r) for r in docs.collect()]

    model = language_id.learn(docs)
    after = stash(corpus_pipeline.identify_language(spark, docs, SMALL))
    judged = [naive_language(model, r[1]) for r in rows_in]
    kept = [r for r, (lang, share) in zip(rows_in, judged) if lang != "und" and share >= corpus_pipeline.MIN_LANGUAGE_SHARE]
    assert key(map(tuple, after.collect())) == key(kept) and len(kept) < len(rows_in)

    once = {}
    for r in kept:
        text = re.sub("[\\x20\\x09-\\x0D]+", " ", r[1] or "")
        best = once.get(text)
        if best is None or (r[0] is None, r[0] or 0) < (best[0] is None, best[0] or 0):
            once[text] = r
    after = stash(corpus_pipeline.drop_copies(spark, after, SMALL))
    assert key(map(tuple, after.collect())) == key(once.values()) and len(once) < len(kept)

    left = sorted(once.values(), key=lambda r: (r[0] is None, r[0] or 0))
    comp = list(range(len(left)))
    bags = [set(r[1].lower().split()) for r in left]
    for i in range(len(left)):
        for j in range(i):
            if len(bags[i] & bags[j]) * 3 > len(bags[i] | bags[j]) and similarity(left[i][1], left[j][1]) >= 0.8:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    after = stash(corpus_pipeline.drop_near_copies(spark, after, SMALL))
    heads = [left[i] for i in sorted(set(comp))]
    assert key(map(tuple, after.collect())) == key(heads) and len(heads) < len(left)

    con = duckdb.connect()
    documents = after.toArrow()  # noqa: F841  the name of the table in the SQL
    sql = mixing.ORACLE_SQL.replace(f"* {mixing.BUDGET}::DOUBLE", f"* {corpus_pipeline.MIX_BUDGET}::DOUBLE")
    want = sorted((d, c) for d, c in con.sql(f"SELECT doc_id, copies FROM ({sql}) WHERE copies > 0").fetchall() if d is not None)
    mixed = stash(corpus_pipeline.mix_sources(spark, after, SMALL))
    got = sorted(tuple(r) for r in mixed.filter("doc_id IS NOT NULL").groupBy("doc_id").count().collect())
    assert got == want and mixed.columns == docs.columns

    v = pieces.load_vocabulary()
    texts = {(r.doc_id, r.text) for r in mixed.collect()}
    out = corpus_pipeline.encode_pieces(spark, mixed, SMALL).collect()
    assert {(r.doc_id, pieces.decode_ids(r.piece_ids, v)) for r in out} == texts and all(r.lossless and r.n_pieces == len(r.piece_ids) for r in out)


def test_near_dedup_short_texts_are_exact(spark):
    """8 words against 9 are 4 k-mers of 5: a similarity of 0.8."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(0, 600, 2):
        w = words(rng, 9)
        rows += [(i, " ".join(w[:8])), (i + 1, " ".join(w))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_near_dedup_one_shared_sketch(spark):
    """Pairs of 16 and 20 k-mers, similarity 0.8, of whose sketches exactly one is the same."""
    rng, known, rows = np.random.default_rng(7), near_dedup._Hashes(), []
    for _ in range(20_000):
        w = words(rng, 24)
        a, b = (near_dedup.sketches(near_dedup.kmers(np.array([known[x] for x in v], np.uint64))) for v in (w[:20], w))
        if (a == b).sum() == 1:
            rows += [(len(rows), " ".join(w[:20])), (len(rows) + 1, " ".join(w))]
    assert len(rows) >= 10
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_pipeline_keeps_documents_without_ids(spark):
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (1, "a b c d e f g"), (None, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([rows[0], rows[2], rows[3]], key=repr)
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        assert sorted(map(tuple, stage(spark, docs, SMALL).collect()), key=repr) == want
