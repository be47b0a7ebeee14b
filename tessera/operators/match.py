"""Similarity, candidate generation, relationship discovery, entity resolution."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import top_k_per_group
from .shared import checkpoint_folder

#: Queries and vectors that are compared by one product, vectors of a block, what a component adds at most to the error of a product
#: in single precision.
QUERIES_AT_ONCE, VECTORS_AT_ONCE, BLOCK, SINGLE = 256, 2048, 16384, 2.4e-7

LEXICAL = {"levenshtein": 0.25, "jaro_winkler": 0.35, "tokens": 0.25, "substring": 0.15}
# How sure a match by each rule is.
RULE_CONFIDENCE = {"email": 0.95, "phone": 0.90, "ssn": 0.99, "name": 0.70, "address": 0.75, "tax_id": 0.98}


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    hit, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit[j] and b[j] == c:
                hit[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, h in zip(b, hit) if h]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def _jaro_winkler(a: str, b: str) -> float:
    j, prefix = _jaro(a, b), 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return j + prefix * 0.1 * (1 - j)


def _common(a: str, b: str) -> float:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, max(row))
    return best / max(len(a), len(b)) if a or b else 1.0


def _pairwise(f):  # noqa: ANN001, ANN202
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype=float)

    return run


def jaro(a: Column, b: Column) -> Column:
    return _pairwise(_jaro)(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _pairwise(_jaro_winkler)(a, b)


def substring_ratio(a: Column, b: Column) -> Column:
    """The longest common substring over the longer text."""
    return _pairwise(_common)(a, b)


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def ngrams(c: Column, n: int = 3) -> Column:
    s = F.lower(c)
    return F.when(F.char_length(s) < n, F.array(s)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def lexical_similarity(a: Column, b: Column) -> Column:
    w = LEXICAL
    return levenshtein_similarity(a, b) * w["levenshtein"] + jaro_winkler(a, b) * w["jaro_winkler"] + jaccard(tokens(a), tokens(b)) * w["tokens"] + substring_ratio(a, b) * w["substring"]


def tf_vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, term, weight): term counts scaled to length one."""
    words = df.select(key, F.explode(F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("n"))
    norm = words.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return words.join(norm, key).select(key, "term", (F.col("n") / F.col("norm")).alias("weight"))


def _prefixes(vectors: DataFrame, key: str, frequency: DataFrame, least: float) -> DataFrame:
    """(key, term): each vector's rarest terms, as many as leave a rest that is shorter than ``least``."""
    w = Window.partitionBy(key).orderBy("f", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(w))  # of this term and all that are more frequent
    return vectors.join(frequency, "term").withColumn("rest", rest).filter(F.col("rest") >= least - 1e-9).select(key, "term")


def tf_cosine(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float = 0.3) -> DataFrame:
    """(left_key, right_key, cosine) of term vectors of length one whose cosine is ``least`` (over 0) or more.

    Vectors meet by their rare terms only: of two such vectors each holds, among its rarest terms, one that the other holds
    among its own, as the rest of a vector is shorter than ``least``. So a word that all texts have joins nothing."""
    if least <= 0:
        raise ValueError("least must be over 0")
    frequency = left.select("term").unionByName(right.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("f"))
    pairs = _prefixes(left, left_key, frequency, least).join(_prefixes(right, right_key, frequency, least), "term").select(left_key, right_key).distinct()
    both = pairs.join(left.select(left_key, "term", F.col("weight").alias("w1")), left_key).join(right.select(right_key, "term", F.col("weight").alias("w2")), [right_key, "term"])
    return both.groupBy(left_key, right_key).agg(F.sum(F.col("w1") * F.col("w2")).alias("cosine")).filter(F.col("cosine") >= least - 1e-12)


def statistical_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_column, b_column, similarity) of numeric profiles: .4 cardinality, .2 nulls, .4 overlap of ranges. Profiles have
    a row for each column, so the pairs are few."""
    x = a.select(F.col("column").alias("a_column"), F.col("cardinality").alias("c1"), (F.col("null_percent") / 100).alias("n1"), F.col("smallest").try_cast("double").alias("lo1"), F.col("largest").try_cast("double").alias("hi1"))
    y = b.select(F.col("column").alias("b_column"), F.col("cardinality").alias("c2"), (F.col("null_percent") / 100).alias("n2"), F.col("smallest").try_cast("double").alias("lo2"), F.col("largest").try_cast("double").alias("hi2"))
    overlap = F.greatest(F.lit(0.0), F.least("hi1", "hi2") - F.greatest("lo1", "lo2"))
    span = F.greatest("hi1", "hi2") - F.least("lo1", "lo2")
    ranges = F.coalesce(F.when(span == 0, 1.0).otherwise(overlap / span), F.lit(0.0))
    return x.join(y).select("a_column", "b_column", ((1 - F.abs(F.col("c1") - F.col("c2"))) * 0.4 + (1 - F.abs(F.col("n1") - F.col("n2"))) * 0.2 + ranges * 0.4).alias("similarity"))


def map_fields(left: DataFrame, right: DataFrame, k: int = 3) -> DataFrame:
    """The k best target fields of each source field by name, with confidence and category. Both have a ``field`` column of
    names; all of one meet all of the other, which is meant for schemas. Spark broadcasts a side only if it is small."""
    pairs = left.select(F.col("field").alias("source")).join(right.select(F.col("field").alias("target")))
    scored = pairs.withColumn("confidence", lexical_similarity(F.col("source"), F.col("target")))
    best = top_k_per_group(scored, ["source"], [F.desc(F.round("confidence", 9)), F.col("target")], k)
    return best.withColumn("category", F.when(F.col("confidence") >= 0.9, "auto").when(F.col("confidence") >= 0.7, "recommended").otherwise("possible"))


def value_overlap(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(left_column, right_column, common, left_distinct, right_distinct): distinct values that columns of different tables
    share, by one grouping of (value, column). Columns are few; values are many."""
    from .profile import unpivot

    every = None
    for name, (df, columns) in tables.items():
        part = unpivot(df, columns).filter("value IS NOT NULL").distinct().select(F.lit(name).alias("t"), F.concat(F.lit(f"{name}."), "column").alias("column"), "value")
        every = part if every is None else every.unionByName(part)
    sizes = every.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    holders = every.groupBy("value").agg(F.array_sort(F.collect_set(F.struct("column", "t"))).alias("h"))  # at most the number of columns
    pairs = holders.filter(F.size("h") > 1).select(F.explode("h").alias("a"), "h").select("a", F.explode("h").alias("b")).filter((F.col("a.column") < F.col("b.column")) & (F.col("a.t") != F.col("b.t")))
    counts = pairs.groupBy(F.col("a.column").alias("left_column"), F.col("b.column").alias("right_column")).agg(F.count(F.lit(1)).alias("common"))
    return counts.join(sizes.select(F.col("column").alias("left_column"), F.col("n").alias("left_distinct")), "left_column").join(sizes.select(F.col("column").alias("right_column"), F.col("n").alias("right_distinct")), "right_column")


# How sure equal kinds of two columns make a relation; others 0.8.
KIND_CONFIDENCE = {"customer_id": 0.95, "order_number": 0.95, "invoice_number": 0.95, "uuid": 0.85}


def discover_relationships(overlaps: DataFrame, least: float = 0.6, kinds: DataFrame | None = None) -> DataFrame:
    """Pairs whose overlap with the smaller column (weight 1.5), names (weight 1) and, where both are of one semantic kind in
    ``kinds`` (column, kind), that kind (weight .8) reach ``least``, and what the overlap says of the relation: equal sets are
    1:1, a contained side is a reference."""
    share = F.col("common") / F.least("left_distinct", "right_distinct")
    name = levenshtein_similarity(F.substring_index("left_column", "_", -1), F.substring_index("right_column", "_", -1))
    kind = F.when((F.col("common") == F.col("left_distinct")) & (F.col("common") == F.col("right_distinct")), "1:1").when(F.col("common") == F.col("left_distinct"), "left references right").when(F.col("common") == F.col("right_distinct"), "right references left").otherwise("N:M")
    score = (share * 1.5 + name) / 2.5
    if kinds is not None:
        of = lambda side: kinds.select(F.col("column").alias(f"{side}_column"), F.col("kind").alias(f"_{side}"))
        overlaps = overlaps.join(of("left"), "left_column", "left").join(of("right"), "right_column", "left")
        sure = F.coalesce(*[F.when(F.col("_left") == k, F.lit(c)) for k, c in KIND_CONFIDENCE.items()], F.lit(0.8))
        score = F.when(F.col("_left") == F.col("_right"), (share * 1.5 + name + sure * 0.8) / 3.3).otherwise(score)
    return overlaps.withColumns({"confidence": score, "kind": kind}).drop("_left", "_right").filter(F.col("confidence") >= least)


def column_cardinality(df: DataFrame, a: str, b: str) -> DataFrame:
    """1:1, 1:N, N:1 or N:M between two columns, by whether each is unique (over .95)."""
    u = df.agg((F.count_distinct(a) / F.count(a)).alias("ua"), (F.count_distinct(b) / F.count(b)).alias("ub"))
    one = lambda c: F.when(F.col(c) > 0.95, "1")
    return u.select("ua", "ub", F.concat(F.coalesce(one("ua"), F.lit("N")), F.lit(":"), F.coalesce(one("ub"), F.when(F.col("ua") > 0.95, "N").otherwise("M"))).alias("kind"))


def candidates(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(a, b, rule, confidence): each row with the first row (least key) of its block of equal normalised value, for each
    rule. Such stars connect a block as all its pairs would, and grow with it."""
    out = None
    for rule, value in rules.items():
        v = F.lower(F.trim(value.cast("string")))
        rows = df.select(F.col(key).alias("b"), v.alias("v")).filter(v.isNotNull() & (v != ""))
        first = rows.groupBy("v").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        part = rows.join(first, "v").filter("a != b").select("a", "b", F.lit(rule).alias("rule"), F.lit(RULE_CONFIDENCE.get(rule, 0.8)).alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out


#: Blocks of more distinct texts than this are joined by segments.
SMALL_BLOCK = 64


def _segment_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, left, right) of texts of a block that may be within ``threshold`` by Levenshtein similarity.

    Texts of lengths L <= m that are similar are within K = (1 - threshold) * m edits. Of K + 1 segments of the shorter one
    at least one is whole in the longer one, moved by no more than the edits before and after it allow: segments are keys."""
    rate, size = 1 - threshold, F.char_length("text")
    edits = lambda m: F.floor(m * rate + 1e-9).cast("int")
    start = "cast(floor(i * l / (k + 1)) as int)"
    end = "cast(floor((i + 1) * l / (k + 1)) as int)"
    key = ["block", "l", "k", "i", "segment"]
    parts = texts.withColumn("l", size).withColumn("k", F.explode(F.sequence(edits(F.col("l")), edits(F.floor(F.col("l") / threshold + 1e-9)))))
    parts = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).select("block", "l", "k", "i", F.expr(f"substring(text, {start} + 1, {end} - {start})").alias("segment"), F.col("key").alias("x"), F.col("text").alias("left"))
    asks = texts.withColumn("m", size).withColumn("k", edits(F.col("m"))).withColumn("l", F.explode(F.sequence(F.col("m") - F.col("k"), F.col("m"))))
    asks = asks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    low, high = F.expr(f"greatest({start} + greatest(-i, m - l - k + i), 0)"), F.expr(f"least({start} + least(i, m - l + k - i), m - ({end} - {start}))")
    asks = asks.withColumns({"low": low, "high": high}).filter("low <= high").withColumn("p", F.explode(F.sequence("low", "high")))
    asks = asks.select("block", "l", "k", "i", F.expr(f"substring(text, p + 1, {end} - {start})").alias("segment"), F.col("key").alias("y"), F.col("text").alias("right")).distinct()
    met = parts.join(asks, key).filter((F.col("x") != F.col("y")) & ((F.char_length("left") < F.char_length("right")) | (F.col("x") < F.col("y"))))
    turned = F.col("x") < F.col("y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(turned, F.col("left")).otherwise(F.col("right")).alias("left"), F.when(turned, F.col("right")).otherwise(F.col("left")).alias("right"))


def fuzzy_pairs(df: DataFrame, key: str, column: str, block: Column, threshold: float, similarity=levenshtein_similarity) -> DataFrame:  # noqa: ANN001
    """(a, b, similarity) of the least rows of a block's distinct texts that are similar, ``threshold`` (over 0) or more.

    By Levenshtein similarity the texts of a block of more than SMALL_BLOCK meet by shared segments only. Other similarities
    have no such bound: all distinct texts of a block meet, so blocks should be fine (:func:`soundex_block`)."""
    texts = df.select(F.col(column).alias("text"), block.alias("block"), F.col(key).alias("k")).filter(F.col(column).isNotNull() & F.col("block").isNotNull()).groupBy("block", "text").agg(F.min("k").alias("key"))
    out = lambda pairs: pairs.select("a", "b", similarity(F.col("left"), F.col("right")).alias("similarity")).filter(F.col("similarity") >= threshold)

    def all_pairs(t: DataFrame) -> DataFrame:
        a, b = t.alias("a"), t.alias("b")
        met = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.key") < F.col("b.key")))
        return met.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), F.col("a.text").alias("left"), F.col("b.text").alias("right"))

    if similarity is not levenshtein_similarity or not 0 < threshold <= 1:
        return out(all_pairs(texts))
    large = texts.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SMALL_BLOCK).select("block")
    few, many = texts.join(large, "block", "left_anti"), texts.join(large, "block", "left_semi")
    return out(all_pairs(few)).unionByName(out(_segment_pairs(many, threshold)).distinct())


def soundex_block(column: str) -> Column:
    """The Soundex code of a text's letters: a block for names that sound alike."""
    return F.soundex(F.regexp_replace(F.col(column), "[^A-Za-z]", ""))


def connected_components(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node that a, b links reach. Labels spread and jump until nothing changes; each round is
    checkpointed, so a lost executor costs a round and the plan stays short."""
    checkpoint_folder(pairs.sparkSession)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "component", F.least("component", F.coalesce("m", "component")).alias("next"))
        jump = step.join(labels.select(F.col("node").alias("next"), F.col("component").alias("far")), "next", "left")
        grown = jump.select("node", F.least("next", F.coalesce("far", "next")).alias("now"), "component").checkpoint()
        labels = grown.select("node", F.col("now").alias("component"))
        if not grown.filter("now != component").take(1):
            break
    if nodes is not None:
        labels = nodes.select("node").distinct().join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return labels


def fuse(df: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """(entity, sources): merged entities, the least id survives; sources are sorted."""
    of = connected_components(pairs, df.select(F.col(key).alias("node")))
    return of.groupBy(F.col("component").alias("entity")).agg(F.array_sort(F.collect_list("node")).alias("sources"))


def unreviewed(found: DataFrame, decided: DataFrame) -> DataFrame:
    """Candidates that have no decision yet, whichever way round."""
    pair = lambda df: df.withColumns({"_l": F.least("a", "b"), "_h": F.greatest("a", "b")})
    return pair(found).join(pair(decided).select("_l", "_h"), ["_l", "_h"], "left_anti").drop("_l", "_h")


def decide(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with the status of their decision (``pending`` without one)."""
    return found.join(decisions.select("a", "b", "status"), ["a", "b"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.try_divide(dot, norm(a) * norm(b))


def _nearest(k: int, least: float):  # noqa: ANN202
    """The pairs of a block of queries and a block of vectors that may be among the first k, and reach ``least``: products in single
    precision against the k-th best so far, with room for their error, then in the order in which Spark and SQL add up."""

    def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a))
        for c in range(a.shape[1]):
            out += a[:, c] * b[:, c]
        return out

    def run(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"_q": np.zeros(0, np.int64), "_v": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        if not len(queries) or not len(vectors):
            return none.astype({"_q": object, "_v": object})  # keys of any type
        q, v = np.array(queries["x"].tolist(), np.float64), np.array(vectors["x"].tolist(), np.float64)
        nq, nv = np.sqrt(in_order(q, q)), np.sqrt(in_order(v, v))
        single_q, single_v = (q / nq[:, None]).astype(np.float32), (v / nv[:, None]).astype(np.float32).T.copy()
        q_id, v_id, room = queries["id"].to_numpy(), vectors["id"].to_numpy(), (q.shape[1] + 4) * SINGLE
        kept = []
        for s in range(0, len(q), QUERIES_AT_ONCE):
            rows = slice(s, s + QUERIES_AT_ONCE)
            best, part = np.full(len(q_id[rows]), least), none
            for w in range(0, len(v), VECTORS_AT_ONCE):
                close = single_q[rows] @ single_v[:, w : w + VECTORS_AT_ONCE]
                if w == 0 and k < close.shape[1]:
                    close[q_id[rows][:, None] == v_id[None, :VECTORS_AT_ONCE]] = -2
                    best = np.maximum(best, np.partition(close, -k, axis=1)[:, -k] - room)
                i, j = np.nonzero(close >= (best - room).astype(np.float32)[:, None])
                i, j = i + s, j + w
                score = np.concatenate([np.zeros(0)] + [in_order(q[i[p : p + 65536]], v[j[p : p + 65536]]) / (nq[i[p : p + 65536]] * nv[j[p : p + 65536]]) for p in range(0, len(i), 65536)])
                ok = (score >= least) & (q_id[i] != v_id[j])
                part = pd.concat([part, pd.DataFrame({"_q": i[ok], "_v": j[ok], "similarity": score[ok]})])
                if len(part) > k:
                    part = part.assign(id=v_id[part["_v"]]).sort_values(["_q", "similarity", "id"], ascending=[True, False, True]).drop(columns="id")
                    part = part[part.groupby("_q").cumcount() < k]
                    full = part.groupby("_q")["similarity"].agg(["size", "min"])
                    full = full[full["size"] == k]
                    best[full.index.to_numpy() - s] = full["min"].to_numpy()
            kept.append(part)
        out = pd.concat(kept)
        return pd.DataFrame({"_q": q_id[out["_q"]], "_v": v_id[out["_v"]], "similarity": out["similarity"]})

    return run


def vector_top_k(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, least: float = -1.0, block: int = 8192) -> DataFrame:
    """(query, key, similarity, rank): a stated set of queries against all vectors. Both are dealt into blocks, and each
    block of at most some ``block`` queries meets each block of vectors in one task, as one product, so neither side is broadcast.
    Vectors that are null, zero or hold a null or non-finite component have no cosine, nor have two of different lengths."""
    from .vectors import usable

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = lambda df: df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")).filter(F.col("id").isNotNull() & usable(F.col("x"))).withColumn("n", F.size("x"))
    q, v = shape(queries), shape(vectors)
    blocks, parts = -(-q.count() // block) or 1, max(parts, -(-vectors.count() // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("j", every(parts))
    v = v.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("i", every(blocks))
    kind = vectors.schema[key].dataType.simpleString()
    scored = q.groupBy("i", "j", "n").cogroup(v.groupBy("i", "j", "n")).applyInPandas(_nearest(k, least), f"_q {kind}, _v {kind}, similarity double")
    return top_k_per_group(scored.select(F.col("_q").alias("query"), F.col("_v").alias(key), "similarity"), ["query"], [F.desc("similarity"), F.col(key)], k)


def match_schemas(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """(source, target, confidence, conversion) of two sources' fields, (field, type) rows: the best target by name, with
    what a conversion of the types is: safe, lossy or invalid."""
    from .rows import CONVERSIONS

    best = map_fields(left.select("field"), right.select("field"), 1).filter(F.col("confidence") >= least)
    typed = best.join(left.select(F.col("field").alias("source"), F.col("type").alias("_a")), "source").join(right.select(F.col("field").alias("target"), F.col("type").alias("_b")), "target")
    verdict = F.when(F.col("_a") == F.col("_b"), "safe")
    for (a, b), v in CONVERSIONS.items():
        verdict = verdict.when((F.col("_a") == a) & (F.col("_b") == b), v)
    return typed.select("source", "target", "confidence", verdict.otherwise("invalid").alias("conversion"))


def term_candidates(fields: DataFrame, terms: DataFrame, manual: DataFrame | None = None, k: int = 3) -> DataFrame:
    """(field, term, confidence, origin): the k best ontology terms (term, label, synonyms) of each field: the mean of name,
    token and n-gram similarity to the label or a synonym; a manual mapping (field, term) goes before all."""
    names = terms.select("term", F.explode(F.array_union(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"))
    pairs = fields.select("field").distinct().join(names)
    a, b = F.lower("field"), F.lower("name")
    score = (levenshtein_similarity(a, b) + jaccard(tokens(a), tokens(b)) + jaccard(ngrams(a), ngrams(b))) / 3
    best = pairs.groupBy("field", "term").agg(F.max(score).alias("confidence")).withColumn("origin", F.lit("similarity"))
    if manual is not None:
        best = best.join(manual.select("field", "term"), ["field", "term"], "left_anti").unionByName(manual.select("field", "term", F.lit(1.0).alias("confidence"), F.lit("manual").alias("origin")))
    return top_k_per_group(best, ["field"], [F.desc(F.col("origin") == "manual"), F.desc("confidence"), F.col("term")], k)
