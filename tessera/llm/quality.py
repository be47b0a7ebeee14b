"""Operator 2: a quality classifier, histogram gradient-boosted trees over statistics of a text.

Trees are complete and flattened into arrays, so that all rows walk down all trees by numpy indexing."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, sampled, table

#: At most about this many labelled rows of each class are learned from.
ROWS_PER_CLASS = 8_000
SEED, TREES, DEPTH, BINS, RATE, SMOOTH, LEAST = 23, 80, 4, 64, 0.15, 1.0, 8.0
THRESHOLD = 0.3
STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "top_three_words", "repeats_next", "distinct_pairs", "lines", "distinct_lines",
    "line_length", "letters", "upper", "digits", "spaces", "stops", "pipes_and_brackets", "other_marks", "high_bytes", "byte_entropy", "sentence_ends", "upper_words", "short_words", "singletons",
)
#: Byte classes: 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence marks, 6 pipes and brackets, 7 other ASCII, 8 beyond.
CLASS = np.full(256, 7, np.int64)
for _k, _chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t\n\r\f\v"), (5, b".,;:!?"), (6, b"|<>{}[]()=/\\#*_~^&@$%+")):
    CLASS[list(_chars)] = _k
CLASS[128:] = 8


def statistics(text: str) -> list[float]:
    """STATISTICS of a whole text; all 0 for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [math.log1p(len(text))] + [0.0] * (len(STATISTICS) - 1)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    size = np.fromiter(map(len, words), np.float64, n)
    lines = text.split("\n")
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    kinds = np.bincount(CLASS, raw, 9)
    total = raw.sum()
    share = raw[raw > 0] / total
    return [
        math.log1p(len(text)), math.log1p(n), float(size.mean()), float(size.std()), len(counts) / n, top[0] / n, sum(top) / n,
        sum(map(eq, words, words[1:])) / n, len(set(zip(words, words[1:]))) / n, len(lines) / n, len(set(lines)) / len(lines), len(text) / len(lines),
        kinds[1] / total, kinds[2] / total, kinds[3] / total, kinds[4] / total, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[8] / total, float(-(share * np.log2(share)).sum()),
        sum(line.rstrip().endswith((".", "!", "?")) for line in lines) / len(lines), sum(map(str.isupper, words)) / n, float((size <= 2).mean()), sum(c == 1 for c in counts.values()) / n,
    ]


@dataclass
class Trees:
    """Inner node i of a tree has the children 2i+1 and 2i+2; its leaves follow the inner nodes."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    bound: np.ndarray  # the same: larger values go right
    value: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), np.int64)
        trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.bound[trees, node])
        return 1 / (1 + np.exp(-(self.base + self.value[trees, node - (2**DEPTH - 1)].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray) -> Trees | None:
    """Boosts complete trees on the logistic loss, level by level, from histograms of binned values."""
    if not len(y):
        return None
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = math.log(rate / (1 - rate))
    inner = 2**DEPTH - 1
    feature, bound, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    raw = np.full(n, base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(DEPTH):
            width, first = 2**d, 2**d - 1
            best, choice = np.full(width, 1e-6), np.full((width, 2), -1)
            for j in range(m):
                at = (node - first) * BINS + binned[:, j]
                gs = np.bincount(at, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(at, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + SMOOTH) + (gt - gs) ** 2 / (ht - hs + SMOOTH) - gt**2 / (ht + SMOOTH)
                gain[(hs < LEAST) | (ht - hs < LEAST)] = 0
                gain[:, len(cuts[j]) :] = 0
                k = gain.argmax(axis=1)
                better = gain[np.arange(width), k] > best
                best[better], choice[better] = gain[np.arange(width), k][better], np.stack([np.full(width, j), k], axis=1)[better]
            for i, (j, k) in enumerate(choice):
                if j >= 0:
                    feature[t, first + i], bound[t, first + i] = j, cuts[j][k]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > bound[t, node])
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + SMOOTH)
        raw += value[t, leaf]
    return Trees(base, feature, bound, value)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``stats``, an array of STATISTICS; null counts as empty."""

    @F.pandas_udf("array<double>")
    def measure(text: pd.Series) -> pd.Series:
        return pd.Series([statistics(t if isinstance(t, str) else "") for t in text], dtype=object)

    return docs.withColumn("stats", measure(F.col(text_col)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = ROWS_PER_CLASS) -> Trees | None:
    """Trees from a bounded sample of the labelled rows that are not held out; None if there is none."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("y").isin(0, 1))
    chosen = F.broadcast(sampled(known, "y", per_class, F.col("id"), SEED))  # bounded by per_class
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    rows = measured(texts).select("id", "y", "stats").collect()
    rows.sort(key=lambda r: (r.id, r.y, r.stats))
    return grow(np.array([r.stats for r in rows], float).reshape(len(rows), len(STATISTICS)), np.array([r.y for r in rows], float))


def score_quality(docs: DataFrame, trees: Trees | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 (0.5 without trees), replacing a column of that name.

    Only the text counts; null counts as empty. Rows stay as they are; an empty table gives an empty result."""
    base = docs.drop("score")
    if trees is None:
        return base.withColumn("score", F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        parts = [shared.value.score(np.array([statistics(t if isinstance(t, str) else "") for t in text[i : i + 1000]], float)) for i in range(0, len(text), 1000)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return base.withColumn("score", score(F.col(text_col)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`score_quality` of ``documents``: doc_id, held_out, score, predicted. Null texts count as empty; every row has a
    score."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs.select("doc_id", "text"), learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
