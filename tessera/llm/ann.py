"""Operator 7: approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half has a codebook, and a vector's cell is its pair of nearest
centroids. A query walks the cells by summed distance with a heap until they hold a given share of all entries, and the
entries there are reranked by exact cosine. The share is learned with the codebooks: as much as a wanted recall needs on a
bounded sample, little where vectors have clusters and a lot where they have none. Cells are grouped by the first centroid; a group's entries and the queries
that visit it meet in blocks of bounded size, whatever the size of a cell."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

#: Centroids of a half (a query's cells in a group are a 64-bit mask), vectors that the codebooks are learned from, rounds.
CENTROIDS, SAMPLE, ROUNDS, SEED = 64, 8_192, 10, 3
#: Share of the true neighbours in the sample that a walk must reach, and how many of its vectors are asked for that.
#: README has the recall measured against brute force.
RECALL, PROBES = 0.96, 512
NEIGHBOURS = 5
#: Entries and queries that meet in one block.
ENTRY_BLOCK, QUERY_BLOCK, ROWS_AT_ONCE = 8_192, 2_048, 128
#: Queries that walk the cells in one task.
WALKS = 256


@dataclass
class Codebooks:
    dim: int
    first: np.ndarray
    second: np.ndarray
    share: float = 1.0  # of all entries, which a query visits


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    x = np.unique(x, axis=0)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centers).argmin(axis=1)
        for j in range(len(centers)):
            if (near == j).any():
                centers[j] = x[near == j].mean(axis=0)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances but for the length of x."""
    return (centers**2).sum(axis=1) - 2 * x @ centers.T


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(whole, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(vectors.tolist(), np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    return x, norm


def needed_share(x: np.ndarray, books: Codebooks, k: int, recall: float) -> float:
    """Share of the unit vectors ``x`` that walks must visit to reach ``recall`` of the ``k`` nearest of PROBES of them."""
    if len(x) < 2:
        return 1.0
    asked = np.arange(len(x))[:: -(-len(x) // PROBES)]
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(x) - 1)
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    half = (books.dim + 1) // 2
    d1, d2 = nearest(x[:, :half], books.first), nearest(x[:, half:], books.second)
    i, j = d1.argmin(axis=1), d2.argmin(axis=1)
    before = []
    for q, own in zip(asked, top):
        cell = d1[q, i] + d2[q, j]
        before.append(np.searchsorted(np.sort(cell), cell[own], side="left"))  # entries in cells that come earlier
    return min(1.0, (float(np.quantile(np.concatenate(before), recall, method="higher")) + 1) / len(x))


def learn(vectors: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, k: int = NEIGHBOURS, recall: float = RECALL) -> Codebooks | None:
    """Codebooks and share from at most about ``sample`` of the (id, vector) rows; None if there are none."""
    n = vectors.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1_000_000))
    rows = vectors.filter(draw < int(1_000_000 * min(1.0, sample / n)) + 1).orderBy("id").limit(2 * sample).collect() or vectors.limit(sample).collect()
    x = np.array([r.vector for r in rows], np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    half, rng = (x.shape[1] + 1) // 2, np.random.default_rng(SEED)
    books = Codebooks(x.shape[1], kmeans(x[:, :half], centroids, rng), kmeans(x[:, half:], centroids, rng))
    books.share = needed_share(x, books, k, recall)
    return books


def visit(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, wanted: float) -> np.ndarray:
    """Masks of the second centroids to visit for each first one: cells in order of d1 + d2 until they hold ``wanted``
    entries."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    masks, have = [0] * len(d1), 0
    heap, seen = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}
    while heap and have < wanted:
        _, a, b = heappop(heap)
        i, j = int(o1[a]), int(o2[b])
        masks[i] |= 1 << j
        have += int(counts[i, j])
        for c, d in ((a + 1, b), (a, b + 1)):
            if c < len(o1) and d < len(o2) and (c, d) not in seen:
                seen.add((c, d))
                heappush(heap, (d1[o1[c]] + d2[o2[d]], c, d))
    return np.array([m - (1 << 64) if m >> 63 else m for m in masks], np.int64)


def build_index(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The (id, vector) rows with their cell, (i, j)."""

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (books.dim + 1) // 2
        for pdf in frames:
            if len(pdf):
                x, norm = _unit(pdf["vector"])
                x /= norm[:, None]
                yield pdf.assign(i=nearest(x[:, :half], books.first).argmin(axis=1).astype(np.int32), j=nearest(x[:, half:], books.second).argmin(axis=1).astype(np.int32))

    return vectors.mapInPandas(cells, "id long, vector array<double>, i int, j int")


def _block(key: tuple, entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The best entries of a block for each of its queries."""
    none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    if not len(entries) or not len(queries):
        return none
    entries = entries.sort_values("id", kind="stable")
    y, ny = _unit(entries["vector"])
    x, nx = _unit(queries["vector"])
    ids, cell, k = entries["id"].to_numpy(), entries["j"].to_numpy().astype(np.uint64), int(queries["k"].iloc[0])
    masks, own, out = queries["mask"].to_numpy().astype(np.int64).view(np.uint64), queries["id"].to_numpy(), []
    for a in range(0, len(x), ROWS_AT_ONCE):
        b = a + ROWS_AT_ONCE
        rough = (x[a:b] / nx[a:b, None]) @ (y / ny[:, None]).T
        meets = ((masks[a:b, None] >> cell[None, :]) & np.uint64(1)).astype(bool) & (own[a:b, None] != ids[None, :])
        rough[~meets] = -np.inf
        bar = np.partition(rough, max(0, len(y) - k), axis=1)[:, max(0, len(y) - k)]
        q, e = np.nonzero(meets & (rough >= bar[:, None] - 1e-9))
        score = np.concatenate([(x[a + q[s : s + 65536]] * y[e[s : s + 65536]]).sum(axis=1) / (nx[a + q[s : s + 65536]] * ny[e[s : s + 65536]]) for s in range(0, len(q), 65536)] or [np.zeros(0)])
        order = np.lexsort((ids[e], -score, q))
        q, e, score = q[order], e[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        top = place < k
        out.append(pd.DataFrame({"query_id": own[a + q[top]], "vec_id": ids[e[top]], "score": score[top]}))
    return pd.concat(out) if out else none


def search(base: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """For each query its ``k`` nearest found by cosine, in double precision: query_id, rank (from 1), vec_id, score;
    nearest first, ties to the smaller id. All candidates if there are fewer. A walk ends when its cells hold the share of the
    entries that :func:`learn` found for ``recall``, and ``k`` + 1 entries at least.

    Both tables have ``id_col`` and ``vector_col``; a candidate with the query's id is its own and left out. Vectors that
    are null, empty, zero, or hold a null or non-finite component, take no part, nor do rows without an id or with
    another number of components than most rows have. Of queries that repeat an id one is searched; candidates that repeat
    one count each. Other columns are ignored; empty tables give an empty result."""
    spark = base.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"

    def plain(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))

    every = plain(base)
    sizes = every.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    every = every.filter(F.size("vector") == sizes["n"])
    books = learn(every, sample, k=k, recall=recall)
    index = stash(build_index(every, books), "index")
    counts = np.zeros((len(books.first), len(books.second)), np.int64)
    for r in index.groupBy("i", "j").count().collect():  # at most CENTROIDS squared
        counts[r["i"], r["j"]] = r["count"]
    total = int(counts.sum())
    asked = plain(queries).filter(F.size("vector") == sizes["n"]).groupBy("id").agg(F.min("vector").alias("vector"))
    n_queries = asked.count()
    asked = asked.repartition(max(1, -(-n_queries // WALKS)), "id")
    q_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    e_blocks = np.maximum(1, -(-counts.sum(axis=1) // ENTRY_BLOCK)).tolist()

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (books.dim + 1) // 2
        for pdf in frames:
            if not len(pdf):
                continue
            x, norm = _unit(pdf["vector"])
            x /= norm[:, None]
            d1, d2 = nearest(x[:, :half], books.first), nearest(x[:, half:], books.second)
            masks = np.stack([visit(a, b, counts, max(books.share * total, k + 1)) for a, b in zip(d1, d2)])
            q, i = np.nonzero(masks)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[q], "vector": [pdf["vector"].iloc[r] for r in q], "i": i.astype(np.int32), "mask": masks[q, i]})

    visits = asked.mapInPandas(walk, "id long, vector array<double>, i int, mask long")
    of_group = F.element_at(F.array(*[F.lit(int(n)) for n in e_blocks]), F.col("i") + 1)
    blocks = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = index.withColumn("eb", F.pmod(F.xxhash64("id"), of_group).cast("int")).withColumn("qb", blocks(F.lit(q_blocks)))
    right = visits.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("eb", blocks(of_group)).withColumn("k", F.lit(k))
    found = left.groupBy("i", "eb", "qb").cogroup(right.groupBy("i", "eb", "qb")).applyInPandas(_block, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`search` of ``embeddings`` for the rows whose vec_id 50 divides: query_id, rank, vec_id, score."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 50 = 0"))
