"""Operator 9: mixing sources to target weights by hierarchical budgets (native DataFrame operations only).

A token budget goes down a tree (domain, language, source). Each node shares its budget among its children by weight;
a child that cannot use its share, all its tokens times ``max_epochs``, leaves the shortage to its siblings, and only
what a whole subtree cannot use reaches the siblings of its ancestors. A leaf repeats whole epochs of its documents
while its budget lasts, then takes the prefix of one more epoch, in that epoch's seeded order, that still fits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

LEVELS = ("domain", "lang", "source")
#: Weight of a node by its path; a node that is not named has weight 1.
WEIGHTS: dict[tuple[str, ...], float] = {
    ("family-0",): 4.0, ("family-1",): 3.0, ("family-2",): 2.0, ("family-3",): 1.0,
    **{(f"family-{i}", lang): w for i in range(4) for lang, w in (("en", 4.0), ("de", 2.0), ("fr", 2.0), ("es", 2.0))},
    **{("family-0", lang, "src0"): 0.25 for lang in ("en", "de", "fr", "es")},
}
BUDGET, MAX_EPOCHS, SEED = 0.6, 3, 17
#: Leaves up to this number are broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_family(source: Column) -> Column:
    """The domain that stands for a source: the remainder of its number by four."""
    return F.concat(F.lit("family-"), F.coalesce(F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]+)$", 1).try_cast("bigint") % 4, F.lit(0)).cast("string"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, doc_id).cast("binary"))


def path_columns(levels: Sequence[str]) -> list[Column]:
    """Nulls count as empty text."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"p{i}") for i, c in enumerate(levels)]


def leaf_budgets(leaves: DataFrame, depth: int, weights: Mapping[tuple[str, ...], float], budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` has p0..p(depth-1) and tokens; adds ``target``, the leaf's budget in whole tokens.

    Capacities are summed up level by level and budgets handed down; a window is over one node's children only."""
    path = [f"p{i}" for i in range(depth)]

    def weight(d: int) -> Column:
        own = {k: v for k, v in weights.items() if len(k) == d}
        if not own:
            return F.lit(1.0)
        known = F.create_map(*[F.lit(x) for k, v in own.items() for x in ("\x1f".join(k), float(v))])
        return F.coalesce(known[F.concat_ws("\x1f", *path[:d])], F.lit(1.0))

    alive = F.lit(True)
    for d in range(1, depth + 1):
        alive = alive & (weight(d) > 0)
    caps = {depth: leaves.select(*path, F.when(alive, F.col("tokens") * F.lit(float(max_epochs))).otherwise(0.0).alias("cap"))}
    for d in range(depth - 1, 0, -1):
        caps[d] = caps[d + 1].groupBy(*path[:d]).agg(F.sum("cap").alias("cap"))
    above = None
    for d in range(1, depth + 1):
        nodes = caps[d].withColumn("w", weight(d))
        nodes = nodes.withColumn("b", budget.cast("double")) if above is None else nodes.join(above, path[: d - 1])
        nodes = nodes.withColumn("ratio", F.coalesce(F.try_divide("cap", "w"), F.lit(0.0)))
        siblings = Window.partitionBy(*path[: d - 1])
        ranked = siblings.orderBy("ratio", *path[:d])
        before = F.coalesce(F.sum("cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("w").over(ranked.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("full", F.coalesce(F.col("ratio") <= F.try_divide(F.col("b") - before, rest), F.lit(True)))
        used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(siblings)
        free = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(siblings)
        share = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.try_divide(F.col("b") - used, free))
        above = nodes.select(*path[:d], share.alias("b"))
    return leaves.join(above, path).select(*leaves.columns, F.floor(F.round("b", 3)).cast("bigint").alias("target"))


def _leaf_cuts(docs: DataFrame, levels: Sequence[str], id_col: str, text_col: str, weights: Mapping, budget: float, max_epochs: int, seed: int) -> tuple[DataFrame, int]:
    """A row for each leaf: p0.., target, epochs, and the last (key, id) of the prefix, null if it is empty."""
    path = [f"p{i}" for i in range(len(levels))]
    slim = stash(docs.select(*path_columns(levels), F.col(id_col).cast("string").alias("id"), tokens(F.col(text_col)).alias("tokens")), "tokens")
    sums = stash(slim.groupBy(*path).agg(F.sum("tokens").alias("tokens")), "sums")
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    leaves = leaf_budgets(sums, len(levels), weights, F.lit(float(int(total * budget))), max_epochs)
    epochs = F.coalesce(F.expr("try_divide(target, tokens)"), F.lit(0.0))
    leaves = leaves.withColumn("epochs", F.floor(epochs).cast("bigint")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("tokens"))
    leaves = stash(leaves.withColumnRenamed("tokens", "leaf_tokens"), "leaves")
    n = leaves.count()
    near = _near(leaves, n)
    keyed = slim.join(near, path).withColumn("key", order_key(seed, F.col("epochs"), F.coalesce("id", F.lit("")))).withColumn("bucket", F.substring("key", 1, 3))
    by_bucket = keyed.groupBy(*path, "bucket").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*path).orderBy("bucket")
    by_bucket = by_bucket.withColumn("upto", F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n"))
    # the bucket in which the budget ends; the prefix's end is looked for there and in the one before
    edge = by_bucket.filter("before <= rest").groupBy(*path).agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("edge"), F.max(F.when(F.col("upto") <= F.col("rest"), F.col("bucket"))).alias("whole"))
    edge = stash(edge.select(*path, F.col("edge.bucket").alias("bucket"), F.col("edge.before").alias("before"), "whole"), "edges")
    inside = keyed.join(_near(edge, n), [*path, "bucket"])
    cum = F.col("before") + F.sum("tokens").over(Window.partitionBy(*path).orderBy("key", "id"))
    last = inside.withColumn("cum", cum).filter("cum <= rest").groupBy(*path).agg(F.max(F.struct("key", "id")).alias("last"))
    cuts = leaves.join(edge.select(*path, "whole"), path, "left").join(last, path, "left")
    return stash(cuts, "cuts"), n


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_LEAVES else df


def mixed_copies(docs: DataFrame, levels: Sequence[str] = LEVELS, weights: Mapping[tuple[str, ...], float] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS,
                 seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with bigint columns ``leaf_target`` (its leaf's budget in tokens) and ``copies`` (how often the mix
    holds the row; 0: not at all). ``budget`` is the mix's size as a share of the tokens there are.

    Tokens are runs without white space. Null levels count as empty text; a null text has no tokens; rows that repeat
    an id in a leaf share their place in the order and enter or stay out together. Columns of the two names, and
    p0, p1, ... that name levels inside, are replaced. An empty table gives an empty result."""
    path = [f"p{i}" for i in range(len(levels))]
    cuts, n = _leaf_cuts(docs, levels, id_col, text_col, weights, budget, max_epochs, seed)
    base = docs.drop("copies", "leaf_target")
    inner = [f"_mix_{p}" for p in path]
    near = _near(cuts.select(*[F.col(p).alias(q) for p, q in zip(path, inner)], F.col("target").alias("leaf_target"), F.col("epochs").alias("_epochs"), F.col("whole").alias("_whole"), F.col("last").alias("_last")), n)
    marked = base.withColumns(dict(zip(inner, path_columns(levels)))).join(near, inner)
    key = order_key(seed, F.col("_epochs"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    inside = F.coalesce(F.substring(key, 1, 3) <= F.col("_whole"), F.lit(False)) | F.coalesce(F.struct(key.alias("key"), F.col(id_col).cast("string").alias("id")) <= F.col("_last"), F.lit(False))
    return marked.withColumn("copies", F.col("_epochs") + inside.cast("bigint")).select(*base.columns, "leaf_target", "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as :func:`mixed_copies` says."""
    marked = mixed_copies(docs, **options).filter("copies > 0")
    return marked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("_copy", "copies", "leaf_target")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`mixed_copies` of ``documents``: doc_id, the three levels, leaf_target, copies."""
    docs = table(spark, sf_dir, "documents")
    return mixed_copies(docs.withColumn("domain", source_family(F.col("source")))).select("doc_id", *LEVELS, "leaf_target", "copies")


def _weight_sql(d: int) -> str:
    path = " || chr(31) || ".join(f"p{i}" for i in range(d))
    cases = " ".join(f"WHEN '{'|'.join(k)}' THEN {v}" for k, v in WEIGHTS.items() if len(k) == d)
    return f"CASE replace({path}, chr(31), '|') {cases} ELSE 1.0 END"


def _level_sql(d: int, src: str) -> str:
    path, up = ", ".join(f"p{i}" for i in range(d)), ", ".join(f"p{i}" for i in range(d - 1))
    by = f"PARTITION BY {up}" if up else ""
    return f"""
n{d} AS (SELECT {path}, max(cap{d}) AS cap, max(w{d}) AS w, max(b{d - 1}) AS b, max(cap{d}) / max(w{d}) AS ratio FROM {src} GROUP BY {path}),
f{d} AS (SELECT *, ratio <= (b - coalesce(sum(cap) OVER ({by} ORDER BY ratio, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                          / sum(w) OVER ({by} ORDER BY ratio, {path} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS whole FROM n{d}),
g{d} AS (SELECT {path}, CASE WHEN whole THEN cap ELSE w * (b - sum(CASE WHEN whole THEN cap ELSE 0 END) OVER (s))
                          / sum(CASE WHEN whole THEN 0 ELSE w END) OVER (s) END AS b{d} FROM f{d} WINDOW s AS ({by})),
l{d} AS (SELECT * FROM {src} JOIN g{d} USING ({path}))"""


ORACLE_SQL = rf"""
WITH docs AS (SELECT doc_id, lang, source,
    'family-' || coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT) % 4, 0) AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
d AS (SELECT *, domain AS p0, coalesce(lang, '') AS p1, coalesce(source, '') AS p2 FROM docs),
leaf AS (SELECT p0, p1, p2, sum(tokens)::BIGINT AS leaf_tokens FROM d GROUP BY p0, p1, p2),
l0 AS (SELECT *, {_weight_sql(1)} AS w1, {_weight_sql(2)} AS w2, {_weight_sql(3)} AS w3, leaf_tokens * {MAX_EPOCHS}.0::DOUBLE AS cap3,
         sum(leaf_tokens * {MAX_EPOCHS}.0::DOUBLE) OVER (PARTITION BY p0, p1) AS cap2, sum(leaf_tokens * {MAX_EPOCHS}.0::DOUBLE) OVER (PARTITION BY p0) AS cap1,
         floor(sum(leaf_tokens) OVER () * {BUDGET}::DOUBLE) AS b0 FROM leaf),
{_level_sql(1, "l0")},{_level_sql(2, "l1")},{_level_sql(3, "l2")},
t AS (SELECT *, floor(round(b3, 3))::BIGINT AS leaf_target FROM l3),
e AS (SELECT *, CASE WHEN leaf_tokens = 0 THEN 0 ELSE leaf_target // leaf_tokens END AS epochs FROM t),
k AS (SELECT d.*, leaf_target, leaf_tokens, epochs, md5('{SEED}:' || epochs || ':' || doc_id) AS key FROM d JOIN e USING (p0, p1, p2))
SELECT doc_id, domain, lang, source, leaf_target,
       epochs + CASE WHEN sum(tokens) OVER (PARTITION BY p0, p1, p2 ORDER BY key, doc_id::VARCHAR) <= leaf_target - epochs * leaf_tokens THEN 1 ELSE 0 END AS copies
FROM k
"""
