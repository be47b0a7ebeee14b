"""Summaries that merge: quantiles of batches, frequent values, overlaps of columns. Each is one pass without a shuffle of the
values; what must be exact is counted again for the few that are left."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import value_overlap

#: Size of a quantile sketch: with 1,000 ranks are within some 0.3 %.
QUANTILE_K, RANK_ERROR = 1000, 0.005
#: Values that a theta sketch holds at least, if there are more; how far, times the root of the values seen, a share may be off.
THETA_K, DOUBT = 4096, 4.0
#: Values that a task keeps of a column.
ROOM = 4096


def quantile_sketches(df: DataFrame, by: Column, value: str) -> DataFrame:
    """(batch, rows, n, sketch): a KLL sketch of the numbers of each batch, to be stored and merged later."""
    v = F.col(value).cast("double")
    return df.groupBy(by.alias("batch")).agg(F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.kll_sketch_agg_double(v, F.lit(QUANTILE_K)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, ranks: Sequence[float]) -> DataFrame:
    """(p, value, n) of all batches: the value's rank is within RANK_ERROR of p. Null if there are no numbers."""
    whole = sketches.filter("n > 0").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("s"))
    rows = [F.struct(F.lit(float(p)).alias("p"), F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", F.lit(float(p)))).alias("value"), F.coalesce("n", F.lit(0)).alias("n")) for p in ranks]
    return whole.select(F.inline(F.array(*rows)))


def _kept(room: int):  # noqa: ANN202
    """Counts of at most 2 * ``room`` values; whenever there are more, all lose what the largest that goes has. A value's true
    count in the task is its own and at most what was taken off in all (``lost``)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, lost = pd.Series(dtype="int64"), 0
        for f in frames:
            counts = counts.add(f["value"].value_counts(), fill_value=0).astype("int64")
            if len(counts) > 2 * room:
                off = int(counts.nlargest(room + 1).iloc[-1])
                lost, counts = lost + off, counts[counts > off] - off
        yield pd.DataFrame({"value": counts.index.astype(object), "n": counts.to_numpy(), "lost": 0})
        yield pd.DataFrame({"value": [None], "n": [0], "lost": [lost]})

    return run


def frequent_values(df: DataFrame, column: str, k: int = 10, room: int = ROOM) -> DataFrame:
    """(value, count, percentage) of the ``k`` most frequent values, ties by value; nulls don't count. Exact.

    Tasks keep the values that may be frequent; those that can be among the first k are counted exactly, without a group for
    each value. Only where even these bounds leave the first k open, as with k values of hardly any copies, all are counted."""
    values = df.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL")
    kept = values.mapInPandas(_kept(room), "value string, n long, lost long").groupBy("value").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")).checkpoint()
    lost = kept.filter("value IS NULL").agg(F.coalesce(F.sum("lost"), F.lit(0))).first()[0]
    top = [r["n"] for r in kept.filter("value IS NOT NULL").orderBy(F.desc("n")).limit(k).collect()]
    total = values.agg(F.count(F.lit(1)).alias("total"))
    if lost == 0:
        counts = kept.filter("value IS NOT NULL").select("value", F.col("n").alias("count"))
    else:
        counts = values
        if len(top) == k and top[-1] > lost:
            counts = values.join(kept.filter(F.col("value").isNotNull() & (F.col("n") + lost >= top[-1])).select("value"), "value", "left_semi")
        counts = counts.groupBy("value").count()
    return counts.orderBy(F.desc("count"), "value").limit(k).join(F.broadcast(total)).select("value", "count", (F.col("count") * 100.0 / F.col("total")).alias("percentage"))  # one row


def estimated_overlap(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(left_column, right_column, share, seen): the estimated share of the smaller column's distinct values that the other has,
    for columns of different tables, from a theta sketch of each: one row a column leaves the tables. ``seen``: how many of the
    smaller one's values the share is counted from, at least; few if the other column has very many."""
    every = None
    for name, (df, columns) in tables.items():
        one = df.agg(*[F.theta_sketch_agg(F.col(c).cast("string")).alias(c) for c in columns])
        part = one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("t"), F.lit(f"{name}.{c}").alias("column"), F.col(c).alias("s")) for c in columns])))
        every = part if every is None else every.unionByName(part)
    every = every.checkpoint()
    a, b = every.alias("a"), every.alias("b")
    size = lambda s: F.theta_sketch_estimate(s)
    met = a.join(b, (F.col("a.t") != F.col("b.t")) & (F.col("a.column") < F.col("b.column")))  # pairs of columns
    small, large = (f(size(F.col("a.s")), size(F.col("b.s"))) for f in (F.least, F.greatest))
    seen = F.when(large <= THETA_K, small).otherwise(small * THETA_K / large)  # a sketch holds the values whose hashes are least
    share = F.try_divide(size(F.theta_intersection("a.s", "b.s")), F.least(size(F.col("a.s")), size(F.col("b.s"))))
    return met.select(F.col("a.column").alias("left_column"), F.col("b.column").alias("right_column"), F.coalesce(share, F.lit(0.0)).alias("share"), seen.alias("seen"))


def sketched_overlap(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], least: float, slack: float = 0.1) -> DataFrame:
    """:func:`match.value_overlap` of the pairs of columns that share ``least`` of the smaller one's values: sketches choose the
    finalists, and only their columns' values are shuffled. A pair is left out if its estimate is below ``least`` by ``slack`` for
    the sketches' sizes and by DOUBT for the share: by Hoeffding's bound one of 10^13 pairs is left out wrongly. A small column
    against a very large one, of which hardly any value is in both sketches, is always counted."""
    margin = slack + DOUBT / F.sqrt(F.greatest("seen", F.lit(1.0)))
    chosen = [(r["left_column"], r["right_column"]) for r in estimated_overlap(tables).filter(F.col("share") >= least - margin).collect()]  # pairs of columns
    wanted = {c for pair in chosen for c in pair}
    few = {name: (df, [c for c in columns if f"{name}.{c}" in wanted]) for name, (df, columns) in tables.items()}
    few = {name: found for name, found in few.items() if found[1]}
    if not few:
        few = {name: (df.limit(0), columns) for name, (df, columns) in tables.items()}
    exact = value_overlap(few)
    return exact.filter(F.col("common") >= least * F.least("left_distinct", "right_distinct"))
