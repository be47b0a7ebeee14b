"""Joins, aggregations, deduplication, top-k and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from .percentiles import percentiles
from .rows import number

# -- joins


def join(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str], kind: str = "inner", output: Sequence[str] | None = None) -> DataFrame:
    """An equi-join on keys of equal number. Spark picks the strategy; AQE splits skewed keys."""
    if len(left_key) != len(right_key) or not left_key:
        raise ValueError("both sides need the same number of keys, one at least")
    on = [left[a] == right[b] for a, b in zip(left_key, right_key)]
    df = left.join(right, on, kind)
    return df.select(*output) if output else df


def feature_join(master: DataFrame, features: Mapping[str, tuple[DataFrame, Mapping[str, object]]], key: str) -> DataFrame:
    """A master table with feature tables joined on: defaults for what is missing, a flag ``has_<name>`` for each."""
    df = master
    for name, (table, defaults) in features.items():
        df = df.join(table.withColumn(f"has_{name}", F.lit(True)), key, "left")
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()} | {f"has_{name}": F.coalesce(f"has_{name}", F.lit(False))})
    return df


def reconcile_keys(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, status): missing, unexpected or matched, in one full outer join of distinct keys."""
    e, a = (d.select(*keys).distinct() for d in (expected, actual))
    both = e.withColumn("_e", F.lit(True)).join(a.withColumn("_a", F.lit(True)), list(keys), "full")
    return both.select(*keys, F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("matched").alias("status"))


def as_of_join(rows: DataFrame, versions: DataFrame, key: Sequence[str], tx_time: str, valid_time: str | None = None, disjoint: bool = True) -> DataFrame:
    """Rows with the version of their key that was visible at (tx_time, valid_time): half-open ranges, null is open; nulls
    without one.

    Versions of a key that do not overlap in transaction time (``disjoint``) need one sorted sweep over rows and versions that
    carries the open version; it is dealt by ranges of key and time, so that a key with most of the rows is in many tasks.
    With a valid time, or versions that overlap, a row may have several: an equi-join by key that filters by the ranges."""
    own = [c for c in versions.columns if c not in key]
    if valid_time or not disjoint:
        t = F.col(f"r.{tx_time}")
        on = [F.col(f"r.{k}") == F.col(f"v.{k}") for k in key] + [F.col("v.tx_from") <= t, F.col("v.tx_to").isNull() | (t < F.col("v.tx_to"))]
        if valid_time:
            u = F.col(f"r.{valid_time}")
            on += [F.col("v.valid_from") <= u, F.col("v.valid_to").isNull() | (u < F.col("v.valid_to"))]
        return rows.alias("r").join(versions.alias("v"), on, "left").select("r.*", *[F.col(f"v.{c}") for c in own])
    names = [f"_k{i}" for i in range(len(key))]
    keys = [F.col(k).alias(n) for k, n in zip(key, names)]
    starts = versions.filter(F.col("tx_from").isNotNull()).dropna(subset=list(key))
    starts = starts.select(*keys, F.col("tx_from").alias("_t"), F.lit(0).alias("_asks"), F.col("tx_to").isNull().alias("_open"), F.col("tx_to").alias("_to"), F.struct(*own).alias("_v"))
    asks = rows.select(*keys, F.col(tx_time).alias("_t"), F.lit(1).alias("_asks"), F.struct(*rows.columns).alias("_r"))
    swept = ordered.with_last(asks.unionByName(starts, allowMissingColumns=True), names, ["_t", "_asks", "_open", "_to"], "_v").filter("_asks = 1")
    seen = F.col("_last.tx_to").isNull() | (F.col("_t") < F.col("_last.tx_to"))
    return swept.withColumn("_last", F.when(seen, F.col("_last"))).select("_r.*", *[F.col(f"_last.{c}") for c in own])


def exclude_held(candidates: DataFrame, holds: DataFrame, key: str) -> DataFrame:
    return candidates.join(holds.select(key).distinct(), key, "left_anti")


def enrich_by_ids(df: DataFrame, ids: str, artifacts: DataFrame, key: str, to: str) -> DataFrame:
    """Collects the artifacts that an array of ids names, sorted by id. Each distinct array is looked up once."""
    got = df.select(ids).distinct().select(ids, F.explode(F.array_distinct(ids)).alias(key)).join(artifacts, key)
    got = got.groupBy(ids).agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in artifacts.columns if c != key]))).alias(to))
    return df.join(got, ids, "left").select(*df.columns, to)


# -- aggregation

FUNCTIONS = {
    "SUM": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "AVG": lambda v: F.coalesce(F.avg(v), F.lit(0.0)),
    "COUNT": lambda v: F.count(v),  # of numeric values, not of rows
    "MIN": F.min,
    "MAX": F.max,
    "STDDEV": F.stddev_pop,
    "VARIANCE": F.var_pop,
    "MEDIAN": None,  # by :func:`percentiles`
}


def aggregate(df: DataFrame, group_by: Sequence[str], aggregations: Sequence[tuple[str, str] | tuple[str, str, str]]) -> DataFrame:
    """(field, function[, alias]) over groups; texts that are numbers count, others don't. A null group is empty text.

    The alias is ``field_function`` in small letters by default; without ``group_by`` all rows are one group."""
    alias = lambda a: a[2] if len(a) > 2 else f"{a[0]}_{a[1]}".lower()
    made = [FUNCTIONS[a[1].upper()](number(F.col(a[0]))).alias(alias(a)) for a in aggregations if a[1].upper() != "MEDIAN"]
    keyed = df.withColumns({g: F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group_by}) if group_by else df
    out = keyed.groupBy(*group_by).agg(*(made or [F.count(F.lit(1)).alias("_rows")]))
    for a in aggregations:
        if a[1].upper() == "MEDIAN":  # ranked, so that no group's values stand in one place
            x = number(F.col(a[0]))
            median = percentiles(keyed, group_by, x, {alias(a): 0.5})
            out = out.join(median, list(group_by), "left") if group_by else out.join(F.broadcast(median), how="left")  # one row each
    return out.select(*group_by, *map(alias, aggregations))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(value, count, percentage) of the most frequent values, ties by value; nulls don't count."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).count()
    total = counts.agg(F.sum("count").alias("total"))
    return counts.orderBy(F.desc("count"), "value").limit(k).join(F.broadcast(total)).select("value", "count", (F.col("count") * 100.0 / F.col("total")).alias("percentage"))


def distinct_count(df: DataFrame, column: str, exact: bool = False) -> DataFrame:
    c = F.count_distinct(column) if exact else F.approx_count_distinct(column, 0.01)
    return df.agg(c.alias("distinct_values"))


def hourly(df: DataFrame, time: str, by: Sequence[str], value: str) -> DataFrame:
    """Average and count per hour and group; works on streams too."""
    return df.groupBy(F.window(time, "1 hour").alias("w"), *by).agg(F.avg(value).alias("average"), F.count(value).alias("n")).select(F.col("w.start").alias("bucket"), *by, "average", "n")


def fuse_confidences(df: DataFrame, by: Sequence[str], confidence: str, weight: str, vote_at: float = 0.5) -> DataFrame:
    """Weighted average, geometric mean (0 if any is 0), and majority vote (0.9 or 0.1)."""
    c, w = F.col(confidence), F.col(weight)
    geometric = F.when(F.min(c) <= 0, 0.0).otherwise(F.exp(F.avg(F.ln(F.when(c > 0, c)))))
    return df.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum(c * w), F.sum(w)), F.lit(0.0)).alias("weighted_average"), geometric.alias("geometric_mean"),
        F.when(F.count_if(c >= vote_at) * 2 > F.count(c), 0.9).otherwise(0.1).alias("majority"),
    )


def weighted_vote(scores: Mapping[str, float]) -> Column:
    """Sum of weight times score, missing scores count as 0."""
    total = F.lit(0.0)
    for c, w in scores.items():
        total = total + F.coalesce(F.col(c), F.lit(0.0)) * w
    return total


# -- deduplication and order


def dedup(df: DataFrame, keys: Sequence[str] | Sequence[Column], order: Sequence[str | Column], keep: str = "first") -> DataFrame:
    """One row a key. ``order`` says what first and last mean and must not tie.

    ``first`` and ``last`` are one aggregation that combines before the shuffle, so a hot key costs nothing.
    ``merge`` fills the first row's nulls from later ones; ``highest_quality`` takes the fullest row, ties by order."""
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    at = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)])
    row = F.struct(*df.columns)
    group = df.select(*named, at.alias("_at"), row.alias("_row")).groupBy(*[f"_k{i}" for i in range(len(keys))])
    if keep in ("first", "last"):
        pick = F.min_by("_row", "_at") if keep == "first" else F.max_by("_row", "_at")
        return group.agg(pick.alias("_row")).select("_row.*")
    if keep == "highest_quality":
        score = quality_of_row(df)
        ranked = df.select(*named, F.struct((-score).alias("q"), at.alias("at")).alias("_at"), row.alias("_row")).groupBy(*[f"_k{i}" for i in range(len(keys))])
        return ranked.agg(F.min_by("_row", "_at").alias("_row")).select("_row.*")
    if keep == "merge":
        value = lambda c: F.min_by(F.col(f"_row.{c}"), F.when(F.col(f"_row.{c}").isNotNull(), F.col("_at"))).alias(c)
        return group.agg(*[value(c) for c in df.columns]).select(*df.columns)
    raise ValueError(f"unknown keep {keep}")


def quality_of_row(df: DataFrame) -> Column:
    """(values + half of the texts that aren't blank) / columns."""
    total = F.lit(0.0)
    for name, kind in df.dtypes:
        c = F.col(name)
        total = total + F.when(c.isNotNull(), 1.0).otherwise(0.0)
        if kind == "string":
            total = total + F.when(F.trim(c) != "", 0.5).otherwise(0.0)
    return total / len(df.columns)


def normalized_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def dedup_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """input, kept, duplicates and their rate in percent."""
    n, kept = F.sum("n"), F.count(F.lit(1))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(n.alias("input"), kept.alias("kept"), (n - kept).alias("duplicates"), F.try_divide((n - kept) * 100.0, n).alias("rate"))


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k of each group, with ``rank``; Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def distinct_union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.distinct()


def set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): in both, only left or only right."""
    e = reconcile_keys(left, right, keys)
    return e.select(*keys, F.when(F.col("status") == "matched", "both").when(F.col("status") == "missing", "left").otherwise("right").alias("side"))


def since_previous(df: DataFrame, by: Sequence[str], time: str, tie: Sequence[str] = (), to: str = "seconds") -> DataFrame:
    """Seconds since the group's previous event; null for the first."""
    w = Window.partitionBy(*by).orderBy(time, *tie)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return df.withColumn(to, (micros(time) - F.lag(micros(time)).over(w)) / 1e6)


def close_versions(df: DataFrame, key: Sequence[str], start: str = "tx_from", end: str = "tx_to", tie: Sequence[str] = ()) -> DataFrame:
    """Each version ends where its key's next one starts."""
    return df.withColumn(end, F.lead(start).over(Window.partitionBy(*key).orderBy(start, *tie)))
