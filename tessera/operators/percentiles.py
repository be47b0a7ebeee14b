"""Exact percentiles by counting and ranking, without all values of a group in one place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoint_folder


def percentiles(df: DataFrame, by: Sequence[str], value: Column, points: Mapping[str, float]) -> DataFrame:
    """(by, a double for each of ``points``): the value at a share of the way through a group's ordered values, between two
    neighbours in proportion. Nulls don't count; a group without values has no row; null groups are a group.

    Values are counted, the counts dealt by ranges and summed up within each range in parallel; only one row a range is
    summed in one task. A value that a third of the rows hold is one count."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    keys = [f"_g{i}" for i in range(len(by))]
    counts = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], value.cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_v").withColumn("_part", F.spark_partition_id()).checkpoint()
    # ranks run over all groups; a group's own begin at its first
    parts = ranged.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy(*keys, "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = ranged.withColumn("_upto", upto).join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part").withColumn("_last", F.col("_before") + F.col("_upto"))
    groups = ranked.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.sum("_n").alias("_all"), F.max("_last").alias("_end"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    placed = (ranked.join(groups, same) if keys else ranked.join(F.broadcast(groups))).select(*keys, "_v", (F.col("_last") - F.col("_end") + F.col("_all")).alias("_hi"), "_n", "_all")
    made, lo = [], F.col("_hi") - F.col("_n")  # this value stands at places lo .. hi - 1
    for q in points.values():
        at = (F.col("_all") - 1) * F.lit(float(q))
        here = lambda p: F.max(F.when((lo <= p) & (p < F.col("_hi")), F.col("_v")))
        low, high, share = here(F.floor(at)), here(F.ceil(at)), F.max(at - F.floor(at))
        made.append(F.when(share == 0, low).otherwise(low + (high - low) * share))
    out = placed.groupBy(*keys).agg(*[m.alias(n) for m, n in zip(made, points)])
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], *points)
