"""Order within groups of which one may hold most of the rows.

Rows are dealt by ranges of (group, order), so a large group lies in several partitions. What a range needs to know of the
ranges before it, the last row or a count, is one small row for each range and group; only the first group of a range goes on
from the range before, so at most one such row a partition is carried over and broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoint_folder


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_part``, the number of its range of (by, order), ascending, nulls first. Equal places share a range."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()).checkpoint()


def _same(by: Sequence[str]) -> Column:
    on = F.col("h._part") == F.col("c._part")
    for b in by:
        on = on & F.col(f"h.{b}").eqNullSafe(F.col(f"c.{b}"))
    return on


def carried(at: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """(by, _part, _carry): the last ``value`` (an aggregation) that is not null of the same group's ranges before. Has a row
    only where there is one: at most one a partition."""
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = at.groupBy(*by, "_part").agg(value.alias("_end"))
    return ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(w)).filter("_carry IS NOT NULL").drop("_end")


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``df`` with ``_prev``, a struct of ``columns`` of the row before in its group; null for the first."""
    at = ranged(df, by, order)
    here = at.withColumn("_prev", F.lag(F.struct(*columns)).over(Window.partitionBy(*by, "_part").orderBy(*order)))
    last = carried(at, by, F.max_by(F.struct(*columns), F.struct(*order)))
    both = here.alias("h").join(F.broadcast(last).alias("c"), _same(by) & F.col("h._prev").isNull(), "left")
    return both.select(*[F.col(f"h.{c}") for c in df.columns], F.coalesce("h._prev", "c._carry").alias("_prev"))


def with_last(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``_last``: the last ``value`` that is not null of its group's rows up to and with this one."""
    at = ranged(df, by, order)
    w = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = at.withColumn("_last", F.last(value, ignorenulls=True).over(w))
    some = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    both = here.alias("h").join(F.broadcast(carried(at, by, some)).alias("c"), _same(by) & F.col("h._last").isNull(), "left")
    return both.select(*[F.col(f"h.{c}") for c in df.columns], F.coalesce("h._last", "c._carry").alias("_last"))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's number in its group, from 0."""
    at = ranged(df, by, order)
    here = at.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)).cast("bigint") - 1)
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_carry", F.sum("_size").over(w)).filter("_carry IS NOT NULL").drop("_size")
    both = here.alias("h").join(F.broadcast(before).alias("c"), _same(by), "left")
    return both.select(*[F.col(f"h.{c}") for c in df.columns], (F.col("h._n") + F.coalesce("c._carry", F.lit(0))).alias(name))
