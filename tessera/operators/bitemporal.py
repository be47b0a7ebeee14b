"""Bitemporal facts (subject, predicate, object, tx_from, tx_to, valid_from, valid_to; half-open, null is open) and audit chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from .relational import close_versions
from .shared import checkpoint_folder

KEY = ["subject", "predicate"]


def covers(start: str, end: str, at: Column) -> Column:
    return (F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end)))


def current(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("tx_to").isNull())


def as_of(facts: DataFrame, tx_time: Column, valid_time: Column | None = None) -> DataFrame:
    df = facts.filter(covers("tx_from", "tx_to", tx_time))
    return df if valid_time is None else df.filter(covers("valid_from", "valid_to", valid_time))


def version_chain(facts: DataFrame, subject: str, predicate: str | None = None) -> DataFrame:
    df = facts.filter(F.col("subject") == subject)
    return (df if predicate is None else df.filter(F.col("predicate") == predicate)).orderBy("tx_from")


def history(writes: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Versions from a log of writes (subject, predicate, object, tx_from): a write of the value that already holds is no
    version; each version ends where the next begins."""
    w = Window.partitionBy(*KEY).orderBy("tx_from", *tie)
    changed = writes.withColumn("_b", F.lag("object").over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~F.col("_b").eqNullSafe(F.col("object"))).drop("_b", "_n")
    return close_versions(changed, KEY, tie=tie)


def supersede(facts: DataFrame, writes: DataFrame) -> DataFrame:
    """The table after one batch of writes (subject, predicate, object, tx_from; a key once): equal values change nothing,
    others close the open version and add one."""
    w = writes.select(*KEY, F.col("object").alias("_o"), F.col("tx_from").alias("_t"))
    old = facts.join(w, KEY, "left")
    ends = F.col("tx_to").isNull() & F.col("_t").isNotNull() & ~F.col("object").eqNullSafe(F.col("_o"))
    closed = old.withColumn("tx_to", F.when(ends, F.col("_t")).otherwise(F.col("tx_to"))).select(*facts.columns)
    same = current(facts).select(*KEY, "object")
    match = None
    for k in (*KEY, "object"):
        c = writes[k].eqNullSafe(same[k])
        match = c if match is None else match & c
    return closed.unionByName(writes.join(same, match, "left_anti"), allowMissingColumns=True)


def chain_statistics(facts: DataFrame, longer_than: int) -> DataFrame:
    per = facts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("chains"), F.avg("n").alias("average"), F.max("n").alias("longest"), F.count_if(F.col("n") > longer_than).alias("long_chains"))


def archivable(facts: DataFrame, before: Column) -> DataFrame:
    """Closed versions that ended before a time."""
    return facts.filter(F.col("tx_to").isNotNull() & (F.col("tx_to") < before))


def hash_entries(entries: DataFrame, payload: Sequence[str], seq: str, prev: str = "prev_hash") -> Column:
    return F.sha2(F.concat_ws("|", F.col(prev), F.col(seq).cast("string"), *[F.col(c).cast("string") for c in payload]), 256)


def verify_chain(entries: DataFrame, by: Sequence[str], seq: str, time: str, payload: Sequence[str]) -> DataFrame:
    """(by, seq, problem): wrong_hash, broken_link, duplicate, time_regression, bad_genesis. Entries have hash and
    prev_hash; the first one's prev_hash is 64 zeros. A long chain is checked in ranges, each of which knows the last entry
    of the one before."""
    e = ordered.with_previous(entries, by, [seq, "hash"], list(dict.fromkeys(["hash", time, seq])))
    first = F.col("_prev").isNull()
    problems = F.array_compact(F.array(
        F.when(F.col("hash") != hash_entries(e, payload, seq), "wrong_hash"),
        F.when(~first & (F.col("prev_hash") != F.col("_prev.hash")), "broken_link"),
        F.when(F.col(f"_prev.{seq}") == F.col(seq), "duplicate"),
        F.when(F.col(f"_prev.{time}") > F.col(time), "time_regression"),
        F.when(first & (F.col("prev_hash") != "0" * 64), "bad_genesis"),
    ))
    return e.select(*by, seq, F.explode(problems).alias("problem"))


#: Levels of a tree that one round hashes: 2**LEVELS neighbours meet in a row.
LEVELS = 8


def merkle_roots(entries: DataFrame, batch: str, seq: str, leaf: Column) -> DataFrame:
    """(batch, root, leaves): pairs of hashes are hashed level by level; an odd last one is paired with itself. Leaves are
    numbered in ranges, and a round hashes LEVELS levels of groups of neighbours, so a batch of any size is dealt out."""
    checkpoint_folder(entries.sparkSession)
    leaves = entries.select(F.col(batch).alias("batch"), F.col(seq).alias("seq"), leaf.alias("h"))
    level = ordered.numbered(leaves, ["batch"], ["seq", "h"], "i").select("batch", "i", "h").checkpoint()
    sizes = level.groupBy("batch").agg(F.count(F.lit(1)).alias("leaves")).checkpoint()
    left = sizes.agg(F.max("leaves")).first()[0] or 0
    level = level.join(sizes.withColumnRenamed("leaves", "n"), "batch")  # n: nodes of the batch at this level
    pairs = "transform(sequence(0, (size(s.hs) - 1) div 2), k -> sha2(concat(s.hs[2 * k], coalesce(get(s.hs, 2 * k + 1), s.hs[2 * k])), 256))"
    climb = f"aggregate(sequence(1, {LEVELS}), named_struct('hs', hs, 'n', n), (s, x) -> if(s.n > 1, named_struct('hs', {pairs}, 'n', (s.n + 1) div 2), s))"
    while left > 1:
        group = level.groupBy("batch", F.expr(f"i div {2**LEVELS}").alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("hs"), F.max("n").alias("n"))
        top = group.withColumn("hs", F.col("hs.h")).select("batch", "i", F.expr(climb).alias("s"))
        level = top.select("batch", "i", F.col("s.hs")[0].alias("h"), F.col("s.n").alias("n")).checkpoint()
        left = -(-left // 2**LEVELS)
    return level.select("batch", F.col("h").alias("root")).join(sizes, "batch")
