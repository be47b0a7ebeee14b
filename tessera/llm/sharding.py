"""Operator 4: sharding by a permutation-filled lookup table (native DataFrame operations only).

Each shard has a preference order of the table's slots, ``(offset + j * skip) mod size``, a permutation as the size is
prime. Shards take turns; each claims the first slot of its order that is free. All get ``size // n`` or one more
slots, and when a shard leaves, most other slots keep their owner. A key's slot is its hash modulo the size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

#: A prime, some 250 slots for each of 16 shards. The table has a row a slot; beyond BROADCAST_SLOTS it is joined by shuffle.
SLOTS, BROADCAST_SLOTS = 4099, 1_000_003
SHARDS = [f"shard-{i:02d}" for i in range(16)]


def hash_mod(key: Column, mod: Column | int) -> Column:
    """The first 15 hex digits of the key's MD5, modulo ``mod``."""
    n = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return n % (F.lit(mod) if isinstance(mod, int) else mod)


#: Owners are four bytes a slot in pieces of PIECE slots, ROW pieces a row of a two-level array: a claim copies one piece and two
#: short arrays, not the table. STEPS tries are one inner fold.
PIECE, ROW, STEPS = 2048, 16, 4096


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``slots`` rows (slot, shard). The turns are one fold in one row: a step tries the next slot of the shard whose turn it
    is. A step that fails moves one number; one that claims copies PIECE owners, two arrays of pieces and the shards' places."""
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime that is no less than the number of shards")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    n, row = len(shards), PIECE * ROW
    names = F.array(*map(F.lit, sorted(shards)))
    one = spark.range(1).select(
        names.alias("names"),
        F.transform(names, lambda s: hash_mod(F.concat(F.lit("offset:"), s), slots)).alias("offset"),
        F.transform(names, lambda s: hash_mod(F.concat(F.lit("skip:"), s), slots - 1) + 1).alias("skip"),
    )
    # owner: 0 where a slot is free; next: the first place of each shard's order that it has not tried; i: whose turn it is,
    # j: the place it tries, p: the slot there
    one = one.withColumn("s", F.expr(f"""named_struct('owner', array_repeat(array_repeat(unhex(repeat('00000000', {PIECE})), {ROW}), {-(-slots // row)}),
        'next', array_repeat(0L, {n}), 'i', 0, 'j', 0L, 'p', offset[0], 'claims', 0L)"""))
    at = f"cast(s.p div {row} as int)", f"cast(s.p % {row} div {PIECE} as int)", f"cast(4 * (s.p % {PIECE}) + 1 as int)"
    put = lambda xs, i, x: f"concat(slice({xs}, 1, {i}), array({x}), slice({xs}, {i} + 2, greatest(size({xs}) - {i} - 1, 0)))"
    piece = f"overlay(s.owner[{at[0]}][{at[1]}] PLACING unhex(lpad(hex(s.i + 1), 8, '0')) FROM {at[2]})"
    turn = f"((s.i + 1) % {n})"
    place = f"if({n} = 1, s.j + 1, s.next[{turn}])"
    step = f"""if(substring(s.owner[{at[0]}][{at[1]}], {at[2]}, 4) = X'00000000',
      named_struct('owner', {put("s.owner", at[0], put(f"s.owner[{at[0]}]", at[1], piece))}, 'next', {put("s.next", "s.i", "s.j + 1")},
        'i', {turn}, 'j', {place}, 'p', (offset[{turn}] + {place} * skip[{turn}]) % {slots}, 'claims', s.claims + 1),
      named_struct('owner', s.owner, 'next', s.next, 'i', s.i, 'j', s.j + 1, 'p', (s.p + skip[s.i]) % {slots}, 'claims', s.claims))"""
    done = f"s.claims >= {slots}"
    tries = int(slots * (math.log(slots) + 2)) + 1  # about slots * ln(slots) are needed
    fold = f"aggregate(sequence(1, {-(-tries // STEPS)}), s, (s, t) -> if({done}, s, aggregate(sequence(1, {STEPS}), s, (s, u) -> if({done}, s, {step}))))"
    while True:
        one = stash(one.withColumn("s", F.expr(fold)), "turns")
        if one.filter(f"s.claims >= {slots}").count():
            break
    # rows of pieces, pieces, slots
    rows = one.select("names", F.posexplode("s.owner").alias("r", "pieces"))
    pieces = rows.select("names", "r", F.posexplode("pieces").alias("q", "piece"))
    places = pieces.select("names", (F.col("r") * row + F.col("q") * PIECE).alias("first"), "piece", F.explode(F.sequence(F.lit(0), F.lit(PIECE - 1))).alias("x"))
    owner = F.conv(F.hex(F.expr("substring(piece, 4 * x + 1, 4)")), 16, 10).cast("int")
    return places.select((F.col("first") + F.col("x")).alias("slot"), F.get("names", owner - 1).alias("shard")).filter(F.col("slot") < slots)


def assign_shards(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with columns slot and shard (replacing any of these names), placed by ``key``: one broadcast lookup, no
    shuffle (but for tables over BROADCAST_SLOTS). Equal keys share a shard; a null key counts as empty text. Rows are kept as they are, repeats too; an
    empty table gives an empty result."""
    placed = df.drop("slot", "shard").withColumn("slot", hash_mod(F.coalesce(F.col(key).cast("string"), F.lit("")), slots).cast("int"))
    lookup = lookup_table(df.sparkSession, shards, slots)
    return placed.join(F.broadcast(lookup) if slots <= BROADCAST_SLOTS else lookup, "slot").select(*df.drop("slot", "shard").columns, "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, files: int = 8) -> None:
    """Writes ``df`` as Parquet, one folder per shard and at most ``files`` files in each."""
    placed = assign_shards(df, key, shards, slots)
    salt = F.pmod(F.xxhash64(F.col(key).cast("string"), "slot"), F.lit(files))
    placed.repartition(len(shards) * files, "shard", salt).write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`assign_shards` of ``documents`` by doc_id: doc_id, source, n_chars, slot, shard."""
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")


def _hash_sql(text: str, mod: int) -> str:
    return f"(('0x' || substring(md5({text}), 1, 15))::BIGINT % {mod})"


_N = len(SHARDS)
#: The same turns as a recursive query, a claim a step.
ORACLE_SQL = f"""
WITH RECURSIVE s AS (SELECT {sorted(SHARDS)} AS names),
c AS (SELECT list_transform(names, lambda n: {_hash_sql("'offset:' || n", SLOTS)}) AS off, list_transform(names, lambda n: {_hash_sql("'skip:' || n", SLOTS - 1)} + 1) AS skip FROM s),
f(k, owner, nxt) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda x: -1), list_transform(range({_N}), lambda x: 0)
  UNION ALL
  SELECT k + 1, list_concat(owner[:slot], [i], owner[slot + 2:]), list_concat(nxt[:i], [j + 1], nxt[i + 2:]) FROM (
    SELECT *, (off[i + 1] + j * skip[i + 1]) % {SLOTS} AS slot FROM (
      SELECT k, owner, nxt, off, skip, k % {_N} AS i,
        list_filter(range(nxt[k % {_N} + 1], {SLOTS}), lambda x: owner[(off[k % {_N} + 1] + x * skip[k % {_N} + 1]) % {SLOTS} + 1] < 0)[1] AS j
      FROM f, c WHERE k < {SLOTS}))),
t AS (SELECT owner FROM f WHERE k = {SLOTS})
SELECT doc_id, source, n_chars, {_hash_sql("doc_id::VARCHAR", SLOTS)}::INT AS slot, names[owner[{_hash_sql("doc_id::VARCHAR", SLOTS)} + 1] + 1] AS shard FROM documents, t, s
"""
