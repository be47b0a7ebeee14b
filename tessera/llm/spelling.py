"""Operator 13: spelling variants by a bit-sliced position index.

A block of the vocabulary holds words of one length. For each position and letter it has a bitset of the words with that
letter there. A query word walks through its letters once; four bitsets advance together: the words that agree so far, and
those that agree but for one replaced, one inserted or one deleted letter, which read the slices of the same, the next and
the previous position. Words that one edit separates share their first or their last half, so that a query meets only the
blocks under its halves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

RUN = r"[A-Za-zÀ-ÿ]{7,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words have at least so many code points and occurrences; every EDIT-th run by hash loses a letter; a form has FACTOR times the occurrences.
LEAST, OCCURRENCES, EDIT, FACTOR = 7, 2, 31, 10
#: Words of one block, and queries that meet a block in one group.
BLOCK, QUERIES = 4096, 65_536


def word_of(doc_id: Column, run: Column) -> Column:
    """The lower-cased run, without one letter if the hash of document and run says so."""
    low = F.translate(run, UPPER, LOWER)
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), low).cast("binary"))
    at = F.pmod(h, F.length(low).cast("bigint")).cast("int")
    cut = F.concat(F.substring(low, F.lit(1), at), F.substring(low, at + 2, F.length(low)))
    return F.when(h % EDIT == 0, cut).otherwise(low)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least LEAST code points and OCCURRENCES occurrences in all texts."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(word_of(F.col("id"), F.col("run")).alias("word")).filter(F.length("word") >= LEAST)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OCCURRENCES)


def keyed(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index's entries (side, size, half, word, n) and the queries' probes of the same form: ``size`` is the length of the
    indexed word, ``half`` its first size // 2 letters or its last size - size // 2."""
    def halves(size: Column) -> Column:
        low = F.floor(size / 2).cast("int")
        return F.array(
            F.struct(F.lit("first").alias("side"), size.alias("size"), F.substring(F.col("word"), F.lit(1), low).alias("half")),
            F.struct(F.lit("last").alias("side"), size.alias("size"), F.right(F.col("word"), size - low).alias("half")),
        )

    size = F.length("word")
    entries = words.select("word", "n", F.explode(halves(size)).alias("k"))
    probes = words.select("word", "n", F.explode(F.flatten(F.transform(F.array(size - 1, size, size + 1), halves))).alias("k"))
    return tuple(df.select("k.*", "word", "n") for df in (entries, probes))


class Slices:
    """The bitsets of a block: words of one length, most frequent first, then in code-point order, one bit each."""

    def __init__(self, words: list[tuple[str, int]]):
        self.words = sorted(words, key=lambda w: (-w[1], w[0]))
        self.size, self.all = len(words[0][0]), (1 << len(words)) - 1
        self.at: list[dict[str, int]] = [{} for _ in range(self.size)]
        for i, (w, _) in enumerate(self.words):
            bit = 1 << i
            for j, c in enumerate(w):
                self.at[j][c] = self.at[j].get(c, 0) | bit

    def near(self, query: str, side: str) -> int:
        """The bitset of the words that one edit separates from the query. On the ``last`` side those that share the first
        half, too, are left to that side."""
        shift, low, at, size = self.size - len(query), self.size // 2, self.at, self.size
        same, replaced, longer, shorter, shared = self.all, 0, 0, 0, 0
        for i, c in enumerate(query):
            if i == low:
                shared = same
            here = at[i].get(c, 0) if i < size else 0
            if shift == 0:
                replaced = (replaced & here) | (same & ~here)
            elif shift > 0:  # the indexed word has one letter more: read the next position
                longer = (longer | same) & at[i + 1].get(c, 0)
            else:  # the indexed word lacks a letter: read the previous position
                shorter = (shorter & (at[i - 1].get(c, 0) if i else 0)) | same
            same &= here
            if not same | replaced | longer | shorter:
                return 0
        found = replaced if shift == 0 else longer | same if shift > 0 else shorter
        return found & ~shared if side == "last" else found


def best_near(words: DataFrame) -> DataFrame:
    """(word, n_near, best): the number of near words and the one (n, word) of most occurrences, the smallest of several;
    words without any are left out. Blocks of more than BLOCK words are dealt over several groups, which get all probes of
    their halves in groups of about QUERIES."""
    entries, probes = keyed(words)
    key = ["side", "size", "half"]
    crowded = lambda df, least, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).select(*key, F.ceil(F.col("_n") / least).cast("int").alias(name))
    # crowded halves are rare and bounded: at most entries / BLOCK of them
    hot = crowded(entries, BLOCK, "blocks").join(crowded(probes, QUERIES, "groups"), key, "full")
    hot = stash(hot.select(*key, F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("groups", F.lit(1)).alias("groups")), "crowded")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        many = df.join(hot, key, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("blocks", "groups")})
        mine = F.pmod(F.xxhash64("word"), F.col(own)).cast("int")
        return many.select(*key, "word", "n", mine.alias(own[:-1]), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1]))

    rows = dealt(entries, "blocks", "groups").withColumn("asks", F.lit(0)).unionByName(dealt(probes, "groups", "blocks").withColumn("asks", F.lit(1)))
    group = [*key, "block", "group"]
    rows = rows.repartition(*group).sortWithinPartitions(*group, "asks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entered, index = None, [], None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for *g, word, n, asks in zip(*(batch.column(c).to_pylist() for c in (*group, "word", "n", "asks"))):
                if g != now:
                    now, entered, index = g, [], None
                if not asks:
                    entered.append((word, n))
                elif entered:
                    index = index or Slices(entered)
                    found = index.near(word, g[0])
                    if found:
                        top = index.words[(found & -found).bit_length() - 1]
                        for x, v in zip(out, (word, found.bit_count(), top[1], top[0])):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["word", "n_near", "near_n", "near"])

    met = rows.mapInArrow(meet, "word string, n_near long, near_n long, near string")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("word"))).alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``: the last word that forms lead to, the word itself without one. Each round
    follows twice as many steps; a form has FACTOR times the occurrences, so there are few."""
    led = stash(forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not led.join(onward, "root", "left_semi").take(1):
            break
        led = stash(led.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return forms.join(led, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of :func:`vocabulary`: word, n, form, root, n_near, form_n.

    ``form`` is the near word (one letter inserted, deleted or replaced) of most occurrences, the smallest in code-point order
    of several, if it has FACTOR times the word's; else null. Null and empty texts hold no words; a null id counts as empty
    text; rows that repeat count each; other columns are ignored; an empty table gives an empty result."""
    words = stash(vocabulary(docs, id_col, text_col), "words")
    near = words.join(best_near(words), "word", "left")
    count = -F.col("best.minus_n")
    chosen = count >= FACTOR * F.col("n")
    forms = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(chosen, F.col("best.word")).alias("form"), F.when(chosen, count).alias("form_n"))
    return with_roots(stash(forms, "forms")).select("word", "n", "form", "root", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`group_variants` of ``documents``: word, form, root, n, n_near, form_n. Null texts hold no words, ties go to the smallest word."""
    return group_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: CRC-32 bit by bit; pairs by the words' one-letter deletions.
ORACLE_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= {LEAST} GROUP BY ALL),
bytes AS (
  SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(hx) // 2), lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END))) AS h
  FROM bytes),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {EDIT} = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST} GROUP BY 1 HAVING sum(n) >= {OCCURRENCES}),
less AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY 1),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {FACTOR} * w.n THEN near END AS form, CASE WHEN near_n >= {FACTOR} * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
led(word, root) AS (SELECT word, word FROM forms UNION SELECT l.word, f.form FROM led l JOIN forms f ON l.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM forms f JOIN led l ON f.word = l.word JOIN forms e ON l.root = e.word WHERE e.form IS NULL
"""
