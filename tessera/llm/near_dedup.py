"""Operator 8: near-duplicate documents by Order MinHash.

A text's k-mers are its runs of five words, each labelled with how often it occurred before. A sketch takes the few
labelled k-mers of least hash and keeps them in text order, so that equal sketches speak for a small edit distance and not
only for common words. Texts that share one of BANDS sketches are candidates, and short texts that share one of their rarest
k-mers; a banded alignment of their k-mers decides. Similarity is aligned k-mers over all k-mers of the two (a Jaccard
similarity that respects order)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_back, stash, table

WORDS, BANDS, KEPT, SIMILARITY, SEED = 5, 20, 4, 0.8, 29
#: Pairs in which a text has so few k-mers are found by their k-mers, without sketches.
FEW = 14
#: Bits of a k-mer signature, in longs.
SIGNED = 8
#: Words whose hashes a worker remembers.
CACHE = 200_000
#: A digest with more than this share of the rows is joined by broadcast; at most 1/HOT_SHARE such digests exist.
HOT_SHARE = 0.001
#: Pivot rounds go on while a round links at least this share of the rows that were apart.
WORTH = 0.1


BUCKET = ["band", "key"]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_mix = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(SEED)
_salt = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)[:, None]
_odd = (_rng.integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_place = (_rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def kmers(hashes: np.ndarray) -> np.ndarray:
    """Occurrence-labelled k-mers of a text's word hashes; one for a text of fewer words, none for an empty one."""
    n = len(hashes)
    if not n:
        return hashes
    m = max(1, n - WORDS + 1)
    s = np.zeros(m, np.uint64)
    for j in range(min(WORDS, n)):
        s += hashes[j : j + m] * _place[j]
    s = (s ^ (s >> np.uint64(31))) * _mix
    order = np.argsort(s, kind="stable")
    held = s[order]
    again = held[1:] == held[:-1]
    if again.any():
        at = np.arange(m)
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~again]), at, 0))
        s[order] = held + (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return s ^ (s >> np.uint64(29))


def sketches(s: np.ndarray) -> np.ndarray:
    """A number for each band."""
    if not len(s):
        return np.zeros(0, np.int64)
    if len(s) <= KEPT:
        chosen = np.repeat(s[None], BANDS, axis=0)  # all of them
    else:
        h = (s[None] ^ _salt) * _odd
        rows, at = np.arange(BANDS), np.empty((BANDS, KEPT), np.int64)
        for i in range(KEPT):
            at[:, i] = h.argmin(axis=1)
            h[rows, at[:, i]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at.sort(axis=1)
        chosen = s[at]
    key = np.zeros(len(chosen), np.uint64)
    for i in range(chosen.shape[1]):
        key = (key ^ chosen[:, i]) * _mix
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def signature(seq: np.ndarray) -> np.ndarray:
    """For each of SIGNED * 64 cells, whether an odd number of k-mers falls into it. Signatures of two texts differ in no
    more cells than k-mers are left over when the texts are aligned."""
    cells = (seq * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64) % (SIGNED * 64)
    return np.packbits((np.bincount(cells, minlength=SIGNED * 64) & 1).astype(np.uint8)).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """Similarity of two k-mer sequences by an alignment within the band that a similarity of ``threshold`` allows;
    0 if it is certainly below. As labelled k-mers occur once, the alignment is a longest increasing run of matches."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    least = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
    if min(n, m) < least:
        return 0.0
    order = np.argsort(b, kind="stable")
    there = np.searchsorted(b[order], a)
    there[there == m] = 0
    match = b[order][there] == a
    i, j = np.flatnonzero(match), order[there[match]]
    j = j[np.abs(i - j) <= max(n, m) - least]
    if len(j) < least:
        return 0.0
    if (np.diff(j) > 0).all():
        longest = len(j)
    else:
        from bisect import bisect_left

        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        longest = len(tails)
    return longest / (n + m - longest)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text_hash, digest, n, bands, sig, seq): digest is of the lower-cased words, n counts k-mers, seq holds
    them in four bytes each."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for part in (batch.slice(i, 500) for batch in batches for i in range(0, batch.num_rows, 500)):
            digest, size, bands, sig, seq = [], [], [], [], []
            for text in part.column("text").to_pylist():
                words = text.lower().split() if isinstance(text, str) else []
                if len(known) > CACHE:
                    known.clear()
                s = kmers(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                short = (s >> np.uint64(32)).astype(np.uint32)
                digest.append(blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                size.append(len(s))
                bands.append(sketches(s))
                sig.append(signature(short))
                seq.append(short.tobytes())
            columns = [*(part.column(c) for c in ("row", "id", "text_hash")), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64())), pa.array(seq, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "text_hash", "digest", "n", "bands", "sig", "seq"])
        known.clear()
        give_back()

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return slim.mapInArrow(prints, "row long, id long, text_hash long, digest binary, n int, bands array<long>, sig array<long>, seq binary")


def linked(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) whose sequences are similar."""

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([aligned(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), threshold) for a, b in zip(x, y)], dtype=float)

    both = pairs.join(seqs.select(F.col("row").alias("a"), F.col("seq").alias("sa")), "a").join(seqs.select(F.col("row").alias("b"), F.col("seq").alias("sb")), "b")
    return both.withColumn("s", similarity("sa", "sb")).filter(F.col("s") >= threshold - 1e-12).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(row, comp, ..) for all rows with a link: comp is the least row that is reached. Labels spread along links and jump
    to their label's label until nothing changes."""
    both = stash(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("row"), F.least("a", "m").alias("comp"), F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(labels.select(F.col("row").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.drop("moved").join(near.select(F.col("a").alias("row"), "m"), "row", "left").select("row", F.least("comp", F.coalesce("m", "comp")).alias("next"), "comp")
        jump = step.join(labels.select(F.col("row").alias("next"), F.col("comp").alias("far")), "next", "left")
        grown = stash(jump.select("row", F.least("next", F.coalesce("far", "next")).alias("comp"), (F.least("next", F.coalesce("far", "next")) != F.col("comp")).alias("moved")), "labels")
        discard(labels)
        labels = grown
        if not grown.filter("moved").take(1):
            discard(both)
            return labels


def _ordered(a: Column, b: Column, df: DataFrame) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def merge_labels(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(row, comp) after more links: only components meet, so later rounds are small."""
    if labels is None:
        return components(links)
    if not links.take(1):
        return labels
    of = lambda c: labels.select(F.col("row").alias(c), F.col("comp").alias(f"{c}_comp"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = components(named.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).filter("a != b"))
    known = labels.join(joined.select(F.col("row").alias("comp"), F.col("comp").alias("now")), "comp", "left").select("row", F.coalesce("now", "comp").alias("comp"))
    new = joined.select("row", "comp").join(labels.select("row"), "row", "left_anti")
    merged = stash(known.unionByName(new), "labels")
    discard(labels, joined)
    return merged


def may_be_similar(n: Column, m: Column, a: Column, b: Column, threshold: float) -> Column:
    """False only for texts of n and m k-mers and signatures a and b that cannot be similar."""
    left_over = reduce(add, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SIGNED)])
    return (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9) & (left_over <= (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-6)


def _open_rows(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with comp, of buckets that hold more than one component. What is aggregated by bucket is written before it is
    joined, here and below, so that Spark sees the shuffles of both sides and can split a hot bucket."""
    named = stash(shared.join(labels.select("row", "comp"), "row", "left").withColumn("comp", F.coalesce("comp", "row")), "named")
    several = stash(named.groupBy(*BUCKET).agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select(*BUCKET), "several")
    rows = stash(named.join(several, BUCKET), "open")
    discard(named, several)
    return rows


def _pivot_round(open_rows: DataFrame, labels: DataFrame | None, seqs: DataFrame, threshold: float, order: Column) -> DataFrame:
    """Compares the rows of each bucket with its pivot, the first row by ``order``, and merges components."""
    pivots = stash(open_rows.groupBy(*BUCKET).agg(F.min(F.struct(order.alias("o"), "row", "n", "comp", "sig")).alias("p")), "pivots")
    near = may_be_similar(F.col("n"), F.col("p.n"), F.col("sig"), F.col("p.sig"), threshold)
    pairs = _ordered(F.col("row"), F.col("p.row"), open_rows.join(pivots, BUCKET).filter((F.col("comp") != F.col("p.comp")) & near))
    links = stash(linked(pairs, seqs, threshold), "links")
    merged = merge_labels(labels, links)
    discard(pivots, links)
    return merged


def spread_kmers(seqs: DataFrame) -> DataFrame:
    """(row, kmer) of sequences."""

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (frame.iloc[i : i + 500] for frame in frames for i in range(0, len(frame), 500)):
            parts = [np.frombuffer(x, np.int32) for x in pdf["seq"]]
            yield pd.DataFrame({"row": np.repeat(pdf["row"].to_numpy(), [len(p) for p in parts]), "kmer": np.concatenate(parts)})

    return seqs.select("row", "seq").mapInPandas(spread, "row long, kmer int")


def short_buckets(short: DataFrame, threshold: float) -> DataFrame:
    """(row, band, key) of short texts: those of n k-mers stand in the buckets of their n - ceil(threshold * n) + 1 rarest.
    Two of similarity ``threshold`` or more have at least one of these in common, as all rank k-mers alike."""
    each = stash(spread_kmers(short), "short")
    ranked = each.join(stash(each.groupBy("kmer").agg(F.count(F.lit(1)).alias("f")), "counts"), "kmer")
    lists = ranked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("f", "kmer"))).alias("k"))  # few of each row
    n = F.size("k")
    rarest = lists.select("row", F.explode(F.slice("k", F.lit(1), (n - F.ceil(threshold * n - 1e-9) + 1).cast("int"))).alias("k"))
    return rarest.filter("k.f > 1").select("row", F.lit(BANDS).alias("band"), F.col("k.kmer").cast("long").alias("key")).distinct()


def own_kmers(rows: DataFrame, seqs: DataFrame) -> DataFrame:
    """(row, own): how many k-mers of each row no other of the rows has. Hashes of four bytes can only make it smaller."""
    kmers_of = spread_kmers(seqs.join(rows, "row", "left_semi"))
    single = kmers_of.groupBy("kmer").agg(F.min("row").alias("row"), F.max("row").alias("_high")).filter("row = _high")
    own = single.groupBy("row").agg(F.count(F.lit(1)).alias("own"))
    return rows.join(own, "row", "left").select("row", F.coalesce("own", F.lit(0)).alias("own"))


def _last_pairs(open_rows: DataFrame, labels: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """Merges the components of all similar pairs in a bucket. A pair within the bucket's largest component needs no look, so
    rows outside of it meet all others."""
    sizes = open_rows.groupBy(*BUCKET, "comp").agg(F.count(F.lit(1)).alias("m"))
    main = stash(sizes.groupBy(*BUCKET).agg(F.max_by("comp", F.struct("m", "comp")).alias("main")), "main")
    every = stash(open_rows.join(main, BUCKET).withColumn("in_main", F.col("comp") == F.col("main")).drop("main"), "sides")
    rest = every.filter("NOT in_main").select(*BUCKET, *[F.col(c).alias(f"{c}_") for c in ("row", "n", "own", "comp", "sig")])
    common = F.least(F.col("n") - F.col("own"), F.col("n_") - F.col("own_"))  # k-mers that the two can have in common
    fits = (common >= threshold * (F.col("n") + F.col("n_") - common) - 1e-9) & may_be_similar(F.col("n"), F.col("n_"), F.col("sig"), F.col("sig_"), threshold)
    apart = (F.col("comp") != F.col("comp_")) & (F.col("in_main") | (F.col("row") < F.col("row_")))
    pairs = _ordered(F.col("row"), F.col("row_"), rest.alias("r").join(every.alias("e"), [F.col(f"r.{c}") == F.col(f"e.{c}") for c in BUCKET] + [apart, fits]))
    links = stash(linked(pairs, seqs, threshold), "links")
    merged = merge_labels(labels, links)
    discard(main, every, links)
    return merged


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``id_col`` (long), class_id (least id of its class), class_size, kept, text_hash.

    Classes are the components of links of similarity ``threshold`` or more; texts whose lower-cased words are the same
    are one class, so null, empty and blank texts are. One row of a class is kept, the one with the least id; of rows that
    repeat it, one. A null id stays only if its class has no other. Other columns are ignored; an empty table gives an
    empty result.

    Candidates are decided in rounds. In each bucket of rows with the same sketch every row is compared with a pivot, which
    gathers a large group of copies by comparisons that grow with its size only. Of what is still apart, a text that has over
    1 - ``threshold`` of its k-mers to itself can have no partner and is settled; the rest meet a pivot with few k-mers of its
    own, which stands in a group's middle, as long as that pays (WORTH). Last, all pairs that still are in different
    components and share one sketch are compared. Pairs that cannot be similar by their sizes, their k-mers of their own, or
    their signatures are not aligned; the rounds and these bounds save work and lose no pair.

    Pairs in which a text has at most FEW k-mers are all found (:func:`short_buckets`). Of longer ones of similarity 0.8, a
    sketch is shared with probability 0.9999 or more (0.99992 at 16 of 20 k-mers, 0.99996 at 40 of 50)."""
    marks = stash(fingerprints(docs, id_col, text_col), "prints")
    first = F.struct(F.col("id").isNull().alias("blank"), "id", "row")
    groups = stash(marks.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies")), "groups")
    reps = groups.select(F.col("first.row").alias("row"))
    picked = marks.filter("n > 0").select("row", "bands").join(reps, "row", "left_semi")
    short = marks.filter(F.col("n").between(1, int(FEW / threshold + 1e-9))).join(reps, "row", "left_semi")
    bands = stash(picked.select("row", F.posexplode("bands").alias("band", "key")).unionByName(short_buckets(short, threshold)), "bands")
    full = stash(bands.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(*BUCKET), "full")
    meeting = stash(bands.join(full, BUCKET), "meeting")
    discard(bands, full)
    seqs = stash(marks.select("row", "n", "sig", "seq").join(meeting.select("row").distinct(), "row", "left_semi"), "seqs")
    shared = stash(meeting.join(seqs.select("row", "n", "sig"), "row"), "shared")
    labels = _pivot_round(shared.withColumn("comp", F.col("row")), None, seqs, threshold, F.xxhash64(F.lit(0), "row"))
    open_rows = _open_rows(shared, labels)
    discard(meeting, shared)
    # of what is still apart, texts whose own k-mers are too many for any partner are settled
    own = own_kmers(open_rows.select("row").distinct(), seqs)
    shared = stash(open_rows.drop("comp").join(own, "row").filter(F.col("n") - F.col("own") >= threshold * F.col("n") - 1e-9), "shared")
    discard(open_rows)
    turn, before = 0, None
    while True:
        open_rows = _open_rows(shared.select(*BUCKET, "row", "n", "sig", "own"), labels)
        discard(shared)
        apart = open_rows.agg(F.approx_count_distinct("comp")).first()[0]  # steers the work only
        if not apart or before and apart > (1 - WORTH) * before:
            break
        turn, before, shared = turn + 1, apart, open_rows
        labels = _pivot_round(open_rows, labels, seqs, threshold, F.struct(F.floor(F.col("own") * 50 / F.col("n")).alias("t"), F.xxhash64(F.lit(turn), "row").alias("x")))
    labels = _last_pairs(open_rows, labels, seqs, threshold) if apart else labels
    discard(open_rows, seqs)
    named_groups = groups.join(labels.select("row", "comp"), groups["first.row"] == labels["row"], "left").select("digest", "first", "copies", F.coalesce("comp", "first.row").alias("comp"))
    named_groups = stash(named_groups, "classes")
    discard(groups)
    classes = stash(named_groups.groupBy("comp").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size")), "heads")
    verdicts = stash(named_groups.join(classes, "comp").select("digest", "copies", "head", "class_size"), "verdicts")
    discard(named_groups, classes)
    bar = max(1, int(marks.count() * HOT_SHARE))
    hot = F.broadcast(verdicts.filter(F.col("copies") > bar))  # at most 1/HOT_SHARE rows
    slim = marks.select("row", "id", "text_hash", "digest")
    out = slim.join(hot, "digest").unionByName(slim.join(hot.select("digest"), "digest", "left_anti").join(verdicts, "digest"))
    return out.select(F.col("id").alias(id_col), F.col("head.id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("kept"), "text_hash")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`near_duplicates` keeps; of rows that repeat an id, or have none, and
    a text one stays."""
    kept = near_duplicates(docs, id_col, text_col, threshold).filter("kept").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_text_hash"))
    marked = docs.withColumn("_text_hash", F.xxhash64(text_col)).alias("d")
    named = F.col(f"d.{id_col}").eqNullSafe(F.col("k._id")) & (F.col("d._text_hash") == F.col("k._text_hash"))
    same = marked.join(kept.hint("shuffle_hash").alias("k"), named, "left_semi")
    again = docs.groupBy(id_col).count().filter("count > 1").take(1)
    return (same.dropDuplicates([id_col, "_text_hash"]) if again else same).drop("_text_hash")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`near_duplicates` of ``documents``: doc_id, class_id, class_size, kept."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
