"""Operator 10: exact deduplication against a persistent digest index (native DataFrame operations only)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, folder_exists, partitions, remove_folder, shared_dir, stash, table

#: ``[\x20\x09-\x0D]+``: what counts as one space when texts are compared.
SPACE = r"[\x20\x09-\x0D]+"
#: A digest with more than this share of the rows is joined by broadcast; at most 1/HOT_SHARE such digests exist.
HOT_SHARE = 0.001


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space replaced by one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256)


class DigestIndex:
    """A table ``(digest, keep_id, group_size, batch)``, bucketed and sorted by digest, that outlives its session.

    ``path`` names its folder (default: a new one in the shared folder); an index that is opened again keeps the number of
    ``buckets`` it was made with. ``group_size`` is the number of rows that the batch which brought the digest held of it."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
        self.name = f"digest_index_{uuid.uuid4().hex}"
        if folder_exists(spark, f"{self.path}.buckets"):
            self.buckets = spark.read.parquet(f"{self.path}.buckets").first()["buckets"]
        else:
            self.buckets = buckets or partitions(spark)
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(f"{self.path}.buckets")
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self, remove: bool = False) -> None:
        """Forgets the table's name; its files stay, but for ``remove``."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if remove:
            remove_folder(self.spark, self.path)
            remove_folder(self.spark, f"{self.path}.buckets")

    def unseen(self, found: DataFrame) -> DataFrame:
        """The rows of ``found`` whose digest the index does not hold, by a sort-merge anti-join: the index's buckets are
        read as they lie, without a shuffle, and ``found`` is dealt to them."""
        return found.join(self.frame().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicates a batch against the index and itself, appends the new digests, and returns one row per
        row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256.

        Of equal texts the row with the smallest id stays, unless an earlier batch brought the text: then none of
        this batch does, keep_id names the earlier row and group_size counts both batches. Null and empty texts are
        equal to each other. Of rows that repeat an id and a text one is marked kept. Rows with a null id stay only
        if no other row of their text has an id. Other columns of ``docs`` are ignored; an empty table gives an empty
        result. A job that may be run again names its ``batch``: what a batch of that name has appended does not count
        against it, so that the same rows get the same verdicts and nothing is appended twice."""
        batch = batch or uuid.uuid4().hex
        slim = stash(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.unhex(text_digest(F.col(text_col))).alias("digest")), "digest")
        first = F.min(F.struct(F.col("id").isNull().alias("blank"), "id", "row"))
        found = stash(slim.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "batch")
        earlier = self.frame().filter(F.col("batch") != batch).groupBy("digest").agg(F.min("keep_id").alias("old_id"), F.sum("group_size").alias("old_n"))
        fresh = stash(self.unseen(found).select("digest", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(batch).alias("batch")), "fresh")
        seen = bool(self.frame().filter(F.col("batch") != batch).take(1))
        if seen:
            found = stash(found.join(earlier.hint("merge"), "digest", "left"), "batch")
        else:
            found = found.withColumns({"old_id": F.lit(None).cast("bigint"), "old_n": F.lit(None).cast("bigint")})
        fresh.repartition(self.buckets, "digest").write.insertInto(self.name)
        discard(fresh)
        mine = F.col("old_n").isNull()
        verdicts = found.select(
            "digest",
            F.when(mine, F.col("first.id")).otherwise(F.col("old_id")).alias("keep_id"),
            (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("group_size"),
            F.when(mine, F.col("first.row")).alias("keep_row"),
        )
        hot = F.col("n") > max(1, int(slim.count() * HOT_SHARE))
        sizes = F.broadcast(found.filter(hot).select("digest"))  # at most 1/HOT_SHARE rows
        few = F.broadcast(verdicts.join(sizes, "digest", "left_semi"))
        out = slim.join(few, "digest").unionByName(slim.join(sizes, "digest", "left_anti").join(verdicts, "digest"))
        kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
        return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """:meth:`DigestIndex.add`, with an index for this call only when none is given."""
    if index is not None:
        return index.add(docs, id_col, text_col)
    index = DigestIndex(docs.sparkSession)
    out = index.add(docs, id_col, text_col)  # reads what add has written, no longer the index
    index.close(remove=True)
    return out


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, null_ids: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`exact_dedup` marks kept. Rows with a null id go unless ``null_ids``
    is set, as in the pipeline; of rows that repeat an id (or have none) and a text one stays. What is kept is a few bytes a row beside the texts it is joined with, so it
    is the hashed side of that join."""
    kept = exact_dedup(docs, id_col, text_col, index).filter("kept").select(F.col(id_col).alias("_id"), F.unhex("text_sha256").alias("_digest"))
    marked = docs.withColumn("_digest", F.unhex(text_digest(F.col(text_col))))
    named = F.col(f"d.{id_col}").eqNullSafe(F.col("k._id")) if null_ids else F.col(f"d.{id_col}") == F.col("k._id")
    same = marked.alias("d").join(kept.hint("shuffle_hash").alias("k"), named & (F.col("d._digest") == F.col("k._digest")), "left_semi")
    again = docs.groupBy(id_col).count().filter("count > 1").take(1)
    return (same.dropDuplicates([id_col, "_digest"]) if again else same).drop("_digest")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`exact_dedup` of ``documents``: doc_id, keep_id, group_size, kept, text_sha256. Null texts count as empty, ties go to
    the smallest id, every row has its verdict."""
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
