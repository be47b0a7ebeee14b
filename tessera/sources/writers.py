"""Writing DataFrames: files, tables, dead letters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", header).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by_date: str | None = None, mode: str = "errorifexists", files: int = 16) -> None:
    """Parquet; with a date column, in folders of year, month and day that later reads can prune. A day's rows are dealt over
    at most ``files`` tasks."""
    if partition_by_date:
        d = F.col(partition_by_date)
        df = df.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d)})
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(files))
        salted = df.withColumn("_salt", salt).repartition("year", "month", "day", "_salt").drop("_salt")
        salted.write.mode(mode).partitionBy("year", "month", "day").parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def load_table(df: DataFrame, name: str, mode: str = "insert") -> None:
    """``insert`` appends, ``replace`` empties the table first."""
    df.write.mode({"insert": "append", "replace": "overwrite"}[mode]).saveAsTable(name)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", partitions: int = 8, batch: int = 10_000, properties: Mapping[str, str] | None = None) -> None:
    """Loads a database table in batches over at most ``partitions`` connections; ``overwrite`` empties the table and keeps
    its definition."""
    df.write.format("jdbc").option("url", url).option("dbtable", name).option("numPartitions", partitions).option("batchsize", batch).option("truncate", True).options(**(properties or {})).mode(mode).save()


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """The target after a merge: rows of ``source`` replace those of equal key. With ``order``, the last of the source's
    rows of a key wins; else its keys must be unique. Null keys equal each other."""
    if order is not None:
        source = source.groupBy(*keys).agg(F.max_by(F.struct(*source.columns), order).alias("r")).select("r.*")
    same = None
    for k in keys:
        c = target[k].eqNullSafe(source[k])
        same = c if same is None else same & c
    return target.join(source, same, "left_anti").unionByName(source)


def ntriples(triples: DataFrame) -> DataFrame:
    """N-Triples lines (value) of (s, p, o, datatype, lang)."""
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(iri(c))
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))
    literal = F.when(F.col("datatype").isNotNull(), F.concat(quoted, F.lit("^^"), iri(F.col("datatype")))).when(F.col("lang").isNotNull(), F.concat(quoted, F.lit("@"), F.col("lang")))
    plain = F.when(F.col("o").rlike(r"^(https?|urn):|^_:"), node(F.col("o"))).otherwise(quoted)
    return triples.select(F.concat_ws(" ", node(F.col("s")), iri(F.col("p")), F.coalesce(literal, plain), F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.text(path)


def write_kafka(df: DataFrame, servers: str, topic: str, key: str) -> None:
    df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


# What a message must hold for its category, in the order in which they are tried, and whether a retry may help.
ERROR_WORDS: tuple[tuple[str, str, bool], ...] = (
    ("connection", "connection|connect", True),
    ("constraint", "constraint|duplicate|foreign key", False),
    ("format", "parse|format", False),
    ("timeout", "timeout", True),
    ("transformation", "transform", False),
    ("io", "io|file", False),
)


def dead_letter(df: DataFrame, error: Column, row_number: Column) -> DataFrame:
    """The failed rows: row_number, message, retry_count 0, and the row as JSON."""
    return df.withColumn("_m", error).filter(F.col("_m").isNotNull()).select(row_number.alias("row_number"), F.col("_m").alias("message"), F.lit(0).alias("retry_count"), F.to_json(F.struct(*df.columns)).alias("payload"))


def passed(df: DataFrame, error: Column) -> DataFrame:
    return df.filter(error.isNull())


def classify_errors(dlq: DataFrame, message: str = "message") -> DataFrame:
    """``category`` by the first words found in the message, and whether a retry may help (``transient``)."""
    low, kind, soft = F.lower(F.coalesce(F.col(message), F.lit(""))), None, None
    for name, words, transient in ERROR_WORDS:
        hit = low.rlike(words)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        soft = F.when(hit, F.lit(transient)) if soft is None else soft.when(hit, F.lit(transient))
    return dlq.withColumns({"category": kind.otherwise("unknown"), "transient": soft.otherwise(False)})


def dlq_stats(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("category").agg(F.count(F.lit(1)).alias("rows"), F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"))


def dlq_read(dlq: DataFrame, category: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    df = dlq if category is None else dlq.filter(F.col("category") == category)
    return df.orderBy("row_number").offset(offset).limit(limit)


def dlq_reprocess(dlq: DataFrame, keep: Column, again: Callable[[DataFrame], DataFrame], error: Column) -> tuple[DataFrame, DataFrame]:
    """Runs the letters that fit ``keep`` through ``again``: those that pass, and those that fail with retry_count + 1."""
    done = again(dlq.filter(keep)).withColumn("_m", error)
    return done.filter(F.col("_m").isNull()).drop("_m"), done.filter(F.col("_m").isNotNull()).withColumns({"message": F.col("_m"), "retry_count": F.col("retry_count") + 1}).drop("_m")
