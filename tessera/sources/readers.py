"""Reading tables, files and change streams into DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Lines, and bytes, that are looked at to detect a CSV file's dialect.
SNIFF_LINES, SNIFF_BYTES = 200, 65_536
DELIMITERS = (",", ";", "\t", "|")


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = True, encoding: str = "UTF-8", skip_rows: int = 0, max_rows: int | None = None, schema: StructType | str | None = None) -> DataFrame:
    """CSV rows as text columns, unless a schema is given. Headerless columns are named column_1, column_2, ...

    ``skip_rows`` leaves out the first lines of each file, before its header."""
    if not skip_rows:
        reader = spark.read.option("sep", delimiter).option("header", has_header).option("encoding", encoding)
        df = (reader.schema(schema) if schema else reader).csv(path)
    else:
        lines = spark.read.option("encoding", encoding).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
        first = lines.groupBy("file").agg(F.min("at").alias("first"))  # a small file is one partition; a large one starts at its first
        kept = lines.join(first, "file").filter(F.col("at") - F.col("first") >= skip_rows)
        head = kept.orderBy("at").first() if has_header else None
        names = [c.strip() for c in head["value"].split(delimiter)] if head else None
        body = kept.filter(F.col("at") - F.col("first") > skip_rows) if has_header else kept
        n = len(names) if names else len(kept.first()["value"].split(delimiter))
        names = names or [f"_c{i}" for i in range(n)]
        fields = ", ".join(f"`{x}` STRING" for x in names)
        df = body.select(F.from_csv("value", fields, {"sep": delimiter}).alias("r")).select("r.*")
    if not has_header:
        df = df.toDF(*[f"column_{i + 1}" for i in range(len(df.columns))])
    return df if max_rows is None else df.limit(max_rows)


# The marks that files begin with, and their encodings.
MARKS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))


def _head(spark: SparkSession, path: str) -> bytes:
    """The first SNIFF_BYTES of a file; of a folder, those of its first file that has more than one line, as a task without rows
    writes a header alone; else of the first that has any."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    inside = [s.getPath() for s in files.listStatus(at) if s.isFile() and s.getLen() and not s.getPath().getName().startswith(("_", "."))]
    first = b""
    for p in sorted(inside, key=lambda p: p.toString()):
        stream = files.open(p)
        try:
            head = bytes(stream.readNBytes(SNIFF_BYTES))
        finally:
            stream.close()
        first = first or head
        if len(head.decode(detect_encoding(head), "replace").splitlines()) > 1:
            return head
    return first


def detect_encoding(head: bytes) -> str:
    """By the mark that the bytes begin with; else UTF-8 if they are, else windows-1252."""
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.end < len(head) or len(head) < SNIFF_BYTES:  # and not a character that the cut has split
            return "windows-1252"
    return "UTF-8"


def sniff_csv(spark: SparkSession, path: str) -> dict:
    """Encoding, delimiter and header of a CSV file, from its first lines: the delimiter that cuts most lines into the same number
    (over one) of fields; a header if the first line has no number where the others do."""
    head = _head(spark, path)
    encoding = detect_encoding(head)
    lines = head.decode(encoding, "replace").lstrip("\ufeff").splitlines()
    lines = (lines[:-1] if len(head) == SNIFF_BYTES and len(lines) > 1 else lines)[:SNIFF_LINES]
    best, fields = ",", 1
    for d in DELIMITERS:
        counts = [line.count(d) for line in lines if line]
        common = max(set(counts), key=counts.count) if counts else 0
        share = counts.count(common) / len(counts) if counts else 0
        if common and share > 0.8 and common + 1 > fields:
            best, fields = d, common + 1
    number = lambda x: x.strip().replace(".", "", 1).lstrip("+-").isdigit()
    rows = [line.split(best) for line in lines if line]
    header = len(rows) > 1 and not any(map(number, rows[0])) and (any(any(map(number, r)) for r in rows[1:]) or len(set(rows[0])) == len(rows[0]))
    return {"delimiter": best, "has_header": header, "fields": fields, "encoding": encoding}


def read_json(spark: SparkSession, path: str, array: bool = False, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", array)
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, sql: str | None = None, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 8, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A database table or query, read in ranges of ``partition_column`` when it is given."""
    reader = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    reader = reader.option("dbtable", f"({sql}) q" if sql else table)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def extract_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.select(*columns) if columns else df


def extract_incremental(df: DataFrame, column: str, last_value) -> DataFrame:
    """Rows whose ``column`` is beyond the last value seen; the filter is pushed to the source."""
    return df.filter(F.col(column) > F.lit(last_value))


def next_watermark(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("next_value"), F.count(F.lit(1)).alias("rows"))


def extract_query(spark: SparkSession, views: Mapping[str, DataFrame], sql: str, args: Mapping | None = None) -> DataFrame:
    """Any SQL over named tables."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=dict(args or {}))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples lines as (s, p, o, datatype, lang); comments and blank lines are left out."""
    line = F.trim("value")
    subject = r"^(<[^>]*>|_:\S+)\s+<([^>]*)>\s+"
    rest = F.regexp_replace(line, subject, "")
    literal = r'^"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?\s*\.\s*$'
    thing = r"^(<[^>]*>|_:\S+)\s*\.\s*$"
    none = lambda c: F.nullif(c, F.lit(""))
    unquote = lambda c: F.regexp_replace(F.regexp_replace(c, r'\\"', '"'), r"\\\\", r"\\")
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    is_literal = rest.rlike(literal)
    return (
        spark.read.text(path).filter(~line.startswith("#") & (line != "")).filter(line.rlike(subject))
        .select(
            bare(F.regexp_extract(line, subject, 1)).alias("s"), F.regexp_extract(line, subject, 2).alias("p"),
            F.when(is_literal, unquote(F.regexp_extract(rest, literal, 1))).otherwise(bare(F.regexp_extract(rest, thing, 1))).alias("o"),
            F.when(is_literal, none(F.regexp_extract(rest, literal, 2))).alias("datatype"), F.when(is_literal, none(F.regexp_extract(rest, literal, 3))).alias("lang"),
        )
    )


def read_cdc_stream(spark: SparkSession, servers: str, topic: str, starting_offsets: str = "earliest", max_per_trigger: int | None = None) -> DataFrame:
    """Change events of a Kafka topic: key, value, topic, partition, offset. Offsets are kept by the query's checkpoint;
    ``starting_offsets`` (a word or JSON) replays from a position."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting_offsets)
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp")


def read_cdc_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same from JSON envelopes in files, as a stream."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def add_row_ids(df: DataFrame, source: str, key: Sequence[str], name: str = "_row_id") -> DataFrame:
    """A stable row id of the source's name and its key columns."""
    return df.withColumn(name, F.concat_ws(":", F.lit(source), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))


def infer_types(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(column, inferred) for text columns, in one pass: the narrowest type that more than ``threshold`` of the values
    that aren't null, empty or NA have. Whole numbers, then numbers, booleans, dates, else text."""
    parts: list[Column] = []
    for c in df.columns:
        v = F.col(c).cast("string")
        some = v.isNotNull() & ~F.lower(F.trim(v)).isin("", "na", "null")
        n = F.count_if(some)
        share = lambda ok, n=n: F.try_divide(F.count_if(ok), n)
        is_int = some & F.trim(v).rlike(r"^[+-]?[0-9]+$")
        is_num = some & F.trim(v).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        is_bool = some & F.lower(F.trim(v)).isin("true", "false", "yes", "no", "t", "f", "y", "n")
        is_date = some & F.trim(v).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")
        kind = F.when(share(is_int) > threshold, "integer").when(share(is_num) > threshold, "float").when(share(is_bool) > threshold, "boolean").when(share(is_date) > threshold, "date").otherwise("string")
        parts.append(F.struct(F.lit(c).alias("column"), kind.alias("inferred")))
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
