"""A change log in a shared folder as a Spark data source, ``tessera_log``: keyed messages in partitions with offsets.

Tasks write segments, Parquet files of one partition's messages; a batch counts once its commit is written, a small file that
gives each segment its first offset and holds the ends of all partitions. Streams keep their offsets in their checkpoints;
``startingOffsets`` (``earliest``, ``latest`` or JSON of partition -> offset) starts one anywhere, and a batch read replays
what lies between two positions. One writer at a time; a streaming batch that is written again is written once."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "partition int, offset bigint, key string, value string"
MESSAGE = pa.schema([("key", pa.string()), ("value", pa.string())])
PARTITIONS, ROWS_AT_ONCE = 4, 10_000
Offsets = dict[str, int]


class Folder:
    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        self.root = self.root.rstrip("/")

    def commits(self) -> list[str]:
        """Names of commits, oldest first."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".json"))

    def commit(self, name: str) -> dict:
        with self.files.open_input_stream(f"{self.root}/commits/{name}") as f:
            return json.loads(f.read())

    def ends(self) -> Offsets:
        names = self.commits()
        return self.commit(names[-1])["ends"] if names else {}

    def write_commit(self, name: str, found: dict) -> None:
        self.files.create_dir(f"{self.root}/commits", recursive=True)
        hidden = f"{self.root}/commits/.{name}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(hidden) as f:
            f.write(json.dumps(found).encode())
        self.files.move(hidden, f"{self.root}/commits/{name}")

    def slices(self, start: Offsets, end: Offsets) -> list[Slice]:
        """The parts of segments between two positions. Commits are read from the newest down to where ``start`` lies."""
        out = []
        for name in reversed(self.commits()):
            one = self.commit(name)
            if all(n <= start.get(p, 0) for p, n in one["ends"].items()):
                break
            for p, base, count, file in one["segments"]:
                low, high = max(base, start.get(str(p), 0)), min(base + count, end.get(str(p), 0))
                if low < high:
                    out.append(Slice(f"{self.root}/segments/{file}", p, base, low, high))
        return sorted(out, key=lambda s: (s.partition, s.low))


@dataclass
class Slice(InputPartition):
    file: str
    partition: int
    base: int
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    segments: list  # (partition, rows, file)


def read_slice(path: str, s: Slice) -> Iterator[pa.RecordBatch]:
    at = s.base
    with pq.ParquetFile(s.file, filesystem=Folder(path).files) as f:
        for batch in f.iter_batches(ROWS_AT_ONCE):
            a, b = max(s.low - at, 0), min(s.high - at, len(batch))
            if a < b:
                part = batch.slice(a, b - a)
                numbers = pa.array(np.arange(at + a, at + b))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), s.partition, np.int32)), numbers, part.column("key"), part.column("value")], ["partition", "offset", "key", "value"])
            at += len(batch)


def position(text: str, ends: Offsets) -> Offsets:
    return {p: 0 for p in ends} if text == "earliest" else dict(ends) if text == "latest" else {str(p): int(n) for p, n in json.loads(text).items()}


class LogReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[Slice]:
        folder = Folder(self.options["path"])
        ends = folder.ends()
        start, end = position(self.options.get("startingoffsets", "earliest"), ends), position(self.options.get("endingoffsets", "latest"), ends)
        return folder.slices(start, end)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return read_slice(self.options["path"], partition)


class LogStream(DataSourceStreamReader):
    """``maxPerTrigger`` bounds the messages a partition gives to a batch, but for the first one after a restart."""

    def __init__(self, options: Mapping[str, str]):
        self.options, self.at = dict(options), None

    def initialOffset(self) -> Offsets:  # noqa: N802
        self.at = position(self.options.get("startingoffsets", "earliest"), Folder(self.options["path"]).ends())
        return self.at

    def latestOffset(self) -> Offsets:  # noqa: N802
        ends, most = Folder(self.options["path"]).ends(), self.options.get("maxpertrigger")
        ends = position(self.options.get("endingoffsets", "latest"), ends)
        if most is None or self.at is None:
            return ends or self.at or {}
        self.at = {p: min(n, self.at.get(p, 0) + int(most)) for p, n in ends.items()}
        return self.at

    def partitions(self, start: Offsets, end: Offsets) -> list[Slice]:
        self.at = dict(end)
        return Folder(self.options["path"]).slices(start, end)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return read_slice(self.options["path"], partition)

    def commit(self, end: Offsets) -> None:
        pass


class LogWriter(DataSourceArrowWriter, DataSourceStreamArrowWriter):
    """Writes ``key`` and ``value``; equal keys go to one partition. Rows come and stay in Arrow batches."""

    def __init__(self, options: Mapping[str, str]):
        self.options, self.many = dict(options), int(options.get("partitions", PARTITIONS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, waiting, open_ = Folder(self.options["path"]), {}, {}
        folder.files.create_dir(f"{folder.root}/segments", recursive=True)

        def flush(p: int) -> None:
            rows = pa.Table.from_batches(waiting.pop(p))
            if p not in open_:
                name = f"{uuid.uuid4().hex}-{p}.parquet"
                open_[p] = [pq.ParquetWriter(f"{folder.root}/segments/{name}", MESSAGE, filesystem=folder.files), 0, name]
            open_[p][0].write_table(rows)
            open_[p][1] += len(rows)

        for batch in iterator:
            batch = pa.RecordBatch.from_arrays([batch.column(c).cast(pa.string()) for c in MESSAGE.names], schema=MESSAGE)
            to = np.array([zlib.crc32((k or "").encode()) for k in batch.column("key").to_pylist()], np.int64) % self.many
            for p in np.unique(to).tolist():
                waiting.setdefault(p, []).append(batch.take(pa.array(np.flatnonzero(to == p))))
                if sum(map(len, waiting[p])) >= ROWS_AT_ONCE:
                    flush(p)
        for p in list(waiting):
            flush(p)
        for writer, _, _ in open_.values():
            writer.close()
        return Written([(p, n, name) for p, (_, n, name) in sorted(open_.items())])

    def commit(self, messages: list[Written], batchId: int | None = None) -> None:  # noqa: N803
        folder = Folder(self.options["path"])
        names = folder.commits()
        token = uuid.uuid4().hex if batchId is None else f"{self.options.get('writer', 'stream')}~{batchId}"
        if any(n.split("-", 1)[1] == f"{token}.json" for n in names):
            return self.abort(messages, batchId)
        ends, segments = folder.ends() or {str(p): 0 for p in range(self.many)}, []
        if len(ends) != self.many:
            raise ValueError(f"the log has {len(ends)} partitions")
        for m in messages:
            for p, n, file in m.segments if m else []:
                segments.append((p, ends[str(p)], n, file))
                ends[str(p)] += n
        folder.write_commit(f"{len(names):012d}-{token}.json", {"ends": ends, "segments": segments})

    def abort(self, messages: list[Written], batchId: int | None = None) -> None:  # noqa: N803
        folder = Folder(self.options["path"])
        for m in messages:
            for _, _, file in m.segments if m else []:
                folder.files.delete_file(f"{folder.root}/segments/{file}")


class ChangeLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:  # noqa: ANN001
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:  # noqa: ANN001, N802
        return LogStream(self.options)

    def writer(self, schema, overwrite: bool) -> LogWriter:  # noqa: ANN001
        return LogWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> LogWriter:  # noqa: ANN001, N802
        return LogWriter(self.options)


def messages(df: DataFrame, key: str) -> DataFrame:
    """(key, value): rows as JSON."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def append_log(rows: DataFrame, path: str, partitions: int = PARTITIONS) -> None:
    """Appends (key, value) as one commit."""
    rows.sparkSession.dataSource.register(ChangeLog)
    rows.select("key", "value").write.format("tessera_log").option("path", path).option("partitions", partitions).mode("append").save()


def write_log_stream(stream: DataFrame, path: str, checkpoint: str, writer: str = "stream", partitions: int = PARTITIONS):  # noqa: ANN201
    """A stream of (key, value) into the log: each of its batches once. Streams that share a log need different ``writer`` names."""
    stream.sparkSession.dataSource.register(ChangeLog)
    return stream.select("key", "value").writeStream.format("tessera_log").option("path", path).option("partitions", partitions).option("writer", writer).option("checkpointLocation", checkpoint)


def _text(at: str | Offsets) -> str:
    return at if isinstance(at, str) else json.dumps(at)


def read_log_stream(spark: SparkSession, path: str, starting_offsets: str | Offsets = "earliest", ending_offsets: str | Offsets = "latest", max_per_trigger: int | None = None) -> DataFrame:
    """The log as a stream of partition, offset, key, value. A checkpoint's offsets go before ``starting_offsets``; with
    ``ending_offsets`` the stream goes no further than these."""
    spark.dataSource.register(ChangeLog)
    reader = spark.readStream.format("tessera_log").option("path", path).option("startingOffsets", _text(starting_offsets)).option("endingOffsets", _text(ending_offsets))
    return (reader.option("maxPerTrigger", max_per_trigger) if max_per_trigger else reader).load()


def replay(spark: SparkSession, path: str, start: str | Offsets = "earliest", end: str | Offsets = "latest") -> DataFrame:
    """The messages between two positions, as a table."""
    spark.dataSource.register(ChangeLog)
    return spark.read.format("tessera_log").option("path", path).option("startingOffsets", _text(start)).option("endingOffsets", _text(end)).load()


def log_position(path: str) -> Offsets:
    """Where the log ends now: partition -> next offset."""
    return Folder(path).ends()
