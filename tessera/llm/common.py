"""What several corpus operators share: reading tables, cutting lineage, seeded sampling thresholds."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where it is unset, for local masters, a
    folder of this machine is chosen."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(shared_dir, "_local", None) or tempfile.mkdtemp(prefix="tessera-shared-")
        shared_dir._local = at
    return at.rstrip("/")


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, at = _folder(spark, path)
    return files.exists(at)


def remove_folder(spark: SparkSession, path: str) -> None:
    files, at = _folder(spark, path)
    files.delete(at, True)


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stashed inside goes when the block ends: write results first."""
    _scratch.append(f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        remove_folder(spark, _scratch.pop())


def stash(df: DataFrame, name: str = "part", keep: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts the lineage, survives lost
    executors, and later readers get column pruning. ``keep`` names another folder, out of reach of :func:`scratch`."""
    spark = df.sparkSession
    path = f"{keep or (_scratch[-1] if _scratch else shared_dir(spark))}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._stashed = path
    return read


def discard(*stashed: DataFrame) -> None:
    """Removes what :func:`stash` wrote, once all that was read from it is written itself."""
    for df in stashed:
        remove_folder(df.sparkSession, df._stashed)


def give_back() -> None:
    """Returns what a task of a Python worker has freed to the machine, as the worker lives on."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sampled(df: DataFrame, by: str, per_value: int, key: Column, seed: int) -> DataFrame:
    """At most about ``per_value`` rows of each value of ``by``, chosen by a seeded hash of ``key``.

    One aggregation counts the values; the filter that follows needs no shuffle. Few values of ``by``
    are expected (classes of a classifier)."""
    counts = {r[0]: r[1] for r in df.filter(F.col(by).isNotNull()).groupBy(by).count().collect()}
    draw = F.pmod(F.xxhash64(F.lit(seed), key.cast("string")), F.lit(1_000_000))
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(by) == F.lit(value)) & (draw < int(1_000_000 * min(1.0, per_value / n))))
    return df.filter(keep)
