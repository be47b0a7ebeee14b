"""What operators that cut lineage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where ``spark.checkpoint.dir`` is unset a folder of this machine is set, for local
    masters only: on a cluster other machines don't see it."""
    at = spark.sparkContext.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="tessera-checkpoints-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name within the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, at: str) -> DataFrame:
    """``df``, written to ``at`` and read from there: as a checkpoint, but in columns, and joins know how large it is."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop_stored(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
