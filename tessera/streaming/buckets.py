"""The latest state of a change stream, in buckets by key: a batch rewrites only the buckets that it touches.

``data/version=v/_bucket=b`` holds a bucket as version v wrote it; ``manifest/version=v`` names, for each bucket that has
rows, the version whose files are live. A version counts once its manifest is whole. A batch that runs again finds its
manifest and does nothing, or writes the same files from the same predecessor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, KEEP, ROWS_A_TASK = 64, 2, 1_000_000


class BucketedState:
    """``keep`` versions stay readable. ``keys`` name a row; ``fields`` are the state's columns. An existing state keeps its
    number of buckets."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], fields: Sequence[str], buckets: int = BUCKETS, keep: int = KEEP):
        self.spark, self.path, self.keys, self.fields, self.keep = spark, path.rstrip("/"), list(keys), list(fields), max(1, keep)
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        known = self.versions()
        self.buckets = spark.read.parquet(f"{self.path}/manifest/version={known[-1]}").first()["buckets"] if known else buckets

    def _at(self, path: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _numbers(self, path: str, prefix: str) -> list[int]:
        if not self._files.exists(self._at(path)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._at(path))]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def versions(self) -> list[int]:
        """The versions whose manifests are whole."""
        at = f"{self.path}/manifest"
        return [v for v in self._numbers(at, "version=") if self._files.exists(self._at(f"{at}/version={v}/_SUCCESS"))]

    def manifest(self, version: int) -> dict[int, int]:
        """bucket -> the version that wrote its live files; has a row a bucket."""
        rows = self.spark.read.parquet(f"{self.path}/manifest/version={version}").filter("bucket IS NOT NULL").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _read(self, live: dict[int, int], schema: StructType) -> DataFrame:
        if not live:
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])  # no Python tasks for nothing
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/version={v}/_bucket={b}" for b, v in sorted(live.items())])

    def frame(self, version: int | None = None) -> DataFrame:
        """The state as of a version (default: the last one)."""
        version = self.versions()[-1] if version is None else version
        live = self.manifest(version)
        schema = StructType.fromDDL(self.spark.read.parquet(f"{self.path}/manifest/version={version}").first()["shape"])
        return self._read(live, schema)

    def bucket(self):  # noqa: ANN201
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def apply(self, changes: DataFrame, order: Sequence[str], epoch: int) -> list[int]:
        """Applies a batch of changes (``operation`` and the fields; the last by ``order`` wins) as version ``epoch`` and
        returns the buckets that it rewrote."""
        from .cdc import latest_changes

        known = self.versions()
        if epoch in known:
            return []
        known = [v for v in known if v < epoch]
        live = self.manifest(known[-1]) if known else {}
        columns = list(dict.fromkeys([*self.fields, *self.keys, *order, "operation"]))
        staged = f"{self.path}/incoming/version={epoch}"
        latest_changes(changes.select(*columns), self.keys, order).withColumn("_bucket", self.bucket()).write.mode("overwrite").parquet(staged)
        last = self.spark.read.parquet(staged)
        shape = changes.select(*self.fields).schema
        touched = sorted(r[0] for r in last.select("_bucket").distinct().collect())  # at most a row a bucket
        old = self._read({b: live[b] for b in touched if b in live}, shape)
        same = None
        for k in self.keys:
            c = old[k].eqNullSafe(last[k])
            same = c if same is None else same & c
        rest = old.join(last, same, "left_anti")
        new = rest.unionByName(last.filter("operation != 'delete'").select(*self.fields)).withColumn("_bucket", self.bucket())
        data, tasks = f"{self.path}/data/version={epoch}", max(1, len(touched))
        parts = 1 + (old.count() + last.count()) // (tasks * ROWS_A_TASK)  # of a bucket; the counts are in the files' footers
        part = F.pmod(F.hash(*self.keys), F.lit(parts))
        new.repartition(tasks * parts, "_bucket", part).write.mode("overwrite").partitionBy("_bucket").parquet(data)
        wrote = self._numbers(data, "_bucket=")
        now = {b: v for b, v in live.items() if b not in touched} | dict.fromkeys(wrote, epoch)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
        rows = [(b, v, self.buckets, ddl) for b, v in sorted(now.items())] or [(None, None, self.buckets, ddl)]
        self.spark.createDataFrame(rows, "bucket int, version long, buckets int, shape string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={epoch}")
        self._files.delete(self._at(staged), True)
        self.remove_old()
        return touched

    def remove_old(self) -> None:
        """Removes manifests before the last ``keep`` and files that none of these names."""
        known = self.versions()
        stay, gone = known[-self.keep :], known[: -self.keep]
        live = {(b, v) for s in stay for b, v in self.manifest(s).items()}
        for v in self._numbers(f"{self.path}/data", "version="):
            if stay and v <= stay[-1]:
                held = self._numbers(f"{self.path}/data/version={v}", "_bucket=")
                for b in held:
                    if (b, v) not in live:
                        self._files.delete(self._at(f"{self.path}/data/version={v}/_bucket={b}"), True)
                if not any((b, v) in live for b in held):
                    self._files.delete(self._at(f"{self.path}/data/version={v}"), True)
        for v in gone:
            self._files.delete(self._at(f"{self.path}/manifest/version={v}"), True)
