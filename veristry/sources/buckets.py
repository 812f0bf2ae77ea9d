"""Tables of one row a key, kept in buckets of keys; an upsert rewrites only the buckets that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """Last parts of the paths that fit a pattern."""
    files, at = _files(spark, pattern)
    return [f.getPath().getName() for f in (files.globStatus(at) or [])]


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the folders v0, v1, ... that were written to their end."""
    files, at = _files(spark, f"{folder}/v*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in (files.globStatus(at) or []))


class BucketTable:
    """A table below ``path``, dealt by a hash of ``keys`` into ``buckets``.

    Each upsert has a number that is larger than those before it.  It writes
    the touched buckets to ``data/v<number>`` and then, in ``manifest/v<number>``,
    of every bucket the upsert that wrote it last.  The manifest counts only
    once it is complete, so a reader sees all of an upsert or nothing; an upsert
    that runs again after a failure writes the same folders once more.  What
    neither of the last two manifests names is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Of each bucket the upsert that wrote it, as the last manifest (before an upsert) says."""
        done = [v for v in versions(self.spark, f"{self.path}/manifest") if before is None or v < before]
        if not done:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/v{done[-1]}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _read(self, buckets: dict[int, int]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v{v}/_bucket={b}" for b, v in sorted(buckets.items())])

    def read(self) -> DataFrame:
        """The table as the last complete upsert left it."""
        return self._read(self.manifest())

    def upsert(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replaces the buckets of the batch's keys by ``merge(their rows, batch)``, which has one row a key."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        known = self.manifest(number)
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]
        if touched:
            rows = merge(self._read({b: known[b] for b in touched if b in known}), batch).select(self.schema.names)
            rows = rows.withColumn("_bucket", bucket).repartition("_bucket")
            rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/v{number}")
            left = {int(n.split("=")[1]) for n in _names(self.spark, f"{self.path}/data/v{number}/_bucket=*")}
            known = {b: v for b, v in known.items() if b not in touched} | {b: number for b in left}
        self.spark.createDataFrame(sorted(known.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{number}")
        self._forget(number)

    def _forget(self, number: int) -> None:
        done = [v for v in versions(self.spark, f"{self.path}/manifest") if v <= number]
        kept = {(b, v) for m in done[-2:] for b, v in self.manifest(m + 1).items()}
        drop = [f"{self.path}/manifest/v{v}" for v in done[:-2]]
        for v in {int(n[1:]) for n in _names(self.spark, f"{self.path}/data/v*")}:
            own = {int(n.split("=")[1]) for n in _names(self.spark, f"{self.path}/data/v{v}/_bucket=*")}
            gone = {b for b in own if (b, v) not in kept}
            if v < number and gone:
                drop += [f"{self.path}/data/v{v}"] if gone == own else [f"{self.path}/data/v{v}/_bucket={b}" for b in gone]
        for path in drop:
            files, at = _files(self.spark, path)
            files.delete(at, True)
