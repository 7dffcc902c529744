"""The cache of lookups as versions of hash buckets, so that an upsert rewrites what it touches.

A key's bucket is a hash of it. A version is a manifest, a list of the folder that holds each bucket (at most one line a bucket);
folders are never changed. An upsert merges the new results with the buckets they fall into, writes these to a new
folder, and then commits the next manifest by renaming it into place, which fails if another writer did so first. Readers take one
manifest, and so see one snapshot; what was written without a commit is seen by nobody. Manifests go through Hadoop's file
system, so the cache may lie wherever Spark writes.

Defined results: no manifest is an empty cache; results with an error are not kept; repeated keys in a batch are merged as
by ``enrich.latest``; an empty batch commits nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import enrich

BUCKETS = 256
SCHEMA = "source string, ioc_type string, ioc_value string, payload string, cached_at long, expires_at long"


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


class VersionedCache:
    """A cache in the folder ``path``; ``buckets`` must stay what it was when the cache began."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The number of the newest manifest, 0 without one."""
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int) -> dict[int, str]:
        """The folder of each bucket in a version."""
        if not version:
            return {}
        stream = self._fs.open(self._at(f"manifests/{version:010d}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): folder for b, folder in json.loads(text).items()}

    def _commit(self, version: int, manifest: dict[int, str]) -> None:
        draft, final = self._at(f"drafts/{uuid.uuid4().hex}"), self._at(f"manifests/{version:010d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(self._at("manifests"))
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise Conflict(f"version {version} is there already")

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version (the newest if none is given); ``only`` limits them to some buckets."""
        held = self.manifest(self.version() if version is None else version)
        paths = sorted({f"{self.path}/{folder}/bucket={b}" for b, folder in held.items() if only is None or b in only})
        rows = self.spark.read.schema(SCHEMA)
        return rows.parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def upsert(self, results: DataFrame, now: int, ttl: int = enrich.DEFAULT_TTL) -> int:
        """Store ``results(source, ioc_type, ioc_value, payload, error)``; gives the version that holds them."""
        version = self.version()
        held = self.manifest(version)
        bucket = F.pmod(F.xxhash64(*enrich.KEY), F.lit(self.buckets)).cast("int").alias("bucket")
        new = results.where("error is null").select(*enrich.KEY)
        touched = {r["bucket"] for r in new.select(bucket).distinct().collect()}  # at most ``buckets`` numbers
        if not touched:
            return version
        folder = f"data/{version + 1:010d}-{uuid.uuid4().hex}"
        merged = enrich.upsert(self.read(version, touched), results, now, ttl)
        merged.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        self._commit(version + 1, held | dict.fromkeys(touched, folder))
        return version + 1

    def purge(self, as_of: int) -> int:
        """Drop what has expired, from the buckets that hold such rows alone."""
        version = self.version()
        held = self.manifest(version)
        bucket = F.pmod(F.xxhash64(*enrich.KEY), F.lit(self.buckets)).cast("int").alias("bucket")
        old = {r["bucket"] for r in self.read(version).where(F.col("expires_at") <= as_of).select(bucket).distinct().collect()}
        if not old:
            return version
        folder = f"data/{version + 1:010d}-{uuid.uuid4().hex}"
        left = enrich.purge(self.read(version, old), as_of).withColumn("bucket", bucket)
        left.repartition(len(old), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        there = {int(f.getPath().getName().removeprefix("bucket=")) for f in self._fs.listStatus(self._at(folder)) if f.getPath().getName().startswith("bucket=")}
        self._commit(version + 1, {b: f for b, f in held.items() if b not in old} | dict.fromkeys(there, folder))
        return version + 1
