"""A snapshot of which a merge rewrites no more than the buckets of its batch.

Rows lie in buckets of their key's hash. A version is a short manifest that says which version each bucket was last
written in; a merge reads and writes the batch's buckets and then the manifest, so a reader sees all of a merge or
nothing, and a writer that dies leaves files that no manifest names.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.operators.state import upsert_snapshot
from nestfold.session import cut

BUCKETS = 256


class BucketedSnapshot:
    """``path`` holds ``data/version=N/bucket=K`` and ``manifests/N.json``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The newest version; 0 before the first merge."""
        root, files = self._hadoop("manifests")
        if not files.exists(root):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(root)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Bucket -> the version it was last written in."""
        version = self.version() if version is None else version
        if not version:
            return {}
        held = self.spark.read.text(f"{self.path}/manifests/{version}.json").first()[0]
        return {int(k): v for k, v in json.loads(held).items()}

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest), of some buckets or of all."""
        there = {k: v for k, v in self.manifest(version).items() if buckets is None or k in set(buckets)}
        if not there:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/version={v}/bucket={k}" for k, v in sorted(there.items())))

    def merge(self, batch: DataFrame, overwrite: list[str], seq: str, as_of: datetime | None = None, insert: bool = True) -> int:
        """Merge a batch as ``upsert_snapshot`` does, and return the new version. The batch's buckets, at most
        ``buckets`` numbers, are all that comes to the driver."""
        now = self.version()
        batch = cut(batch)
        touched = sorted(r[0] for r in batch.filter(F.col(self.key).isNotNull()).select(self.bucket()).distinct().collect())
        merged = upsert_snapshot(self.read(now, touched), batch.filter(F.col(self.key).isNotNull()), self.key, overwrite, seq, as_of, insert)
        new = now + 1
        while self._hadoop(f"data/version={new}")[1].exists(self._hadoop(f"data/version={new}")[0]):
            new += 1  # left by a writer that died
        rows = merged.withColumn("bucket", self.bucket()).repartition(max(1, len(touched)), "bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/data/version={new}")
        written, files = self._hadoop(f"data/version={new}")
        names = [s.getPath().getName() for s in files.listStatus(written)]
        made = {int(n.removeprefix("bucket=")): new for n in names if n.startswith("bucket=")}
        target, files = self._hadoop(f"manifests/{new}.json")
        part, _ = self._hadoop(f"manifests/{new}.tmp")
        out = files.create(part, True)
        out.write(bytearray(json.dumps(self.manifest(now) | made).encode()))
        out.close()
        files.rename(part, target)
        return new
