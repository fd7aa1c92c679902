"""An outbox that shows whole batches only.

Tasks write files of their own; a batch becomes visible when its manifest, which names them, is written. A batch that
runs again finds its manifest and leaves what was sent; one that fails leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from nestfold.sources.captured import file_system


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    rows: int = 0


class OutboxWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = file_system(self.path)
        done, writer, name = Written(), None, f"part-{uuid.uuid4().hex}.parquet"
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if writer is None:
                    files.create_dir(f"{root}/parts")
                    writer = pq.ParquetWriter(f"{root}/parts/{name}", batch.schema, filesystem=files)
                    done.files.append(name)
                writer.write_batch(batch)
                done.rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return done

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        files, root = file_system(self.path)
        manifest = f"{root}/manifests/batch-{batchId}.json"
        if files.get_file_info(manifest).type != fs.FileType.NotFound:
            self.abort(messages, batchId)  # sent before a restart: the first attempt counts
            return
        files.create_dir(f"{root}/manifests")
        named = [f for m in messages if m for f in m.files]
        made = f"{manifest}.{uuid.uuid4().hex}.tmp"
        with files.open_output_stream(made) as out:
            out.write(json.dumps({"batch_id": batchId, "files": named, "rows": sum(m.rows for m in messages if m)}).encode())
        files.move(made, manifest)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        files, root = file_system(self.path)
        for name in (f for m in messages if m for f in m.files):
            files.delete_file(f"{root}/parts/{name}")


class BatchWriter(DataSourceArrowWriter):
    """One batch of a stream, as ``foreachBatch`` has it."""

    def __init__(self, options: dict[str, str]):
        self.outbox, self.batch_id = OutboxWriter(options), int(options["batch_id"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.outbox.write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.outbox.commit(messages, self.batch_id)

    def abort(self, messages: list[Written | None]) -> None:
        self.outbox.abort(messages, self.batch_id)


class Outbox(DataSource):
    """``writeStream.format("outbox").option("path", ...)``, or ``write_batch``; ``read_batches`` reads it."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def streamWriter(self, schema: StructType, overwrite: bool) -> OutboxWriter:  # noqa: N802
        return OutboxWriter(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Outbox)


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """Send a batch from ``foreachBatch``, for streams in update mode. A batch that runs again is computed again, since its
    tasks write the state too, but its manifest stays the first one."""
    batch.write.format("outbox").mode("append").option("path", path).option("batch_id", batch_id).save()


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches, with ``batch_id``. One short manifest a batch is read to name their files."""
    files, root = file_system(path)
    manifests = []
    for f in files.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True)):
        if f.base_name.endswith(".json"):
            with files.open_input_stream(f.path) as held:
                manifests.append(json.loads(held.read()))
    parts = [(name, m["batch_id"]) for m in manifests for name in m["files"]]
    if not parts:
        return spark.createDataFrame([], f"{schema}, batch_id bigint")
    rows = spark.read.schema(schema).parquet(*(f"{path.rstrip('/')}/parts/{name}" for name, _ in parts))
    batches = spark.createDataFrame(parts, "_file string, batch_id bigint")
    return rows.withColumn("_file", F.col("_metadata.file_name")).join(F.broadcast(batches), "_file").drop("_file")
