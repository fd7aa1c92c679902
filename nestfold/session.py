"""Session helpers: runtime settings the operators rely on, and lineage cuts."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings. ``forceOptimizeSkewedJoin`` lets AQE split a hot join key even when
# the join feeds an aggregate on the same key; LAST_WIN is the duplicate-label rule of
# the label/value pages; Arrow batches of whole texts stay at a few megabytes.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    _ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and work tables.

    Taken from ``spark.checkpoint.dir``; where a session sets none, a folder in the
    warehouse, which every executor reaches too. Never a machine-local temporary folder: losing
    an executor must not lose a cut.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or context.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
        context.setCheckpointDir(folder)
    return folder


def _path(spark: SparkSession, name: str):
    """The Hadoop path of ``name`` and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


_SHIPPED: set[str] = set()
_PREPARED: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, whatever their working folder is."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # imported from a shipped archive already
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    path, files = _path(spark, f"{_cut_dir(spark)}/nestfold-{app}.zip")
    out = files.create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path.makeQualified(files.getUri(), files.getWorkingDirectory()).toString())


def _cut_dir(spark: SparkSession) -> str:
    """The folder of this application's cuts; its files go when the application ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/cuts-{app}"
    if app not in _PREPARED:
        _PREPARED.add(app)
        path, files = _path(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that an operator writes, beside the cuts."""
    return f"{_cut_dir(spark)}/work/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once as a table in the shared folder and read it back.

    The result has no lineage, real file sizes for the optimizer and column pruning; unlike
    ``checkpoint`` it also leaves behind the constraints of the plan, which grow with every
    round of an iteration.
    """
    target = work_folder(df.sparkSession, "cut")
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def forget_cuts(spark: SparkSession) -> None:
    """Delete the tables and files written so far for this application, once nothing reads them any more."""
    path, files = _path(spark, f"{_cut_dir(spark)}/work")
    files.delete(path, True)


# A joined side is broadcast only after its rows and bytes were counted and found below these.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when its counted rows and bytes allow it, else a plain shuffle side."""
    small = cut(df)
    probe = small.limit(max_rows + 1)
    size = F.sum(F.length(F.to_json(F.struct(*probe.columns))).cast("long")) if probe.columns else F.lit(0)
    rows, held = probe.agg(F.count("*"), size).first()
    return F.broadcast(small) if rows <= max_rows and (held or 0) <= max_bytes else small
