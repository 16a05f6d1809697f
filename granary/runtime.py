"""What a job needs of its session: shared scratch tables, shipped code, bounded Arrow batches.

Scratch tables live under ``spark.checkpoint.dir``, the folder that the cluster shares. It is read
from the session; a local folder is set only where the session names none, as in tests. Nothing is
written to a machine-local folder on a cluster, and ``localCheckpoint`` is never used: a table that
cuts the lineage outlives the executors that wrote it.
"""

from __future__ import annotations

import io
import tempfile
import threading
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_tables: dict[str, list[str]] = {}
_paths: dict[int, str] = {}
_lock = threading.Lock()

#: Arrow batches towards Python hold at most so many rows and bytes, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1024, "16m"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = Path(tempfile.mkdtemp(prefix="granary-")).as_uri()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``release`` deletes what is there."""
    path = f"{scratch_root(spark)}/granary-{name}-{uuid.uuid4().hex}"
    with _lock:
        _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The stored table replaces the lineage, so an executor lost later costs no recomputation, and what
    follows may read it more than once. ``release`` deletes it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # Small row groups: a writer holds one in memory.
    writer = df.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def forget(df: DataFrame) -> None:
    """Delete one scratch table: iterations do so with what the next round replaces."""
    path, spark = _paths.pop(id(df), None), df.sparkSession
    if path:
        with _lock:
            _tables[spark.sparkContext.applicationId].remove(path)
        delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete this session's scratch tables; call it when what was derived from them is written."""
    with _lock:
        paths = _tables.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path in whichever store holds it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def ship(spark: SparkSession) -> SparkSession:
    """Hand the package to the executors, which share no folder with the driver; bound Arrow batches."""
    app = spark.sparkContext.applicationId
    with _lock:
        if app not in _shipped:
            spark.sparkContext.addPyFile(_zipped(spark))
            _shipped.add(app)
    # Lowered where the session allows more, which bounds memory and changes no result; a smaller setting stays.
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def _zipped(spark: SparkSession) -> str:
    """The package as an archive in the shared folder."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    path = f"{scratch_root(spark)}/granary-code-{uuid.uuid4().hex}.zip"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(jvm_path)
    out.write(bytearray(held.getvalue()))
    out.close()
    return path


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the session has cores is dealt out evenly; any larger one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """How many partitions the session asks of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
