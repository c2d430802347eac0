"""Tables in the folder that driver and executors share: lineage is cut there, and intermediate
results that several steps read are written there once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        found = tempfile.mkdtemp(prefix="saltern-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/saltern/{name}-{uuid.uuid4().hex}"


def _where(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _where(spark, path)
    return files.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    files, where = _where(spark, path)
    files.delete(where, True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder, with Parquet's ``options``, and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saltern_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "saltern_path", None):
            delete(df.sparkSession, path)


#: Rows of an Arrow batch of whole texts, and bytes after which a batch ends with its row.
TEXT_ROWS, TEXT_BYTES = 1000, 1 << 20
_UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def small_batches(spark: SparkSession) -> None:
    """Texts are long, and so are rows of packed ones: from now on, the session's Arrow batches hold at
    most ``TEXT_ROWS`` rows and end with the row that reaches ``TEXT_BYTES``, which bounds what a Python
    worker and its executor hold of them off the heap. Smaller settings stay."""
    rows, size = (f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if int(spark.conf.get(rows)) > TEXT_ROWS:
        spark.conf.set(rows, TEXT_ROWS)
    found = spark.conf.get(size).lower().rstrip("b")  # as 67108864b, 64m or 64mb
    if not 0 < int(found.rstrip("kmg")) * _UNITS.get(found[-1], 1) <= TEXT_BYTES:
        spark.conf.set(size, TEXT_BYTES)


#: State on the executors' disks rather than in their memory: caches are bounded, and a finished
#: stream's state is soon let go. Without the third setting RocksDB sets 4 MB of disk aside for each
#: state partition, however small.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "32",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
