"""What every part of the engine asks of a running Spark session."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []


#: Bytes of a batch between the JVM and Python: ten thousand long texts, the default by rows, take both sides' memory.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python workers can import it anywhere; bound the batches that they get."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="siftlog-"), "siftlog_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("siftlog", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local folder of our own if master is local, an error if not."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siftlog-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/siftlog/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of new_path() through Hadoop's file systems; a path that is gone already is fine."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


#: With this on, Spark deletes an action's shuffle files when the action ends; else they stay until the driver's JVM collects the plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back. Survives lost executors, unlike a local checkpoint."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftlog_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t._siftlog_path)
