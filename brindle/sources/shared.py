"""Files that all executors share: below spark.checkpoint.dir, written and read through Spark's own layers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session on one machine that has none gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-checkpoints-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below shared_root; it is removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/brindle-{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through Hadoop's file system layer."""
    target, files = _at(spark, path)
    files.delete(target, True)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, written by the driver through Hadoop's file system layer."""
    target, files = _at(spark, path)
    out = files.create(target, True)
    out.write(bytearray(content))
    out.close()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of texts. One that Spark reads in fewer partitions than there are cores (a small one, in few row
    groups) is dealt to all cores; a larger one stays as it is read."""
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
