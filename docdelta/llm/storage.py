"""Cutting lineage with written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables that something may still read, by the scope they were written in; the first ends with the process.
_written: list[list[tuple[SparkSession, str]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Unset, a local session (tests) gets a folder of its own; on a cluster
    that is an error, since executors do not see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docdelta-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, *by: str, keep: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder, in a folder for each value of ``by``, and read it back: (table, path).

    The table is deleted with the :func:`scratch` it is written in; without one, or with ``keep``, at the end of the
    process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[0 if keep else -1].append((spark, path))
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch() -> Iterator[None]:
    """Delete on leaving all tables written inside but those to keep."""
    _written.append([])
    try:
        yield
    finally:
        for spark, path in _written.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`materialise` that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished queries, which otherwise stay until the driver happens to collect garbage."""
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _leave() -> None:
    for spark, path in _written[0]:
        if spark.sparkContext._jsc is not None:  # a stopped session's folder is the cluster's to clear
            discard(spark, path)
