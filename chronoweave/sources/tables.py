"""Tables that a plan reads more than once: written to the folder that all executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, by `spark.checkpoint.dir`; in local mode one below the working folder if that is unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(f"{Path.cwd()}/spark-warehouse/checkpoints")
    return context.getCheckpointDir()


def place(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, for a table or store; what lies there when the driver's JVM ends is deleted."""
    path = f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)
    system.delete(target, True)
    return path


_RUNS: list[list[tuple[SparkSession, str]]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What `kept` writes inside is deleted at the end; results must have been stored by then."""
    _RUNS.append([])
    try:
        yield
    finally:
        for spark, path in _RUNS.pop():
            delete(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder. What reads it has a scan in place of the plan, pruned to its
    columns; a lost executor costs a read. Such tables go at the end of `scratch`, outside of it when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _RUNS:
        _RUNS[-1].append((spark, path))
    else:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark reaches; one that is absent is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file to any file system that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
