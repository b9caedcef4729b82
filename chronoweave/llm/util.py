"""What the operators of this package share: Arrow batches, worker-side objects and shared folders."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest file or table of parameters that is broadcast.
MAX_BROADCAST_BYTES = 64 << 20

#: Rows that are computed at once: a worker holds Python objects of so many texts, not of a whole Arrow batch.
BLOCK_ROWS = 512

_OBJECTS: dict[Any, Any] = {}
#: Bounded dictionaries of modules, which `worker_object` empties.
MEMOS: list[dict] = []


def worker_object(key: Any, build: Callable[[], Any]) -> Any:
    """An object that a Python worker builds once and keeps while tasks use the same key.

    Workers outlive stages: what another operator has left, its object and the memos, goes first."""
    if key not in _OBJECTS:
        if _OBJECTS:
            _OBJECTS.clear()
            for memo in MEMOS:
                memo.clear()
            give_back()
        _OBJECTS[key] = build()
    return _OBJECTS[key]


def give_back() -> None:
    """Objects that only refer to each other go, and freed memory goes back to the system."""
    gc.collect()
    trim()


def trim() -> None:
    """Freed memory goes back to the system, where the C library can do that: idle workers hold less."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Shipped:
    """A broadcast value with an id that workers can key by: equal values have equal ids."""

    def __init__(self, spark: SparkSession, value: Any):
        self.id = hashlib.sha256(pickle.dumps(value)).hexdigest()
        self.held = spark.sparkContext.broadcast(value)

    @property
    def value(self) -> Any:
        return self.held.value


def file_bytes(path: str) -> bytes:
    """A parameter file, read on the driver; its size is checked before it is broadcast."""
    size = Path(path).stat().st_size
    if size > MAX_BROADCAST_BYTES:
        raise ValueError(f"{path} has {size} bytes; {MAX_BROADCAST_BYTES} can be broadcast")
    return Path(path).read_bytes()


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """The strings of a column, nulls as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def map_columns(df: DataFrame, inputs: list[str], run: Callable[[pa.RecordBatch], list[pa.Array]], added: str, keep: list[str] | None = None, trimmed: bool = False) -> DataFrame:
    """`df` with columns computed batch by batch in Arrow from `inputs`; `trimmed` workers give freed memory back after each task.

    The columns in `keep` (all, if None) pass through Python unchanged, the
    others end there; a column of `df` named like an added one is replaced."""
    new = T._parse_datatype_string(added)
    names = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    sent = list(dict.fromkeys([*kept, *inputs]))
    schema = T.StructType([*[df.schema[c] for c in kept], *new])
    reads, passes, out_names = [sent.index(c) for c in inputs], len(kept), [f.name for f in schema]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([*batch.columns[:passes], *run(batch.select(reads))], names=out_names)
        if trimmed:
            trim()

    return df.select(*[F.col(_q(c)) for c in sent]).mapInArrow(mapped, schema)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: the cluster's `spark.checkpoint.dir`.

    Where that is unset, one below the working folder in local mode; an error on a cluster, whose executors wouldn't see it."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(f"{Path.cwd()}/spark-warehouse/checkpoints")
    return context.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, whichever it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_LISTS: list[list[tuple[SparkSession, str]]] = []
#: Set while a table is written: its shuffle files go when it is complete.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What `cut` writes inside is deleted at the end; results must have been stored by then."""
    _LISTS.append([])
    try:
        yield
    finally:
        for spark, path in _LISTS.pop():
            delete(spark, path)


def written(df: DataFrame, spark: SparkSession) -> str:
    """The path of `df` written as a table in the shared folder."""
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if _LISTS:
        _LISTS[-1].append((spark, path))
    return path


def cut(df: DataFrame, spark: SparkSession) -> DataFrame:
    """`df` as a table in the shared folder: its lineage ends there, so a lost executor costs a read."""
    return spark.read.schema(df.schema).parquet(written(df, spark))


class Rounds:
    """Tables of a computation in rounds: `keep` replaces the one of the same name, whose files go."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = written(df, self.spark)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                delete(self.spark, self.paths.pop(name))
