"""Questions that arrive as files: scored in micro-batches, each question once.

The stream's checkpoint holds what was claimed, the journal what is done. A batch writes its answers
before it commits; if it dies between, it runs again and the journal tells it what is left. A
budget ends the stream after the batch that passes it; what is unread stays for the next start."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.sources import journal
from chronoweave.sources.tables import delete


class BudgetPassed(Exception):
    """The journal's spend is over the budget."""


def done_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the journal so far; none before the first batch."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:  # the folder appears with the first row
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def process_batch(batch: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, schema: T.StructType, max_usd: float | None = None, cost: str = "cost", read_only: bool = False) -> int:
    """Scores the batch's questions that the journal hasn't, appends the rows and returns their number. Error rows are asked again; raises before any work if the budget is spent.

    `read_only` scores nothing and writes nothing: the number is what would be asked."""
    spark = batch.sparkSession
    known = done_rows(spark, path, schema)
    if max_usd is not None and cost in known.columns and (known.agg(F.sum(cost)).first()[0] or 0.0) >= max_usd:
        raise BudgetPassed(f"{max_usd} are spent")
    todo = journal.pending(batch.dropDuplicates(["qid"]), journal.answered(known, "error"))
    if read_only:
        return todo.count()
    rows = score(todo).select(*schema.names).persist()
    try:
        n = rows.count()
        if n:
            journal.append(rows, path)
        return n
    finally:
        rows.unpersist()


def start(spark: SparkSession, source: str, question_schema: T.StructType, score: Callable[[DataFrame], DataFrame], journal_path: str, row_schema: T.StructType, checkpoint: str, *, files_per_batch: int = 16, max_usd: float | None = None, available_now: bool = True):
    """A streaming query over JSON files of questions; `available_now` ends it when all present files are read."""
    stream = spark.readStream.schema(question_schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    writer = stream.writeStream.foreachBatch(lambda batch, _: process_batch(batch, score, journal_path, row_schema, max_usd) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def clear(spark: SparkSession, journal_path: str, checkpoint: str) -> None:
    """Forgets a run: its journal and the stream's checkpoint, wherever they are."""
    for place in (journal_path, checkpoint):
        delete(spark, place)
