"""Questions claimed for a time: a stream whose state knows what is asked, by whom it wasn't answered in time, and what is done.

A question's state is `claimed` (with a number of tries and a timer), `done` or `given_up`.  Questions and the journal's rows are both
inputs: a row that answers ends the claim, a row with an error releases it at once, a timer that runs out releases it, too; a
released question is claimed again until its tries are used up.  The journal's rows of a batch are written before the batch
ends and read by the next one, ahead of its timers, so only what nobody answered runs out.

Claims of a batch are scored in waves.  Each wave is written once, in a folder of its own, and its spend is observed by that
write; a batch that is run again after a crash leaves out the questions whose rows it has written.  Before every wave, first tries and others alike,
the spend is held against the budget: past it the stream ends, and the rest of its claims are asked after the next start.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronoweave.streaming.queue import BudgetPassed

CLAIMED, DONE, GIVEN_UP = "claimed", "done", "given_up"
_OUT = "qid string, try int, state string, body string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Claims(StatefulProcessor):
    """The state of one question. Inputs are (qid, kind, body), kind `question`, `done` or `failed`; outputs are claims, and questions given up."""

    def __init__(self, lease_ms: int, tries: int):
        self.lease_ms, self.tries = lease_ms, tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("claim", "state string, try int, body string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        state, tries, body = self.own.get() if self.own.exists() else (None, 0, None)
        kinds = set()
        for r in rows:
            kinds.add(r["kind"])
            body = body if r["body"] is None else r["body"]
        if state == DONE or "done" in kinds:
            self._settle(DONE, tries, None)
        elif state == GIVEN_UP or state == CLAIMED and "failed" not in kinds or body is None:
            if state is not None:
                self.own.update((state, tries, body))
        else:
            yield self._claim(key[0], tries, body, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state, tries, body = self.own.get()
        if state == CLAIMED:
            yield self._claim(key[0], tries, body, timerValues)

    def close(self) -> None:
        pass

    def _settle(self, state: str, tries: int, body: str | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.own.update((state, tries, body))

    def _claim(self, qid: str, tries: int, body: str, times) -> Row:
        """The next try, or the end of them."""
        if tries >= self.tries:
            self._settle(GIVEN_UP, tries, body)
            return Row(qid=qid, **{"try": tries}, state=GIVEN_UP, body=body)
        self._settle(CLAIMED, tries + 1, body)
        self.handle.registerTimer(times.getCurrentProcessingTimeInMs() + self.lease_ms)
        return Row(qid=qid, **{"try": tries + 1}, state=CLAIMED, body=body)


@dataclass
class Spend:
    """What a run has paid, on the driver: `tell` gets the share, once at each of `marks`, the budget ends it."""

    max_usd: float | None = None
    spent: float = 0.0
    rows: int = 0
    given_up: int = 0
    marks: tuple[float, ...] = (0.8, 0.95)
    tell: Callable[[float], None] = lambda share: None
    told: list[float] = field(default_factory=list)
    passed: bool = False

    def check(self) -> None:
        if self.max_usd is not None and self.spent >= self.max_usd:
            self.passed = True
            raise BudgetPassed(f"{self.spent} of {self.max_usd} are spent")

    def add(self, rows: int, cost: float) -> None:
        self.rows, self.spent = self.rows + rows, self.spent + cost
        for mark in self.marks:
            if self.max_usd and self.spent >= mark * self.max_usd and mark not in self.told:
                self.told.append(mark)
                self.tell(self.spent / self.max_usd)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _waves(spark: SparkSession, claims: DataFrame, batch: int, question: T.StructType, score: Callable[[DataFrame], DataFrame], journal: str, row: T.StructType, spend: Spend, wave_rows: int) -> None:
    """Scores a batch's claims and writes their rows; a batch that runs again leaves out what it has written rows for."""
    if _exists(spark, place := f"{journal}/batch={batch}"):
        written = spark.read.schema(row).option("recursiveFileLookup", "true").json(place)
        claims = claims.join(written.select("qid"), "qid", "left_anti")
    own = claims.where(F.col("state") == CLAIMED)
    numbers = claims.agg(F.count(F.when(F.col("state") == CLAIMED, 1)).alias("n"), F.count(F.when(F.col("state") == GIVEN_UP, 1)).alias("up")).first()
    waves = -(-numbers["n"] // wave_rows)
    spend.given_up += numbers["up"]
    for k in range(waves):
        spend.check()
        part = own.where(F.pmod(F.xxhash64("qid"), F.lit(waves)) == k)
        asked = part.select("qid", "try", F.from_json("body", question).alias("q")).select("qid", "try", *[F.col(f"q.`{c}`") for c in question.names if c not in ("qid", "try")])
        seen = Observation()
        paid = score(asked).select(*row.names).observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
        paid.write.json(f"{place}/wave={uuid.uuid4().hex}")
        spend.add(seen.get["n"], seen.get["cost"])


def start(
    spark: SparkSession, source: str, question: T.StructType, score: Callable[[DataFrame], DataFrame], journal: str, row: T.StructType, checkpoint: str, spend: Spend,
    *, lease_seconds: float = 3600, tries: int = 3, wave_rows: int = 10_000, files_per_batch: int = 16, every: str = "5 seconds", partitions: int | None = None, read_only: bool = False,
):
    """A streaming query over JSON files of questions (with qid) at `source`.

    `score` makes rows (qid, error, cost and what else `row` has) of claims: the question's columns and `try`; a claim without a row runs out
    after `lease_seconds`. What the journal holds is done from the start, and counts as spent. `read_only` claims, and asks nobody.
    `partitions` of the state are fixed by a checkpoint's first start."""
    settings = {"spark.sql.streaming.stateStore.providerClass": _ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    target = spark._jvm.org.apache.hadoop.fs.Path(journal)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    known = spark.read.schema(row).option("recursiveFileLookup", "true").json(journal).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost")).first()
    spend.add(known["n"], known["cost"])
    asked = spark.readStream.schema(question).option("maxFilesPerTrigger", files_per_batch).json(source).select("qid", F.lit("question").alias("kind"), F.to_json(F.struct(*question.names)).alias("body"))
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    answered = spark.readStream.schema(row).option("recursiveFileLookup", "true").json(journal).select("qid", F.when(failed, "failed").otherwise("done").alias("kind"), F.lit(None).cast("string").alias("body"))
    claims = asked.unionByName(answered).where("qid is not null").groupBy("qid").transformWithState(statefulProcessor=Claims(int(1000 * lease_seconds), tries), outputStructType=_OUT, outputMode="Append", timeMode="ProcessingTime")

    def batch(found: DataFrame, number: int) -> None:
        # Every read of a batch's claims would run the state again: they are written once.
        place = f"{checkpoint}-claims"
        found.write.mode("overwrite").parquet(place)
        if not read_only:
            _waves(spark, spark.read.schema(found.schema).parquet(place), number, question, score, journal, row, spend, wave_rows)

    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return claims.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark: SparkSession, *args, until: Callable[[Spend], bool], seconds: float = 600, **how):
    """Starts a query and waits until the condition holds, the budget ends it, or nothing has come of it for so many seconds; any other error is raised.

    Time in which the stream works on new files or rows isn't counted, so a long run isn't cut short."""
    query = start(spark, *args, **how)
    spend = args[-1]
    try:
        left, seen = seconds, None
        while query.isActive and left > 0 and not until(spend):
            query.awaitTermination(0.5)
            known = (spend.rows, spend.given_up)
            left = seconds if known != seen or query.status["isDataAvailable"] else left - 0.5
            seen = known
    except StreamingQueryException:
        if not spend.passed:
            raise
    finally:
        query.stop()
    if query.exception() is not None and not spend.passed:
        raise query.exception()
    return query
