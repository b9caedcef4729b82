"""Responses of models that are paid for once: a store that is read, asked beside, and written.

The store is a folder of Parquet files by bucket of the key; every run appends files, `compact` makes them one a bucket again.
Equal requests of a run meet before anybody is asked, so a key is one call (single flight).  Answers are written before they
are used: what follows reads them from the store's own files or from the run's table, never from the client again, however
often a plan reads them and whichever executor is lost.  Only the task that asks may run twice: a call is repeated if its
task dies before its file is committed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.sources.caches import response_key
from chronoweave.sources.tables import delete, kept

ENTRY = "key string, model string, response string, valid boolean, cost double, ts timestamp"


@dataclass(frozen=True)
class Answer:
    """What a client may return instead of a text: the text and what it cost."""

    text: str
    cost: float = 0.0


def ask(requests: DataFrame, client: Callable[[str, str], str | Answer], *, attempts: int = 3, backoff: float = 1.5, valid: Callable[[str], bool] = bool, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """key, model, response, valid and cost of each request (key, model, prompt), by calls of the client.

    A failure or an invalid answer is tried again, `attempts` times in all, later each time; the last failure raises, the last
    invalid answer is returned. The costs of all calls of a request add up. Calls run as tasks, one request after the other in each."""

    def one(model: str, prompt: str) -> tuple[str, bool, float]:
        cost = 0.0
        for attempt in range(attempts):
            last = attempt == attempts - 1
            try:
                answer = client(model, prompt)
            except Exception:
                if last:
                    raise
                sleep(backoff**attempt)
                continue
            text = answer.text if isinstance(answer, Answer) else answer
            cost += answer.cost if isinstance(answer, Answer) else 0.0
            if valid(text) or last:
                return text, bool(valid(text)), cost
        raise ValueError("attempts must be 1 or more")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [one(m, p) for m, p in zip(batch["model"], batch["prompt"], strict=True)]
            yield pd.DataFrame({"key": batch["key"], "model": batch["model"], "response": [r for r, _, _ in out], "valid": [v for _, v, _ in out], "cost": [c for _, _, c in out]})

    return requests.select("key", "model", "prompt").mapInPandas(run, "key string, model string, response string, valid boolean, cost double")


class ResponseStore:
    """A store at `path`. Without `reads` every distinct request is asked, and its valid answer is stored all the same."""

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64, reads: bool = True):
        self.spark, self.path, self.buckets, self.reads = spark, path, buckets, reads

    def _bucket(self) -> Column:
        return F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(self.buckets)).cast("int")

    def entries(self) -> DataFrame:
        """All entries, with their bucket; none before the first write."""
        try:
            return self.spark.read.schema(f"{ENTRY}, bucket int").parquet(self.path)
        except PySparkException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{ENTRY}, bucket int")

    def known(self) -> DataFrame:
        """key and response: the latest valid entry of each key, as an aggregate whose partial sums hold a row for each key."""
        return self.entries().where("valid and response is not null").groupBy("key").agg(F.max_by("response", F.struct("ts", "response")).alias("response"))

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)

    def append(self, answers: DataFrame) -> None:
        """Stores the valid ones of `answers` (key, model, response, valid, cost)."""
        self._write(answers.where("valid").withColumn("ts", F.current_timestamp()).select(*[c.split()[0] for c in ENTRY.split(", ")]), self.path)

    def answer(self, requests: DataFrame, client: Callable[[str, str], str | Answer], **how) -> DataFrame:
        """`requests` (with model and prompt, perhaps key) with response, valid, cost (of the calls of this run, on one row of each key) and from_store.

        The client is asked once for each distinct key that the store hasn't, whatever `requests` is read for later."""
        if "key" not in requests.columns:
            none = F.lit(None).cast("string")
            requests = requests.withColumn("key", response_key(F.col("model"), F.col("prompt"), none, none, none))
        requests = kept(requests)
        single = requests.groupBy("key").agg(F.min(F.struct("model", "prompt")).alias("r")).select("key", "r.model", "r.prompt")
        if self.reads:
            known = kept(single.select("key").join(self.known(), "key"))
            single = single.join(known.select("key"), "key", "left_anti")
        fresh = kept(ask(single, client, **how))
        self.append(fresh)
        found = fresh.select("key", "response", "valid", "cost", F.lit(False).alias("from_store"))
        if self.reads:
            found = found.unionByName(known.select("key", "response", F.lit(True).alias("valid"), F.lit(0.0).alias("cost"), F.lit(True).alias("from_store")))
        return requests.join(found, "key")

    def compact(self) -> None:
        """One entry for each key, one file for each bucket: written beside the store, which it then replaces."""
        beside = f"{self.path.rstrip('/')}-{uuid.uuid4().hex}"
        entries = self.entries().where("valid and response is not null")
        rest = [c.split()[0] for c in ENTRY.split(", ")[1:]]
        latest = entries.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("ts", "response")).alias("e")).select("key", *[F.col(f"e.{c}") for c in rest])
        self._write(latest, beside)
        delete(self.spark, self.path)
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        target = fs_path(beside)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(target, fs_path(self.path))


def asker(store: ResponseStore, client: Callable[[str, str], str | Answer], model: str, **how) -> Callable[[DataFrame], DataFrame]:
    """`ask` of `plans.reason.by_model`: (qid, prompt) with `response`, by a store and a client."""

    def ask_model(prompts: DataFrame) -> DataFrame:
        return store.answer(prompts.select("qid", "prompt", F.lit(model).alias("model")), client, **how).select("qid", "prompt", "response")

    return ask_model
