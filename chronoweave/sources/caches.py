"""Caches of model responses and of embeddings as tables, and clients for models."""

from __future__ import annotations

import io
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Spark's errors say of a cache that is absent or isn't a table of Parquet files with the wanted columns.
REBUILT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "Could not read footer")


def response_key(model: Column, prompt: Column, temperature: Column, max_tokens: Column, extra: Column) -> Column:
    """SHA-256 of the request's fields as JSON in a fixed order."""
    names = "extra_params", "max_tokens", "model", "prompt", "temperature"
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for c, n in zip((extra, max_tokens, model, prompt, temperature), names, strict=True)])), 256)


def lookup(requests: DataFrame, cache: DataFrame, enabled: bool = True) -> DataFrame:
    """Requests with the cached response, NULL where there is none; of entries with one key the latest counts, entries without a response don't."""
    if not enabled:
        return requests.withColumn("response", F.lit(None).cast("string"))
    known = cache.where("response is not null").groupBy("key").agg(F.max_by("response", F.struct("ts", "response")).alias("response"))
    return requests.join(known, "key", "left")


def call_misses(found: DataFrame, client: Callable[[str, str], str], attempts: int = 3, backoff: float = 1.5, valid: Callable[[str], bool] = bool, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Asks a client for the requests without a response, with retries; the last failure raises, invalid answers count as failures but the last one is returned.

    `found` has key, model, prompt and response. The client is made where it runs, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for model, prompt in zip(batch["model"], batch["prompt"], strict=True):
                for attempt in range(attempts):
                    try:
                        answer = client(model, prompt)
                    except Exception:
                        if attempt == attempts - 1:
                            raise
                        sleep(backoff**attempt)
                        continue
                    if valid(answer):
                        break
                out.append(answer)
            yield batch.assign(response=out)

    misses = found.where("response is null")
    return found.where("response is not null").unionByName(misses.mapInPandas(run, found.schema))


def valid_only(responses: DataFrame, is_valid: Column) -> DataFrame:
    """What may be stored: responses that passed."""
    return responses.where(F.coalesce(is_valid, F.lit(False)))


def replay_client(answers: dict[str, str]) -> Callable[[str, str], str]:
    """An offline client: known prompts get their answer, others raise."""

    def ask(model: str, prompt: str) -> str:
        return answers[prompt]

    return ask


def embed(texts: DataFrame, encoder, column: str = "text", model: Column | None = None, query: bool = False) -> DataFrame:
    """Adds `embedding` by an encoder (a pandas UDF of texts); queries get the model's prefix, passages never."""
    from chronoweave.functions.text import query_prefix

    text = query_prefix(model, F.col(column)) if query and model is not None else F.col(column)
    return texts.withColumn("embedding", encoder(text))


def cache_is_valid(cache: DataFrame, keys: DataFrame) -> bool:
    """Whether a cached table has exactly the wanted keys in the wanted order (`pos`, `key` of both)."""
    a, b = cache.select("pos", "key"), keys.select("pos", "key")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def read_matrix(spark: SparkSession, path: str, keys_field: str) -> DataFrame:
    """pos, key and embedding of a stored matrix, wherever Spark reads: `.npz` with an array of keys and one of rows named
    `embeddings`, or the old format, one JSON object of both. A matrix is one file, of a vocabulary that one task holds."""
    if path.endswith(".npz"):

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for content in batch["content"]:
                    with np.load(io.BytesIO(content), allow_pickle=False) as blob:
                        keys, matrix = blob[keys_field].tolist(), blob["embeddings"]
                    for at in range(0, len(keys), 4096):
                        part = slice(at, at + 4096)
                        yield pd.DataFrame({"pos": range(at, at + len(keys[part])), "key": keys[part], "embedding": list(matrix[part].astype(np.float32))})

        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "pos long, key string, embedding array<float>")
    value = F.from_json("value", f"`{keys_field}` array<string>, embeddings array<array<float>>", {"mode": "FAILFAST"}).alias("v")
    both = F.arrays_zip(F.col(f"v.`{keys_field}`").alias("key"), F.col("v.embeddings").alias("embedding"))
    return spark.read.text(path, wholetext=True).select(value).select(F.posexplode(both).alias("pos", "x")).select(F.col("pos").cast("long").alias("pos"), "x.key", "x.embedding")


def adopted(spark: SparkSession, path: str, keys_field: str, slug: str, keys: DataFrame, writer: str = "bge-base-en-v1.5") -> DataFrame | None:
    """The old cache's rows, if the encoder is the one that wrote it and it has exactly the wanted keys in the wanted order; None if not,
    or if it is absent or damaged, which is no error: embeddings are built then."""
    if slug != writer:
        return None
    try:
        old = read_matrix(spark, path, keys_field)
        return old if cache_is_valid(old, keys) else None
    except (PySparkException, Py4JJavaError) as e:
        if not any(mark in str(e) for mark in (*REBUILT, "MALFORMED_RECORD", "BadZipFile", "KeyError", "ValueError")):
            raise
        return None


def load_or_build(spark: SparkSession, path: str, slug: str, keys: DataFrame, build: Callable[[DataFrame], DataFrame], legacy: tuple[str, str] | None = None) -> DataFrame:
    """The cached embeddings of a model if they are of these keys; else those of an old cache (`legacy`: its path and field of keys) that
    may be adopted; else built. What is adopted or built is written, in place of what was absent, of other keys or damaged.

    Any other error, as of a lost connection, is raised: the cache stays as it is."""
    place = f"{path}/model_slug={slug}"
    try:
        cached = spark.read.parquet(place)
        if cache_is_valid(cached, keys):
            return cached
    except PySparkException as e:
        if not any(mark in str(e) for mark in REBUILT):
            raise
    rows = adopted(spark, legacy[0], legacy[1], slug, keys) if legacy else None
    (build(keys) if rows is None else rows).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
