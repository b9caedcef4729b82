"""Corpus cleaning in stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
`documents`.  `run` writes each stage's result as Parquet in the shared folder and reads it
again, so that a lost executor costs one stage's tasks at most.  A stage's input and what it
has written on its way are deleted once its result is complete; the last result stays for the caller.

Null and empty texts pass every stage: they aren't toxic, have no duplicates, benchmark windows or secrets, and
no tokens.  Rows without an id stay, too; of rows with one id one stays.  Of equal texts the smallest id stays.
Empty tables give empty results; without labels of both kinds, or without items, the first and the third stage keep all.
Further columns pass through all stages but the last, whatever they are called.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, decontam, near, secrets, toxic
from chronoweave.llm.util import delete, scratch, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below their language's threshold; the classifier learns from the labels of `docs`."""
    model = toxic.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic.drop(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontam.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; n_chars follows the text."""
    masked = secrets.mask(docs, secrets.train(docs))
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else masked


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every document left."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", tokenize),
]

#: SQL can't express the classifier, the samples and the tokeniser: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        if k:
            delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
