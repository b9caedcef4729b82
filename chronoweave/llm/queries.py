"""The registered queries of this package and the SQL of those that SQL can express.

Each query applies its operator with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, chat, count, decontam, lines, media, near, periods, phrases, pii, secrets, shards, toxic


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    docs = _table(spark, folder, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its class of near duplicates."""
    return near.classes(_table(spark, folder, "documents"))


def op3_preference_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as chosen ones, with the next one's answer as rejected ones."""
    return chat.preference_pairs(chat.answered_by_next(_table(spark, folder, "conversations")))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it passes the context length."""
    docs = _table(spark, folder, "documents")
    return count.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048, keep=["doc_id"])


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every text."""
    docs = _table(spark, folder, "documents")
    return secrets.report(secrets.scan(docs, secrets.train(docs), keep=["doc_id"]))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    docs, benchmark = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return decontam.report(decontam.find(docs, benchmark, keep=["doc_id"]))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text by a classifier that is trained on labels not held out."""
    docs = _table(spark, folder, "documents")
    model = toxic.train(docs, _table(spark, folder, "labels"))
    return (
        toxic.score(docs, model, keep=["doc_id"])
        .withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
        .withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
        .select("doc_id", "held_out", "score", "predicted", "threshold", "rejected")
    )


def op8_media(spark: SparkSession, folder: str) -> DataFrame:
    """Every text stored as an audio clip, read back and analysed."""
    return media.round_trip(_table(spark, folder, "documents"), keep=["doc_id"])


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every repeated line or sentence, the occurrence that stays, and the run of repeats that it is in."""
    return lines.repeats(_table(spark, folder, "documents"))


def op10_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with surrogates for its personal data."""
    found = pii.replace(_table(spark, folder, "documents"), PII_KEY, keep=["doc_id"])
    return found.select("doc_id", F.size("entities").cast("long").alias("n_entities"), "entities", "text")


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen shards of equal size, documents with equal texts together."""
    return shards.assign(_table(spark, folder, "documents"), shards=16)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every text, every tenth of which repeats a stretch of its own up to its end."""
    found = periods.find(_table(spark, folder, "documents"), keep=["doc_id"], rewrite=periods.rewound)
    return periods.report(found)


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Each language's first phrases whose words stand together more often than apart."""
    return phrases.collocations(_table(spark, folder, "documents"))


#: The key of the registered query; in production it comes from the caller.
PII_KEY = b"chronoweave surrogate key"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_preference_chat": op3_preference_chat,
    "op4_token_counts": op4_token_counts,
    "op5_secrets": op5_secrets,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_media": op8_media,
    "op9_line_dedup": op9_line_dedup,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_sharding": op11_sharding,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op3_preference_chat": chat.SQL,
    "op9_line_dedup": lines.SQL,
    "op13_phrases": phrases.SQL,
}
