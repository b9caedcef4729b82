"""Dataset construction: what is still to translate, and the facts of all answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import text
from chronoweave.sources.graph import COLUMNS


def not_yet(pool: DataFrame, existing: DataFrame, key: str = "quid") -> DataFrame:
    """Questions that aren't translated yet."""
    return pool.join(existing.select(key).distinct(), key, "left_anti")


def gated(translations: DataFrame, target: str = "vi", source: str = "en") -> DataFrame:
    """Translations that pass, cleaned."""
    clean = translations.withColumn(target, text.clean_translation(F.col(target)))
    return clean.where(text.good_translation(F.col(target), F.col(source)))


def answer_subgraph(facts: DataFrame, answers: DataFrame, translated: DataFrame) -> DataFrame:
    """Facts with a subject or object among all answers, with the translated relation or else its plain words.

    `answers` is (answer), `translated` (p, relation_vi), each relation once. Each end is a semi join with the distinct answers, objects only of facts whose subject is none, so no fact is doubled."""
    wanted = answers.select(F.col("answer").alias("e")).distinct()
    by_subject = facts.join(wanted.withColumnRenamed("e", "s"), "s", "left_semi")
    # A subject that is no answer: NULL subjects too.
    rest = facts.join(wanted.select(F.col("e").alias("_e")), F.col("s") == F.col("_e"), "left_anti")
    by_object = rest.join(wanted.withColumnRenamed("e", "o"), "o", "left_semi")
    kept = by_subject.select(*COLUMNS).unionAll(by_object.select(*COLUMNS)).join(translated, "p", "left")
    return kept.select(*COLUMNS, F.coalesce("relation_vi", F.translate("p", "_", " ")).alias("relation_vi"))


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows and new ones; a new row replaces the old one of its key."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def retry_temperature(attempt: Column) -> Column:
    """0 at first, then from 0.45 up in steps of 0.15."""
    return F.when(attempt == 0, 0.0).otherwise(F.round(0.3 + 0.15 * attempt, 2))
