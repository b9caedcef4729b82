"""Stage 1: a question's facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.shared import asked_of, first_met, keys_of
from chronoweave.sources.graph import COLUMNS, endpoints


def touching(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """Facts with a key's entity `e` at either end, one row for each end; `keys` has e and what else a row should carry."""
    return endpoints(facts).join(keys, "e")


def retrieve(facts: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """F_q: distinct facts that touch any of a question's entities with any of its relations.

    `entities` is (qid, e), main or auxiliary, and `relations` (qid, p). Entity and relation are one join key. Facts are made distinct before
    the join, not questions' facts after it, which are many times as many."""
    keys, ends = keys_of(entities, relations), endpoints(asked_of(facts, relations), loops_twice=False)
    return ends.join(keys, ["e", "p"]).where(first_met(F.col("own"))).select("qid", *COLUMNS)


def main_facts(facts: DataFrame, mains: DataFrame) -> DataFrame:
    """Facts of the main entity with the relation; `mains` is (qid, e, p)."""
    return endpoints(facts, loops_twice=False).join(mains, ["e", "p"]).select("qid", *COLUMNS)


def context_facts(facts: DataFrame, auxiliaries: DataFrame, main: DataFrame) -> DataFrame:
    """Distinct facts of auxiliary entities with the relation that the main facts don't have. A fact needs one auxiliary entity, not a pair."""
    found = endpoints(facts, loops_twice=False).join(auxiliaries, ["e", "p"]).select("qid", *COLUMNS).distinct()
    return found.join(main.select("qid", *COLUMNS).distinct(), ["qid", *COLUMNS], "left_anti")


def context_of(facts: DataFrame, auxiliaries: DataFrame, mains: DataFrame) -> DataFrame:
    """As `context_facts`, with the main entities' keys (qid, e, p) in place of their facts: which facts are theirs is seen in the join."""
    names = lambda keys, name: keys.groupBy("qid", "p").agg(F.collect_set("e").alias(name))
    own = names(auxiliaries, "own").join(names(mains, "_mains"), ["qid", "p"], "left").select("qid", "p", "own", "_mains", F.explode("own").alias("e"))
    has = lambda c: F.coalesce(F.array_contains("_mains", F.col(c)), F.lit(False))
    ends = endpoints(asked_of(facts, auxiliaries), loops_twice=False)
    return ends.join(own, ["e", "p"]).where(first_met(F.col("own")) & ~has("s") & ~has("o")).select("qid", *COLUMNS)


def in_order(fq: DataFrame) -> DataFrame:
    """`fq` with `pos`, the place of each fact of a question in canonical order, from 0."""
    return fq.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy(*COLUMNS)).cast("long") - 1)
