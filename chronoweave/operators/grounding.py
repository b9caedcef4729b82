"""Mentions to entities and relation phrases to relations: exact keys first, vectors for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import text
from chronoweave.operators.dense import nearest  # noqa: F401  the search for what exact keys don't find

#: Second relation of a phrase: kept if it scores nearly like the first, or high by itself.
GAP, HIGH = 0.15, 0.75


def exact(mentions: DataFrame, vocabulary: DataFrame, mention: str = "mention", entity: str = "entity", key=text.mention_key) -> DataFrame:
    """`mentions` with the `entity` of the same key, NULL without one. Of entities with one key the last in order counts; a mention that is an entity itself is that one where its key has none."""
    keyed = vocabulary.groupBy(key(F.col(entity)).alias("_key")).agg(F.max(entity).alias("_by_key"))
    found = mentions.withColumn("_key", key(F.col(mention))).join(keyed, "_key", "left")
    same = vocabulary.select(F.col(entity).alias("_same")).distinct()
    found = found.join(same, F.col(mention) == F.col("_same"), "left")
    return found.select(*mentions.columns, F.coalesce("_by_key", "_same").alias(entity))


def best(rows: DataFrame, keys: list[str], k: int, order: list[Column], name: str = "rank") -> DataFrame:
    """The first k rows of each key. A literal bound lets partitions drop all others before the shuffle."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= k).drop("_block")


def expand(ranked: DataFrame, keys: list[str], gap: float = GAP, high: float = HIGH) -> DataFrame:
    """Of each key's two best relations the first, and the second if it is close to it or high. `ranked` has rank and sim."""
    tops = ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("rank") == r, F.col("sim"))).alias(f"_sim{r}") for r in (1, 2)])
    second = (F.col("_sim1") - F.col("_sim2") < gap) | (F.col("_sim2") >= high)
    return ranked.join(tops, keys).where((F.col("rank") == 1) | ((F.col("rank") == 2) & second)).drop("_sim1", "_sim2")


def grounded(found: DataFrame, entity: str = "entity") -> DataFrame:
    """Mentions that were grounded."""
    return found.where(F.col(entity).isNotNull())


def others(found: DataFrame, main: str = "main", entity: str = "entity") -> DataFrame:
    """Grounded entities besides the main one."""
    return found.where(F.col(entity) != F.col(main))
