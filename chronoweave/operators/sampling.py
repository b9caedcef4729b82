"""Reproducible stratified samples whose prefixes are samples too."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.sources.tables import kept

STRATUM = ["qtype", "answer_type", "time_level"]


def rank_hash(seed: int | Column, qid: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed).cast("string"), F.lit(":"), qid), 256)


def stratum(fields: list[str] = STRATUM) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f), F.lit("")) for f in fields])


def nested_order(questions: DataFrame, seed: int, fields: list[str] = STRATUM) -> DataFrame:
    """`questions` with `stratum` and `place` in (0, 1): the order by (place, stratum) mixes strata in proportion at every prefix.

    A window over a stratum would be one task: its hashes, which are even, are cut into 4,096 ranges, ranks run
    inside a range, and the ranges' counts are summed before."""
    key, part = [F.coalesce(F.col(f), F.lit("\0")).alias(f"_{i}") for i, f in enumerate(fields)], F.substring("_hash", 1, 3).alias("_part")
    names = [f"_{i}" for i in range(len(fields))]
    rows = questions.withColumn("_hash", rank_hash(seed, F.col("qid"))).select("*", *key, part)
    counts = rows.groupBy(*names, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*names).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*names, "_part", before.alias("_before"), F.sum("_n").over(W.partitionBy(*names)).alias("_all"))
    at = F.row_number().over(W.partitionBy(*names, "_part").orderBy("_hash", "qid")) - 1 + F.col("_before")
    placed = rows.join(starts, [*names, "_part"]).withColumn("place", (at + 0.5) / F.col("_all"))
    return placed.select(*questions.columns, "place").withColumn("stratum", stratum(fields))


def sample(questions: DataFrame, n: int, seed: int, fields: list[str] = STRATUM) -> DataFrame:
    """The first n questions of the nested order, with `pos`; all of them if there are fewer, none for n below 0.

    The limit is a top-n, so `pos` is counted over n rows only."""
    top = nested_order(questions, seed, fields).orderBy("place", *fields).limit(max(0, n))
    return top.withColumn("pos", F.row_number().over(W.orderBy("place", *fields)).cast("long") - 1)


def strata_counts(rows: DataFrame, fields: list[str] = STRATUM) -> DataFrame:
    return rows.groupBy(stratum(fields).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def simple_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by hash order: reproducible whatever the order of the input."""
    return rows.orderBy(rank_hash(seed, F.col(key).cast("string")), key).limit(n)


def numbered(rows: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """`rows` with numbers from 0 in the order of a column; equal values in any order.

    Rows are written in ranges of the column, and each range is numbered by itself, from the sum of the ranges before it."""
    ranges = kept(rows.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(order))
    met = ranges.withColumn("_inside", inside).join(sizes.select("_range", before.alias("_before")), "_range")
    return met.withColumn(name, (F.col("_before") + F.col("_inside") - 1).cast("long")).drop("_range", "_inside", "_before")


def python_sample(rows: DataFrame, order: str, n: int, seed: int) -> DataFrame:
    """n rows as Python's `random.sample` draws them from the rows in the order of `order` (numbers 0, 1, ...), with `pos`, the place among those drawn.

    Only the n drawn numbers are made on the driver."""
    drawn = random.Random(seed).sample(range(total := rows.count()), min(n, total))
    places = rows.sparkSession.createDataFrame(list(enumerate(drawn)), f"pos long, `{order}` long")
    return rows.join(places, order)


def limited(rows: DataFrame, limit: int | None, order: list[str]) -> DataFrame:
    """The first rows; 0 and None are no limit."""
    return rows.orderBy(*order).limit(limit) if limit else rows


def choose(quids: DataFrame | None, manifest: DataFrame | None, drawn: DataFrame) -> DataFrame:
    """Explicit ids before a frozen sample before a drawn one."""
    return next(x for x in (quids, manifest, drawn) if x is not None)


def sample_id(dataset: Column, n: Column, seed: Column) -> Column:
    return F.concat(dataset, F.lit("_n"), n.cast("string"), F.lit("_seed"), seed.cast("string"))
