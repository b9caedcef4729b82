"""The journal of answered questions: lines of JSON that only grow, and what is derived from them.

There is no broker: claims, retries and releases are Spark's tasks, and what is pending is
an anti join of the sample with the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

META = "main_entity string, subgraph_size long, chain_size long, mentions array<string>, grounded array<string>, relation_phrase string, relation_id string, relation_ids array<string>, relation_sim double, main_entity_raw string, n_explicit_anchors long, n_implicit_anchors long, n_anchors long, parse_ok boolean, raw_len long, prompt_style string, abstain_retry boolean, abstain_recovered boolean, lang string, ablation string, k long, n_implicit long, model string, answer_recall_sg boolean, answer_recall_chain boolean, anchor_derivable boolean, anchor_recall boolean, chain_recall boolean, error string, retrieval string"
ROW = f"qid string, question string, gold array<string>, pred array<string>, hit boolean, qtype string, qlabel string, answer_type string, meta struct<{', '.join(x.replace(' ', ':', 1) for x in META.split(', '))}>, hit_gran boolean, time_level string, qgroup string, skipped boolean"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a journal; blank lines and lines cut off by a kill are skipped."""
    rows = spark.read.schema(f"{ROW}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null and (qid is not null or question is not null)").drop("_corrupt_record")


def append(rows: DataFrame, path: str) -> None:
    """Adds rows as new files; a file appears only when its task has committed."""
    rows.write.mode("append").json(path)


def answered(rows: DataFrame, error: str = "meta.error") -> DataFrame:
    """Rows with an id and without an error; an empty error text is none."""
    return rows.where((F.coalesce("qid", F.lit("")) != "") & (F.coalesce(F.col(error), F.lit("")) == ""))


def latest(rows: DataFrame, key: str = "qid", order: str = "seq") -> DataFrame:
    """The last row of each key by `order`, with `order` and `first_seen`, where the key first stood.

    As an aggregate, so that repeated rows of one key meet in partial sums and not in one task's window."""
    rest = [c for c in rows.columns if c not in (key, order)]
    last = F.max(F.struct(order, *rest)).alias("last")
    return rows.groupBy(key).agg(last, F.min(order).alias("first_seen")).select(key, *[F.col(f"last.{c}").alias(c) for c in (order, *rest)], "first_seen")


def pending(sample: DataFrame, *done: DataFrame, key: str = "qid") -> DataFrame:
    """Questions of the sample that none of the tables (answered, queued, in flight) has."""
    for d in done:
        sample = sample.join(d.select(key).distinct(), key, "left_anti")
    return sample


def released(claims: DataFrame, done: DataFrame, now, seconds: int, key: str = "qid") -> DataFrame:
    """Claimed questions (key, claimed_at) that aren't done and were claimed more than so many seconds before `now`: to be asked again."""
    stale = claims.groupBy(key).agg(F.max("claimed_at").alias("_at")).where(F.unix_timestamp(now) - F.unix_timestamp("_at") > seconds)
    return pending(stale.select(key), done, key=key)


def replayable(sample: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Journal rows worth keeping, and questions to ask again: error rows count as unanswered."""
    good = answered(rows)
    return good, pending(sample, good)


def merge(journal: DataFrame, other: DataFrame, key: str = "qid", order: str = "seq") -> DataFrame:
    """Both tables' rows, one each key: the journal wins, then the later row."""
    ranked = journal.withColumn("_from", F.lit(1)).unionByName(other.withColumn("_from", F.lit(0)))
    rest = [c for c in journal.columns if c != key]
    best = F.max(F.struct("_from", order, *[c for c in rest if c != order])).alias("best")
    return ranked.groupBy(key).agg(best).select(key, *[F.col(f"best.{c}").alias(c) for c in rest])


def counts(sample: DataFrame, done: DataFrame, inflight: DataFrame | None = None) -> DataFrame:
    """done, queued and inflight as one row."""
    tables = [("done", sample.join(done.select("qid").distinct(), "qid", "left_semi"))]
    if inflight is not None:
        tables.append(("inflight", inflight.select("qid").distinct()))
    left = pending(sample, done, *([inflight] if inflight is not None else []))
    tables.append(("queued", left))
    long = None
    for name, t in tables:
        one = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("state"), "n")
        long = one if long is None else long.unionAll(one)
    return long.groupBy().pivot("state", ["done", "queued", "inflight"]).agg(F.coalesce(F.sum("n"), F.lit(0))).na.fill(0)


def without_skipped(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("skipped").isNull())


def dump(rows: DataFrame, path: str, position: str = "pos") -> None:
    """A snapshot in order. Ranges keep it parallel: file names follow the order."""
    rows.orderBy(position).write.mode("overwrite").json(path)


def legacy(rows: DataFrame) -> DataFrame:
    """The flat runner's single JSON value: share of hits, number, and the results as one array.

    For a report of one run only: the array is one value."""
    return rows.agg(F.to_json(F.struct(F.avg(F.col("hit").cast("int")).alias("hits_at_1"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("qid", "hit"))).alias("results"))).alias("json"))


def running_accuracy(rows: DataFrame, order: str = "seq", part: str = "part", block: int = 1 << 16) -> DataFrame:
    """Hits so far and their share in order of completion.

    A window over all rows would be one task: rows are cut into blocks of `block` numbers, each block's
    total is summed over the (few) blocks before it, and rows run only inside their block."""
    blocks = rows.withColumn(part, F.floor(F.col(order) / block))
    totals = blocks.groupBy(part).agg(F.sum(F.col("hit").cast("long")).alias("h"), F.count(F.lit(1)).alias("c"))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(part, F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    inside = W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    hits = F.col("h0") + F.sum(F.col("hit").cast("long")).over(inside)
    n = F.col("c0") + F.count(F.lit(1)).over(inside)
    return blocks.join(starts, part).select(*rows.columns, hits.alias("hits"), n.alias("n"), (hits / n).alias("accuracy"))


def progress(rows: DataFrame, total: int, order: str = "seq", elapsed: str = "elapsed") -> DataFrame:
    """Seconds left after each completion: elapsed per row done so far, times the rows to come."""
    run = running_accuracy(rows, order)
    return run.withColumn("eta", F.col(elapsed) / F.col("n") * (total - F.col("n")))
