"""Recalls of retrieved facts, and aggregates over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import dates, scores, text
from chronoweave.sources.graph import endpoints


def answer_recall(facts: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, recalled) for questions with facts that have a gold answer. `gold` is (qid, answer_type, answers).

    One pass over facts that are at hand by question: a question's few answers go with its row, no fact is shuffled more than once."""
    return facts.join(_asked(gold), "qid").where(_has_answer()).select("qid").distinct().withColumn("recalled", F.lit(True))


def _asked(gold: DataFrame) -> DataFrame:
    """(qid, answer_type, _names, _times)."""
    return gold.select("qid", "answer_type", F.transform("answers", text.normalize).alias("_names"), F.col("answers").alias("_times"))


def with_answer(chain: Column) -> Column:
    """Whether one of a list of facts has one of the answers of the question's row, which has them normalised as `_names`."""
    return F.exists(chain, lambda x: _has_answer(x["s"], x["o"], x["ts"], F.col("_names"), F.col("answers")))


def _has_answer(s: Column | str = "s", o: Column | str = "o", ts: Column | str = "ts", names: Column | str = "_names", times: Column | str = "_times") -> Column:
    """Whether a fact has one of the question's answers: at one of its ends, or as its time at the answer's grain."""
    s, o, ts, names, times = (F.col(c) if isinstance(c, str) else c for c in (s, o, ts, names, times))
    named = F.arrays_overlap(F.array(text.normalize(s), text.normalize(o)), names)
    timed = F.exists(times, lambda g: scores.time_matches(ts, g))
    return F.coalesce(F.when(F.col("answer_type") == scores.TIME, timed).otherwise(named), F.lit(False))


def sizes(facts: DataFrame, gold: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(qid, n, recalled, on_anchor): a question's facts, whether one has a gold answer, and whether one is on an anchor, in one pass over `facts` (with d).

    `answer_recall` and `anchor_recall` together: a question's few answers and dates go with its row."""
    own = _asked(gold)
    if anchors is None:
        own = own.withColumn("_days", F.array().cast("array<date>"))
    else:
        own = own.join(anchors.groupBy("qid").agg(F.collect_set("anchor").alias("_days")), "qid", "left")
    on = F.coalesce(F.array_contains("_days", dates.parse_ts(F.col("ts"))), F.lit(False))
    return facts.join(own, "qid").groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max(_has_answer()).alias("recalled"), F.max(on).alias("on_anchor"))


def anchor_recall(facts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(qid, recalled) for questions with a fact on one of their anchors."""
    days = facts.select("qid", dates.parse_ts(F.col("ts")).alias("anchor"))
    return days.join(anchors.select("qid", "anchor").distinct(), ["qid", "anchor"], "left_semi").select("qid").distinct().withColumn("recalled", F.lit(True))


def gold_anchors(facts: DataFrame, questions: DataFrame, explicit: DataFrame, grounded: DataFrame) -> DataFrame:
    """(qid, anchor): the dates a question names, or else those of its main entity's facts that touch another grounded entity.

    `questions` is (qid, main), `grounded` (qid, entity)."""
    free = questions.join(explicit.select("qid").distinct(), "qid", "left_anti")
    other = grounded.join(free, "qid").where("entity <> main").select("qid", F.col("entity").alias("other")).distinct()
    mine = endpoints(facts).join(free.withColumnRenamed("main", "e"), "e").select("qid", "s", "o", "ts")
    far = mine.select("qid", "ts", F.explode(F.array("s", "o")).alias("other")).join(other, ["qid", "other"], "left_semi")
    return explicit.select("qid", "anchor").unionAll(far.select("qid", dates.parse_ts(F.col("ts")).alias("anchor"))).distinct()


def rate(condition: Column) -> Column:
    """Share of rows; NULL counts as no, and no rows give 0."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("int")), F.lit(0.0))


def rate_where(condition: Column, eligible: Column) -> Column:
    """Share among eligible rows."""
    return F.coalesce(F.avg(F.when(F.coalesce(eligible, F.lit(False)), F.coalesce(condition, F.lit(False)).cast("int"))), F.lit(0.0))


def breakdown(rows: DataFrame, key: str, metric: str = "hit") -> DataFrame:
    """(bucket, hits, total); rows without the key are in the bucket `unknown`."""
    bucket = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("unknown"))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count_if(F.coalesce(F.col(metric), F.lit(False))).alias("hits"), F.count(F.lit(1)).alias("total"))


def summarize(rows: DataFrame) -> DataFrame:
    """All measures of a run in one pass; `rows` are of the journal's schema. `error_rate` is ours, the others count error rows as misses without facts."""
    meta = lambda name: F.col(f"meta.{name}")
    derivable = meta("anchor_derivable")
    measures = {
        "hits_at_1": rate(F.col("hit")),
        "hits_at_1_granular": rate(F.col("hit_gran")),
        "answer_recall_sg": rate(meta("answer_recall_sg")),
        "answer_recall_chain": rate(meta("answer_recall_chain")),
        "anchor_recall": rate_where(meta("anchor_recall"), derivable),
        "chain_recall": rate_where(meta("chain_recall"), derivable),
        "anchor_derivable_rate": rate(derivable),
        "empty_subgraph_rate": rate(F.coalesce(meta("subgraph_size"), F.lit(0)) == 0),
        "parse_fail_rate": rate(meta("parse_ok") == F.lit(False)),
        "abstain_rate": rate(scores.abstained(meta("chain_size"), meta("parse_ok"), F.col("pred"))),
        "reasoning_loss_rate": rate(scores.reasoning_loss(F.col("hit"), meta("answer_recall_chain"))),
        "relation_expanded_rate": rate(scores.relation_expanded(meta("relation_ids"))),
        "granularity_mismatch_rate": rate(scores.granularity_mismatch(F.col("question"), F.col("gold"), F.col("answer_type"))),
        "error_rate": rate(F.coalesce(meta("error"), F.lit("")) != ""),
    }
    return rows.agg(F.count(F.lit(1)).alias("n_scored"), *[c.alias(n) for n, c in measures.items()])


def flat_summary(rows: DataFrame, hit: str = "hit", latency: str = "latency") -> DataFrame:
    """hits, total, percent and mean latency."""
    hits = F.count_if(F.col(hit))
    return rows.agg(hits.alias("hits"), F.count(F.lit(1)).alias("total"), F.round(F.try_divide(hits * 100.0, F.count(F.lit(1))), 6).alias("percent"), F.round(F.avg(latency), 6).alias("mean_latency"))


def discordant(a: DataFrame, b: DataFrame, metric: str = "hit", order: str = "seq") -> DataFrame:
    """n_paired, only_a, only_b and agree over common questions; of b's repeated rows the last counts, a's all do."""
    last = b.groupBy("qid").agg(F.max_by(F.coalesce(F.col(metric), F.lit(False)), order).alias("_b"))
    met = a.select("qid", F.coalesce(F.col(metric), F.lit(False)).alias("_a")).join(last, "qid")
    only_a, only_b = F.count_if(F.col("_a") & ~F.col("_b")), F.count_if(F.col("_b") & ~F.col("_a"))
    n = F.count(F.lit(1))
    return met.agg(n.alias("n_paired"), only_a.alias("only_a"), only_b.alias("only_b"), (n - only_a - only_b).alias("agree"))


def spend(rows: DataFrame, prices: DataFrame, fallback: tuple[float, float]) -> DataFrame:
    """Cost by model: the reported one, else tokens times the model's price, else times the fallback's.

    `rows` has model, prompt_tokens, completion_tokens and cost, `prices` model, pp and pc."""
    priced = rows.join(prices, "model", "left")
    own = F.col("prompt_tokens") * F.coalesce("pp", F.lit(fallback[0])) + F.col("completion_tokens") * F.coalesce("pc", F.lit(fallback[1]))
    return priced.groupBy("model").agg(F.round(F.sum(F.coalesce("cost", own)), 6).alias("usd"), F.count(F.lit(1)).alias("calls"))


def effective_cap(requested: Column, spent: Column, headroom: Column, margin: float = 0.10) -> Column:
    """The total a run may spend: never more than asked, nor than was spent and still can be; an unlimited account gives what was asked."""
    left = F.greatest(F.lit(0.0), headroom - margin)
    return F.when(headroom == F.lit(float("inf")), requested).otherwise(F.greatest(F.lit(0.0), F.least(requested, spent + left)))


def estimated_calls(n: Column, ablation: Column) -> Column:
    """Model calls of a run: three to extract and one to answer; without a subgraph only the answer."""
    return F.when(ablation == "no_sg", n).otherwise(n * 4)
