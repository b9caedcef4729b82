"""Stage 2: dates a question hangs on, and its facts near them."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions import dates, text, vectors
from chronoweave.operators.grounding import best
from chronoweave.operators.shared import Shared
from chronoweave.sources.graph import COLUMNS, dated
from chronoweave.sources.tables import kept

#: The bound of numbers of neighbours that are a column, if the caller knows none: all are kept.
BOUND = 2**31 - 1
LARGE, K_LARGE = 1000, 80


def effective_k(fq: DataFrame, k: int, lang: str) -> DataFrame:
    """(qid, k): Vietnamese questions with more than `LARGE` facts get at least `K_LARGE` neighbours."""
    return k_of(fq.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), k, lang)


def k_of(sizes: DataFrame, k: int, lang: str) -> DataFrame:
    """`effective_k` by the numbers of facts (qid, n)."""
    return sizes.select("qid", F.when((F.lit(lang) == "vi") & (F.col("n") > LARGE), F.greatest(F.lit(k), F.lit(K_LARGE))).otherwise(k).alias("k"))


def knn(fq: DataFrame, anchors: DataFrame, k: int | str = 40, bound: int = BOUND) -> DataFrame:
    """Facts among the k nearest in time to any of the question's anchors; a question without anchors keeps all.

    `fq` has d and pos, `anchors` is (qid, anchor); `k` a number or a column of `fq`. Ties go by pos.
    `bound` is the largest number that the column has: a literal bound is what lets partitions prune before the shuffle."""
    near = fq.join(anchors.distinct(), "qid").withColumn("dist", dates.distance(F.col("d"), F.col("anchor")))
    own = F.lit(k) if isinstance(k, int) else F.col(k)
    bound = k if isinstance(k, int) else bound
    first = best(near, ["qid", "anchor"], bound, [F.col("dist"), F.col("pos")], "_rank").where(F.col("_rank") <= own)
    first = first.select(*fq.columns).distinct()
    free = fq.join(anchors.select("qid").distinct(), "qid", "left_anti")
    return first.unionByName(free)


def min_distance(fq: DataFrame, anchors: DataFrame) -> DataFrame:
    """`fq` with `dist`, the days to the nearest anchor; NULL without anchors."""
    near = anchors.groupBy("qid").agg(F.collect_set("anchor").alias("_anchors"))  # a question names few dates
    days = F.array_min(F.transform("_anchors", lambda a: dates.distance(F.col("d"), a)))
    return fq.join(near, "qid", "left").withColumn("dist", days).drop("_anchors")


def serialize(chain: DataFrame, anchors: DataFrame) -> DataFrame:
    """`chain` with `dist` and `rank`, from 1: nearest to any anchor first, ties and questions without anchors in order of pos."""
    return min_distance(chain, anchors).withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.coalesce("dist", F.lit(0)), "pos")).cast("long"))


def extremes(fq: DataFrame, questions: DataFrame, question: str = "question") -> DataFrame:
    """(qid, anchor): the first date of the facts if the question has a word for first, the last one for last."""
    ends = fq.groupBy("qid").agg(F.min("d").alias("low"), F.max("d").alias("high")).join(questions.select("qid", F.col(question).alias("_q")), "qid")
    low, high = F.when(text.has_any(F.col("_q"), text.FIRST_WORDS), F.col("low")), F.when(text.has_any(F.col("_q"), text.LAST_WORDS), F.col("high"))
    return ends.select("qid", F.explode(F.array_compact(F.array(low, high))).alias("anchor")).distinct()


def implicit(scored: DataFrame, n: int) -> DataFrame:
    """(qid, anchor): distinct dates of the n facts most similar to the question; `scored` has sim, pos and d."""
    return best(scored, ["qid"], n, [F.desc("sim"), F.asc("pos")]).select("qid", F.col("d").alias("anchor")).distinct()


def implicit_days(similar: DataFrame) -> DataFrame:
    """`implicit` by the n most similar facts."""
    return similar.select("qid", F.col("d").alias("anchor")).distinct()


def score_facts(fq: DataFrame, question_vectors: DataFrame, fact_vectors: DataFrame, keys: list[str]) -> DataFrame:
    """`fq` with sim: cosine of the question's vector (qid, qv) and the fact's (keys, fv). Facts share vectors, which are made once."""
    return fq.join(question_vectors, "qid").join(fact_vectors, keys).withColumn("sim", vectors.similarity(F.col("qv"), F.col("fv"))).drop("qv", "fv")


def explicit(questions: DataFrame, question: str = "question", name: str | None = None) -> DataFrame:
    """(qid, anchor): dates that questions name. What `name`, a column, says is no date: a number in an entity's name isn't a year."""
    asked = F.col(question) if name is None else text.without_name(F.col(question), F.col(name))
    return questions.select("qid", F.explode(dates.explicit_anchors(asked)).alias("anchor")).distinct()


def all_anchors(*parts: DataFrame) -> DataFrame:
    """Union of anchors without repeats."""
    out = parts[0].select("qid", "anchor")
    for p in parts[1:]:
        out = out.unionByName(p.select("qid", "anchor"))
    return out.distinct()


def pair_facts(fq: DataFrame, grounded: DataFrame) -> DataFrame:
    """Facts whose both ends are grounded entities of the question, for questions with at least two; `grounded` is (qid, entity)."""
    names = grounded.select("qid", "entity").distinct()
    many = names.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("qid")
    left, right = names.withColumnRenamed("entity", "s"), names.withColumnRenamed("entity", "o")
    return fq.join(many, "qid", "left_semi").join(left, ["qid", "s"], "left_semi").join(right, ["qid", "o"], "left_semi")


def with_pairs(near: DataFrame, pairs: DataFrame) -> DataFrame:
    return near.unionByName(pairs.select(*near.columns)).distinct()


def semantic_chain(scored: DataFrame | Shared, anchors: DataFrame, k: int, likeness=None) -> DataFrame:
    """The ablation without neighbours: the most similar facts, k for each anchor, at least k; then in order of proximity, or of similarity without anchors.

    The number kept differs by question; the largest one is a literal bound, which lets partitions prune before the shuffle. `scored` has a row for each question and fact, or is `Shared`,
    with a `likeness` as its `similar` has it: only facts that are kept are then met with their questions, and placed among all others."""
    n = anchors.distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("_n"))
    most = n.agg(F.max("_n")).first()[0] or 1
    if likeness is None:
        rows, order = scored, [F.desc("sim"), F.asc("pos")]
    else:
        rows, order = kept(scored.similar(likeness, k * most)), [F.desc("sim"), *map(F.col, COLUMNS)]
    ranked = best(rows, ["qid"], k * most, order, "_rank").join(n, "qid", "left")
    chosen = ranked.where(F.col("_rank") <= k * F.greatest(F.lit(1), F.coalesce("_n", F.lit(0))))
    if likeness is not None:
        chosen = kept(chosen)
        places = scored.placed(chosen.select("qid", *COLUMNS, "d")).select("qid", "pos", *[F.col(c).alias(f"_{c}") for c in COLUMNS])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in COLUMNS]
        chosen = chosen.join(places.withColumnRenamed("qid", "_qid"), [F.col("qid") == F.col("_qid"), *same]).drop("_qid", *[f"_{c}" for c in COLUMNS])
    order = [F.coalesce("dist", F.lit(0)), F.when(F.col("_n").isNull(), F.col("_rank")).otherwise(F.col("pos")), F.col("pos")]
    near = min_distance(chosen, anchors).withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order)).cast("long"))
    return near.drop("_rank", "_n")


def shuffled(chain: DataFrame, questions: DataFrame, seed: int, question: str = "question") -> DataFrame:
    """The ablation without proximity order: `rank` by a hash of seed, question and fact."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("_q"), *COLUMNS), 256)
    joined = chain.join(questions.select("qid", F.col(question).alias("_q")), "qid")
    return joined.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(key, "pos")).cast("long")).drop("_q")


def dated_lists(pairs: DataFrame) -> DataFrame:
    """(qid, _pairs): facts of questions as lists."""
    return dated(pairs).groupBy("qid").agg(F.collect_set(F.struct(*COLUMNS, "d")).alias("_pairs"))


def ordered(ablation: str, seed: int) -> Column:
    """A question's `facts` in the order of its chain: that of `serialize`, `semantic_chain` (where they come the most similar first) or `shuffled`; the row has question, n_anchors and _anchors."""
    fact = lambda x: [x[c].alias(c) for c in COLUMNS]
    near = lambda x: F.coalesce(F.array_min(F.transform("_anchors", lambda a: dates.distance(x["d"], a))), F.lit(0))
    if ablation == "no_ps":
        key = lambda x, i: (F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("question"), *[x[c] for c in COLUMNS]), 256), F.lit(0))
    elif ablation == "no_kntn":
        key = lambda x, i: (near(x), F.when(F.col("n_anchors").isNull(), i).otherwise(0))
    else:
        key = lambda x, i: (near(x), F.lit(0))
    return F.sort_array(F.transform("facts", lambda x, i: F.struct(key(x, i)[0].alias("first"), key(x, i)[1].alias("second"), *fact(x), x["d"].alias("d"))))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _python_order(seeds: pa.Array, sizes: pa.Array) -> pa.Array:
    """For each seed (hexadecimal) and size the places 0 .. size - 1 as Python's generator shuffles them."""
    out = []
    for seed, n in zip(seeds.to_pylist(), sizes.to_pylist(), strict=True):
        places = list(range(n))
        random.Random(int(seed, 16)).shuffle(places)
        out.append(places)
    return pa.array(out, pa.list_(pa.int32()))


def shuffled_as_python(chain: DataFrame, questions: DataFrame, seed: int, question: str = "question") -> DataFrame:
    """The ablation without proximity order as Python's `random` has it: `chain` (with rank, from 1) in the order of its
    shuffle, seeded by the first 16 digits of the SHA-256 of `seed:question`. A question's shuffle is one short list; chains stay where they are."""
    sizes = chain.groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("_n")).join(questions.select("qid", F.col(question).alias("_q")), "qid")
    key = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "_q"), 256), 1, 16)
    orders = sizes.select("qid", F.posexplode(_python_order(key, F.col("_n"))).alias("_new", "_old")).select("qid", (F.col("_old") + 1).cast("long").alias("rank"), (F.col("_new") + 1).cast("long").alias("_new"))
    return chain.join(orders, ["qid", "rank"]).withColumn("rank", F.col("_new")).drop("_new")
