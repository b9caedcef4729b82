"""Queries that write what a run keeps and read it back: question files, manifests, journals, caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.catalog.evaluation import _ORDER
from chronoweave.catalog.registry import query
from chronoweave.catalog.views import EXPLICIT, FACTS, QUESTIONS, Views
from chronoweave.functions import dates, text
from chronoweave.operators import sampling
from chronoweave.plans.reason import by_model, with_retry
from chronoweave.sources import caches, embeddings, graph, journal, questions, responses
from chronoweave.sources.tables import shared_folder
from chronoweave.streaming import leases, queue


def _place(v: Views) -> str:
    return f"{shared_folder(v.spark)}/stores/{uuid.uuid4().hex}"


@query("SELECT qid, question, answer_type, qtype, qlabel, time_level, array_to_string(answers, ',') AS a FROM questions", f"{FACTS}, {QUESTIONS}")
def a4_question_scan(v: Views) -> DataFrame:
    """JSON arrays of about a thousand records, one a file, read as questions."""
    parts = -(-v.questions.count() // 1000)
    records = v.questions.select(F.col("qid").alias("quid"), "question", "answers", "answer_type", "qtype", "qlabel", "time_level", F.pmod(F.xxhash64("qid"), F.lit(max(1, parts))).alias("part"))
    files = records.groupBy("part").agg(F.to_json(F.collect_list(F.struct(*[c for c in records.columns if c != "part"]))).alias("value")).select("value")
    path = _place(v)
    files.write.option("maxRecordsPerFile", 1).text(path)
    read = questions.read_json(v.spark, path, questions.POINT)
    return read.select("qid", F.col("question_vi").alias("question"), "answer_type", "qtype", "qlabel", "time_level", F.array_join("answers", ",").alias("a"))


@query("SELECT row_number() OVER (ORDER BY place, qtype, answer_type, time_level) - 1 AS pos, qid, 'point_n50_seed42' AS sample_id FROM placed QUALIFY pos < 50", f"{FACTS}, {QUESTIONS}, {_ORDER}")
def a6_manifest(v: Views) -> DataFrame:
    """A frozen sample of fifty: its size is the feature."""
    path = f"{_place(v)}.json"
    questions.write_manifest(path, sampling.sample(v.questions, 50, 42), questions.POINT, "test", 50, 42)
    return questions.read_manifest(v.spark, path).select(F.col("pos").cast("long").alias("pos"), "qid", "sample_id")


@query("SELECT qid, k % 2 = 0 AS hit, CASE WHEN k % 5 = 0 THEN 'timed out' END AS error, k % 3 = 0 AS retried FROM questions WHERE k % 7 > 0", f"{FACTS}, {QUESTIONS}")
def a7_journal(v: Views) -> DataFrame:
    """Rows appended in two lots (A8), a line cut off by a kill and a blank one; skipped rows (C8) stay out."""
    meta = F.struct(F.when(F.col("k") % 5 == 0, "timed out").alias("error"), (F.col("k") % 3 == 0).alias("abstain_retry"))
    rows = v.questions.select("qid", "question", (F.col("k") % 2 == 0).alias("hit"), meta.alias("meta"), F.when(F.col("k") % 7 == 0, True).alias("skipped"), "k")
    path = _place(v)
    for lot in (0, 1):
        journal.append(rows.where(F.col("k") % 2 == lot).drop("k"), path)
    v.spark.createDataFrame([('{"qid": "cut o',), ("",)], "value string").write.mode("append").text(path)
    return journal.without_skipped(journal.read(v.spark, path)).select("qid", "hit", F.col("meta.error").alias("error"), F.col("meta.abstain_retry").alias("retried"))


@query("SELECT qid, k FROM questions", f"{FACTS}, {QUESTIONS}")
def a12_dump(v: Views) -> DataFrame:
    """A snapshot replaces the one before."""
    path = _place(v)
    for rows in (v.questions.select("qid", F.lit(0).cast("long").alias("k")), v.questions.select("qid", "k")):
        journal.dump(rows, path, "qid")
    return v.spark.read.schema("qid string, k long").json(path)


@query("SELECT DISTINCT p AS key, length(p) AS size FROM facts", FACTS)
def a13_embedding_cache(v: Views) -> DataFrame:
    """Built for the first keys, built again for others, then read."""
    path = _place(v)
    keys = graph.relations(v.facts).select(F.xxhash64("relation").alias("pos"), F.col("relation").alias("key"))
    build = lambda size: lambda k: k.withColumn("embedding", F.array(size.cast("float")))
    caches.load_or_build(v.spark, path, "m", keys.where("length(key) < 6"), build(F.lit(0)))
    caches.load_or_build(v.spark, path, "m", keys, build(F.length("key")))
    read = caches.load_or_build(v.spark, path, "m", keys, build(F.lit(-1)))
    return read.select("key", F.col("embedding")[0].cast("long").alias("size"))


@query("SELECT DISTINCT p AS key, length(p) AS adopted, -1 AS other_encoder, CASE WHEN length(p) < 6 THEN -2 END AS other_keys FROM facts", FACTS)
def a14_adopted_cache(v: Views) -> DataFrame:
    """A cache of the old format, one JSON object of a vocabulary, is adopted for the encoder that wrote it and for its very keys, and refused for others."""
    path = _place(v)
    names = graph.relations(v.facts)
    keys = names.select((F.row_number().over(W.orderBy("relation")) - 1).cast("long").alias("pos"), F.col("relation").alias("key"))
    old = F.struct(F.transform("rows", lambda x: x["key"]).alias("keys"), F.transform("rows", lambda x: F.array(F.length(x["key"]).cast("float"))).alias("embeddings"))
    keys.agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("rows")).select(F.to_json(old).alias("value")).coalesce(1).write.text(f"{path}/old")
    build = lambda mark: lambda k: k.withColumn("embedding", F.array(F.lit(mark).cast("float")))
    made = lambda name, slug, wanted, mark: caches.load_or_build(v.spark, f"{path}/{name}", slug, wanted, build(mark), (f"{path}/old", "keys")).select("key", F.col("embedding")[0].cast("int").alias(name))
    found = made("adopted", "bge-base-en-v1.5", keys, 0).join(made("other_encoder", "m", keys, -1), "key")
    return found.join(made("other_keys", "bge-base-en-v1.5", keys.where("length(key) < 6"), -2), "key", "left")


@query("SELECT 'm' AS model, qid AS prompt, CASE WHEN k % 2 = 0 THEN 'kept' ELSE 'asked ' || qid END AS response FROM questions", f"{FACTS}, {QUESTIONS}")
def a16_model_calls(v: Views) -> DataFrame:
    """A client is asked for what the cache hasn't; its first answer isn't valid (K6), its second one is."""
    known = v.questions.select(F.col("qid").alias("key"), F.lit("m").alias("model"), F.col("qid").alias("prompt"), F.when(F.col("k") % 2 == 0, "kept").alias("response"))
    return caches.call_misses(known, _Client(), valid=lambda r: r != "", sleep=lambda s: None).select("model", "prompt", "response")


class _Client:
    """Answers a prompt the second time it is asked."""

    def __init__(self):
        self.asked: set[str] = set()

    def __call__(self, model: str, prompt: str) -> str:
        if prompt in self.asked:
            return f"asked {prompt}"
        self.asked.add(prompt)
        return ""


class _Lots:
    """Vectors of a text's length and number of e's, in turned order; every client's first call fails."""

    def __init__(self, settings: dict):
        self.scale, self.failed = settings["scale"], False

    def __call__(self, texts: list[str]) -> embeddings.Reply:
        if not self.failed:
            self.failed = True
            raise OSError("down")
        return embeddings.Reply([(i, [self.scale * len(t), t.count("e")]) for i, t in reversed(list(enumerate(texts)))], sum(map(len, texts)))


@query("SELECT qid, 2 * length(question) AS x, length(question) - length(replace(question, 'e', '')) AS y, (SELECT sum(length(q))::BIGINT FROM (SELECT DISTINCT question AS q FROM questions)) AS tokens FROM questions", f"{FACTS}, {QUESTIONS}")
def a17_embedding_connector(v: Views) -> DataFrame:
    """Every distinct question once, in lots, by a client of a registry (K5) that fails first and turns its answers round; its usage is charged."""
    registry = embeddings.Registry()
    registry.register("lots", _Lots)
    twice = v.questions.select("qid", "question").unionAll(v.questions.select("qid", "question"))
    found, bill = embeddings.embed(twice, registry.handle("lots", scale=2), "question", lot=50, normalize=False, sleep=lambda s: None)
    once = found.groupBy("qid").agg(F.first("embedding").alias("v"))
    return once.select("qid", F.col("v")[0].cast("long").alias("x"), F.col("v")[1].cast("long").alias("y"), bill.select("tokens").scalar().alias("tokens"))


@query(
    """, topics AS (SELECT *, k % 50 AS topic FROM questions)
SELECT 1 AS run, topic, count(*) AS questions, 1 AS calls, topic % 3 > 0 AS valid, 0 AS from_store FROM topics WHERE k % 4 < 3 GROUP BY topic
UNION ALL SELECT 2, topic, count(*), CASE WHEN topic % 3 > 0 AND topic IN (SELECT topic FROM topics WHERE k % 4 < 3) THEN 0 ELSE 1 END, topic % 3 > 0, CASE WHEN topic % 3 > 0 AND topic IN (SELECT topic FROM topics WHERE k % 4 < 3) THEN count(*) ELSE 0 END FROM topics GROUP BY topic
UNION ALL SELECT 3, topic, count(*), 1, topic % 3 > 0, 0 FROM topics GROUP BY topic""",
    f"{FACTS}, {QUESTIONS}",
)
def a15_cache_runs(v: Views) -> DataFrame:
    """Three runs over one store: some questions, all of them, all of them with reads off (L7). Questions of one topic have one prompt, which is one call;
    every third topic's answer isn't valid and isn't stored; compaction between the runs changes nothing."""
    path, out = _place(v), None
    asked = v.questions.select("qid", "k", (F.col("k") % 50).alias("topic"), F.concat(F.lit("topic "), F.col("k") % 50).alias("prompt"), F.lit("m").alias("model"))
    for run, (part, reads) in enumerate((("k % 4 < 3", True), ("true", True), ("true", False)), 1):
        store = responses.ResponseStore(v.spark, path, buckets=8, reads=reads)
        found = store.answer(asked.where(part), _Topics(), attempts=1, valid=lambda text: text != "")
        store.compact()
        each = found.groupBy("topic").agg(F.count(F.lit(1)).alias("questions"), F.max("cost").cast("int").alias("calls"), F.max("valid").alias("valid"), F.sum(F.col("from_store").cast("long")).alias("from_store"))
        each = each.select(F.lit(run).alias("run"), "topic", "questions", "calls", "valid", "from_store")
        out = each if out is None else out.unionAll(each)
    return out


class _Topics:
    """Answers a topic once: a second call for it in one task fails. Every third topic has an empty answer."""

    def __init__(self):
        self.asked: set[str] = set()

    def __call__(self, model: str, prompt: str) -> responses.Answer:
        if prompt in self.asked:
            raise ValueError(f"asked again: {prompt}")
        self.asked.add(prompt)
        return responses.Answer("" if int(prompt.split()[1]) % 3 == 0 else f"['{prompt}']", 1.0)


@query("SELECT DISTINCT p AS relation FROM facts", FACTS)
def a20_relation_scan(v: Views) -> DataFrame:
    """Keys of a JSON object of relations, a vocabulary that a prompt can hold."""
    path = _place(v)
    entry = F.struct("relation", F.length("relation").cast("long").alias("n"))
    graph.relations(v.facts).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).coalesce(1).write.text(path)
    return graph.relation_ids(v.spark, path)


@query("SELECT qid FROM questions ORDER BY qid LIMIT 10", f"{FACTS}, {QUESTIONS}")
def g10_limit(v: Views) -> DataFrame:
    """The limit is the feature; 0 is none, and an explicit selection goes before a frozen one and a drawn one (G13)."""
    chosen = sampling.choose(None, sampling.limited(v.questions, 10, ["qid"]), v.questions.limit(0))
    return sampling.limited(chosen, 0, ["qid"]).select("qid")


@query("SELECT qid, coalesce(string_agg(anchor::VARCHAR, ',' ORDER BY anchor), '') AS dates FROM questions LEFT JOIN explicit USING (qid) GROUP BY qid", f"{FACTS}, {QUESTIONS}, {EXPLICIT}")
def h5_ordered_dates(v: Views) -> DataFrame:
    """A question said twice names each of its dates once, in the first order."""
    twice = text.without_name(F.concat("question", F.lit(" "), "question"), F.col("main"))
    return v.questions.select("qid", F.array_join(dates.explicit_anchors(twice).cast("array<string>"), ",").alias("dates"))


@query("SELECT (k % 2 = 0)::INT + 1 AS tries, count(*) AS questions FROM questions GROUP BY 1", f"{FACTS}, {QUESTIONS}")
def j3_complete(v: Views) -> DataFrame:
    """A batch with failures, then the same batch again: done questions aren't asked twice (J2), failed ones are."""
    path, batch = _place(v), v.questions.select("qid", "k")
    schema = batch.select("qid", F.lit("").alias("error"), F.lit(0.0).alias("cost")).schema
    scored = lambda failed: lambda df: df.select("qid", F.when(failed, "down").otherwise("").alias("error"), F.lit(1.0).alias("cost"))
    queue.process_batch(batch, scored(F.col("k") % 2 == 0), path, schema)
    queue.process_batch(batch, scored(F.lit(False)), path, schema, read_only=True)
    queue.process_batch(batch, scored(F.lit(False)), path, schema)
    tries = queue.done_rows(v.spark, path, schema).groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("tries"))
    return tries.groupBy("tries").agg(F.count(F.lit(1)).alias("questions"))


@query("SELECT qid FROM questions WHERE k % 3 > 0 AND k % 4 = 0", f"{FACTS}, {QUESTIONS}")
def j4_released(v: Views) -> DataFrame:
    """Claims that are too old and not done go back to the queue."""
    claims = v.questions.select("qid", F.when(F.col("k") % 4 == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.timestamp_seconds(F.lit(5000))).alias("claimed_at"))
    return journal.released(claims, v.questions.where("k % 3 = 0"), F.timestamp_seconds(F.lit(5400)), 3600)


def _leased(v: Views, spend: leases.Spend, until, **how) -> DataFrame:
    """The journal of a stream of questions of which every fifth one's first claim dies."""
    path = _place(v)
    v.questions.select("qid", "k").write.json(f"{path}/questions")
    row = v.spark.createDataFrame([], "qid string, try int, error string, cost double").schema
    dies = (F.col("k") % 5 == 0) & (F.col("try") == 1)
    score = lambda claims: claims.where(~dies).select("qid", "try", F.lit("").alias("error"), F.lit(1.0).alias("cost"))
    asked = v.questions.select("qid", "k").schema
    leases.run(v.spark, f"{path}/questions", asked, score, f"{path}/journal", row, f"{path}/checkpoint", spend, until=until, lease_seconds=1, every="1 second", partitions=max(4, v.spark.sparkContext.defaultParallelism), **how)
    return v.spark.read.schema(row).option("recursiveFileLookup", "true").json(f"{path}/journal")


@query("SELECT qid, 1 AS answers, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS try FROM questions", f"{FACTS}, {QUESTIONS}")
def j4_leases(v: Views) -> DataFrame:
    """A stream whose claims have timers: what dies is asked again once, what is answered never."""
    total = v.questions.count()
    rows = _leased(v, leases.Spend(), lambda s: s.rows >= total)
    return rows.groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("answers"), F.max("try").alias("try"))


@query("SELECT TRUE AS ended, TRUE AS within_a_wave, 2 AS told, TRUE AS each_once, count(*) AS questions FROM questions", f"{FACTS}, {QUESTIONS}")
def j6_budget(v: Views) -> DataFrame:
    """The stream ends before the wave past its budget, and has told of four fifths and of nineteen twentieths once each; other questions wait."""
    total = v.questions.count()
    spend = leases.Spend(max_usd=total / 4)
    rows = _leased(v, spend, lambda s: False, wave_rows=max(1, total // 40))
    found = rows.agg(F.sum("cost").alias("paid"), (F.count(F.lit(1)) == F.count_distinct("qid")).alias("each_once"))
    within = (F.col("paid") >= spend.max_usd) & (F.col("paid") < spend.max_usd + 0.1 * total)
    return found.select(F.lit(spend.passed).alias("ended"), within.alias("within_a_wave"), F.lit(len(spend.told)).alias("told"), "each_once", F.lit(total).cast("long").alias("questions"))


@query("SELECT qid, CASE WHEN k % 3 = 0 THEN 'first' WHEN k % 3 = 1 AND k % 2 = 1 THEN 'second' ELSE '' END AS pred, k % 3 = 1 AND k % 2 = 1 AS abstain_retry, k % 3 < 2 AS parse_ok FROM questions", f"{FACTS}, {QUESTIONS}")
def k7_retry(v: Views) -> DataFrame:
    """One second pass for readable empty answers on non-empty chains, in the strict style."""
    k, none = F.col("k") % 3, F.array().cast("array<string>")
    first = v.questions.select("qid", "question", F.lit("entity").alias("answer_type"), F.lit("P").alias("prompt"), (F.col("k") % 2).alias("chain_size"), (k < 2).alias("parse_ok"), F.when(k == 0, F.array(F.lit("first"))).otherwise(none).alias("pred"))
    ask = lambda prompts: prompts.withColumn("response", F.lit("['second']"))
    return with_retry(first, ask, "strict", "en").select("qid", F.array_join("pred", ",").alias("pred"), "abstain_retry", "parse_ok")


@query("SELECT qid, CASE WHEN k % 2 = 0 THEN main ELSE 'again' END AS pred, TRUE AS parse_ok, k % 2 = 1 AS abstain_recovered FROM questions", f"{FACTS}, {QUESTIONS}")
def l11_model_reasoner(v: Views) -> DataFrame:
    """Stage 3 by a model: prompts of a style, answers to those in a cache or of a client, and the second pass."""
    q = v.questions.withColumn("answer_type", F.lit("entity"))
    chain = q.select("qid", F.col("main").alias("s"), F.col("relation").alias("p"), F.col("aux").alias("o"), F.lit("2024-01-01").alias("ts"), F.lit(1).alias("rank"))
    even = q.where("k % 2 = 0").select("qid", "main")

    def ask(prompts: DataFrame) -> DataFrame:
        known = prompts.join(even, "qid", "left")
        return known.withColumn("response", F.when(F.col("prompt").contains("never right"), "['again']").when(F.col("main").isNotNull(), F.concat(F.lit("<think>['x']</think> ['"), "main", F.lit("']"))).otherwise("[]")).drop("main")

    return by_model(ask, "strict", "en")(q, chain, None).select("qid", F.array_join("pred", ",").alias("pred"), "parse_ok", "abstain_recovered")
