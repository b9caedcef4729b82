"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.catalog.registry import query
from chronoweave.catalog.views import FACTS, FULL, INTERVALS, QUESTIONS, Views
from chronoweave.functions import dates, scores, text
from chronoweave.operators import corpus, sampling
from chronoweave.plans import prompts
from chronoweave.plans.reason import parsed
from chronoweave.plans.spec import ABLATIONS, RunSpec
from chronoweave.sources import caches, questions

#: Timestamps of every grain from order dates.
_STAMPS = """stamps AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m') || '-31' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ts FROM orders)"""


def _stamps(v: Views) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, lambda f: F.date_format("o_orderdate", f)
    ts = F.when(k == 0, d("yyyy")).when(k == 1, d("yyyy-MM")).when(k == 2, F.concat(d("yyyy-MM"), F.lit("-31"))).otherwise(d("yyyy-MM-dd"))
    return v.table("orders").select(F.col("o_orderkey").alias("id"), ts.alias("ts"))


@query("SELECT id, coalesce(try_cast(ts AS DATE), try_cast(rpad(ts[1:7], 7, '') || '-01' AS DATE), try_cast(ts[1:4] || '-01-01' AS DATE))::VARCHAR AS d FROM (SELECT id, CASE len(ts) WHEN 4 THEN ts || '-01-01' WHEN 7 THEN ts || '-01' ELSE ts END AS ts FROM stamps)".replace("rpad(ts[1:7], 7, '')", "ts[1:7]"), _STAMPS)
def i2_parse_ts(v: Views) -> DataFrame:
    """With the fallback for days a month hasn't (I1)."""
    return _stamps(v).select("id", dates.parse_ts(F.col("ts")).cast("string").alias("d"))


@query("SELECT id, (['year', 'month', 'day'])[len(string_split(ts, '-'))] AS grain FROM stamps", _STAMPS)
def i3_granularity(v: Views) -> DataFrame:
    return _stamps(v).select("id", dates.granularity_of(F.col("ts")).alias("grain"))


@query("SELECT id, ts[1:4] AS y, ts[1:7] AS m, ts AS d FROM stamps", _STAMPS)
def i4_trim(v: Views) -> DataFrame:
    return _stamps(v).select("id", *[dates.trim_to(F.col("ts"), F.lit(g)).alias(g[0]) for g in ("year", "month", "day")])


@query("SELECT s, o, a::VARCHAR AS ts, date_diff('day', a, b) AS days FROM intervals", INTERVALS)
def i10_distance(v: Views) -> DataFrame:
    return v.interval_facts.select("s", "o", "ts", dates.distance(F.to_date("ts"), F.to_date("ts_end")).cast("long").alias("days"))


@query("SELECT item_id, lower(replace(trim('  ' || text || chr(9), ' ' || chr(9) || chr(10)), '_', ' ')) AS n FROM benchmark")
def i11_normalize(v: Views) -> DataFrame:
    return v.table("benchmark").select("item_id", text.normalize(F.concat(F.lit("  "), "text", F.lit("\t"))).alias("n"))


@query("SELECT qid, array_to_string(CASE WHEN answer_type = 'time' THEN list_transform(answers, lambda a: CASE WHEN question LIKE '%month%' THEN a[1:7] WHEN question LIKE '%what year%' THEN a[1:4] ELSE a END) ELSE answers END, ',') AS a FROM questions", f"{FACTS}, {QUESTIONS}")
def i12_asked_grain(v: Views) -> DataFrame:
    return v.questions.select("qid", F.array_join(scores.at_asked_grain(F.col("answers"), F.col("question"), F.col("answer_type")), ",").alias("a"))


def _raw(v: Views) -> DataFrame:
    """Model outputs around each question's gold: a list after deliberation, a fence, no list, an empty list."""
    a, k = F.col("answers")[0], F.col("k") % 4
    raw = F.when(k == 0, F.concat(F.lit("<think>['X']</think>['"), a, F.lit("', 2014]"))).when(k == 1, F.concat(F.lit("```json\n['"), a, F.lit("']\n```"))).when(k == 2, F.lit("I do not know")).otherwise(F.lit("[]"))
    return v.questions.withColumn("response", raw)


@query("SELECT qid, CASE k % 4 WHEN 0 THEN answers[1] || ',2014' WHEN 1 THEN answers[1] WHEN 3 THEN '' END AS found FROM questions", f"{FACTS}, {QUESTIONS}")
def i13_answer_list(v: Views) -> DataFrame:
    """No list is NULL, an empty one isn't."""
    return _raw(v).select("qid", F.array_join(text.answer_list(F.col("response")), ",").alias("found"))


@query("SELECT qid, CASE k % 4 WHEN 1 THEN answers[1] WHEN 0 THEN 'X' ELSE '' END AS found FROM questions", f"{FACTS}, {QUESTIONS}")
def i14_mention_list(v: Views) -> DataFrame:
    return _raw(v).select("qid", F.array_join(text.mention_list(F.col("response")), ",").alias("found"))


@query("SELECT qid, k % 4 <> 2 AS parse_ok, len(CASE k % 4 WHEN 0 THEN [1, 2] WHEN 1 THEN [1] ELSE [] END) AS n FROM questions", f"{FACTS}, {QUESTIONS}")
def l10_parsed(v: Views) -> DataFrame:
    """Readable or not, and the flattened list (L10)."""
    return parsed(_raw(v)).select("qid", "parse_ok", F.size("pred").cast("long").alias("n"))


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'answer' WHEN 1 THEN '' ELSE text END AS t FROM benchmark")
def i15_strip_reasoning(v: Views) -> DataFrame:
    k, t = F.col("item_id") % 3, F.col("text")
    raw = F.when(k == 0, F.concat(F.lit("<think>"), t, F.lit("</think> answer"))).when(k == 1, F.concat(F.lit(" <think>"), t)).otherwise(t)
    return v.table("benchmark").select("item_id", text.strip_reasoning(raw).alias("t"))


@query("SELECT item_id, CASE item_id % 2 WHEN 0 THEN 'Ai đã đến?' ELSE 'b' END AS t FROM benchmark")
def i16_clean_translation(v: Views) -> DataFrame:
    raw = F.when(F.col("item_id") % 2 == 0, F.lit("note\n\nCâu hỏi dịch sang tiếng Việt là: Ai đã đến?")).otherwise(F.lit(" a\n b "))
    return v.table("benchmark").select("item_id", text.clean_translation(raw).alias("t"))


@query("SELECT item_id, item_id % 4 IN (0, 2) AS ok FROM benchmark")
def i17_question_mark(v: Views) -> DataFrame:
    source = F.when(F.col("item_id") % 2 == 0, "Who?").otherwise("Who? ")
    target = F.when(F.col("item_id") % 4 == 0, "Ai?").when(F.col("item_id") % 4 == 2, "Ai ? ").otherwise("Ai")
    return v.table("benchmark").select("item_id", text.keeps_question_mark(source, target).alias("ok"))


@query("SELECT item_id, (['Thăm', 'mot', 'Make a visit', 'ba'])[item_id % 4 + 1] AS line FROM benchmark")
def i18_numbered_line(v: Views) -> DataFrame:
    k = (F.col("item_id") % 4).cast("int")
    out = F.lit("1. Thăm\n\nmot\n")
    index = F.when(k == 0, 0).when(k == 1, 1).otherwise(7)
    found = F.when(k == 3, text.numbered_line(F.lit("2.ba"), F.lit(0), F.lit("x"))).otherwise(text.numbered_line(out, index, F.lit("Make_a_visit")))
    return v.table("benchmark").select("item_id", found.alias("line"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'Represent this sentence for searching relevant passages: ' || source ELSE source END AS q, CASE WHEN lang = 'en' THEN 'bge-base-en-v1.5' ELSE 'm--' || lang END AS tag FROM documents")
def i21_query_prefix(v: Views) -> DataFrame:
    """With the encoder's tag (I22)."""
    model = F.when(F.col("lang") == "en", "BAAI/bge-base-en-v1.5").otherwise(F.concat(F.lit("x/m +"), "lang"))
    return v.table("documents").select("doc_id", text.query_prefix(model, F.col("source")).alias("q"), text.slug(model).alias("tag"))


@query("""SELECT doc_id, sha256('{"extra_params":"","max_tokens":' || n_chars || ',"model":"' || lang || '","prompt":"' || source || '","temperature":0.0}') AS key FROM documents""")
def i23_cache_key(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", caches.response_key(F.col("lang"), F.col("source"), F.lit(0.0), F.col("n_chars"), F.lit("")).alias("key"))


@query(", cache AS (SELECT 'd' || doc_id AS key, text AS response, doc_id % 3 AS ts FROM documents WHERE doc_id % 2 = 0) SELECT 'd' || doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN length(text) ELSE -1 END AS n FROM documents", "x AS (SELECT 1)")
def a15_response_cache(v: Views) -> DataFrame:
    """Hits get the latest valid response, misses none."""
    docs = v.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "doc_id", "text")
    good = docs.where("doc_id % 2 = 0").select("key", F.col("text").alias("response"), F.lit(2.0).alias("ts"))
    old = good.select("key", F.lit("old").alias("response"), F.lit(1.0).alias("ts"))
    broken = good.select("key", F.lit(None).cast("string").alias("response"), F.lit(3.0).alias("ts"))
    return caches.lookup(docs.select("key"), good.unionAll(old).unionAll(broken)).select("key", F.coalesce(F.length("response"), F.lit(-1)).cast("long").alias("n"))


@query("SELECT qid, CASE WHEN k % 2 = 0 THEN 'Single' ELSE 'Multiple' END AS qlabel, CASE WHEN k % 2 = 0 THEN 'Simple' ELSE 'Complex' END AS qgroup, '' AS time_level, '' AS question_en, len(answers) AS n FROM questions", f"{FACTS}, {QUESTIONS}")
def a5_adapter_interval(v: Views) -> DataFrame:
    records = v.questions.select(F.col("qid").alias("uniq_id"), "question", "answers", "answer_type", F.when(F.col("k") % 2 == 0, "simple_time").otherwise("before_after").alias("type"))
    return questions.adapt(records, questions.INTERVAL).select("qid", "qlabel", "qgroup", "time_level", "question_en", F.size("answers").cast("long").alias("n"))


@query("SELECT qid, qtype, qlabel AS qgroup, time_level, question AS t FROM questions", f"{FACTS}, {QUESTIONS}")
def a5_adapter_point(v: Views) -> DataFrame:
    """With the choice of language (B4): no English text here, so the other one."""
    records = v.questions.withColumnRenamed("qid", "quid")
    return questions.adapt(records, questions.POINT).select("qid", "qtype", "qgroup", "time_level", questions.in_language("vi").alias("t"))


@query("SELECT qid, question FROM questions ORDER BY qid LIMIT 3", f"{FACTS}, {QUESTIONS}")
def a22_head(v: Views) -> DataFrame:
    """The smoke run's first questions: the number is the feature."""
    return questions.head(v.questions.select("qid", "question"), 3, "qid")


@query("SELECT doc_id, lower(text) LIKE '%first%' OR lower(text) LIKE '%earliest%' AS f, lower(text) LIKE '%last%' OR lower(text) LIKE '%latest%' AS l FROM documents")
def c12_superlatives(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", text.has_any(F.col("text"), text.FIRST_WORDS).alias("f"), text.has_any(F.col("text"), text.LAST_WORDS).alias("l"))


@query("SELECT item_id, 'Ai đã đến Iraq ' || item_id || '?' AS vi, 'Who?' AS en FROM benchmark WHERE item_id % 5 = 0")
def c10_translation_gate(v: Views) -> DataFrame:
    k = F.col("item_id") % 5
    vi = F.when(k == 0, F.concat(F.lit("Ai đã đến Iraq "), "item_id", F.lit("?"))).when(k == 1, "Who came?").when(k == 2, "Ai đã đến the Iraq?").when(k == 3, "tôi không thể?").otherwise("Ai đã đến")
    return corpus.gated(v.table("benchmark").select("item_id", vi.alias("vi"), F.lit("Who?").alias("en")))


@query("SELECT qid, 'docs_n' || k || '_seed42' AS sample_id FROM questions", f"{FACTS}, {QUESTIONS}")
def b11_sample_id(v: Views) -> DataFrame:
    return v.questions.select("qid", sampling.sample_id(F.lit("docs"), F.col("k"), F.lit(42)).alias("sample_id"))


@query(
    """, settings AS (
  SELECT qid, CASE WHEN k % 3 = 0 THEN 'interval' ELSE 'point' END AS dataset, CASE WHEN k % 2 = 0 THEN 'vi' ELSE 'en' END AS lang, k % 50 AS k1, k % 7 AS n1, (['', 'no_sg', 'no_kntn', 'no_ps'])[k % 4 + 1] AS ablation, qtype, time_level, k FROM questions)
SELECT qid, concat_ws('_', dataset, lang, qtype, k::VARCHAR, CASE WHEN k % 5 > 0 THEN 's' || k % 5 END, nullif(ablation, ''), CASE WHEN k1 NOT IN (0, 40) THEN 'k' || k1 END,
  CASE WHEN n1 <> 0 AND n1 <> CASE dataset WHEN 'point' THEN 2 ELSE 5 END THEN 'n' || n1 END, CASE WHEN k % 6 = 0 THEN 'strict' END, CASE WHEN time_level = 'day' THEN 'emb-day' END, CASE WHEN k % 8 = 0 THEN 'hosted' END, CASE WHEN k % 9 = 0 THEN 'nothink' END) AS run_id FROM settings""",
    f"{FACTS}, {QUESTIONS}",
)
def b10_run_id(v: Views) -> DataFrame:
    """A run's name for every row of a table of settings."""
    k, text = F.col("k"), lambda c: F.coalesce(c, F.lit(""))
    settings = v.questions.select(
        "qid", F.when(k % 3 == 0, "interval").otherwise("point").alias("dataset"), F.when(k % 2 == 0, "vi").otherwise("en").alias("lang"), F.concat(F.lit("maker/"), "qtype").alias("model"), k.alias("n"),
        text(F.when(k % 5 > 0, F.concat(F.lit("s"), (k % 5).cast("string")))).alias("sample_id"), F.element_at(F.array(*map(F.lit, ABLATIONS)), (k % 4 + 1).cast("int")).alias("ablation"), (k % 50).cast("int").alias("k"), (k % 7).cast("int").alias("n_implicit"),
        F.when(k % 6 == 0, "strict").alias("style"), F.when(F.col("time_level") == "day", "maker/day").alias("encoder"), (k % 8 == 0).alias("self_hosted"), (k % 9 > 0).alias("thinking"),
    )
    return settings.select("qid", RunSpec.run_ids(settings).alias("run_id"))


@query("SELECT doc_id % 4 AS attempt, CASE doc_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.45 WHEN 2 THEN 0.6 ELSE 0.75 END::DOUBLE AS t, count(*) AS n FROM documents GROUP BY 1, 2")
def i28_retry_temperature(v: Views) -> DataFrame:
    return v.table("documents").select((F.col("doc_id") % 4).alias("attempt")).withColumn("t", corpus.retry_temperature(F.col("attempt"))).groupBy("attempt", "t").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT '[' || string_agg(p, ', ' ORDER BY p) || ']' AS list FROM (SELECT DISTINCT p FROM facts)", FACTS)
def b7_relation_list(v: Views) -> DataFrame:
    """The sorted list that the relation prompt holds."""
    return prompts.sorted_list(v.facts, "p")


_PROMPT = prompts.template("strict", "en").replace("'", "''")
_FILLED = "'" + _PROMPT.replace("{question}", "' || question || '").replace("{answer_type}", "' || answer_type || '").replace("{topk}", "' || CASE qlabel WHEN 'Multiple' THEN '5' ELSE '1' END || '").replace("{entities}", "' || entities || '").replace("{facts}", "' || coalesce(facts, '') || '") + "'"


@query(
    f""", said AS (SELECT qid, string_agg('[' || s || ', ' || p || ', ' || o || ', ' || ts || ']', chr(10) ORDER BY rank) AS facts FROM chain GROUP BY qid),
named AS (SELECT *, CASE WHEN main < aux THEN main || ', ' || aux WHEN main = aux THEN main ELSE aux || ', ' || main END AS entities FROM questions)
SELECT qid, {_FILLED} AS prompt FROM named LEFT JOIN said USING (qid)""",
    FULL,
)
def b8_reasoning_prompt(v: Views) -> DataFrame:
    """Each question's whole prompt."""
    names = v.questions.select("qid", F.explode(F.array("main", "aux")).alias("entity"))
    return prompts.reasoning(v.questions, v.chain, names, "strict", "en")


@query("SELECT qid, 'Which one of these relations does the question ask about? Answer with its name only.' || chr(10) || 'Relations: [x]' || chr(10) || 'Entities: ' || main || chr(10) || 'Question: ' || question AS prompt FROM questions", f"{FACTS}, {QUESTIONS}")
def b7_relation_prompt(v: Views) -> DataFrame:
    """The extraction prompt for relations."""
    return v.questions.select("qid", prompts.extraction("relation", "en", {"relations": F.lit("[x]"), "entities": F.col("main"), "question": F.col("question")}).alias("prompt"))
