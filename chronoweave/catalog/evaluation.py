"""Queries of scores, aggregates, samples and journals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.catalog.registry import query
from chronoweave.catalog.views import ANCHORS, CHAIN, EXPLICIT, FACTS, FULL, GRAPH, JOURNAL, QUESTIONS, ROWS, VECTORS, Views
from chronoweave.functions import dates, scores
from chronoweave.operators import corpus, metrics, sampling
from chronoweave.plans.answer import TemporalQA, Trace
from chronoweave.plans.prompts import evidence, grounded_text
from chronoweave.plans.reason import by_rules
from chronoweave.plans.spec import RunSpec
from chronoweave.sources import journal, questions as q_source

#: Predictions made from the gold: right, wrong, finer, empty by k.
_PRED = """preds AS (SELECT *, CASE k % 4 WHEN 0 THEN [' ' || upper(answers[1]) || ' '] WHEN 1 THEN ['Nobody', answers[1]] WHEN 2 THEN [answers[1] || '-01'] ELSE [] END AS pred FROM questions),
hits AS (SELECT qid, k, answer_type, qlabel, qtype, question, answers, pred, len(pred) > 0 AND list_contains(list_transform(answers, lambda g: lower(replace(trim(g), '_', ' '))), lower(replace(trim(pred[1]), '_', ' '))) AS hit FROM preds)"""


def _preds(v: Views) -> DataFrame:
    a = F.col("answers")[0]
    pred = F.when(F.col("k") % 4 == 0, F.array(F.concat(F.lit(" "), F.upper(a), F.lit(" ")))).when(F.col("k") % 4 == 1, F.array(F.lit("Nobody"), a)).when(F.col("k") % 4 == 2, F.array(F.concat(a, F.lit("-01")))).otherwise(F.array().cast("array<string>"))
    return v.questions.withColumn("pred", pred)


@query("SELECT qid, hit FROM hits", f"{FACTS}, {QUESTIONS}, {_PRED}")
def e3_hits_at_1(v: Views) -> DataFrame:
    return _preds(v).select("qid", scores.hit(F.col("pred"), F.col("answers")).alias("hit"))


@query(
    """SELECT qid, CASE WHEN answer_type = 'time' THEN len(pred) > 0 AND len(list_filter(answers, lambda g: array_to_string(string_split(pred[1], '-')[1:len(string_split(g, '-'))], '-') = g)) > 0 ELSE hit END AS hit_gran FROM hits""",
    f"{FACTS}, {QUESTIONS}, {_PRED}",
)
def e4_hits_granular(v: Views) -> DataFrame:
    return _preds(v).select("qid", scores.hit_granular(F.col("pred"), F.col("answers"), F.col("answer_type")).alias("hit_gran"))


@query("SELECT qid, len(list_filter(pred, lambda p: list_contains(list_transform(answers, lambda g: lower(replace(trim(g), '_', ' '))), lower(replace(trim(p), '_', ' '))))) > 0 AS hit FROM hits", f"{FACTS}, {QUESTIONS}, {_PRED}")
def e24_any_hit(v: Views) -> DataFrame:
    return _preds(v).select("qid", scores.any_hit(F.col("pred"), F.col("answers")).alias("hit"))


@query("SELECT qid, len(pred) = 0 AND k % 3 = 0 AND k % 5 > 0 AS abstained FROM hits", f"{FACTS}, {QUESTIONS}, {_PRED}")
def e10_abstained(v: Views) -> DataFrame:
    ok = F.when(F.col("k") % 3 == 0, True).when(F.col("k") % 3 == 1, False)
    return _preds(v).select("qid", scores.abstained(F.col("k") % 5, ok, F.col("pred")).alias("abstained"))


@query(
    """SELECT qid, answer_type = 'time' AND ((regexp_matches(question, 'what year') AND list_min(list_transform(answers, lambda g: len(string_split(g, '-')))) > 1) OR (regexp_matches(question, 'What month') AND list_min(list_transform(answers, lambda g: len(string_split(g, '-')))) > 2)) AS mismatch FROM questions""",
    f"{FACTS}, {QUESTIONS}",
)
def e11_granularity_mismatch(v: Views) -> DataFrame:
    return v.questions.select("qid", scores.granularity_mismatch(F.col("question"), F.col("answers"), F.col("answer_type")).alias("mismatch"))


@query("SELECT qid, CASE WHEN regexp_matches(question, 'What month') THEN 'month' WHEN regexp_matches(question, 'what year') THEN 'year' END AS asked FROM questions", f"{FACTS}, {QUESTIONS}")
def i5_asked_granularity(v: Views) -> DataFrame:
    return v.questions.select("qid", dates.asked_granularity(F.col("question")).alias("asked"))


@query("SELECT qid, NOT hit AND hit_b AS lost FROM rows", ROWS)
def e12_reasoning_loss(v: Views) -> DataFrame:
    return v.rows.select("qid", scores.reasoning_loss(F.col("hit"), F.col("hit_b")).alias("lost"))


@query("SELECT qid, CASE k % 3 WHEN 2 THEN FALSE ELSE k % 3 = 1 END AS expanded FROM questions", f"{FACTS}, {QUESTIONS}")
def e13_relation_expanded(v: Views) -> DataFrame:
    ids = F.when(F.col("k") % 3 == 0, F.array("relation")).when(F.col("k") % 3 == 1, F.array("relation", "aux"))
    return v.questions.select("qid", scores.relation_expanded(ids).alias("expanded"))


_RECALL = """named AS (SELECT DISTINCT qid, lower(replace(trim(unnest(answers)), '_', ' ')) AS g FROM questions WHERE answer_type <> 'time'), timed AS (SELECT DISTINCT qid, unnest(answers) AS g FROM questions WHERE answer_type = 'time'),
in_sg AS (SELECT qid FROM fq JOIN named USING (qid) WHERE g IN (lower(replace(trim(s), '_', ' ')), lower(replace(trim(o), '_', ' '))) UNION SELECT qid FROM fq JOIN timed USING (qid) WHERE array_to_string(string_split(ts, '-')[1:len(string_split(g, '-'))], '-') = g),
in_chain AS (SELECT qid FROM chain JOIN named USING (qid) WHERE g IN (lower(replace(trim(s), '_', ' ')), lower(replace(trim(o), '_', ' '))) UNION SELECT qid FROM chain JOIN timed USING (qid) WHERE array_to_string(string_split(ts, '-')[1:len(string_split(g, '-'))], '-') = g),
on_anchor AS (SELECT DISTINCT qid FROM chain JOIN anchors USING (qid) WHERE d = anchor)"""


@query("SELECT qid, TRUE AS recalled FROM in_sg", f"{FULL}, {_RECALL}")
def d7_answer_recall(v: Views) -> DataFrame:
    """Questions whose facts have a gold answer (H4: gold answers among the facts' ends)."""
    return v.shared.recalled(v.questions.select("qid", "answer_type", "answers"))


@query("SELECT qid, TRUE AS recalled FROM on_anchor", f"{FULL}, {_RECALL}")
def d8_anchor_recall(v: Views) -> DataFrame:
    return metrics.anchor_recall(v.chain, v.anchors)


@query("SELECT qid, qid IN (SELECT qid FROM in_chain) AND qid IN (SELECT qid FROM on_anchor) AS recalled FROM questions", f"{FULL}, {_RECALL}")
def e14_chain_recall(v: Views) -> DataFrame:
    both = metrics.answer_recall(v.chain, v.questions.select("qid", "answer_type", "answers")).select("qid").join(metrics.anchor_recall(v.chain, v.anchors), "qid")
    return v.questions.select("qid").join(both, "qid", "left").select("qid", F.coalesce("recalled", F.lit(False)).alias("recalled"))


@query(
    """, free AS (SELECT qid, main, aux FROM questions WHERE qid NOT IN (SELECT qid FROM explicit)), mine AS (SELECT qid, aux, s, o, ts FROM free JOIN ends ON e = main WHERE main <> aux)
SELECT qid, anchor::VARCHAR AS anchor FROM explicit UNION SELECT qid, ts::DATE::VARCHAR FROM mine WHERE aux IN (s, o)""",
    FULL,
)
def d9_gold_anchors(v: Views) -> DataFrame:
    grounded = v.questions.select("qid", F.explode(F.array("main", "aux")).alias("entity"))
    return metrics.gold_anchors(v.facts, v.questions.select("qid", "main"), v.explicit, grounded).select("qid", F.col("anchor").cast("string").alias("anchor"))


@query("SELECT count(*) AS n_paired, count_if(a.hit AND NOT b.hit_b) AS only_a, count_if(NOT a.hit AND b.hit_b) AS only_b, count_if(a.hit = b.hit_b) AS agree FROM rows a JOIN rows b USING (qid)", ROWS)
def e15_discordant_pairs(v: Views) -> DataFrame:
    """With the paired join (D10); b holds each question twice, the last row counts."""
    b = v.rows.select("qid", F.col("hit_b").alias("hit"), "seq")
    twice = b.unionAll(b.select("qid", (~F.col("hit")).alias("hit"), (F.col("seq") - 1000000).alias("seq")))
    return metrics.discordant(v.rows, twice)


@query("SELECT count(*) AS n, round(avg(hit::INT), 9) AS rate, round(avg(hit_b::INT) FILTER (hit), 9) AS rate_where, count_if(hit) AS eligible FROM rows", ROWS)
def e5_rates(v: Views) -> DataFrame:
    """Rates over all rows (E5, E6) and over eligible ones (E7)."""
    hit, b = F.col("hit"), F.col("hit_b")
    return v.rows.agg(F.count(F.lit(1)).alias("n"), F.round(metrics.rate(hit), 9).alias("rate"), F.round(metrics.rate_where(b, hit), 9).alias("rate_where"), F.count_if(hit).alias("eligible"))


@query("SELECT CASE WHEN lang = 'es' THEN 'unknown' ELSE lang END AS bucket, count_if(hit) AS hits, count(*) AS total FROM rows GROUP BY 1", ROWS)
def e8_breakdown(v: Views) -> DataFrame:
    return metrics.breakdown(v.rows.withColumn("lang", F.when(F.col("lang") == "es", "").otherwise(F.col("lang"))), "lang")


@query("SELECT count_if(hit) AS hits, count(*) AS total, round(count_if(hit) * 100.0 / count(*), 6) AS percent, round(avg(latency), 6) AS mean_latency FROM rows", ROWS)
def e22_flat_summary(v: Views) -> DataFrame:
    return metrics.flat_summary(v.rows)


@query(
    """, drawn AS (SELECT *, seq % 4 AS size_sg, seq % 5 AS size_chain, seq % 2 = 0 AS derivable, seq % 7 < 3 AS r_anchor, seq % 11 < 4 AS r_chain, seq % 13 < 6 AS r_sg, hit_b AS in_chain, seq % 3 = 0 AS parsed, seq % 3 = 1 AS unparsed, seq % 17 < 5 AS finer, seq % 19 < 8 AS two, seq % 23 < 9 AS said, seq % 29 = 0 AS failed, seq % 6 < 2 AS is_time FROM rows)
SELECT count(*) AS n_scored, round(avg(hit::INT), 9) AS hits_at_1, round(avg(finer::INT), 9) AS hits_at_1_granular, round(avg(r_sg::INT), 9) AS answer_recall_sg, round(avg(in_chain::INT), 9) AS answer_recall_chain,
  round(avg(r_anchor::INT) FILTER (derivable), 9) AS anchor_recall, round(avg(r_chain::INT) FILTER (derivable), 9) AS chain_recall, round(avg(derivable::INT), 9) AS anchor_derivable_rate, round(avg((size_sg = 0)::INT), 9) AS empty_subgraph_rate,
  round(avg(unparsed::INT), 9) AS parse_fail_rate, round(avg((size_chain > 0 AND parsed AND NOT said)::INT), 9) AS abstain_rate, round(avg((NOT hit AND in_chain)::INT), 9) AS reasoning_loss_rate, round(avg(two::INT), 9) AS relation_expanded_rate,
  round(avg((is_time AND seq % 31 < 12)::INT), 9) AS granularity_mismatch_rate, round(avg(failed::INT), 9) AS error_rate FROM drawn""",
    ROWS,
)
def e9_run_summary(v: Views) -> DataFrame:
    """Every measure of a run in one pass, each driven by a share of its own."""
    n, none = F.col("seq"), F.array().cast("array<string>")
    share = lambda m, below: n % m < below
    pick = lambda yes, *names: F.when(yes, F.array(*map(F.lit, names)))
    meta = F.struct(
        (n % 4).alias("subgraph_size"), (n % 5).alias("chain_size"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("parse_ok"), pick(share(19, 8), "a", "b").otherwise(F.array(F.lit("a"))).alias("relation_ids"), (n % 2 == 0).alias("anchor_derivable"),
        share(7, 3).alias("anchor_recall"), share(11, 4).alias("chain_recall"), share(13, 6).alias("answer_recall_sg"), F.col("hit_b").alias("answer_recall_chain"), F.when(n % 29 == 0, "timed out").alias("error"),
    )
    asks, gold = F.when(share(31, 12), "In what year?").otherwise("When?"), F.array(F.lit("2005-01-02"))
    rows = v.rows.select("qid", "hit", share(17, 5).alias("hit_gran"), asks.alias("question"), gold.alias("gold"), pick(share(23, 9), "x").otherwise(none).alias("pred"), F.when(share(6, 2), "time").otherwise("entity").alias("answer_type"), meta.alias("meta"))
    found = metrics.summarize(rows)
    return found.select("n_scored", *[F.round(c, 9).alias(c) for c in found.columns if c != "n_scored"])


@query("SELECT qtype || '|' || answer_type || '|' || time_level AS stratum, count(*) AS n FROM questions GROUP BY 1", f"{FACTS}, {QUESTIONS}")
def e16_strata_counts(v: Views) -> DataFrame:
    return sampling.strata_counts(v.questions)


_ORDER = """placed AS (SELECT *, (row_number() OVER (PARTITION BY qtype, answer_type, time_level ORDER BY sha256('42:' || qid), qid) - 0.5) / count(*) OVER (PARTITION BY qtype, answer_type, time_level) AS place FROM questions)"""


@query("SELECT qid, qtype || '|' || answer_type || '|' || time_level AS stratum, round(place::DOUBLE, 9) AS place FROM placed", f"{FACTS}, {QUESTIONS}, {_ORDER}")
def f1_stratified_order(v: Views) -> DataFrame:
    return sampling.nested_order(v.questions, 42).select("qid", "stratum", F.round(F.col("place").cast("double"), 9).alias("place"))


@query("SELECT row_number() OVER (ORDER BY place, qtype, answer_type, time_level) - 1 AS pos, qid FROM placed QUALIFY pos < 50", f"{FACTS}, {QUESTIONS}, {_ORDER}")
def g8_prefix_sample(v: Views) -> DataFrame:
    """A top-n report: the sample's size is the feature."""
    return sampling.sample(v.questions, 50, 42).select("pos", "qid")


@query("SELECT qid FROM questions ORDER BY sha256('7:' || qid), qid LIMIT 25", f"{FACTS}, {QUESTIONS}")
def g9_simple_sample(v: Views) -> DataFrame:
    return sampling.simple_sample(v.questions, "qid", 25, 7).select("qid")


@query("SELECT qid, sha256('42:' || qid) AS rank_hash FROM questions", f"{FACTS}, {QUESTIONS}")
def i24_rank_hash(v: Views) -> DataFrame:
    return v.questions.select("qid", sampling.rank_hash(42, F.col("qid")).alias("rank_hash"))


@query(", manifest AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS pos FROM questions) SELECT pos, qid, question FROM manifest JOIN questions USING (qid)", f"{FACTS}, {QUESTIONS}")
def d11_ordered_selection(v: Views) -> DataFrame:
    """Ids in an order of their own, one of which no question has."""
    named = sampling.numbered(v.questions.select("qid"), "qid").unionByName(v.spark.createDataFrame([("gone", -1)], "qid string, pos long"))
    return q_source.select_in_order(v.questions, named).select("pos", "qid", "question")


@query("SELECT DISTINCT ON (qid) qid, source, seq FROM journal ORDER BY qid, seq DESC", JOURNAL)
def f3_latest_row(v: Views) -> DataFrame:
    return journal.latest(v.journal.select("qid", "seq", "source")).select("qid", "source", "seq")


@query("SELECT qid, seq FROM journal WHERE qid <> '' AND error = ''", JOURNAL)
def c9_answered(v: Views) -> DataFrame:
    return journal.answered(v.journal, "error").select("qid", "seq")


@query("SELECT DISTINCT qid FROM journal WHERE qid NOT IN (SELECT qid FROM journal WHERE error = '' AND seq >= 4)", JOURNAL)
def d14_pending(v: Views) -> DataFrame:
    """Also enqueueing (J1) and the replay of errors (J5)."""
    done = journal.answered(v.journal, "error").where("seq >= 4")
    return journal.pending(v.journal.select("qid").distinct(), done)


@query(
    """, both_sides AS (SELECT qid, seq, source, error, 1 AS f FROM journal WHERE source = 'assistant' UNION ALL SELECT qid, seq + 100, source, error, 0 FROM journal WHERE source <> 'assistant')
SELECT DISTINCT ON (qid) qid, seq, source FROM both_sides ORDER BY qid, f DESC, seq DESC""",
    JOURNAL,
)
def d15_journal_merge(v: Views) -> DataFrame:
    mine, other = v.journal.where("source = 'assistant'"), v.journal.where("source <> 'assistant'").withColumn("seq", F.col("seq") + 100)
    return journal.merge(mine, other).select("qid", "seq", "source")


@query("SELECT count(DISTINCT qid) FILTER (seq >= 4 AND error = '') AS done, (SELECT count(DISTINCT qid) FROM journal WHERE qid NOT IN (SELECT qid FROM journal WHERE seq >= 4 AND error = '')) AS queued, 0::BIGINT AS inflight FROM journal", JOURNAL)
def e20_store_counts(v: Views) -> DataFrame:
    return journal.counts(v.journal.select("qid").distinct(), journal.answered(v.journal, "error").where("seq >= 4"))


@query("SELECT seq, sum(hit::INT) OVER w::BIGINT AS hits, count(*) OVER w AS n, round((sum(hit::INT) OVER w) / (count(*) OVER w), 9) AS accuracy FROM rows WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)".replace("OVER w::BIGINT", "OVER w"), ROWS)
def f4_running_accuracy(v: Views) -> DataFrame:
    return journal.running_accuracy(v.rows).select("seq", "hits", "n", F.round("accuracy", 9).alias("accuracy"))


@query("SELECT seq, round(latency / (count(*) OVER w) * ((SELECT count(*) FROM rows) - (count(*) OVER w)), 6) AS eta FROM rows WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)", ROWS)
def f5_progress(v: Views) -> DataFrame:
    return journal.progress(v.rows, v.rows.count(), elapsed="latency").select("seq", F.round("eta", 6).alias("eta"))


@query(", calls AS (SELECT CASE lang WHEN 'en' THEN 'small' WHEN 'fr' THEN 'large' ELSE 'other' END AS model, n_chars AS p, n_chars % 100 AS c, CASE WHEN doc_id % 7 = 0 THEN 0.5 END AS cost FROM documents) SELECT model, round(sum(coalesce(cost, p * CASE model WHEN 'small' THEN 0.00000005 WHEN 'large' THEN 0.0000001 ELSE 0.000003 END + c * CASE model WHEN 'small' THEN 0.00000008 WHEN 'large' THEN 0.00000032 ELSE 0.00001 END)), 6)::DOUBLE AS usd, count(*) AS calls FROM calls GROUP BY model", "x AS (SELECT 1)")
def e21_spend(v: Views) -> DataFrame:
    """With the cost formula (I25)."""
    model = F.when(F.col("lang") == "en", "small").when(F.col("lang") == "fr", "large").otherwise("other")
    calls = v.table("documents").select(model.alias("model"), F.col("n_chars").alias("prompt_tokens"), (F.col("n_chars") % 100).alias("completion_tokens"), F.when(F.col("doc_id") % 7 == 0, 0.5).alias("cost"))
    prices = v.spark.createDataFrame([("small", 5e-8, 8e-8), ("large", 1e-7, 3.2e-7)], "model string, pp double, pc double")
    return metrics.spend(calls, prices, (3e-6, 1e-5))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 3.0 ELSE greatest(0.0, least(3.0, n_chars / 1000.0 + greatest(0.0, doc_id / 100.0 - 0.1))) END::DOUBLE AS cap FROM documents")
def i26_effective_cap(v: Views) -> DataFrame:
    headroom = F.when(F.col("doc_id") % 5 == 0, float("inf")).otherwise(F.col("doc_id") / 100.0)
    return v.table("documents").select("doc_id", metrics.effective_cap(F.lit(3.0), F.col("n_chars") / 1000.0, headroom).alias("cap"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN n_chars ELSE n_chars * 4 END AS calls FROM documents")
def i27_estimated_calls(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", metrics.estimated_calls(F.col("n_chars"), F.when(F.col("lang") == "en", "no_sg").otherwise("")).alias("calls"))


@query("SELECT qid FROM rows WHERE qid NOT IN (SELECT qid FROM rows WHERE hit)", ROWS)
def c7_not_yet(v: Views) -> DataFrame:
    """Questions that aren't translated yet (also H6, C8's kind of filter)."""
    return corpus.not_yet(v.rows.select("qid"), v.rows.where("hit"), "qid")


@query(", news AS (SELECT qid, 'new' AS text FROM rows WHERE hit), olds AS (SELECT qid, lang AS text FROM rows) SELECT qid, text FROM news UNION ALL SELECT qid, text FROM olds WHERE qid NOT IN (SELECT qid FROM news)", ROWS)
def h7_upsert(v: Views) -> DataFrame:
    return corpus.upsert(v.rows.select("qid", F.col("lang").alias("text")), v.rows.where("hit").select("qid", F.lit("new").alias("text")), "qid")


@query("SELECT qid, string_agg('[' || s || ', ' || p || ', ' || o || ', ' || ts || ']', chr(10) ORDER BY rank) AS facts FROM chain GROUP BY qid", FULL)
def b6_evidence(v: Views) -> DataFrame:
    return evidence(v.chain)


@query("SELECT qid, CASE WHEN main < aux THEN main || ', ' || aux WHEN main = aux THEN main ELSE aux || ', ' || main END AS entities FROM questions", f"{FACTS}, {QUESTIONS}")
def b6_grounded_text(v: Views) -> DataFrame:
    return grounded_text(v.questions.select("qid", F.explode(F.array("main", "aux")).alias("entity")))


_RULES = """bounds AS (SELECT qid, min(anchor) AS low, max(anchor) AS high FROM anchors GROUP BY qid),
inside AS (SELECT chain.qid, qlabel, CASE WHEN answer_type = 'time' THEN ts WHEN s = main THEN o ELSE s END AS value, CASE WHEN question LIKE '%last%' THEN -date_diff('day', DATE '1970-01-01', d) ELSE date_diff('day', DATE '1970-01-01', d) END AS place, rank
  FROM chain JOIN questions USING (qid) LEFT JOIN bounds USING (qid) WHERE (NOT regexp_matches(question, '\\bafter\\b') OR low IS NULL OR d > low) AND (answer_type = 'time' OR CASE WHEN s = main THEN o ELSE s END <> main)),
firsts AS (SELECT qid, value, min({'place': place, 'rank': rank}) AS at_place, any_value(qlabel) AS qlabel FROM inside GROUP BY qid, value),
lists AS (SELECT qid, list(value ORDER BY at_place, value) AS values_all, any_value(qlabel) AS qlabel FROM firsts GROUP BY qid),
answered AS (SELECT questions.qid, coalesce(values_all[1:CASE WHEN lists.qlabel = 'Multiple' THEN 5 ELSE 1 END], []) AS pred FROM questions LEFT JOIN lists USING (qid))"""


@query("SELECT qid, array_to_string(pred, ',') AS pred FROM answered", f"{FULL}, {_RULES}")
def k1_rule_reasoner(v: Views) -> DataFrame:
    """Stage 3 as a plan: window, order, other end, the first few (G11)."""
    return by_rules(v.questions, v.chain, v.anchors).select("qid", F.array_join("pred", ",").alias("pred"))


_IMPLICIT = "implicit AS (SELECT DISTINCT qid, d AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, pos) AS r FROM scored) WHERE r <= 2)"
_BOTH = "anchors AS (SELECT qid, anchor FROM explicit UNION SELECT qid, anchor FROM implicit)"
_ALL = ANCHORS.replace("SELECT qid, anchor FROM explicit UNION", "SELECT qid, anchor FROM explicit UNION SELECT qid, anchor FROM implicit UNION")
_START = f"{GRAPH}, {VECTORS}, {EXPLICIT}, {_IMPLICIT}"
_NEAREST = CHAIN.replace("r <= 5", "r <= 40")
_WIDER = "ks AS (SELECT qid, CASE WHEN count(*) > 1000 THEN 80 ELSE 40 END AS kk FROM fq GROUP BY qid), " + CHAIN.replace("kept AS (", "near0 AS (", 1).replace("WHERE r <= 5", "JOIN ks USING (qid) WHERE r <= kk").replace(
    "), near AS (", "), kept AS (SELECT * FROM near0 UNION SELECT fq.qid, s, p, o, ts, d, pos FROM fq JOIN questions USING (qid) WHERE main <> aux AND s IN (main, aux) AND o IN (main, aux)), near AS (", 1)
_SIMILAR = """counted AS (SELECT qid, count(*) AS n FROM anchors GROUP BY qid),
top AS (SELECT scored.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY scored.qid ORDER BY sim DESC, pos) AS r FROM scored LEFT JOIN counted USING (qid)),
near AS (SELECT top.qid, s, p, o, ts, d, pos, any_value(r) AS r, min(abs(date_diff('day', anchor, d))) AS dist FROM top LEFT JOIN anchors USING (qid) WHERE r <= 40 * greatest(1, n) GROUP BY ALL),
chain AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coalesce(dist, 0), CASE WHEN dist IS NULL THEN r ELSE pos END, pos) AS rank FROM near)"""
_SHUFFLED = _NEAREST[: _NEAREST.index("), near AS (")] + """), chain AS (
  SELECT kept.*, row_number() OVER (PARTITION BY qid ORDER BY sha256('42:' || question || ':' || s || ':' || p || ':' || o || ':' || ts), pos) AS rank FROM kept JOIN questions USING (qid))"""  # fmt: skip
_GLOBAL = r"""said AS (SELECT *, '[' || s || ', ' || p || ', ' || o || ', ' || ts || ']' AS fid, regexp_extract_all(lower(replace(s || ' ' || p || ' ' || o, '_', ' ') || ' (' || ts || ')'), '([\p{L}\p{N}_]+)', 1) AS terms FROM (SELECT DISTINCT * FROM facts)),
posted AS (SELECT fid, any_value(len) AS len, term, count(*) AS tf FROM (SELECT fid, len(terms) AS len, unnest(terms) AS term FROM said) GROUP BY fid, term),
idfs AS (SELECT term, ln(1 + ((SELECT count(*) FROM said) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posted GROUP BY term),
terms AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(question), '([\p{L}\p{N}_]+)', 1)) AS term FROM questions),
lexical AS (SELECT qid, fid, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len(terms)) FROM said)))), 6) AS score FROM terms JOIN posted USING (term) JOIN idfs USING (term) GROUP BY qid, fid),
short AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fid) AS place FROM lexical QUALIFY place <= 200),
fq AS (SELECT qid, s, p, o, ts, ts::DATE AS d, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, place) - 1 AS pos
  FROM short JOIN said USING (fid) JOIN questions USING (qid) JOIN embeddings a ON a.vec_id = k % 500 JOIN embeddings b ON b.vec_id = (length(s) * 31 + length(o) * 7 + length(p) * 3 + length(ts)) % 500 QUALIFY pos < 100)"""


def _answers(v: Views, trace: Trace | None = None, **settings) -> DataFrame:
    qs = v.questions.withColumn("aux", F.array("aux")).withColumn("relations", F.array("relation"))
    scored = lambda fq, questions, kind: v.similar(fq)
    scored.number = v.likeness.number
    plan = TemporalQA(v.facts, RunSpec(**settings), explicit=lambda questions: v.explicit, scored=scored, vectors=lambda questions, facts: v.vectors(facts), trace=trace)
    out = plan.answer(qs)
    return out.select("qid", F.array_join("pred", ",").alias("pred"), "subgraph_size", "chain_size", "answer_recall_sg", "answer_recall_chain", "anchor_recall")


_RESULT = """SELECT questions.qid, array_to_string(pred, ',') AS pred, coalesce((SELECT count(*) FROM fq WHERE fq.qid = questions.qid), 0) AS subgraph_size, coalesce((SELECT count(*) FROM chain WHERE chain.qid = questions.qid), 0) AS chain_size,
  questions.qid IN (SELECT qid FROM in_sg) AS answer_recall_sg, questions.qid IN (SELECT qid FROM in_chain) AS answer_recall_chain, questions.qid IN (SELECT qid FROM on_anchor) AS anchor_recall FROM questions JOIN answered USING (qid)"""


@query(_RESULT, f"{_START}, {_BOTH}, {_NEAREST}, {_RECALL}, {_RULES}")
def answer_pipeline(v: Views) -> DataFrame:
    """All three stages over all questions (flagship)."""
    return _answers(v)


@query("SELECT 'point_en_rules_0' AS run_id, (SELECT count(*) FROM questions) AS questions, (SELECT count(*) FROM fq) AS facts, (SELECT count(*) FROM anchors) AS anchors, (SELECT count(*) FROM chain) AS chain, 0 AS undated", f"{_START}, {_BOTH}, {_NEAREST}")
def k8_trace(v: Views) -> DataFrame:
    """What the stages of the flagship run have made, observed while they were written."""
    trace = Trace()
    _answers(v, trace)
    row = trace.row(v.spark, RunSpec().run_id)
    return row.select("run_id", *[F.col(f"{stage}.rows").alias(stage) for stage in ("questions", "facts", "anchors", "chain")], (F.col("facts.undated") + F.col("anchors.undated") + F.col("chain.undated")).cast("int").alias("undated"))


@query(_RESULT, f"{_START}, {_ALL}, {_WIDER}, {_RECALL}, {_RULES}")
def answer_pipeline_vi(v: Views) -> DataFrame:
    """With what Vietnamese adds: dates of superlatives, more neighbours, facts between grounded entities (G12, E2, H3)."""
    return _answers(v, lang="vi")


@query(_RESULT, f"{_START}, {_BOTH}, {_SIMILAR}, {_RECALL}, {_RULES}")
def k4_no_kntn(v: Views) -> DataFrame:
    """The run without nearest facts."""
    return _answers(v, ablation="no_kntn")


@query(_RESULT, f"{_START}, {_BOTH}, {_SHUFFLED}, {_RECALL}, {_RULES}")
def k4_no_ps(v: Views) -> DataFrame:
    """The run without proximity order."""
    return _answers(v, ablation="no_ps")


_SUBJECTS = _RULES.replace("WHEN s = main THEN o ELSE s END AS value", "ELSE s END AS value").replace("AND (answer_type = 'time' OR CASE WHEN s = main THEN o ELSE s END <> main)", "")


@query(_RESULT, f"{FACTS}, {QUESTIONS}, {_GLOBAL}, {VECTORS}, {EXPLICIT}, {_IMPLICIT}, {_BOTH}, {_NEAREST}, {_RECALL}, {_SUBJECTS}")
def k3_no_sg(v: Views) -> DataFrame:
    """The run without a subgraph: facts by the words and vectors of the question."""
    return _answers(v, ablation="no_sg")
