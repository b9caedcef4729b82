"""Queries of scans, lookups, retrieval and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.catalog.registry import query
from chronoweave.catalog.views import ANCHORS, CHAIN, ENDPOINTS, EXPLICIT, FACTS, FULL, GRAPH, INTERVALS, QUESTIONS, VECTORS, Views
from chronoweave.functions import dates, text, vectors
from chronoweave.operators import chain, corpus, dense, grounding, retrieval, subgraph
from chronoweave.sources import graph, inverted
from chronoweave.sources.adjacency import Adjacency
from chronoweave.sources.tables import place


@query(
    """, lines AS (
  SELECT CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN user_id || chr(9) || event_type || chr(9) || props || chr(9) ELSE user_id || chr(9) || event_type || chr(9) || props || chr(9) || '2024 ' END AS l
  FROM events), cut AS (SELECT string_split(trim(l, ' ' || chr(9)), chr(9)) AS f FROM lines WHERE l <> '')
SELECT f[1] AS s, f[2] AS p, f[3] AS o, f[4] AS ts FROM cut WHERE len(f) = 4""",
    "x AS (SELECT 1)",
)
def a1_scan_kg(v: Views) -> DataFrame:
    """Tab-separated lines, some blank, some with an empty last field."""
    tab = F.lit("\t")
    three = F.concat(F.col("user_id").cast("string"), tab, "event_type", tab, "props", tab)
    lines = v.table("events").select(F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, three).otherwise(F.concat(three, F.lit("2024 "))).alias("value"))
    return graph.parse_lines(lines)


@query("SELECT e, count(*) AS n FROM ends GROUP BY e", f"{FACTS}, {ENDPOINTS}")
def a2_adjacency(v: Views) -> DataFrame:
    return graph.endpoints(v.facts).groupBy("e").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e, count(*) AS n FROM ends GROUP BY e", f"{FACTS}, {ENDPOINTS}")
def a2_stored_adjacency(v: Views) -> DataFrame:
    return Adjacency.write(v.facts).ends().groupBy("e").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT qid, e, s, p, o, ts FROM questions JOIN ends ON main = e", GRAPH)
def d1_stored_facts(v: Views) -> DataFrame:
    """By bucketed tables; entities with a few hundred facts are dealt over several buckets."""
    return Adjacency.write(v.facts, limit=200).touching(v.questions.select("qid", F.col("main").alias("e"))).select("qid", "e", *graph.COLUMNS)


@query("SELECT qid, s, p, o, ts FROM fq", GRAPH)
def h1_stored_subgraph(v: Views) -> DataFrame:
    return Adjacency.write(v.facts).retrieve(*v.wanted)


@query("SELECT DISTINCT e AS entity FROM ends", f"{FACTS}, {ENDPOINTS}")
def a3_entities(v: Views) -> DataFrame:
    return graph.entities(v.facts)


@query("SELECT DISTINCT p AS relation FROM facts", FACTS)
def a3_relations(v: Views) -> DataFrame:
    return graph.relations(v.facts)


@query("SELECT '[' || s || ', ' || p || ', ' || o || ', ' || ts || ']' AS t, count(*) AS n FROM facts GROUP BY 1", FACTS)
def b1_fact_tuple(v: Views) -> DataFrame:
    return v.facts.groupBy(text.fact_tuple(*map(F.col, graph.COLUMNS)).alias("t")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT replace(s || ' ' || p || ' ' || o, '_', ' ') || ' (' || ts || ')' AS t, count(*) AS n FROM facts GROUP BY 1", FACTS)
def b2_fact_text(v: Views) -> DataFrame:
    return v.facts.groupBy(text.fact_text(*map(F.col, graph.COLUMNS)).alias("t")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT s || ' ' || p || ' ' || o AS line FROM facts", FACTS)
def b3_fact_line(v: Views) -> DataFrame:
    return v.facts.select(text.fact_line(F.col("s"), F.col("p"), F.col("o")).alias("line")).distinct()


@query("SELECT qid, f.s, f.p, f.o, f.ts FROM questions JOIN facts f ON f.p = relation AND (f.s = main OR f.o = main)", GRAPH)
def c1_main_facts(v: Views) -> DataFrame:
    return subgraph.main_facts(v.facts, v.questions.select("qid", F.col("main").alias("e"), F.col("relation").alias("p")))


@query("SELECT DISTINCT qid, f.s, f.p, f.o, f.ts FROM questions JOIN facts f ON f.p = relation AND (f.s = aux OR f.o = aux) WHERE f.s <> main AND f.o <> main", GRAPH)
def c2_context_facts(v: Views) -> DataFrame:
    keys = lambda c: v.questions.select("qid", F.col(c).alias("e"), F.col("relation").alias("p"))
    return subgraph.context_of(v.facts, keys("aux"), keys("main"))


@query("SELECT qid, entity FROM (SELECT qid, main, unnest([main, aux]) AS entity FROM questions) WHERE entity <> main", f"{FACTS}, {QUESTIONS}")
def c4_auxiliary(v: Views) -> DataFrame:
    found = v.questions.select("qid", "main", F.explode(F.array("main", "aux")).alias("entity"))
    return grounding.others(found).select("qid", "entity")


@query(
    """, many AS (SELECT qid, unnest([main, aux]) AS entity FROM questions)
SELECT fq.qid, s, p, o, ts FROM fq WHERE (SELECT count(DISTINCT entity) FROM many m WHERE m.qid = fq.qid) >= 2
  AND EXISTS (SELECT 1 FROM many m WHERE m.qid = fq.qid AND m.entity = s) AND EXISTS (SELECT 1 FROM many m WHERE m.qid = fq.qid AND m.entity = o)""",
    GRAPH,
)
def c5_pair_facts(v: Views) -> DataFrame:
    grounded = v.questions.select("qid", F.explode(F.array("main", "aux")).alias("entity"))
    return v.shared.between(grounded)


@query("SELECT qid, e, s, p, o, ts FROM questions JOIN ends ON main = e", GRAPH)
def d1_facts_touching(v: Views) -> DataFrame:
    return subgraph.touching(v.facts, v.questions.select("qid", F.col("main").alias("e"))).select("qid", "e", *graph.COLUMNS)


_MENTIONS = """mentions AS (
  SELECT vec_id AS qid, CASE vec_id % 4 WHEN 0 THEN ' USER ' || vec_id || ' ' WHEN 1 THEN 'user_' || vec_id WHEN 2 THEN 'Key_' || vec_id ELSE 'nobody ' || vec_id END AS mention FROM embeddings),
entities AS (SELECT DISTINCT e AS entity FROM ends),
keyed AS (SELECT lower(replace(trim(entity), '_', ' ')) AS k, max(entity) AS by_key FROM entities GROUP BY 1),
found AS (SELECT qid, mention, coalesce(by_key, entities.entity) AS entity FROM mentions LEFT JOIN keyed ON lower(replace(trim(mention), '_', ' ')) = k LEFT JOIN entities ON entities.entity = mention)"""


def _mentions(v: Views) -> DataFrame:
    i = F.col("vec_id")
    said = F.when(i % 4 == 0, F.concat(F.lit(" USER "), i, F.lit(" "))).when(i % 4 == 1, F.concat(F.lit("user_"), i)).when(i % 4 == 2, F.concat(F.lit("Key_"), i)).otherwise(F.concat(F.lit("nobody "), i))
    return v.table("embeddings").select(i.alias("qid"), said.alias("mention"))


@query("SELECT qid, mention, entity FROM found", f"{FACTS}, {ENDPOINTS}, {_MENTIONS}")
def d2_exact_grounding(v: Views) -> DataFrame:
    return grounding.exact(_mentions(v), graph.entities(v.facts))


@query("SELECT qid, mention, entity FROM found WHERE entity IS NOT NULL", f"{FACTS}, {ENDPOINTS}, {_MENTIONS}")
def c3_grounded(v: Views) -> DataFrame:
    return grounding.grounded(grounding.exact(_mentions(v), graph.entities(v.facts)))


_SCORED = """scored AS (
  SELECT q.vec_id AS qid, i.vec_id AS item, round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS sim
  FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, item) AS rank FROM scored)"""


def _ranked(v: Views, k: int) -> DataFrame:
    ask, have = v.asked.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), v.table("embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("iv"))
    return grounding.nearest(ask, have, k)


@query("SELECT qid, item FROM ranked WHERE rank = 1", _SCORED)
def d3_dense_top1(v: Views) -> DataFrame:
    return _ranked(v, 1).select("qid", "item")


@query("SELECT qid, item, rank FROM ranked WHERE rank <= 5", _SCORED)
def d5_dense_topk(v: Views) -> DataFrame:
    return _ranked(v, 5).select("qid", "item", "rank")


@query("SELECT qid, item, sim, rank FROM ranked WHERE rank <= 100", _SCORED)
def d5_dense_top100(v: Views) -> DataFrame:
    return _ranked(v, 100)


def _stored(v: Views, k: int) -> DataFrame:
    """By an index of blocks, which is written, and read by a search that skips blocks."""
    have = v.table("embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("iv"))
    index = dense.DenseIndex.build(have, place(v.spark, "stores"), block_rows=64)
    return index.search(v.asked.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), k)


@query("SELECT qid, item FROM ranked WHERE rank = 1", _SCORED)
def d3_stored_top1(v: Views) -> DataFrame:
    return _stored(v, 1).select("qid", "item")


@query("SELECT qid, item, sim, rank FROM ranked WHERE rank <= 100", _SCORED)
def d5_stored_top100(v: Views) -> DataFrame:
    return _stored(v, 100)


@query(
    """, phrases AS (SELECT DISTINCT p AS relation, CASE length(p) % 2 WHEN 0 THEN upper(p) ELSE replace(p, '_', ' ') END AS phrase FROM facts), keyed AS (SELECT lower(trim(p)) AS k, max(p) AS entity FROM facts GROUP BY 1)
SELECT phrase, entity AS relation FROM phrases LEFT JOIN keyed ON lower(trim(phrase)) = k""",
    FACTS,
)
def d4_relation_exact(v: Views) -> DataFrame:
    """Relations keep their underscores, so a phrase with blanks isn't found."""
    names = graph.relations(v.facts)
    phrases = names.select(F.when(F.length("relation") % 2 == 0, F.upper("relation")).otherwise(F.translate("relation", "_", " ")).alias("phrase"))
    return grounding.exact(phrases, names, "phrase", "relation", text.relation_key)


@query(
    """, tops AS (SELECT qid, max(sim) FILTER (rank = 1) AS s1, max(sim) FILTER (rank = 2) AS s2 FROM ranked GROUP BY qid)
SELECT qid, item, rank FROM ranked JOIN tops USING (qid) WHERE rank = 1 OR (rank = 2 AND (s1 - s2 < 0.15 OR s2 >= 0.75))""",
    _SCORED,
)
def c11_expansion(v: Views) -> DataFrame:
    return grounding.expand(_ranked(v, 2), ["qid"]).select("qid", "item", "rank")


@query("SELECT qid, s, p, o, ts FROM fq", GRAPH)
def h1_subgraph(v: Views) -> DataFrame:
    return subgraph.retrieve(v.facts, *v.wanted)


@query("SELECT qid, pos, s, p, o, ts FROM fq", GRAPH)
def g1_canonical_order(v: Views) -> DataFrame:
    return v.shared.in_order()


@query("SELECT qid, anchor::VARCHAR AS anchor FROM explicit", f"{FACTS}, {QUESTIONS}, {EXPLICIT}")
def i6_explicit_anchors(v: Views) -> DataFrame:
    return v.explicit.select("qid", F.col("anchor").cast("string").alias("anchor"))


@query("SELECT qid, anchor::VARCHAR AS anchor FROM extremes", f"{GRAPH}, {EXPLICIT}, {ANCHORS}")
def e2_extremes(v: Views) -> DataFrame:
    return chain.extremes(v.shared.ranges(), v.questions).select("qid", F.col("anchor").cast("string").alias("anchor"))


@query("SELECT qid, anchor::VARCHAR AS anchor FROM anchors", f"{GRAPH}, {EXPLICIT}, {ANCHORS}")
def h2_all_anchors(v: Views) -> DataFrame:
    return v.anchors.select("qid", F.col("anchor").cast("string").alias("anchor"))


@query("SELECT qid, s, p, o, ts FROM kept", FULL)
def d6_temporal_knn(v: Views) -> DataFrame:
    return v.shared.nearest(v.anchors, 5).select("qid", *graph.COLUMNS)


@query("SELECT qid, pos, dist FROM near", FULL)
def e1_min_distance(v: Views) -> DataFrame:
    return chain.min_distance(v.nearest, v.anchors).select("qid", "pos", F.col("dist").cast("long").alias("dist"))


@query("SELECT qid, rank, s, p, o, ts FROM chain", FULL)
def g2_proximity_order(v: Views) -> DataFrame:
    return v.chain.select("qid", "rank", *graph.COLUMNS)


@query("SELECT qid, CASE WHEN count(*) > 1000 THEN 80 ELSE 40 END AS k FROM fq GROUP BY qid", GRAPH)
def g12_effective_k(v: Views) -> DataFrame:
    return chain.k_of(v.shared.sizes(), 40, "vi")


@query("SELECT DISTINCT qid, d::VARCHAR AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, pos) AS r FROM scored) WHERE r <= 2", f"{GRAPH}, {VECTORS}")
def g3_implicit_anchors(v: Views) -> DataFrame:
    return v.shared.similar(v.likeness, 2).select("qid", F.col("d").alias("anchor")).distinct().select("qid", F.col("anchor").cast("string").alias("anchor"))


@query(
    """, counted AS (SELECT qid, count(*) AS n FROM anchors GROUP BY qid),
best AS (SELECT scored.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY scored.qid ORDER BY sim DESC, pos) AS r FROM scored LEFT JOIN counted USING (qid)),
far AS (SELECT best.qid, pos, any_value(r) AS r, min(abs(date_diff('day', anchor, d))) AS dist FROM best LEFT JOIN anchors USING (qid) WHERE r <= 3 * greatest(1, n) GROUP BY best.qid, pos)
SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY coalesce(dist, 0), CASE WHEN dist IS NULL THEN r ELSE pos END, pos) AS rank FROM far""",
    f"{GRAPH}, {EXPLICIT}, {ANCHORS}, {VECTORS}",
)
def g6_semantic_chain(v: Views) -> DataFrame:
    return chain.semantic_chain(v.shared, v.anchors, 3, v.likeness).select("qid", "pos", "rank")


@query(
    """SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY sha256('42:' || question || ':' || s || ':' || p || ':' || o || ':' || ts), pos) AS rank FROM kept JOIN questions USING (qid)""",
    FULL,
)
def g7_seeded_shuffle(v: Views) -> DataFrame:
    return chain.shuffled(v.nearest, v.questions, 42).select("qid", "pos", "rank")


@query()
def g7_python_shuffle(v: Views) -> DataFrame:
    """The order of Python's generator, which SQL doesn't have: a test holds it against `random`."""
    return chain.shuffled_as_python(v.chain, v.questions, 42).select("qid", "pos", "rank")


@query(
    """, pairs AS (SELECT qid, s, p, o, ts FROM fq JOIN questions USING (qid) WHERE main <> aux AND s IN (main, aux) AND o IN (main, aux))
SELECT qid, s, p, o, ts FROM kept UNION SELECT qid, s, p, o, ts FROM pairs""",
    FULL,
)
def h3_with_pairs(v: Views) -> DataFrame:
    grounded = v.questions.select("qid", F.explode(F.array("main", "aux")).alias("entity"))
    kept = v.shared.nearest(v.anchors, 5).select("qid", *graph.COLUMNS)
    return chain.with_pairs(kept, v.shared.between(grounded))


@query("SELECT s, o, a::VARCHAR AS ts, b::VARCHAR AS ts_end, (DATE '1970-01-01' + floor((date_diff('day', DATE '1970-01-01', a) + date_diff('day', DATE '1970-01-01', b)) / 2.0)::INT)::DATE::VARCHAR AS d FROM intervals", INTERVALS)
def i8_interval_midpoint(v: Views) -> DataFrame:
    """Also the date of an interval fact (I9)."""
    return graph.dated(v.interval_facts).select("s", "o", "ts", "ts_end", F.col("d").cast("string").alias("d"))


@query(
    """, answers AS (SELECT DISTINCT unnest(answers) AS e FROM questions WHERE answer_type = 'entity'), others AS (SELECT facts.* FROM facts ANTI JOIN answers ON s = e),
found AS (SELECT facts.* FROM facts SEMI JOIN answers ON s = e UNION ALL SELECT others.* FROM others SEMI JOIN answers ON o = e)
SELECT s, p, o, ts, CASE WHEN p = 'click' THEN 'nhấp' ELSE replace(p, '_', ' ') END AS relation_vi FROM found""",
    f"{FACTS}, {QUESTIONS}",
)
def d12_answer_subgraph(v: Views) -> DataFrame:
    answers = v.questions.where("answer_type = 'entity'").select(F.explode("answers").alias("answer"))
    translated = v.spark.createDataFrame([("click", "nhấp")], "p string, relation_vi string")
    return corpus.answer_subgraph(v.facts, answers, translated)


_TERMS = r"""terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)) AS term FROM documents),
sized AS (SELECT doc_id, len(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)) AS len FROM documents),
posted AS (SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY term, doc_id),
idfs AS (SELECT term, count(*) AS n, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posted GROUP BY term),
asked AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)) AS term FROM benchmark),
scores AS (SELECT qid, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM sized)))) AS score FROM asked JOIN posted USING (term) JOIN idfs USING (term) JOIN sized USING (doc_id) GROUP BY qid, doc_id),
short AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scores)"""


def _bm25(v: Views, k: int) -> DataFrame:
    return retrieval.search(v.table("documents"), v.table("benchmark"), k, query_id="item_id", query="text")


@query("SELECT term, count(*) AS docs, sum(tf)::BIGINT AS uses FROM posted GROUP BY term", _TERMS)
def e17_postings(v: Views) -> DataFrame:
    return retrieval.postings(v.table("documents")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("uses"))


@query("SELECT doc_id, len FROM sized", _TERMS)
def i19_document_lengths(v: Views) -> DataFrame:
    return retrieval.lengths(v.table("documents"))


@query("SELECT term, n, round(idf, 9) AS idf FROM idfs", _TERMS)
def e18_idf(v: Views) -> DataFrame:
    docs = v.table("documents")
    return retrieval.idf(retrieval.postings(docs), docs.count()).withColumn("idf", F.round("idf", 9))


@query("SELECT qid, doc_id, round(score, 6) AS score FROM short WHERE rank <= 20", _TERMS)
def e19_bm25(v: Views) -> DataFrame:
    """With the term join (D13): the best twenty with their scores."""
    return _bm25(v, 20).select("qid", "doc_id", "score")


@query("SELECT qid, doc_id, round(score, 6) AS score, rank FROM short WHERE rank <= 20", _TERMS)
def e19_stored_index(v: Views) -> DataFrame:
    """The best twenty by an index that is written with a part of the documents and grows by two appends."""
    index = inverted.InvertedIndex(v.spark, place(v.spark, "stores"))
    for lot in range(3):
        index.append(v.table("documents").where(F.col("doc_id") % 3 == lot))
    return index.search(v.table("benchmark"), 20, "item_id", "text")


@query("SELECT qid, doc_id, rank FROM short WHERE rank <= 200", _TERMS)
def g4_bm25_shortlist(v: Views) -> DataFrame:
    return _bm25(v, retrieval.SHORTLIST).select("qid", "doc_id", "rank")


@query(
    """, dense AS (SELECT qid, doc_id, rank, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM short JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = doc_id % 500 WHERE rank <= 50)
SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, rank) AS dense_rank FROM dense QUALIFY dense_rank <= 10""",
    _TERMS,
)
def g5_dense_rerank(v: Views) -> DataFrame:
    """Also the ablation without a subgraph (K3): lexical candidates, then vectors."""
    e, docs = v.table("embeddings"), v.table("documents").select("doc_id", (F.col("doc_id") % 500).alias("vec_id"))
    asked = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return retrieval.rerank(_bm25(v, 50), asked, docs.join(e, "vec_id").select("doc_id", F.col("embedding").alias("dv")), 10).select("qid", "doc_id", "dense_rank")


@query("SELECT vec_id, i, round(e[i] / CASE WHEN sqrt(list_dot_product(e, e)) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END, 4) + 0.0 AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), unnest(range(1, 65)) AS r(i)")
def e23_l2_norm(v: Views) -> DataFrame:
    return v.table("embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), (F.round("x", 4) + 0.0).alias("x"))


@query("SELECT q.vec_id AS a, i.vec_id AS b, round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 4) AS sim FROM embeddings q JOIN embeddings i ON q.label = i.label WHERE q.vec_id % 100 = 0")
def i20_cosine(v: Views) -> DataFrame:
    a, b = v.asked.select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("x")), v.table("embeddings").select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("y"))
    return a.join(b, "label").select("a", "b", F.round(vectors.dot(F.col("x"), F.col("y")), 4).alias("sim"))
