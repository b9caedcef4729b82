"""Graph tables over the star schema, in Spark and, word for word, in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import chain, subgraph
from chronoweave.operators.shared import Shared
from chronoweave.sources import graph
from chronoweave.sources.tables import kept

#: Names of question types, by number.
QTYPES = ("equal", "before_after", "first_last", "equal_multi", "after_first", "before_last")
LEVELS = ("day", "month", "year")


class Views:
    """Tables of one folder, built on demand; what queries read several times is written once and kept."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def facts(self) -> DataFrame:
        """Events, orders and line items as facts."""
        day = lambda c: F.date_format(c, "yyyy-MM-dd")
        events = self.table("events").select(F.concat(F.lit("User_"), "user_id").alias("s"), F.col("event_type").alias("p"), F.concat(F.lit("Key_"), F.get_json_object("props", "$.k")).alias("o"), day("ts").alias("ts"))
        named = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
        placed = self.table("orders").select("o_custkey", F.concat(F.lit("Place_order_"), "o_orderpriority").alias("p"), day("o_orderdate").alias("ts"))
        orders = placed.join(named, F.col("o_custkey") == F.col("c_custkey")).select("c_name", "p", "n_name", "ts")
        items = self.table("lineitem").select(F.concat(F.lit("Supplier_"), "l_suppkey"), F.concat(F.lit("Ship_"), "l_returnflag"), F.concat(F.lit("Part_"), "l_partkey"), day("l_shipdate"))
        return events.unionAll(orders).unionAll(items)

    @cached_property
    def interval_facts(self) -> DataFrame:
        """Orders with their line items, from the earlier to the later of both days."""
        a, b = F.to_date("o_orderdate"), F.to_date("l_shipdate")
        rows = self.table("orders").join(self.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        return rows.select(F.concat(F.lit("Order_"), "o_orderkey").alias("s"), F.lit("Deliver").alias("p"), F.concat(F.lit("Line_"), "l_linenumber").alias("o"), F.least(a, b).cast("string").alias("ts"), F.greatest(a, b).cast("string").alias("ts_end"))

    @cached_property
    def questions(self) -> DataFrame:
        """A question for each user and kind of event."""
        base = self.table("events").groupBy("user_id", "event_type").agg(F.min(F.date_format("ts", "yyyy-MM-dd")).alias("t0"))
        k = F.col("user_id") * 7 + F.length("event_type")
        pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("k") % n + 1).cast("int"))
        head = lambda lead: F.concat(F.lit(lead), F.lit(" User "), "user_id", F.lit(" "), "event_type")
        text = F.when(F.col("k") % 5 == 0, F.concat(head("What did"), F.lit(" on 5 January 2024?"))).when(F.col("k") % 5 == 1, F.concat(head("What did first"), F.lit(" in January 2024?")))
        text = text.when(F.col("k") % 5 == 2, F.concat(head("In what year did"), F.lit(" after 2024?"))).when(F.col("k") % 5 == 3, F.concat(head("What month did"), F.lit(" between 2024 and 2025?"))).otherwise(F.concat(head("Who saw"), F.lit(" last?")))
        q = base.withColumn("k", k).select(
            F.concat(F.lit("q"), "user_id", F.lit("_"), "event_type").alias("qid"), "k", "user_id", "event_type", "t0", text.alias("question"), F.concat(F.lit("User_"), "user_id").alias("main"), F.col("event_type").alias("relation"), F.concat(F.lit("Key_"), F.col("k") % 100).alias("aux"),
            F.when(F.col("k") % 3 == 0, "time").otherwise("entity").alias("answer_type"), F.when(F.col("k") % 2 == 0, "Single").otherwise("Multiple").alias("qlabel"), pick(QTYPES, 6).alias("qtype"), pick(LEVELS, 3).alias("time_level"),
        )
        # Facts of other relations answer no question: they are left out where they are read, before a shuffle.
        asked = kept(self.table("events").select(F.col("event_type").alias("p")).distinct())
        gold = self.facts.join(asked, "p", "left_semi").join(q.select("qid", F.col("main").alias("s"), F.col("relation").alias("p"), F.col("t0").alias("ts")), ["s", "p", "ts"]).groupBy("qid").agg(F.sort_array(F.collect_set("o")).alias("objects"))
        answers = F.when(F.col("answer_type") == "time", F.array(F.when(F.col("time_level") == "year", F.substring("t0", 1, 4)).when(F.col("time_level") == "month", F.substring("t0", 1, 7)).otherwise(F.col("t0")))).otherwise(F.col("objects"))
        return kept(q.join(gold, "qid").select("qid", "k", "question", "main", "relation", "aux", "answer_type", "qlabel", "qtype", "time_level", answers.alias("answers")))

    @cached_property
    def wanted(self) -> tuple[DataFrame, DataFrame]:
        """(qid, e) of main and auxiliary entities and (qid, p)."""
        q = self.questions
        return q.select("qid", F.explode(F.array("main", "aux")).alias("e")), q.select("qid", F.col("relation").alias("p"))

    @cached_property
    def fq(self) -> DataFrame:
        return kept(graph.dated(subgraph.in_order(subgraph.retrieve(self.facts, *self.wanted))))

    @cached_property
    def shared(self) -> Shared:
        """The questions' facts, each once for each of its ends."""
        return Shared(self.facts, *self.wanted)

    @cached_property
    def nearest(self) -> DataFrame:
        """The five facts nearest to each anchor, with their places among all facts of the question."""
        return kept(self.shared.placed(self.shared.nearest(self.anchors, 5)))

    @property
    def likeness(self) -> Callable[[DataFrame], DataFrame]:
        """`similar`, with the number of a fact's vector."""
        found = partial(self.similar)
        found.number = self._number()
        return found

    @staticmethod
    def _number() -> Column:
        """The number of a fact's vector."""
        return ((F.length("s") * 31 + F.length("o") * 7 + F.length("p") * 3 + F.length("ts")) % 500).cast("long")

    def _numbered(self, facts: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Vectors of the table in place of an encoder's: (qid, qv), facts with the number of theirs, and the numbers' vectors."""
        e = self.table("embeddings")
        asked = self.questions.withColumn("vec_id", F.col("k") % 500).join(e, "vec_id").select("qid", F.col("embedding").alias("qv"))
        return asked, facts.withColumn("number", self._number()), e.select(F.col("vec_id").alias("number"), F.col("embedding").alias(name))

    def vectors(self, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(qid, qv) and (fact_id, dv)."""
        asked, numbered, known = self._numbered(facts, "dv")
        return asked, numbered.join(known, "number").select("fact_id", "dv")

    def similar(self, fq: DataFrame) -> DataFrame:
        """Facts of questions with their similarity."""
        asked, numbered, known = self._numbered(fq, "fv")
        return chain.score_facts(numbered, asked, known, ["number"]).drop("number")

    @cached_property
    def explicit(self) -> DataFrame:
        """Dates that questions name. Users from 1000 on have numbers like years in their names."""
        return chain.explicit(self.questions, name="main")

    @cached_property
    def anchors(self) -> DataFrame:
        return kept(chain.all_anchors(self.explicit, chain.extremes(self.shared.ranges(), self.questions)))

    @cached_property
    def chain(self) -> DataFrame:
        return kept(chain.serialize(self.nearest, self.anchors))

    @cached_property
    def rows(self) -> DataFrame:
        """Scored rows: labelled documents, hit by quality in one run and by toxicity in the other."""
        labels, docs = self.table("labels"), self.table("documents")
        return labels.join(docs, "doc_id").select(F.col("doc_id").alias("seq"), F.concat(F.lit("d"), "doc_id").alias("qid"), (F.col("quality") == 1).alias("hit"), (F.col("toxic") == 1).alias("hit_b"), "lang", "source", (F.col("n_chars") / 1000.0).alias("latency"))

    @cached_property
    def journal(self) -> DataFrame:
        """Conversation turns as a journal: a line for each turn, an error where the system speaks."""
        return self.table("conversations").select(F.col("conv_id").cast("string").alias("qid"), F.col("turn").alias("seq"), F.col("role").alias("source"), F.when(F.col("role") == "system", "refused").otherwise("").alias("error"))

    @cached_property
    def asked(self) -> DataFrame:
        """Vectors that search: every hundredth, against all."""
        return self.table("embeddings").where("vec_id % 100 = 0")


FACTS = """facts AS (
  SELECT 'User_' || user_id AS s, event_type AS p, 'Key_' || json_extract_string(props, '$.k') AS o, strftime(ts, '%Y-%m-%d') AS ts FROM events
  UNION ALL SELECT c_name, 'Place_order_' || o_orderpriority, n_name, strftime(o_orderdate, '%Y-%m-%d') FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Supplier_' || l_suppkey, 'Ship_' || l_returnflag, 'Part_' || l_partkey, strftime(l_shipdate, '%Y-%m-%d') FROM lineitem)"""
INTERVALS = """intervals AS (
  SELECT 'Order_' || o_orderkey AS s, 'Deliver' AS p, 'Line_' || l_linenumber AS o, least(o_orderdate::DATE, l_shipdate::DATE) AS a, greatest(o_orderdate::DATE, l_shipdate::DATE) AS b
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
ENDPOINTS = "ends AS (SELECT s AS e, * FROM facts UNION ALL SELECT o, * FROM facts)"
QUESTIONS = """base AS (
  SELECT user_id, event_type, min(strftime(ts, '%Y-%m-%d')) AS t0, user_id * 7 + length(event_type) AS k FROM events GROUP BY user_id, event_type
), asked AS (
  SELECT 'q' || user_id || '_' || event_type AS qid, k, t0, 'User_' || user_id AS main, event_type AS relation, 'Key_' || (k % 100) AS aux,
    CASE k % 5 WHEN 0 THEN 'What did User ' || user_id || ' ' || event_type || ' on 5 January 2024?' WHEN 1 THEN 'What did first User ' || user_id || ' ' || event_type || ' in January 2024?'
      WHEN 2 THEN 'In what year did User ' || user_id || ' ' || event_type || ' after 2024?' WHEN 3 THEN 'What month did User ' || user_id || ' ' || event_type || ' between 2024 and 2025?' ELSE 'Who saw User ' || user_id || ' ' || event_type || ' last?' END AS question,
    CASE WHEN k % 3 = 0 THEN 'time' ELSE 'entity' END AS answer_type, CASE WHEN k % 2 = 0 THEN 'Single' ELSE 'Multiple' END AS qlabel,
    (['equal', 'before_after', 'first_last', 'equal_multi', 'after_first', 'before_last'])[k % 6 + 1] AS qtype, (['day', 'month', 'year'])[k % 3 + 1] AS time_level
  FROM base
), golds AS (
  SELECT qid, list_sort(list(DISTINCT o)) AS objects FROM asked JOIN facts ON s = main AND p = relation AND ts = t0 GROUP BY qid
), questions AS (
  SELECT asked.qid, k, question, main, relation, aux, answer_type, qlabel, qtype, time_level,
    CASE WHEN answer_type = 'time' THEN [CASE time_level WHEN 'year' THEN t0[1:4] WHEN 'month' THEN t0[1:7] ELSE t0 END] ELSE objects END AS answers
  FROM asked JOIN golds ON asked.qid = golds.qid)"""
FQ = """wanted AS (SELECT qid, main AS e, relation AS p FROM questions UNION SELECT qid, aux, relation FROM questions),
fq0 AS (SELECT DISTINCT qid, s, p, o, ts FROM wanted JOIN ends USING (e, p)),
fq AS (SELECT *, ts::DATE AS d, row_number() OVER (PARTITION BY qid ORDER BY s, p, o, ts) - 1 AS pos FROM fq0)"""
VECTORS = """scored AS (
  SELECT fq.qid, s, p, o, ts, d, pos, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
  FROM fq JOIN questions USING (qid) JOIN embeddings a ON a.vec_id = k % 500 JOIN embeddings b ON b.vec_id = (length(s) * 31 + length(o) * 7 + length(p) * 3 + length(ts)) % 500)"""
EXPLICIT = """explicit AS (
  SELECT qid, unnest(CASE k % 5 WHEN 0 THEN [DATE '2024-01-05'] WHEN 3 THEN [DATE '2024-01-01', DATE '2025-01-01'] WHEN 4 THEN [] ELSE [DATE '2024-01-01'] END) AS anchor FROM questions)"""
ANCHORS = """extremes AS (
  SELECT qid, min(d) AS anchor FROM fq JOIN questions USING (qid) WHERE question LIKE '%first%' GROUP BY qid
  UNION SELECT qid, max(d) FROM fq JOIN questions USING (qid) WHERE question LIKE '%last%' GROUP BY qid
), anchors AS (SELECT qid, anchor FROM explicit UNION SELECT qid, anchor FROM extremes)"""
CHAIN = """kept AS (
  SELECT DISTINCT qid, s, p, o, ts, d, pos FROM (
    SELECT fq.*, row_number() OVER (PARTITION BY qid, anchor ORDER BY abs(date_diff('day', anchor, d)), pos) AS r FROM fq JOIN anchors USING (qid)) WHERE r <= 5
  UNION ALL SELECT qid, s, p, o, ts, d, pos FROM fq WHERE qid NOT IN (SELECT qid FROM anchors)
), near AS (
  SELECT kept.qid, s, p, o, ts, d, pos, min(abs(date_diff('day', anchor, d))) AS dist FROM kept LEFT JOIN anchors USING (qid) GROUP BY ALL
), chain AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coalesce(dist, 0), pos) AS rank FROM near)"""
ROWS = """rows AS (
  SELECT doc_id AS seq, 'd' || doc_id AS qid, quality = 1 AS hit, toxic = 1 AS hit_b, lang, source, n_chars / 1000.0 AS latency FROM labels JOIN documents USING (doc_id))"""
JOURNAL = "journal AS (SELECT conv_id::VARCHAR AS qid, turn AS seq, role AS source, CASE WHEN role = 'system' THEN 'refused' ELSE '' END AS error FROM conversations)"
GRAPH = ", ".join((FACTS, ENDPOINTS, QUESTIONS, FQ))
FULL = ", ".join((GRAPH, EXPLICIT, ANCHORS, CHAIN))
