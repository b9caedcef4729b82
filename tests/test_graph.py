"""A toy graph with the edges that matter."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import chain, corpus, grounding, metrics, subgraph
from chronoweave.plans.answer import TemporalQA
from chronoweave.plans.spec import RunSpec
from chronoweave.sources import adjacency, graph

LINES = """Alpha_(North)\tMake_a_visit\tBeta\t2005-11-13
Beta\tHost_a_visit\tAlpha_(North)\t2005-11-13
Alpha_(North)\tMake_a_visit\tGamma\t2005-11-03
Alpha_(North)\tMake_a_visit\tDelta\t2005-11-23
Alpha_(North)\tMake_a_visit\tBeta\t2005-11-13
Beta\tMake_a_visit\tBeta\t2006
Gamma\tPraise_or_endorse\tBeta\t2006-02

three\tfields\tonly
five\tfields\tare\ttoo\tmany
last\tis\tempty\t
"""


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("kg") / "full.txt"
    path.write_text(LINES)
    return graph.read_tsv(spark, str(path)).cache()


def test_scan(facts):
    assert facts.count() == 7
    assert graph.endpoints(facts).where("e = 'Beta'").count() == 6
    assert graph.endpoints(facts, loops_twice=False).where("e = 'Beta'").count() == 5
    assert {r[0] for r in graph.entities(facts).collect()} == {"Alpha_(North)", "Beta", "Gamma", "Delta"}


def test_nearest_in_time(spark, facts):
    """Of equally near facts the first in canonical order stays."""
    q = spark.createDataFrame([("q", "Alpha_(North)")], "qid string, e string")
    fq = graph.dated(subgraph.in_order(subgraph.retrieve(facts, q, spark.createDataFrame([("q", "Make_a_visit")], "qid string, p string"))))
    assert fq.count() == 3
    anchors = spark.createDataFrame([("q", date(2005, 11, 13))], "qid string, anchor date")
    assert {r["o"] for r in chain.knn(fq, anchors, 2).collect()} == {"Beta", "Delta"}
    order = [r["o"] for r in chain.serialize(fq, anchors).orderBy("rank").collect()]
    assert order == ["Beta", "Delta", "Gamma"]
    none = anchors.limit(0)
    assert chain.knn(fq, none, 2).count() == 3
    assert [r["o"] for r in chain.serialize(fq, none).orderBy("rank").collect()] == ["Beta", "Delta", "Gamma"]
    ks = fq.withColumn("k", F.lit(1))
    assert {r["o"] for r in chain.knn(ks, anchors, "k").collect()} == {"Beta"}


def test_more_than_a_thousand_neighbours(spark):
    fq = graph.dated(subgraph.in_order(spark.range(1100).selectExpr("'q' qid", "'a' s", "'p' p", "concat('o', id) o", "'2001-01-01' ts")))
    anchors = fq.select("qid", F.col("d").alias("anchor")).distinct()
    assert chain.knn(fq.withColumn("k", F.lit(1050)), anchors, "k").count() == 1050
    plan = TemporalQA(fq.select("s", "p", "o", "ts"), RunSpec(k=1050))
    questions = spark.sql("select 'q' qid, 'which' question, 'a' main, array('a') aux")
    assert plan.spec.neighbours == 1050 and plan.stage2(questions, fq, anchors).count() == 1050


def test_grounding(spark):
    names = spark.createDataFrame([("A_b",), ("a_b",), ("Iran",)], "entity string")
    said = spark.createDataFrame([(1, " a B "), (2, "nobody"), (3, "Iran")], "i int, mention string")
    assert {r["i"]: r["entity"] for r in grounding.exact(said, names).collect()} == {1: "a_b", 2: None, 3: "Iran"}
    phrases = spark.createDataFrame([("Make_a_visit",), ("make a visit",)], "mention string")
    relations = spark.createDataFrame([("Make a visit",)], "entity string")
    found = {r["mention"]: r["entity"] for r in grounding.exact(phrases, relations, key=lambda c: F.lower(F.trim(c))).collect()}
    assert found == {"Make_a_visit": None, "make a visit": "Make a visit"}


def test_all_stages(spark, facts):
    questions = spark.createDataFrame(
        [("q1", "Who did Alpha visit first after 3 November 2005?", "Alpha_(North)", None, ["Make_a_visit"], "entity", "Single", ["beta"]), ("q2", "When?", None, None, ["Make_a_visit"], "time", "Single", ["2005"])],
        "qid string, question string, main string, aux array<string>, relations array<string>, answer_type string, qlabel string, answers array<string>",
    )
    rows = {r["qid"]: r for r in TemporalQA(facts, RunSpec()).answer(questions).collect()}
    assert rows["q1"]["pred"] == ["Beta"] and rows["q1"]["hit"] and rows["q1"]["answer_recall_chain"]
    assert rows["q2"]["pred"] == [] and not rows["q2"]["hit"] and rows["q2"]["subgraph_size"] == 0


def test_language_and_ablation(spark, facts):
    """What a setting adds or takes away, with the default encoder."""
    questions = spark.createDataFrame(
        [("q1", "Who did Alpha visit first after 3 November 2005?", "Alpha_(North)", ["Beta"], ["Make_a_visit", "Host_a_visit"], "entity", "Multiple", ["beta"]), ("q2", "Praise of Gamma?", "Gamma", None, ["Praise_or_endorse"], "entity", "Single", ["Beta"])],
        "qid string, question string, main string, aux array<string>, relations array<string>, answer_type string, qlabel string, answers array<string>",
    )
    run = lambda **kw: {r["qid"]: r for r in TemporalQA(facts, RunSpec(**kw)).answer(questions).collect()}
    en, vi = run(k=1, n_implicit=1), run(lang="vi", k=1, n_implicit=1)
    assert en["q1"]["subgraph_size"] == 4 and vi["q1"]["subgraph_size"] == 5  # the second relation, too
    assert vi["q1"]["n_anchors"] >= en["q1"]["n_anchors"] and vi["q1"]["chain_size"] > en["q1"]["chain_size"]
    assert en["q2"]["pred"] == ["Beta"] and en["q2"]["meta"]["anchor_derivable"] and en["q2"]["meta"]["parse_ok"]
    similar, shuffled = run(ablation="no_kntn", k=1), run(ablation="no_ps")
    assert similar["q2"]["chain_size"] == 1 and shuffled["q1"]["chain_size"] == 4
    everywhere = run(ablation="no_sg")
    assert everywhere["q2"]["main"] is None and everywhere["q2"]["subgraph_size"] >= 1 and everywhere["q2"]["meta"]["retrieval"] == "global_semantic"
    summary = metrics.summarize(TemporalQA(facts, RunSpec()).answer(questions)).first()
    assert summary["n_scored"] == 2 and summary["relation_expanded_rate"] == 0.0 and summary["anchor_derivable_rate"] == 1.0


def test_similar_facts_without_anchors(spark, facts):
    fq = graph.dated(subgraph.in_order(facts.distinct().withColumn("qid", F.lit("q"))))
    scored = fq.withColumn("sim", F.col("pos") / 10)
    none = spark.createDataFrame([], "qid string, anchor date")
    assert [r["pos"] for r in chain.semantic_chain(scored, none, 3).orderBy("rank").collect()] == [5, 4, 3]


def test_answer_subgraph(spark, facts):
    answers = spark.createDataFrame([("Gamma",), ("Gamma",)], "answer string")
    words = spark.createDataFrame([("Praise_or_endorse", "khen")], "p string, relation_vi string")
    assert sorted(r["relation_vi"] for r in corpus.answer_subgraph(facts, answers, words).collect()) == ["Make a visit", "khen"]


def test_spec():
    assert RunSpec(k=0).neighbours == 40 and RunSpec(dataset="interval").implicit == 5
    with pytest.raises(ValueError, match="ablation"):
        RunSpec(ablation="no")
    with pytest.raises(ValueError, match="style"):
        RunSpec(style="own")
    assert RunSpec.from_conf({"k": "10", "cache": "false"}) == RunSpec(k=10, cache=False)


def shuffles_below(plan: str, table: str) -> list[str]:
    """Exchanges between a scan of a table and the join above it, by the indents of a plan's lines."""
    lines, found = plan.split("\n"), []
    depth = lambda line: next((i for i, c in enumerate(line) if c.isalnum() or c == "*"), 0)
    for i, line in enumerate(lines):
        if "Scan parquet" in line and f"{table}[" in line:
            level = depth(line)
            for above in reversed(lines[:i]):
                if depth(above) < level:
                    level = depth(above)
                    if "Join" in above:
                        break
                    if "Exchange hashpartitioning" in above or "Exchange range" in above:
                        found.append(above)
    return found


@pytest.mark.parametrize("broadcast", [-1, 10 << 20])
def test_stored_adjacency(spark, broadcast):
    """Lookups equal those without a store, with self-loops and a large entity; the facts' side isn't shuffled."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        rows = [(f"e{i % 7}", f"r{i % 3}", f"e{i % 11}", f"20{i % 30:02d}") for i in range(300)] + [("hub", "r1", f"x{i}", "2001") for i in range(200)] + [("hub", "r1", "hub", "2002"), (None, "r1", "e1", "2003")]
        facts = spark.createDataFrame(rows, "s string, p string, o string, ts string")
        stored = adjacency.Adjacency.write(facts, buckets=4, limit=50)
        assert spark.table(f"{stored.name}_large").where("e = 'hub'").first()["salts"] >= 4
        assert sorted(map(str, stored.ends().select("e", "s", "p", "o", "ts").collect())) == sorted(map(str, graph.endpoints(facts).select("e", "s", "p", "o", "ts").collect()))
        entities = spark.createDataFrame([("q1", "e1"), ("q1", "hub"), ("q2", "e3"), ("q3", "nobody"), ("q2", "e3")], "qid string, e string")
        relations = spark.createDataFrame([("q1", "r1"), ("q1", "r2"), ("q2", "r0"), ("q3", "r1")], "qid string, p string")
        plain = lambda df: sorted(map(str, df.collect()))
        order = ["qid", "e", "s", "p", "o", "ts"]
        one, two = stored.touching(entities).select(*order), stored.retrieve(entities, relations)
        assert plain(one) == plain(subgraph.touching(facts, entities).select(*order))
        assert plain(two) == plain(subgraph.retrieve(facts, entities, relations))
        for df in (one, two):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert stored.name in plan and not shuffles_below(plan, stored.name), plan
        stored.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_orders_of_python(spark):
    """Shuffles and samples are those of Python's generator."""
    import hashlib
    import random

    from chronoweave.operators import sampling

    sizes = {"q1": 1, "q2": 7, "q3": 40}
    rows = spark.createDataFrame([(q, r + 1, f"f{r}") for q, n in sizes.items() for r in range(n)], "qid string, rank long, s string")
    asked = spark.createDataFrame([(q, f"what of {q} é?") for q in sizes], "qid string, question string")
    got = chain.shuffled_as_python(rows, asked, 42).orderBy("qid", "rank").collect()
    for q, n in sizes.items():
        want = [f"f{r}" for r in range(n)]
        random.Random(int(hashlib.sha256(f"42:what of {q} é?".encode()).hexdigest()[:16], 16)).shuffle(want)
        assert [r["s"] for r in got if r["qid"] == q] == want
    many = spark.range(500).withColumnRenamed("id", "place")
    random.seed(7)
    assert [r["place"] for r in sampling.python_sample(many, "place", 25, 7).orderBy("pos").collect()] == random.sample(range(500), 25)
    assert sampling.python_sample(many.limit(3), "place", 25, 7).count() == 3
