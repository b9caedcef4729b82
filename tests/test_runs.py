"""Summaries, samples, journals, caches and the stream."""

import json
import os
from datetime import date  # noqa: F401

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.operators import metrics, sampling
from chronoweave.plans import prompts, reason
from chronoweave.plans.spec import RunSpec
from chronoweave.sources import caches, embeddings, journal, questions, responses, tables
from chronoweave.streaming import queue

ROWS = [
    {"qid": "1", "question": "In what year?", "gold": ["2005-01-02"], "pred": ["2005"], "hit": False, "hit_gran": False, "qtype": "equal", "qlabel": "Single", "answer_type": "time", "meta": {"subgraph_size": 3, "chain_size": 2, "parse_ok": True, "relation_ids": ["a", "b"], "anchor_derivable": True, "anchor_recall": True, "chain_recall": False, "answer_recall_sg": True, "answer_recall_chain": True}},
    {"qid": "2", "question": "Who?", "gold": ["A"], "pred": [], "hit": False, "hit_gran": False, "qtype": "equal", "qlabel": "Single", "answer_type": "entity", "meta": {"subgraph_size": 3, "chain_size": 2, "parse_ok": True, "relation_ids": ["a"], "anchor_derivable": False}},
    {"qid": "3", "question": "Who?", "gold": ["A"], "pred": [], "hit": False, "hit_gran": False, "qtype": "", "qlabel": "Single", "answer_type": "entity", "meta": {"error": "timed out"}},
    {"qid": "4", "question": "Who?", "gold": ["A"], "pred": ["a"], "hit": True, "hit_gran": True, "qtype": "first_last", "qlabel": "Single", "answer_type": "entity", "meta": {"subgraph_size": 1, "chain_size": 1, "parse_ok": False, "anchor_derivable": True, "anchor_recall": False}},
]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("runs") / "run.jsonl"
    path.write_text("\n".join([*map(json.dumps, ROWS[:2]), "", *map(json.dumps, ROWS[2:]), '{"qid": "5", "ques']))
    return journal.read(spark, str(path)).cache()


def test_summary(rows):
    """Error rows count as misses without facts, as everywhere, and by themselves."""
    got = metrics.summarize(rows).first().asDict()
    want = {"n_scored": 4, "hits_at_1": 0.25, "hits_at_1_granular": 0.25, "anchor_recall": 0.5, "chain_recall": 0.0, "anchor_derivable_rate": 0.5, "empty_subgraph_rate": 0.25, "parse_fail_rate": 0.25, "abstain_rate": 0.25, "reasoning_loss_rate": 0.25, "relation_expanded_rate": 0.25, "granularity_mismatch_rate": 0.25, "error_rate": 0.25}
    assert {k: got[k] for k in want} == want
    assert metrics.summarize(rows.limit(0)).first()["hits_at_1"] == 0.0
    assert {r["bucket"]: r["total"] for r in metrics.breakdown(rows, "qtype").collect()} == {"equal": 2, "unknown": 1, "first_last": 1}


def test_journal(spark, rows):
    assert {r["qid"] for r in journal.answered(rows).collect()} == {"1", "2", "4"}
    sample = spark.createDataFrame([(q,) for q in "12345"], "qid string")
    assert {r["qid"] for r in journal.pending(sample, journal.answered(rows)).collect()} == {"3", "5"}
    lines = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "qid string, seq int, v string")
    assert {(r["qid"], r["v"], r["first_seen"]) for r in journal.latest(lines).collect()} == {("a", "z", 1), ("b", "y", 2)}
    assert journal.counts(sample, journal.answered(rows)).first().asDict() == {"done": 3, "queued": 2, "inflight": 0}
    n = 10_000
    run = journal.running_accuracy(spark.range(n).select(F.col("id").alias("seq"), (F.col("id") % 2 == 0).alias("hit")), block=1024).orderBy(F.desc("seq")).first()
    assert (run["hits"], run["n"]) == (n // 2, n)


def test_samples_nest(spark):
    assert spark.range(1).select(sampling.rank_hash(42, F.lit("3022533")).alias("h")).first()["h"] == "00078f0228d6f1a8c5d620dd98dd2f1ecb45b1fbed9af3f28f7afd8fe8e01e99"
    qs = spark.range(300).select(F.col("id").cast("string").alias("qid"), (F.col("id") % 3).cast("string").alias("qtype"), F.lit("entity").alias("answer_type"), F.lit("day").alias("time_level"))
    ids = lambda n: [r["qid"] for r in sampling.sample(qs, n, 42).orderBy("pos").collect()]
    assert ids(90)[:30] == ids(30) and len(set(ids(90))) == 90 and ids(-1) == [] and len(ids(999)) == 300
    assert {r["n"] for r in sampling.strata_counts(sampling.sample(qs, 90, 42)).collect()} == {30}


def test_manifest(spark, tmp_path):
    qs = spark.createDataFrame([("b", 0, "s"), ("a", 1, "s")], "qid string, pos int, stratum string")
    questions.write_manifest(str(tmp_path / "m.json"), qs, "point", "test", 2, 42)
    back = questions.read_manifest(spark, "m", str(tmp_path))
    assert [(r["pos"], r["qid"]) for r in back.orderBy("pos").collect()] == [(0, "b"), (1, "a")]


def test_question_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"quid": 7, "question": "Ai?", "answers": ["A", 2014], "answer_type": "entity", "qtype": "equal", "qlabel": "Single"}]))
    row = questions.read_json(spark, str(tmp_path / "q.json"), questions.POINT).first()
    assert (row["qid"], row["answers"], row["question_en"], row["time_level"]) == ("7", ["A", "2014"], "", "")
    with pytest.raises(ValueError, match="corpus"):
        questions.adapt(spark.range(1), "other")


def test_caches(spark, tmp_path):
    found = spark.createDataFrame([("k1", "m", "p1", "old"), ("k2", "m", "p2", None)], "key string, model string, prompt string, response string")
    out = {r["key"]: r["response"] for r in caches.call_misses(found, caches.replay_client({"p2": "new"})).collect()}
    assert out == {"k1": "old", "k2": "new"}
    keys = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, key string")
    built = []

    def build(k):
        built.append(1)
        return k.withColumn("embedding", F.array(F.lit(1.0)))

    for _ in range(2):
        assert caches.load_or_build(spark, str(tmp_path), "m", keys, build).count() == 2
    assert len(built) == 1
    swapped = spark.createDataFrame([(1, "a"), (0, "b")], "pos int, key string")
    caches.load_or_build(spark, str(tmp_path), "m", swapped, build)
    assert len(built) == 2


def test_retry(spark):
    first = spark.createDataFrame([("1", "P", 2, True, [], "Who?", "entity"), ("2", "P", 0, True, [], "Who?", "entity"), ("3", "P", 2, False, [], "Who?", "entity")], "qid string, prompt string, chain_size int, parse_ok boolean, pred array<string>, question string, answer_type string")
    ask = lambda prompts: prompts.withColumn("response", F.lit("['A']"))
    out = {r["qid"]: (r["pred"], r["abstain_recovered"], r["parse_ok"]) for r in reason.with_retry(first, ask, "strict", "en").collect()}
    assert out == {"1": (["A"], True, True), "2": ([], False, True), "3": ([], False, False)}
    assert {tuple(r["pred"]) for r in reason.with_retry(first, ask, "paper", "en").collect()} == {()}
    with pytest.raises(ValueError, match="style"):
        prompts.template("other", "en")
    assert prompts.template("strict", "fr") == prompts.template("strict", "en") != prompts.template("strict", "vi")


def test_stream(spark, tmp_path):
    """Answered questions aren't asked again, failed ones are, and a spent budget stops."""
    schema = T.StructType([T.StructField("qid", T.StringType())])
    out = T.StructType([*schema, T.StructField("error", T.StringType()), T.StructField("cost", T.DoubleType())])
    source, path, mark = tmp_path / "in", str(tmp_path / "journal"), str(tmp_path / "mark")
    source.mkdir()
    (source / "1.json").write_text('{"qid": "a"}\n{"qid": "b"}\n')
    fails = lambda df: df.select("qid", F.when(F.col("qid") == "b", "down").otherwise("").alias("error"), F.lit(1.0).alias("cost"))
    works = lambda df: df.select("qid", F.lit("").alias("error"), F.lit(1.0).alias("cost"))
    queue.start(spark, str(source), schema, fails, path, out, mark).awaitTermination(120)
    (source / "2.json").write_text('{"qid": "a"}\n{"qid": "b"}\n{"qid": "c"}\n')
    queue.start(spark, str(source), schema, works, path, out, mark).awaitTermination(120)
    done = spark.read.schema(out).json(path)
    assert sorted((r["qid"], r["error"]) for r in done.collect()) == [("a", ""), ("b", ""), ("b", "down"), ("c", "")]
    with pytest.raises(queue.BudgetPassed):
        queue.process_batch(spark.createDataFrame([("d",)], schema), works, path, out, max_usd=3.0)
    queue.clear(spark, path, mark)
    assert queue.done_rows(spark, path, out).count() == 0


class Counting:
    """A client that leaves a file for each call, wherever it runs."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, model, prompt):
        import hashlib
        import uuid

        with open(f"{self.folder}/{hashlib.md5(prompt.encode()).hexdigest()}-{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        return "[]" if "never right" not in prompt and "q1?" in prompt else "['x']" if "never right" in prompt else "['Ann']"


def test_a_model_run_pays_once(spark, tmp_path):
    """One call for each distinct prompt, the retry's beside it, however often the result is read; a second run pays nothing."""
    calls = tmp_path / "calls"
    calls.mkdir()
    schema = "qid string, question string, main string, aux array<string>, answer_type string, qlabel string"
    q = spark.createDataFrame([(f"q{i}", f"q{i % 10}?", "Ann", [], "entity", "Single") for i in range(20)], schema)
    chain = q.select("qid", F.col("main").alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"), F.lit("2024").alias("ts"), F.lit(1).alias("rank"))
    for _ in range(2):
        store = responses.ResponseStore(spark, str(tmp_path / "store"), buckets=4)
        found = reason.by_model(responses.asker(store, Counting(calls), "m"), "strict", "en")(q, chain, None)
        got = {r["qid"]: (r["pred"], r["abstain_recovered"]) for r in found.collect()}
        assert found.count() == 20 and found.where("abstain_recovered").count() == 2
        assert got["q1"] == (["x"], True) and got["q11"] == (["x"], True) and got["q2"] == (["Ann"], False)
        assert len(list(calls.iterdir())) == 11  # ten prompts and one retry


def test_response_store(spark, tmp_path):
    """Invalid answers aren't stored, failures are tried again and raise in the end, reads off still writes, compaction keeps the latest."""
    tries = []

    def flaky(model, prompt):
        if "fail" in prompt or not tries:
            tries.append(prompt)
            raise OSError("down")
        return responses.Answer("" if prompt == "bad" else f"{prompt}!", 0.5)

    store = responses.ResponseStore(spark, str(tmp_path / "s"), buckets=3)
    rows = spark.createDataFrame([(1, "m", "a"), (2, "m", "a"), (3, "m", "bad"), (4, "other", "a"), (None, "m", "b")], "id int, model string, prompt string")
    got = {r["id"]: (r["response"], r["valid"], r["cost"], r["from_store"]) for r in store.answer(rows, flaky, sleep=lambda s: None).collect()}
    assert got[1] == got[2] == ("a!", True, 0.5, False) and got[3] == ("", False, 1.5, False) and got[4][0] == "a!" and got[None][0] == "b!"
    assert store.known().count() == 3 and store.entries().count() == 3
    off = responses.ResponseStore(spark, str(tmp_path / "s"), buckets=3, reads=False)
    assert {r["response"] for r in off.answer(rows.where("id = 1"), lambda m, p: "new").collect()} == {"new"}
    off.compact()
    assert store.entries().count() == 3 and "new" in {r["response"] for r in store.known().collect()}
    assert store.answer(rows.limit(0), flaky).count() == 0
    with pytest.raises(Exception, match="down"):
        store.answer(spark.createDataFrame([("m", "fail")], "model string, prompt string"), flaky, sleep=lambda s: None)


def test_kept_tables_go(spark):
    with tables.scratch():
        df = tables.kept(spark.range(3))
        path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert df.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_run_ids_of_a_table(spark):
    """The column's names are those of the settings' objects."""
    rows = [("point", "en", "a/m", 5, "", "", 40, 2, "paper", "x/e", True), ("interval", "vi", "m", 0, "s1", "no_ps", 10, 0, "strict", "hash-64", False), ("interval", "en", "m", 7, "", "", 0, 5, "paper", "hash-64", True)]
    names = "dataset lang model n sample_id ablation k n_implicit style encoder thinking".split()
    df = spark.createDataFrame(rows, "dataset string, lang string, model string, n int, sample_id string, ablation string, k int, n_implicit int, style string, encoder string, thinking boolean")
    assert [r[0] for r in df.select(RunSpec.run_ids(df)).collect()] == [RunSpec(**dict(zip(names, r, strict=True))).run_id for r in rows]


class Lot:
    """Says which settings made it; notes how many texts came at once."""

    def __init__(self, settings):
        self.settings = settings

    def __call__(self, texts):
        if self.settings.get("broken"):
            return embeddings.Reply([(0, [1.0])] * len(texts))
        return embeddings.Reply([(i, [float(self.settings["size"]), float(len(texts))]) for i in range(len(texts))][::-1], len(texts))


def test_embedding_connector(spark):
    """Lots are filled across batches, a change of settings makes a new client, unfit replies raise in the end, nulls stay null."""
    registry = embeddings.Registry()
    registry.register("m", Lot)
    texts = spark.range(0, 95, 1, 1).select(F.concat(F.lit("t"), "id").alias("text")).unionAll(spark.createDataFrame([(None,), ("t1",)], "text string")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for size in (1, 2):
            found, bill = embeddings.embed(texts, registry.handle("m", size=size), lot=20, normalize=False, price=10.0)
            rows = found.collect()
            assert len(rows) == 97 and {r["embedding"][0] for r in rows if r["text"]} == {float(size)}
            assert [r["embedding"] for r in rows if r["text"] is None] == [None] and bill.first()["tokens"] == 95 and bill.first()["cost"] == 95 * 10 / 1e6
            assert sum(r["embedding"][1] == 20.0 for r in rows if r["text"]) >= 60
        assert registry.handle("other", size=3).settings == '{"model": "other", "size": 3}'
        with pytest.raises(Exception, match="vectors came back"):
            embeddings.embed(texts, registry.handle("m", broken=True), sleep=lambda s: None)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(KeyError):
        embeddings.Registry().handle("m")


def test_stored_matrices(spark, tmp_path):
    """`.npz` and the old JSON are read; other keys, another order, other encoders and damaged files are refused."""
    import numpy as np

    names, matrix = ["b", "a", "c"], np.arange(6, dtype=np.float32).reshape(3, 2)
    np.savez(tmp_path / "m.npz", entities=np.array(names), embeddings=matrix)
    (tmp_path / "old.json").write_text(json.dumps({"entities": names, "embeddings": matrix.tolist()}))
    (tmp_path / "cut.json").write_text(json.dumps({"entities": names})[:9])
    (tmp_path / "cut.npz").write_bytes(b"PK nothing")
    keys = lambda order: spark.createDataFrame(list(enumerate(order)), "pos long, key string")
    for name in ("m.npz", "old.json"):
        rows = caches.read_matrix(spark, str(tmp_path / name), "entities").orderBy("pos").collect()
        assert [tuple(r) for r in rows] == [(i, n, matrix[i].tolist()) for i, n in enumerate(names)]
    own = "bge-base-en-v1.5"
    assert caches.adopted(spark, str(tmp_path / "old.json"), "entities", own, keys(names)).count() == 3
    assert caches.adopted(spark, str(tmp_path / "old.json"), "entities", "other", keys(names)) is None
    for path, order in (("old.json", ["a", "b", "c"]), ("old.json", ["b", "a"]), ("none.json", names), ("cut.json", names), ("cut.npz", names)):
        assert caches.adopted(spark, str(tmp_path / path), "entities", own, keys(order)) is None
