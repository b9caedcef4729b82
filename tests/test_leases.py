"""Claims that run out, fail, are given up; a budget that ends a run between waves."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.streaming import leases

QUESTION = T.StructType().add("qid", "string").add("k", "long")
ROW = T.StructType().add("qid", "string").add("try", "integer").add("error", "string").add("cost", "double")


def run(spark, folder, score, until, **how):
    spend = leases.Spend(how.pop("max_usd", None), tell=how.pop("tell", lambda share: None))
    args = (spark, str(folder / "questions"), QUESTION, score, str(folder / "journal"), ROW, str(folder / "checkpoint"), spend)
    leases.run(*args, until=until, seconds=120, lease_seconds=0.5, every="200 milliseconds", partitions=2, **how)
    rows = spark.read.schema(ROW).option("recursiveFileLookup", "true").json(str(folder / "journal")).collect()
    return spend, rows


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("q"), "id").alias("qid"), F.col("id").alias("k"))
    rows.unionAll(rows.limit(5)).write.json(str(tmp_path / "questions"))
    return tmp_path


def test_claims(spark, folder):
    """Every fifth question's first claim dies, every seventh's fails once, one fails for ever: the others are asked once."""
    dies, fails = (F.col("k") % 5 == 0) & (F.col("try") == 1), (F.col("k") == 13) | (F.col("k") % 7 == 0) & (F.col("try") == 1)
    score = lambda df: df.where(~dies).select("qid", "try", F.when(fails, "down").otherwise("").alias("error"), F.lit(1.0).alias("cost"))
    spend, rows = run(spark, folder, score, lambda s: s.given_up == 1 and s.rows >= 46)
    tries = {}
    for r in rows:
        tries.setdefault(r["qid"], []).append((r["try"], r["error"]))
    want = {}
    for k in range(40):
        want[f"q{k}"] = [(t, "down") for t in (1, 2, 3)] if k == 13 else [(2, "")] if k % 5 == 0 else [(1, "down"), (2, "")] if k % 7 == 0 else [(1, "")]
    assert {q: sorted(t) for q, t in tries.items()} == want
    assert spend.rows == len(rows) == spend.spent


def test_budget(spark, folder):
    """The run ends before the wave that would pass the budget, having told at both marks once; the next start asks the rest."""
    told = []
    score = lambda df: df.select("qid", "try", F.lit("").alias("error"), F.lit(0.5).alias("cost"))
    spend, rows = run(spark, folder, score, lambda s: False, max_usd=10.0, wave_rows=8, tell=told.append)
    assert 10 <= spend.spent < 16 and spend.rows == len(rows) == 2 * spend.spent and len({r["qid"] for r in rows}) == len(rows) and len(told) == 2
    spend, rows = run(spark, folder, score, lambda s: s.rows >= 40)
    assert spend.spent == 20 and sorted(r["qid"] for r in rows) == sorted(f"q{k}" for k in range(40))


def test_a_run_that_goes_on_is_not_cut(spark, folder):
    """Before, a run was over after so many seconds, whatever was still to be asked."""
    spend = leases.Spend()
    score = lambda df: df.select("qid", "try", F.lit("").alias("error"), F.lit(1.0).alias("cost"))
    args = (spark, str(folder / "questions"), QUESTION, score, str(folder / "journal"), ROW, str(folder / "checkpoint"), spend)
    leases.run(*args, until=lambda s: s.rows >= 40, seconds=2, lease_seconds=60, every="200 milliseconds", partitions=2, wave_rows=4, files_per_batch=1)
    assert spend.rows == 40
    leases.run(*args, until=lambda s: False, seconds=2, lease_seconds=60, every="200 milliseconds", partitions=2)  # nothing comes any more: it ends
