"""Phrases against SQL, counts against loops."""

import random
from collections import Counter

import numpy as np
import pytest

from chronoweave.llm import phrases


def test_query_equals_sql(same):
    assert same("op13_phrases") > 0


@pytest.mark.parametrize("seed", range(8))
def test_intervals(seed):
    """Counts by the suffix array are those of a loop, for phrases of up to five words."""
    rng = random.Random(seed)
    pieces = [[rng.randrange(1, 4) for _ in range(rng.choice((0, 1, 2, 5, 40)))] for _ in range(30)]
    ids = np.array([w for p in pieces for w in [*p, 0]])
    want = Counter((n, tuple(p[i : i + n])) for p in pieces for n in range(1, 6) for i in range(len(p) - n + 1))
    got = {(n, tuple(ids[a : a + n].tolist())): c for n, at, sizes in phrases.intervals(ids, 1, 5) for a, c in zip(at.tolist(), sizes.tolist(), strict=True)}
    assert got == want


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["A b. A b, a B!c d a b", None, "", " . ,", "x\ty x  y\nx y\vx\x1cy", "ﬀ É é É é"] * 6
    rows = [(i % 9 or None, t, (None, "en", "und")[i % 3], "a", "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, f string, phrase string")


def test_edges(spark, odd):
    """Null languages and texts, pieces of other blanks, repeated rows, clashing names: counts by loops."""
    found, rows = Counter(), odd.collect()
    for r in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        for c in ".,;:!?\n\v\f\r":
            text = text.replace(c, ".")
        for piece in text.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            found.update((r["lang"] or "und", n, " ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    got = {(r["lang"], r["n"], r["phrase"]): r["f"] for r in phrases.counts(odd, least_count=1).where("n > 0").collect()}
    assert got == found
    assert phrases.collocations(odd.limit(0)).count() == 0
    assert phrases.collocations(odd.where("text is null")).count() == 0


def test_filter_that_lets_all_pass(spark, data, monkeypatch):
    """A filter that is too small changes nothing, nor do small shards."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted(map(tuple, phrases.collocations(docs).collect()))
    monkeypatch.setattr(phrases, "MAX_BITS", 12)
    monkeypatch.setattr(phrases, "SHARD_WORDS", 3000)
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == want


def test_longer_phrases(spark):
    """Phrases of five words: only the whole one stays where its parts occur only in it, and scores are exact beyond 64 bits."""
    docs = spark.createDataFrame([("a b c d e. z",)] * 30 + [("a b",)] * 90, "text string").selectExpr("text", "'en' as lang")
    got = {r["phrase"]: r for r in phrases.collocations(docs, longest=5).collect()}
    assert set(got) == {"a b", "a b c d e"}
    assert got["a b c d e"]["l"] == 120 and got["a b c d e"]["score"] == 10**6 * 900 // (120 * 30) and got["a b"]["a"] == 120
    big = spark.sql("select (cast(1000000 as decimal(38,0)) * cast(a as decimal(20,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) * cast(r as decimal(20,0))) s from values (9000000000001L, 9000000000003L, 9000000000007L) as t(a, l, r)").first()["s"]
    assert big == 10**6 * 9000000000001**2 // (9000000000003 * 9000000000007)
