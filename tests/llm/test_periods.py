"""Periodic runs against a search that compares all words at every distance and takes each period anew."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.llm import periods


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[:-q])


def brute(words, least=24, times=3):
    """Every stretch that has a period and can't be extended with it, by loops over starts and periods."""
    n, found = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and smallest_period(words[i : j + q]) == q:
                found.add((i, j + q - i, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def search(words, **how):
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([names[w] for w in words], np.int32)
    return periods.runs_of(x, np.array([0, len(x)]), **how)[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 30), st.integers(2, 4))
def test_small_alphabets(words, least, times):
    assert search(words, least=least, times=times) == brute(words, least, times)


@pytest.mark.parametrize("seed", range(12))
def test_nested_long_and_batched(seed):
    """Runs of many periods, nested, at the edges of texts and blocks; several texts searched together."""
    rng, texts = random.Random(seed), []
    for _ in range(6):
        words = []
        while len(words) < rng.choice((0, 30, 400, 1500)):
            unit = [rng.randrange(rng.choice((1, 2, 5, 1000))) for _ in range(rng.choice((1, 2, 7, 40, 170)))]
            words += unit * rng.choice((1, 1, 2, 3, 6)) + unit[: rng.randrange(len(unit))]
        texts.append(words)
    x = np.array([w for t in texts for w in t], np.int32)
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    assert periods.runs_of(x, bounds) == [brute(t) for t in texts]


def test_sums_that_agree_by_chance(monkeypatch):
    """If sums can't tell stretches apart, runs are found all the same."""
    words = [0, 1, 2] * 20 + list(range(9, 60))
    monkeypatch.setattr(periods.Sums, "same", lambda self, at, q, size: np.ones(len(at), bool))
    assert search(words) == brute(words)


def test_edges(spark):
    """Nulls, empty texts, repeated rows, blanks of other kinds, a very long text, clashing names."""
    long = " ".join(f"w{i % 7}" for i in range(60_000))
    rows = [(None, None, "x"), (None, "a " * 30, "y"), (1, "", "z"), (1, "", "z"), (7, "b c\x1cd " * 24, "n"), (8, long, "n"), (9, " \t\n", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {(r["doc_id"], r["collapsed"]): r["runs"] for r in periods.find(df).collect()}
    assert got[(None, "")] == [] and got[(1, "")] == [] and got[(9, "")] == []
    assert got[(None, "a")] == [(0, 30, 1)] and got[(7, "b c\x1cd")] == [(0, 24, 1)]
    assert got[(8, " ".join(f"w{i}" for i in range(7)))] == [(0, 60_000, 7)]
    assert periods.find(df.limit(0)).count() == 0
    assert [r["n_runs"] for r in periods.report(periods.find(df, keep=["doc_id"])).where("doc_id = 1").collect()] == [0, 0]


def test_query(spark, data):
    """The registered query against the brute search, on every document of up to 1,500 words."""
    import __spark_entry__ as entry

    got = {r["doc_id"]: r for r in entry.queries()["op12_periodic_runs"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    checked = 0
    for d in docs:
        words = planted(d["doc_id"], [w.decode() for w in (d["text"] or "").encode().split()])
        if len(words) > 1500:
            continue
        runs, r = brute(words), got[d["doc_id"]]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want = (len(runs), *best, None if not runs else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
        assert tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == want
        checked += bool(runs)
    assert checked > 5
