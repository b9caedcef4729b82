"""Vectors for dates, texts and scores."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import dates, scores, text, vectors
from chronoweave.operators import chain


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("ngày 8 tháng 5 năm 2013", ["2013-05-08"]), ("vào tháng 1 năm 2006", ["2006-01-01"]), ("vào ngày 14.12.2008", ["2008-12-14"]), ("ngày 13-11-2005", ["2005-11-13"]), ("SAU NĂM 2010", ["2010-01-01"]), ("on 10 October 2009", ["2009-10-10"]), ("May 8th, 2013", ["2013-05-08"]),
        ("before August, the year of 2013", ["2013-01-01"]), ("between 2008 and 2012", ["2008-01-01", "2012-01-01"]), ("từ 2008 đến 2012", ["2008-01-01", "2012-01-01"]), ("31 February 2013", ["2013-02-01"]), ("2013-05", ["2013-05-01"]), ("in 2010, after 8 May 2013", ["2013-05-08", "2010-01-01"]),
        ("May 2013 and 2013-05-01", ["2013-05-01"]), ("no date here", []), ("11/13/2005", []), (None, []), ("", []),
    ],
)
def test_anchors(spark, said, want):
    assert value(spark, dates.explicit_anchors(F.lit(said).cast("string"))) == [date.fromisoformat(d) for d in want]


def test_anchors_of_a_column(spark):
    rows = spark.createDataFrame([("in 2010",), (None,)], "q string").select(dates.explicit_anchors("q").alias("a")).collect()
    assert [r["a"] for r in rows] == [[date(2010, 1, 1)], []]


@pytest.mark.parametrize(("said", "want"), [("In which year did", "year"), ("in what month of what year", "month"), ("vào năm nào", "year"), ("THÁNG NÀO", "month"), ("When did", None), ("khi nào", None)])
def test_asked_granularity(spark, said, want):
    assert value(spark, dates.asked_granularity(F.lit(said))) == want


def test_timestamps(spark):
    assert value(spark, dates.trim_to(F.lit("2013-05-08"), F.lit("year"))) == "2013"
    assert value(spark, dates.trim_to(F.lit("2013-05-08"), F.lit("month"))) == "2013-05"
    assert value(spark, dates.granularity_of(F.lit("2013"))) == "year"
    assert value(spark, dates.granularity_of(F.lit("1-2-3-4"))) == "day"
    assert value(spark, dates.midpoint(F.lit("1960-01-01"), F.lit("1960-01-04"))) == date(1960, 1, 2)
    assert value(spark, dates.parse_ts(F.lit("2013-02-31"))) == date(2013, 2, 1)
    assert value(spark, dates.parse_ts(F.lit("2013-13-01"))) is None
    assert value(spark, dates.parse_ts(F.lit("none"))) is None


@pytest.mark.parametrize(
    ("raw", "want"),
    [("['Iran']", ["Iran"]), ("<think>['X']</think>['A', 2014]", ["A", "2014"]), ("first ['A'] then ['B']", ["B"]), ("```json\n['A']\n```", ["A"]), ("[China, Make_a_visit, Iraq, 2013-05-08]", None), ("[]", []), ("", None), (None, None), ("I do not know", None)],
)
def test_answers(raw, want):
    assert text.parse_answers(raw) == want


def test_mentions():
    assert text.parse_mentions("a ['A'] b ['B']") == ["A"]
    assert text.parse_mentions("no list") == []
    assert text.parse_mentions("[2014]") == ["2014"]


@pytest.mark.parametrize(("raw", "want"), [("a</think>b</think> c", "c"), ("<think>cut", ""), ("  <think>cut", ""), ("plain", "plain")])
def test_strip_reasoning(spark, raw, want):
    assert value(spark, text.strip_reasoning(F.lit(raw))) == want


@pytest.mark.parametrize(("vi", "en", "ok"), [("", "", False), ("Câu dịch sang đã", "", False), ("Who?", "Who?", False), ("Ai đến the Iraq?", "Who?", False), ("Ai đã đến", "Who?", False), ("Ai đã đến?", "Who?", True), ("Ai đã đến", "", True)])
def test_gate(spark, vi, en, ok):
    assert value(spark, text.good_translation(F.lit(vi), F.lit(en))) is ok


def test_scores(spark):
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert value(spark, scores.hit(strings(" South_Korea "), strings("south korea")))
    assert not value(spark, scores.hit(strings(), strings("a")))
    assert not value(spark, scores.hit(strings("B", "A"), strings("A")))
    assert not value(spark, scores.hit(F.lit(None).cast("array<string>"), strings("A")))
    assert value(spark, scores.hit_granular(strings("2013-05-08"), strings("2013"), F.lit("time")))
    assert not value(spark, scores.hit_granular(strings("2013"), strings("2013-05-08"), F.lit("time")))
    assert value(spark, scores.any_hit(strings("B", "A"), strings("a")))
    assert value(spark, scores.granularity_mismatch(F.lit("in what year"), strings("2013-05-08"), F.lit("time")))


def test_vectors(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, vectors.l2_normalize(zero)) == [0.0, 0.0]
    assert value(spark, vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    encode = vectors.hash_encoder(8)
    rows = spark.createDataFrame([("Make_a_visit",), ("make a visit",), (None,)], "t string").select(encode("t").alias("v")).collect()
    assert rows[0]["v"] == rows[1]["v"] and not any(rows[2]["v"])


@pytest.mark.parametrize(("said", "name", "want"), [
    ("What did User 1234 click on 5 January 2024?", "User_1234", ["2024-01-05"]),
    ("What did User 1234 click?", "User_123", ["1234-01-01"]),
    ("Who saw user_1234 last in 2010?", "User_1234", ["2010-01-01"]),
    (r"Who saw \Q2001\E (x) in 2010?", r"\Q2001\E_(x)", ["2010-01-01"]),
    ("Who was there in 2010?", None, ["2010-01-01"]),
    ("Who was there in 2010?", " ", ["2010-01-01"]),
])
def test_numbers_in_names_are_no_dates(spark, said, name, want):
    rows = spark.createDataFrame([("q", said, name)], "qid string, question string, main string")
    assert [str(r["anchor"]) for r in chain.explicit(rows, name="main").collect()] == want
    assert {str(r["anchor"]) for r in chain.explicit(rows).collect()} >= set(want)
