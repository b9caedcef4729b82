"""Scores of one answered question, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.functions import dates, text

TIME = "time"


def hit(pred: Column, gold: Column) -> Column:
    """Whether the first prediction is a gold answer."""
    return F.coalesce(F.array_contains(F.transform(gold, text.normalize), text.normalize(F.get(pred, 0))), F.lit(False))


def time_matches(value: Column, gold: Column) -> Column:
    """Whether a timestamp equals a gold one at the gold's grain."""
    return dates.trim_to(value, dates.granularity_of(gold)) == gold


def hit_granular(pred: Column, gold: Column, answer_type: Column) -> Column:
    """Like `hit`, but a time may be finer than the gold one."""
    first = F.get(pred, 0)
    return F.when(answer_type == TIME, F.coalesce(F.exists(gold, lambda g: time_matches(first, g)), F.lit(False))).otherwise(hit(pred, gold))


def any_hit(pred: Column, gold: Column) -> Column:
    """The smoke test's looser score: any prediction among the gold answers."""
    return F.coalesce(F.arrays_overlap(F.transform(pred, text.normalize), F.transform(gold, text.normalize)), F.lit(False))


def abstained(chain_size: Column, parse_ok: Column, pred: Column) -> Column:
    """A non-empty chain, a readable answer, and nothing in it."""
    return (F.coalesce(chain_size, F.lit(0)) > 0) & parse_ok.eqNullSafe(F.lit(True)) & (F.size(F.coalesce(pred, F.array().cast("array<string>"))) == 0)


def granularity_mismatch(question: Column, gold: Column, answer_type: Column) -> Column:
    """The question asks for a coarser unit than even the coarsest gold answer has."""
    asked = dates.asked_granularity(question)
    coarsest = F.array_min(F.transform(gold, dates.parts_of))
    return F.coalesce((answer_type == TIME) & (F.size(gold) > 0) & asked.isNotNull() & (coarsest > dates.parts_for(asked)), F.lit(False))


def reasoning_loss(is_hit: Column, in_chain: Column) -> Column:
    """A miss whose answer was in the chain."""
    return ~F.coalesce(is_hit, F.lit(False)) & F.coalesce(in_chain, F.lit(False))


def relation_expanded(relation_ids: Column) -> Column:
    return F.size(F.coalesce(relation_ids, F.array().cast("array<string>"))) > 1


def at_asked_grain(answers: Column, question: Column, answer_type: Column) -> Column:
    """Time answers trimmed to the unit that the question asks for; others unchanged."""
    asked = dates.asked_granularity(question)
    plain = F.transform(answers, text.strip)
    trimmed = F.transform(plain, lambda a: dates.trim_to(a, asked))
    return F.when((answer_type == TIME) & (F.size(answers) > 0), F.when(asked.isNull(), plain).otherwise(trimmed)).otherwise(answers)


def top_k(qlabel: Column) -> Column:
    """How many answers a prompt asks for."""
    return F.when(qlabel == "Multiple", 5).otherwise(1)
