"""Normalising, tokenising and parsing of texts."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGES = r"(?U)^\s+|\s+$"

# Marks of failed translations, letters of Vietnamese, English words that a translation must not keep.
LEAKS = ("dịch sang", "chú thích", "tôi không thể", "i cannot", "as an ai", "i'm sorry")
VIETNAMESE = r"[àáâãèéêìíòóôõùúăđĩũơưẠ-ỹÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯ]"
ENGLISH = r"(?iuU)\b(the|who|whom|when|which|leader|minister|president|before|after|first|last|with|from|of|and|country|countries|government)\b"
PREAMBLE = r"(?iuU)^(câu hỏi\s*(đã\s*)?dịch\s*sang\s*tiếng\s*việt\s*(là)?\s*:?\s*)"
FIRST_WORDS = ("đầu tiên", "lần đầu tiên", "sớm nhất", "first", "earliest")
LAST_WORDS = ("cuối cùng", "lần cuối cùng", "gần đây nhất", "muộn nhất", "last", "latest")
# Marks of deliberation and of fenced blocks in model output.
OPEN, CLOSE = "<think>", "</think>"
FENCE, FENCE_TAGS = "```", ("json", "python")
BGE_MARK, BGE_PREFIX = "bge-base-en", "Represent this sentence for searching relevant passages: "


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, _EDGES, "")


def normalize(c: Column) -> Column:
    """Form in which answers are compared: stripped, lower case, blanks for underscores."""
    return F.translate(F.lower(strip(c)), "_", " ")


def mention_key(c: Column) -> Column:
    """Form in which mentions are looked up; equal to `normalize` but for the order of steps."""
    return F.lower(F.translate(strip(c), "_", " "))


def relation_key(c: Column) -> Column:
    """Relations are looked up without replacing underscores."""
    return F.lower(strip(c))


def without_name(c: Column, name: Column) -> Column:
    """The text with an underscore for each mention of a name, in its own form or in plain words; a mention within a longer word is none."""
    quoted = lambda n: F.concat(F.lit(r"\Q"), F.replace(n, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    either = F.concat(F.lit(r"(?iuU)(?<!\w)(?:"), quoted(name), F.lit("|"), quoted(F.translate(name, "_", " ")), F.lit(r")(?!\w)"))
    return F.when(strip(name) != "", F.regexp_replace(c, either, F.lit("_"))).otherwise(c)


def fact_tuple(s: Column, p: Column, o: Column, ts: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", s, p, o, ts), F.lit("]"))


def fact_text(s: Column, p: Column, o: Column, ts: Column) -> Column:
    plain = F.translate(F.concat_ws(" ", s, p, o), "_", " ")
    return F.concat(plain, F.lit(" ("), ts, F.lit(")"))


def fact_line(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws(" ", s, p, o)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased text contains one of the strings, also inside words."""
    low = F.lower(c)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def strip_reasoning(c: Column) -> Column:
    """What follows the last closed deliberation; nothing if one was opened and not closed."""
    return F.when(c.contains("</think>"), strip(F.substring_index(c, "</think>", -1))).when(F.regexp_replace(c, r"(?U)^\s+", "").startswith("<think>"), "").otherwise(c)


def clean_translation(c: Column) -> Column:
    """The last paragraph, or else line, without a preamble."""
    text = strip(c)
    last = lambda mark: F.element_at(F.filter(F.transform(F.split(text, mark), strip), lambda p: p != ""), -1)
    return strip(F.regexp_replace(F.when(text.contains("\n\n"), last("\n\n")).when(text.contains("\n"), last("\n")).otherwise(text), PREAMBLE, ""))


def keeps_question_mark(source: Column, target: Column) -> Column:
    return ~strip(source).endswith("?") | strip(target).endswith("?")


def good_translation(target: Column, source: Column) -> Column:
    """Quality gate of a Vietnamese translation; an empty source asks for no question mark."""
    return F.coalesce((target != "") & ~has_any(target, LEAKS) & target.rlike(VIETNAMESE) & ~target.rlike(ENGLISH) & ((source == "") | keeps_question_mark(source, target)), F.lit(False))


def numbered_line(text: Column, index: int | Column, fallback: Column) -> Column:
    """The index-th non-empty line without its number, or the fallback with blanks for underscores."""
    found = F.filter(F.transform(F.split(text, r"\R"), strip), lambda x: x != "")
    line = F.coalesce(F.get(found, index), F.translate(fallback, "_", " "))
    return F.when(line.rlike(r"^\p{Nd}"), strip(F.regexp_replace(line, r"^[^.]*\.", ""))).otherwise(line)


def query_prefix(model: Column, text: Column) -> Column:
    """Queries of one encoder family carry an instruction; passages never do."""
    return F.when(F.lower(model).contains(BGE_MARK), F.concat(F.lit(BGE_PREFIX), text)).otherwise(text)


def slug(model: Column) -> Column:
    """File-safe tag of an encoder: the last part of its name, other characters than letters, digits, `-._` as `-`."""
    return F.regexp_replace(F.substring_index(model, "/", -1), r"[^\p{L}\p{N}\-._]", "-")


# --- lists in model output: literals, which only a parser can tell -----------------------------------


@dataclass
class _Scan:
    """What one walk over a model's output finds: lists between brackets without others inside, and lists that fill a fenced block."""

    flat: list[str] = field(default_factory=list)
    fenced: list[str] = field(default_factory=list)


def _scan(text: str) -> _Scan:
    found, opened, fence, at = _Scan(), -1, -1, 0
    while at < len(text):
        if text.startswith(FENCE, at):
            body = text[fence:at].strip() if fence >= 0 else ""
            if body.startswith("[") and body.endswith("]"):
                found.fenced.append(body)
                fence = -1
            else:  # what didn't close a list may open one
                fence = at + len(FENCE)
                fence += next((len(tag) for tag in FENCE_TAGS if text.startswith(tag, fence)), 0)
            at = max(at + len(FENCE), fence)
            continue
        if text[at] == "[":
            opened = at
        elif text[at] == "]" and opened >= 0:
            found.flat.append(text[opened : at + 1])
            opened = -1
        at += 1
    return found


def _without_thoughts(text: str) -> str:
    """The text without what stands between the marks of a deliberation, in any case; one that isn't closed stays."""
    low, out, at = text.lower(), [], 0
    if len(low) != len(text):  # a letter whose lower case is longer: places would differ
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    while (start := low.find(OPEN, at)) >= 0 and (end := low.find(CLOSE, start)) >= 0:
        out.append(text[at:start])
        at = end + len(CLOSE)
    return "".join([*out, text[at:]])


def _literal(text: str) -> list[str] | None:
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None
    return [str(x) for x in value] if isinstance(value, list) else None


def _first_list(candidates: Iterator[str]) -> list[str] | None:
    return next((x for x in map(_literal, candidates) if x is not None), None)


def parse_answers(raw: str | None) -> list[str] | None:
    """The final answer list of a model's output: of the last fenced block, all of the text, or the last brackets that hold a list.

    None if there is none, which an empty list isn't."""
    text = _without_thoughts(raw or "").strip()
    seen = _scan(text)
    return _first_list(iter((*seen.fenced[::-1][:1], text, *seen.flat[::-1])))


def parse_mentions(raw: str | None) -> list[str]:
    """The first list of a model's output, of a fenced block if there is one; empty if there is none."""
    text = (raw or "").strip()
    seen = _scan(text)
    if seen.fenced:
        text = seen.fenced[0]
        seen = _scan(text)
    return _first_list(iter((text, *seen.flat[:1]))) or []


@F.pandas_udf(T.ArrayType(T.StringType()))
def answer_list(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in raw:
        yield batch.map(parse_answers)


@F.pandas_udf(T.ArrayType(T.StringType()))
def mention_list(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in raw:
        yield batch.map(parse_mentions)
