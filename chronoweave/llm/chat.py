"""Preference formatting, in DataFrame functions only.

For each pair of a chosen and a rejected conversation the longest common prefix of
turns (same role, same text) is rendered once as the prompt; what follows on each side
is that side's completion, with the spans to train on: the texts of assistant
turns with their end marks.  Spans count characters of the completion, ends are exclusive.

Turns are in order of turn, role and text; rows that repeat a turn count once.  A null
text is empty, a null role `unknown`.  A side without turns has an empty
completion, and a pair whose sides are equal has only a prompt.  Rows without a
pair id are in no pair.  Marks inside texts are broken by a blank so that they don't end a turn.  Extra
columns have no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, MARK, BROKEN = "<|im_start|>", "<|im_end|>", "<|im_", "<| im_"
TRAINED = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(f"{END}\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column) -> Column:
    """start:end of every trained text, comma-joined."""
    head = lambda t: F.length(t["role"]) + len(START) + 1
    body = lambda t: F.length(t["text"]) + len(END)
    none = F.slice(F.array(F.lit("")), 1, 0)
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + head(t)
        own = F.when(t["role"] == TRAINED, F.array(F.concat_ws(":", start, start + body(t)))).otherwise(none)
        return F.struct((start + body(t) + 1).alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step)["spans"], ",")


def preference_pairs(turns: DataFrame, pair_id: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask and rejected_mask of each pair.

    `side` is `chosen` or `rejected`. One shuffle brings both sides of a pair together."""
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(BROKEN))
    rows = turns.where(F.col(pair_id).isNotNull()).select(F.col(pair_id).alias("pair_id"), F.col(side).alias("side"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), clean.alias("text")).alias("t"))
    both = rows.groupBy("pair_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("t")))).alias(s[0]) for s in ("chosen", "rejected")])
    plain = both.select("pair_id", *[F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(c) for c in ("c", "r")])
    shorter = F.least(F.size("c"), F.size("r"))
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    differs = F.filter(places, lambda i: ~F.get("c", i).eqNullSafe(F.get("r", i)))
    found = plain.withColumn("n", F.coalesce(F.array_min(differs), shorter))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    return found.select(
        "pair_id",
        F.col("n").cast("long").alias("n_common"),
        _joined(F.slice("c", 1, F.col("n"))).alias("prompt"),
        _joined(rest("c")).alias("chosen"),
        _joined(rest("r")).alias("rejected"),
        _spans(rest("c")).alias("chosen_mask"),
        _spans(rest("r")).alias("rejected_mask"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs from a table of conversations: number 2k is the chosen one of pair k, 2k + 1 the rejected one."""
    return conversations.withColumn("pair_id", F.shiftright("conv_id", 1)).withColumn("side", F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected"))


def answered_by_next(conversations: DataFrame) -> DataFrame:
    """Pairs from a table of conversations: each is chosen, and rejected with the last answer of the following conversation in place of its own.

    Without an answer of its own both sides are equal; without one of the next conversation the rejected answer is empty.
    Turns without a number come first, as they are."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    last = F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last")
    lasts = rows.where((F.col("role") == TRAINED) & F.col("turn").isNotNull()).groupBy("conv_id").agg(last)
    own, following = lasts.select("conv_id", F.col("last.turn").alias("_last")), lasts.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("_reply"))
    met = rows.join(own.join(following, "conv_id", "left"), "conv_id", "left")
    replaced = F.when((F.col("turn") == F.col("_last")) & (F.col("role") == TRAINED), F.coalesce("_reply", F.lit(""))).otherwise(F.col("text"))
    side = lambda name, text: F.struct(F.lit(name).alias("side"), text.alias("text"))
    both = met.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(F.array(side("chosen", F.col("text")), side("rejected", replaced))).alias("both"))
    return both.select("pair_id", "both.side", "turn", "role", "both.text")


SQL = r"""
WITH lasts AS (
  SELECT conv_id, max({'turn': turn, 'text': coalesce(text, '')}) AS last FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY conv_id
), met AS (
  SELECT c.conv_id AS pair_id, turn, role, text, CASE WHEN turn = own.last.turn AND role = 'assistant' THEN coalesce(following.last.text, '') ELSE text END AS other
  FROM conversations c LEFT JOIN lasts own ON own.conv_id = c.conv_id LEFT JOIN lasts following ON following.conv_id = own.conv_id + 1 WHERE c.conv_id IS NOT NULL
), turns AS (
  SELECT DISTINCT pair_id, side, turn, coalesce(role, 'unknown') AS role, replace(coalesce(CASE side WHEN 0 THEN text ELSE other END, ''), '<|im_', '<| im_') AS text
  FROM met, (SELECT unnest([0, 1]) AS side)
), both_sides AS (
  SELECT pair_id,
    coalesce(list({'role': role, 'text': text} ORDER BY turn, role, text) FILTER (side = 0), []) AS c,
    coalesce(list({'role': role, 'text': text} ORDER BY turn, role, text) FILTER (side = 1), []) AS r
  FROM turns GROUP BY pair_id
), counted AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, least(len(c), len(r))) AS n FROM both_sides
), cut AS (
  SELECT pair_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM counted
), shown AS (
  SELECT *, list_transform(p, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS ps,
    list_transform(c, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS cs,
    list_transform(r, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS rs FROM cut
)
SELECT pair_id, n AS n_common, array_to_string(ps, '') AS prompt, array_to_string(cs, '') AS chosen, array_to_string(rs, '') AS rejected,
  array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: (length(array_to_string(cs[1:i - 1], '')) + 22)::VARCHAR || ':' || (length(array_to_string(cs[1:i], '')) - 1)::VARCHAR), ',') AS chosen_mask,
  array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: (length(array_to_string(rs[1:i - 1], '')) + 22)::VARCHAR || ':' || (length(array_to_string(rs[1:i], '')) - 1)::VARCHAR), ',') AS rejected_mask
FROM shown
"""
