"""Substring dedup by line and sentence hashing.

Units are the lines of a text or, where a line has several, its sentences (they end
at `.`, `!` or `?` before a blank).  A unit is normalised to lower case with single
blanks; units without any other character are none.  Digests of all units are
grouped over all documents; the occurrence with the smallest document id, then the
smallest offset, stays, every other one is a repeat.  Offsets are those of the
original text in code points, ends exclusive.

Every repeat is reported, with the length of its run: the characters of the repeats that follow each other in its
document, itself among them.  `remove` takes all of them out; as short units repeat by chance, a caller may leave those in
runs of fewer than `run_chars` characters where they are.  `long_run` says which have `RUN_CHARS` or more.

The smallest occurrence of each digest is a partial aggregate, so a unit in a
third of all documents costs one row for each task.  Only digests that occur twice
are joined back; they are written out first, so that the join's large partitions
can be split.  Runs are found in windows by document, over its repeats only.

Null and empty texts have no units.  Rows with one id are one document: equal
units at the same offset of it are one occurrence; rows without an id are left
alone.  Ids are whole numbers, others are an error.  Extra columns have no effect.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.util import BLOCK_ROWS, cut, map_columns, texts_of

#: Characters from which on a run of repeats is hardly one by chance.
RUN_CHARS = 120
_SENTENCE = re.compile(r"(?<=[.!?]) ")
_BLANKS = re.compile(r"[\t\v\f\r ]+")


def units(text: str | None) -> Iterator[tuple[bytes, int, int, int]]:
    """(digest of the normalised unit, its length, start, end)."""
    start = 0
    for line in (text or "").split("\n"):
        low = line.lower()
        same = len(low) == len(line)
        cuts = [0, *(m.end() for m in _SENTENCE.finditer(line)), len(line) + 1]
        for k in range(len(cuts) - 1):
            a, b = cuts[k], cuts[k + 1] - 1
            unit = _BLANKS.sub(" ", low[a:b] if same else line[a:b].lower()).strip(" ")
            if unit:
                yield hashlib.md5(unit.encode()).digest(), len(unit), start + a, start + b
        start += len(line) + 1


def exploded(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """digest, doc_id, k (the unit's number in its text), size, start, end of every unit."""
    names = ["digest", "doc_id", "k", "size", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                found = [list(units(t)) for t in texts_of(batch, 1)]
                counts = [len(u) for u in found]
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), counts)))
                numbers = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in counts)])
                flat = [u for us in found for u in us]
                columns = [pa.array([u[i] for u in flat], kind) for i, kind in enumerate((pa.binary(), pa.int32(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([columns[0], ids, pa.array(numbers), *columns[1:]], names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "digest binary, doc_id long, k int, size int, start int, end int")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end of every repeated unit, kept_doc_id, kept_start of the occurrence that stays, and run_chars and long_run of its run of repeats."""
    found = exploded(docs, doc_id, text)
    place = F.struct("doc_id", "start")
    firsts = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    firsts = cut(firsts.select("digest", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start")), docs.sparkSession)
    again = found.join(firsts, "digest").where("doc_id <> kept_doc_id or start <> kept_start").drop("digest").distinct()
    again = again.withColumn("run", F.col("k") - F.dense_rank().over(W.partitionBy("doc_id").orderBy("k")))
    again = again.withColumn("run_chars", F.sum("size").over(W.partitionBy("doc_id", "run")))
    return again.select("doc_id", "start", "end", "kept_doc_id", "kept_start", "run_chars", (F.col("run_chars") >= RUN_CHARS).alias("long_run"))


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the spans, which may overlap."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a] if a > at else "")
        at = max(at, b)
    return "".join([*out, text[at:]])


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_chars: int = 1) -> DataFrame:
    """`docs` with the repeated units in runs of `run_chars` characters or more cut out of its texts, and `removed`, their original spans; a column of that name is replaced."""
    docs = docs.drop("removed")
    spans = repeats(docs, doc_id, text).where(F.col("run_chars") >= run_chars).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed")).withColumnRenamed("doc_id", "_id")
    joined = docs.join(spans, F.col(doc_id) == F.col("_id"), "left").drop("_id")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = [without(t, [(s["start"], s["end"]) for s in row or ()]) for t, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        return [pa.array(out, pa.string())]

    return map_columns(joined, [text, "removed"], run, f"`{text}` string").select(*docs.columns, "removed")


#: The same units and removals in SQL, for tables whose documents have one row each.
SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line, sum(length(l[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l[i]) - 1 AS line_at
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i)
), parts AS (
  SELECT doc_id, line_at, s[j] AS part, sum(length(s[j]) + 1) OVER (PARTITION BY doc_id, i ORDER BY j) - length(s[j]) - 1 AS inside
  FROM (SELECT doc_id, i, line_at, string_split(replace(replace(replace(line, '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1)), chr(1)) AS s FROM lines), unnest(range(1, len(s) + 1)) AS r(j)
), normal AS (
  SELECT doc_id, line_at + inside AS start, line_at + inside + length(part) AS "end", trim(regexp_replace(lower(part), '[\t\v\f\r ]+', ' ', 'g'), ' ') AS unit FROM parts
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k FROM normal WHERE unit <> ''
), firsts AS (
  SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start
  FROM numbered WINDOW w AS (PARTITION BY unit ORDER BY doc_id, start)
), again AS (
  SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM firsts WHERE doc_id <> kept_doc_id OR start <> kept_start
), sized AS (
  SELECT *, sum(length(unit)) OVER (PARTITION BY doc_id, run) AS size FROM again
)
SELECT doc_id, start::INT AS start, "end"::INT AS "end", kept_doc_id, kept_start::INT AS kept_start, size::BIGINT AS run_chars, size >= 120 AS long_run FROM sized
"""
