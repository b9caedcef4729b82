"""Periodic runs of words, by divide and conquer on interned word ids after Main and Lorentz.

Words are what blanks (space and the characters 9 to 13) separate, numbered from 0.  A run is a stretch of
`least` words or more, and of `times` smallest periods or more, that no neighbouring word extends keeping its period.

A text is halved again and again; a run is found at the midpoint of the smallest block that holds it.  With a period
q, it has q words of its own right or left of that midpoint m, so its ends are m less the longest common suffix of what
ends at m and at m+q, and m+q plus the longest common prefix of what begins there (the same with m-q).  These lengths are
the values of the Z-functions of the block's halves.  They are wanted only where they make a run: periods at which neither
word beside the midpoint returns have the value 0 and are passed over, then those at which too few words return; for the
rest both lengths are found in the whole text by bisecting sums of powers, all midpoints and periods of a level at a time.
Equal stretches are one run, with their smallest period.  Every run is compared word by word; where sums had agreed by
chance, its text is searched again by comparing all words at every distance.

Everything about a text happens in one task: work grows with n log n words, memory with the longest text.  Null and
empty texts have no words.  Repeated rows are handled one by one.  Extra columns pass or end as `keep` says.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.util import _q

LEAST, TIMES = 24, 3
#: Words of the texts that are searched together; a longer text is searched alone.
BLOCK_WORDS = 1 << 17
#: Pairs of midpoint and period that are looked at together.
PAIRS = 1 << 20
#: Blocks of so many words are looked at side by side, larger ones one by one.
SMALL = 512
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_POWER = np.uint64(0x9E3779B97F4A7C15)


class Sums:
    """Prefix sums of word values times powers modulo 2^64: equal stretches of words have equal differences."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.powers = np.ones(n + 1, np.uint64)
        done = 1
        while done <= n:
            step = self.powers[done - 1 : done] * _POWER
            more = min(done, n + 1 - done)
            self.powers[done : done + more] = self.powers[:more] * step
            done += more
        values = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(31)
        values *= np.uint64(0x94D049BB133111EB)
        values ^= values >> np.uint64(29)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.powers[:-1], out=self.sums[1:])

    def same(self, at: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` words from `at` on return q words later."""
        s = self.sums
        return (s[at + size] - s[at]) * self.powers[q] == s[at + q + size] - s[at + q]

    def reach(self, at: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, `most` at most, return q words later: those from `at` on, or (`back`) those before it."""
        low, high = np.zeros_like(at), most.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_] + 1) >> 1
            start = at[open_] - mid if back else at[open_]
            same = self.same(start, q[open_], mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1
        return low


def _crossing(x: np.ndarray, bounds: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(midpoint or the place q before it, q, number of the text) where a word beside a midpoint returns q words later."""
    sizes = np.diff(bounds)
    block = 1 << (2 * max(least, times) - 1).bit_length() - 1  # a shortest run in such a block has its midpoint inside
    padded = np.concatenate([np.full(SMALL, -1, x.dtype), x, np.full(SMALL, -2, x.dtype)])
    while True:
        texts = np.flatnonzero(sizes > block // 2)
        if not len(texts):
            return
        blocks = (sizes[texts] - block // 2 - 1) // block + 1
        owner = np.repeat(texts, blocks)
        first = np.repeat(np.cumsum(blocks) - blocks, blocks)
        mids = bounds[owner] + block // 2 + block * (np.arange(len(owner)) - first)
        if block <= SMALL:
            most = block // times
            steps = np.arange(1, most + 1)
            for at in range(0, len(mids), max(1, PAIRS // most)):
                m, own = mids[at : at + max(1, PAIRS // most)], owner[at : at + max(1, PAIRS // most)]
                place = (m + SMALL)[:, None] + steps
                right = (padded[place] == x[m][:, None]) | (padded[place - 1] == x[m - 1][:, None])
                place = (m + SMALL)[:, None] - steps
                left = (padded[place] == x[m][:, None]) | (padded[place - 1] == x[m - 1][:, None])
                for hit, sign in ((right, 0), (left, 1)):
                    i, k = np.nonzero(hit)
                    q = k + 1
                    yield m[i] - sign * q, q, own[i]
        else:
            for m, own in zip(mids.tolist(), owner.tolist(), strict=True):
                start, end = int(bounds[own]), int(bounds[own + 1])
                most = min(block, end - start) // times
                k = min(most, end - m - 1)
                q = np.flatnonzero((x[m + 1 : m + k + 1] == x[m]) | (x[m : m + k] == x[m - 1])) + 1
                if k < most and k + m < end and x[end - 1] == x[m - 1]:
                    q = np.append(q, end - m)
                yield np.full(len(q), m), q, np.full(len(q), own)
                k = min(most, m - start)
                before = x[m - k : m][::-1]
                hit = before == x[m]
                hit[: len(before) - 1] |= before[1:] == x[m - 1]
                if m - k > start:
                    hit[-1:] |= x[m - k - 1] == x[m - 1]
                q = np.flatnonzero(hit) + 1
                yield m - q, q, np.full(len(q), own)
        block *= 2


def _compared(x: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """Runs of one text by comparing all words at every distance."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(x) // times + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(least, times * q):
                found.setdefault((a, b + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def runs_of(x: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, in order; text i has the word ids x[bounds[i]:bounds[i + 1]]."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    if len(x) < least:
        return out
    sums, found = Sums(x), []
    for at, q, own in _crossing(x, bounds, least, times):
        start, end = bounds[own], bounds[own + 1]
        inside = (at >= start) & (at + q <= end)
        at, q, start, end = at[inside], q[inside], start[inside], end[inside]
        # One of both lengths has half of what the run has besides one period.
        half = np.maximum(-(-(least - q) // 2), -(-(times - 1) * q // 2))
        ahead, behind = at + q + half <= end, at - half >= start
        good = np.zeros(len(at), bool)
        good[ahead] = sums.same(at[ahead], q[ahead], half[ahead])
        behind &= ~good
        good[behind] = sums.same((at - half)[behind], q[behind], half[behind])
        at, q, start, end = at[good], q[good], start[good], end[good]
        if len(at):
            a = at - sums.reach(at, q, at - start, True)
            b = at + q + sums.reach(at, q, end - at - q, False)
            whole = b - a >= np.maximum(least, times * q)
            found.append(np.stack([a[whole], b[whole], q[whole]]))
    if not found:
        return out
    a, b, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, b, a))
    a, b, q = a[order], b[order], q[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    again = set()
    owners = np.searchsorted(bounds, a[fresh], side="right") - 1
    for i, s, e, p in zip(owners.tolist(), a[fresh].tolist(), b[fresh].tolist(), q[fresh].tolist(), strict=True):
        out[i].append((s - int(bounds[i]), e - s, p))
        if not np.array_equal(x[s : e - p], x[s + p : e]):
            again.add(i)
    for i in again:
        out[i] = _compared(x[bounds[i] : bounds[i + 1]], least, times)
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those that a run has after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def rewound(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """The words of a text in which every tenth document, by the digest of its id, repeats a stretch up to its end.

    A document without an id stays as it is."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * -(-(n - a) // p))[: n - a]


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least: int = LEAST, times: int = TIMES, keep: list[str] | None = None, rewrite: Callable[[str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Adds `runs` (start, length, period in words, in order) and `collapsed`, the words that no run repeats joined by
    one space, to `docs`; columns of these names are replaced.

    `rewrite` may change the words of a text, by its id as text, before they are searched."""
    names = ("runs", "collapsed")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    schema = T.StructType([*[docs.schema[c] for c in kept], *T._parse_datatype_string(f"runs {RUNS}, collapsed string")])
    out_names, passes = [f.name for f in schema], len(kept)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def searched(batch: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        sizes = [len(w) for w in texts]
        ids = np.fromiter((numbers[w] for words in texts for w in words), np.int32, sum(sizes))
        rows, short = runs_of(ids, np.r_[0, np.cumsum(sizes)].astype(np.int64), least, times), []
        for words, runs in zip(texts, rows, strict=True):
            if runs:
                stays = kept_words(len(words), runs)
                words = [words[i] for i in np.flatnonzero(stays).tolist()]
            short.append(b" ".join(words))
        runs = pa.array([[{"start": a, "length": n, "period": q} for a, n, q in r] for r in rows], kind)
        return pa.RecordBatch.from_arrays([*batch.columns[:passes], runs, pa.array(short, pa.binary()).cast(pa.string())], names=out_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, words = 0, [], 0
            for at in range(batch.num_rows):
                found = (batch.column(passes)[at].as_py() or "").encode().split()
                if rewrite:
                    found = rewrite(batch.column(passes + 1)[at].as_py(), found)
                if held and words + len(found) > BLOCK_WORDS:
                    yield searched(batch.slice(first, len(held)), held)
                    first, held, words = at, [], 0
                held.append(found)
                words += len(found)
            if held:
                yield searched(batch.slice(first, len(held)), held)

    sent = docs.select(*[F.col(_q(c)) for c in kept], F.col(_q(text)).alias("_text"), F.col(_q(doc_id)).cast("string").alias("_id"))
    return sent.mapInArrow(run, schema)


def report(found: DataFrame) -> DataFrame:
    """n_runs, the run with the greatest length/period (the first of equals, null without runs), and the digests of all runs and of the collapsed text."""
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda acc, x: F.when(x["length"] * acc["period"] > acc["length"] * x["period"], x).otherwise(acc))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return (
        found.withColumn("_best", best)
        .withColumn("n_runs", F.size("runs").cast("long"))
        .withColumns({c: F.col(f"_best.{c}") for c in ("start", "length", "period")})
        .withColumn("exponent_milli", F.expr("1000 * _best.length div _best.period"))
        .withColumn("runs_sha256", F.sha2(F.concat_ws("", lines), 256))
        .withColumn("collapsed_sha256", F.sha2("collapsed", 256))
        .drop("runs", "collapsed", "_best")
    )
