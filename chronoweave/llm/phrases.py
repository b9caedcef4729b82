"""Phrase collocation mining by suffix arrays of word ids.

Texts are lower-cased (A-Z only), cut into pieces at punctuation and line ends, and those into words at blanks and tabs.
A task interns the words of a shard of texts, sorts all suffixes of its pieces by prefix doubling, as far as the longest
phrase reaches, and reads the counts of its n-grams off the intervals of suffixes that share their first n words; counts
of all shards are summed by phrase.

Phrases are counted in passes by length: single words and pairs first, then one more word at a time.  A phrase can be as
frequent as asked only if both phrases that it has with one word less are, so a shard leaves out phrases of which one
isn't in a Bloom filter of the frequent ones.  The filter is sized by their number, up to `MAX_BITS`; what passes by
chance falls to the exact count.  So counts are those of the whole corpus, and the filter only saves shuffled rows.

Everything is per language (null: `und`).  Null and empty texts have no words.  Rows count each on its own, repeated or
not.  Extra columns have no effect; empty tables give empty results.  A shard holds whole texts: memory grows with the
longest one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.util import Shipped, _q, cut, give_back, worker_object

#: Words of a shard.
SHARD_WORDS = 1 << 20
#: Bits of the largest filter (32 MB), and of a smaller one for each phrase.
MAX_BITS, BITS_EACH = 28, 16
_COUNTS = "lang string, n int, phrase string, f bigint"
#: A-Z as a-z, characters that end a piece as a full stop.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\v\f\r" else b for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """The words of a text in UTF-8, a full stop wherever a piece ends and at the end."""
    return text.encode().translate(_BYTES).replace(b".", b" . ").split() + [b"."]


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of the pieces of `ids` (0 ends a piece) ordered by their first `depth` words or more, by prefix doubling."""
    ranks, done = ids.astype(np.int64), 1
    left = words_left(ids)
    while done < depth:
        ahead = np.zeros(len(ids), np.int64)
        if done < len(ids):
            ahead[:-done] = np.where(left[:-done] > done, ranks[done:], 0)
        keys = ranks * (int(ahead.max(initial=0)) + 1) + ahead
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        ranks[order] = np.cumsum(np.r_[1, keys[1:] != keys[:-1]])[: len(ids)]
        done *= 2
    return np.argsort(ranks, kind="stable").astype(np.int32)


def words_left(ids: np.ndarray) -> np.ndarray:
    """Words from each place to the end of its piece; 0 where one ends."""
    ends = np.flatnonzero(ids == 0)
    return (np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(len(ids))).astype(np.int32)


def intervals(ids: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, place of one occurrence, count) of all n-grams of `least` to `most` words: intervals of the suffix array whose
    neighbours have n words or more in common."""
    order, left = suffix_array(ids, most), words_left(ids)
    one, two = order[:-1], order[1:]
    common = np.ones(len(one), bool)
    for n in range(1, most + 1):
        reach = (left[one] >= n) & (left[two] >= n)
        common = common & reach
        at = np.flatnonzero(common)
        common[at] = ids[one[at] + n - 1] == ids[two[at] + n - 1]
        if n >= least:
            first = np.flatnonzero(np.r_[True, ~common])
            sizes = np.diff(np.r_[first, len(order)])
            real = left[order[first]] >= n
            yield n, order[first[real]], sizes[real]


def _hashes(words: list[np.ndarray], salt: int) -> np.ndarray:
    """A 64-bit hash for each row of word hashes."""
    out = np.full(len(words[0]), salt, np.uint64)
    for w in words:
        out = (out ^ w) * _MULTIPLIER
        out ^= out >> np.uint64(32)
    return out * _MULTIPLIER


def _places(hashed: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places in a filter of 1 << bits for each hash."""
    shift = np.uint64(64 - bits)
    return [((hashed * np.uint64(m)) >> shift).astype(np.int64) for m in (1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _salt(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _counted(docs: DataFrame, least: int, most: int, frequent: tuple[Shipped, int] | None) -> DataFrame:
    """Counts of the n-grams of `least` to `most` words in each shard; those of 0 words are the counts of all words.

    `frequent`: the filter of phrases of `least` - 1 words, and its bits."""
    names = ["lang", "n", "phrase", "f"]

    def shard(lang: str, numbers: dict[bytes, int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, words = np.concatenate(parts), pa.array(list(numbers), pa.binary()).cast(pa.string())
        if frequent:
            bits = frequent[1]
            held = worker_object(("phrases", frequent[0].id), lambda: np.unpackbits(frequent[0].value.view(np.uint8), bitorder="little").view(bool))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))[ids]
        elif least == 1:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([int((ids > 0).sum())], pa.int64())], names=names)
        for n, places, sizes in intervals(ids, least, most):
            if frequent:  # both phrases with one word less may be frequent
                for skip in (0, 1):
                    hashed = _hashes([hashes[places + skip + k] for k in range(n - 1)], _salt(lang))
                    good = np.logical_and.reduce([held[p] for p in _places(hashed, bits)])
                    places, sizes = places[good], sizes[good]
            for at in range(0, len(places), 1 << 16):
                some = places[at : at + (1 << 16)]
                phrase = pc.binary_join_element_wise(*(words.take(pa.array(ids[some + k])) for k in range(n)), " ")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(np.full(len(some), n, np.int32)), phrase, pa.array(sizes[at : at + (1 << 16)])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        words = 0
        for batch in batches:
            for k in range(batch.num_rows):
                lang, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if not text:
                    continue
                if lang not in held:
                    numbers: dict[bytes, int] = defaultdict(count().__next__)
                    numbers[b"."]
                    held[lang] = numbers, []
                found = words_of(text)
                held[lang][1].append(np.fromiter(map(held[lang][0].__getitem__, found), np.int32, len(found)))
                words += len(found)
                if words >= SHARD_WORDS:
                    for key, (numbers, parts) in held.items():
                        yield from shard(key, numbers, parts)
                    held, words = {}, 0
                    give_back()
        for key, (numbers, parts) in held.items():
            yield from shard(key, numbers, parts)

    return docs.mapInArrow(run, _COUNTS).groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))


def _filter(phrases: DataFrame) -> tuple[Shipped, int] | None:
    """A Bloom filter of `phrases` (lang, phrase), with its bits; none if there are none."""
    number = phrases.count()
    if not number:
        return None
    bits = min(MAX_BITS, max(12, (number * BITS_EACH - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for batch in batches:
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [np.array([xxhash.xxh3_64_intdigest(w)], np.uint64) for w in phrase.encode().split(b" ")]
                for place in _places(_hashes(words, _salt(lang)), bits):
                    held[place] = True
        packed = np.packbits(held, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(packed[at])], names=["at", "bits"])

    parts = phrases.select("lang", "phrase").mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 1 << MAX_BITS - 6 rows
    packed = np.zeros(1 << bits - 6, np.int64)
    packed[parts["at"].to_numpy()] = parts["bits"].to_numpy()
    return Shipped(phrases.sparkSession, packed), bits


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", *, longest: int = 3, least_count: int = 10) -> DataFrame:
    """lang, n, phrase, f: all phrases of 1 to `longest` words with f >= least_count, and the number of all words as n = 0."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(_q(lang)).cast("string"), F.lit("und")).alias("lang"), F.col(_q(text)).alias("text"))
    wanted = (F.col("f") >= least_count) | (F.col("n") == 0)
    found = last = cut(_counted(rows, 1, 2, None).where(wanted), spark)
    for n in range(3, longest + 1):
        held = _filter(last.where(F.col("n") == n - 1))
        if held is None:
            break
        last = cut(_counted(rows, n, n, held).where(wanted), spark)
        found = found.unionByName(last)
    return found


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", *, longest: int = 3, least_count: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of 2 to `longest` words.

    a, l and r are the counts of the phrase and of both parts of its weakest cut, score is floor(10^6 a^2 / (l r)), n the
    number of the language's words.  A phrase goes if a longer one that holds it has `percent` of its count or more."""
    found = counts(docs, text, lang, longest=longest, least_count=least_count)
    phrases = found.where("n >= 1").select("lang", "phrase", "f")
    whole = found.where("n >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, size: F.concat_ws(" ", F.slice("w", start, size))
    cuts = whole.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    # Products of three counts: decimals hold 38 digits.
    score = F.expr("(cast(1000000 as decimal(38, 0)) * cast(a as decimal(20, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) * cast(r as decimal(20, 0)))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c"))
    weakest = weakest.select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    if longest > 2:
        inner = whole.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
        inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("s"))
        holders = inner.select("lang", part(F.col("s"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        weakest = weakest.join(holders, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = found.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The registered query in SQL.
SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM pieces, unnest(range(1, 4)) AS a(k), unnest(range(1, greatest(len(w) - k + 2, 1))) AS b(i)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM candidates) AS c
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : c.k], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(w[c.k + 1 :], ' ')
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, inner_phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase FROM candidates WHERE len(w) = 3) GROUP BY ALL
), ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank
  FROM weakest AS c LEFT JOIN longer AS h ON h.lang = c.lang AND h.inner_phrase = c.phrase WHERE h.a IS NULL OR 100 * h.a < 50 * c.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
