"""Benchmark decontamination by word windows.

Items and documents are lower-cased (A-Z only) and cut into words.  Every run of
`width` item words is a window; an item with fewer words, but not none, is one
window.  The windows' hashes go to the executors as a sorted set, behind a
check of the items' bytes; those of a larger benchmark are joined with the documents' windows that pass
a Bloom filter, which is sized by the number of windows up to 64 MB.  A document's words become numbers of the item vocabulary (0: no item has
it), its windows are hashed by a rolling polynomial, and each hash that is in the
set is verified word by word.  A document word inside any occurrence is hit.

Null and empty texts have no words and no hits; items without words have no
window.  Equal items are all reported.  Item ids are compared and sorted as Spark casts them to strings, whatever
the benchmark's size; all items without an id are one, called by the empty string.  Repeated document rows are handled one
by one.  Extra columns of either table have no effect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.util import BLOCK_ROWS, MEMOS, Shipped, cut, map_columns, texts_of, worker_object

WIDTH = 10
#: Largest benchmark, in bytes of its texts, whose windows are broadcast; least and most bits of the filter for larger ones.
MAX_BYTES, LEAST_BITS, MOST_BITS = 8 << 20, 16, 29
MEMO_ENTRIES = 200_000
_SPANS = "array<struct<start:int,end:int>>"

#: Bytes of words stay (A-Z as a-z, bytes of other scripts as they are); all others become blanks.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FIND = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII, in UTF-8."""
    return text.encode().translate(_BYTES).split() if text else []


class WindowSet:
    """The windows of some items, by length and hash."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for item_id, text in items:
            words = words_of(text)
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            n = min(width, len(ids))
            for k in range(len(ids) - n + 1) if n else ():
                owners = by_length.setdefault(n, {}).setdefault(tuple(ids[k : k + n]), [])
                if not owners or owners[-1] != item_id:
                    owners.append(item_id)
        self.lengths = []
        for n, windows in sorted(by_length.items()):
            hashed: dict[int, list[tuple[int, ...]]] = {}
            hashes = self.hashes(np.array(list(windows), dtype=np.uint64).ravel(), n)[:: n].tolist()
            for h, w in zip(hashes, windows, strict=True):
                hashed.setdefault(h, []).append(w)
            self.lengths.append((n, np.sort(np.array(list(hashed), dtype=np.uint64)), hashed, windows))

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n numbers from each position on."""
        out = ids[: len(ids) - n + 1].copy()
        for k in range(1, n):
            out *= _MULTIPLIER
            out += ids[k : len(ids) - n + 1 + k]
        out ^= out >> np.uint64(29)
        return out * _MULTIPLIER

    def scan(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: number of words, hit spans of words, merged and in order, and ids of items found."""
        get = self.numbers.get
        per_text = [words_of(t) for t in texts]
        sizes = [len(w) for w in per_text]
        ids = np.fromiter(map(get, chain.from_iterable(per_text), repeat(0)), np.uint64, sum(sizes))
        ends = np.cumsum(sizes) if sizes else np.zeros(0, int)
        found: dict[int, list[tuple[int, int, list[str]]]] = {}
        known = np.r_[0, np.cumsum(ids > 0)]
        for n, hashes, hashed, windows in self.lengths:
            if len(ids) < n:
                continue
            # Only windows of item words throughout, within one text, can be in the set.
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            rolled = self.hashes(ids, n)[at]
            place = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            at = at[hashes[place] == rolled]
            owner = np.searchsorted(ends, at, side="right")
            for p, o in zip(at.tolist(), owner.tolist(), strict=True):
                window = tuple(ids[p : p + n].tolist())
                if p + n <= ends[o] and window in windows:  # verified word by word
                    start = p - int(ends[o]) + sizes[o]
                    found.setdefault(o, []).append((start, start + n, windows[window]))
        for i, n_words in enumerate(sizes):
            spans: list[tuple[int, int]] = []
            for start, end, _ in sorted(found.get(i, ()), key=lambda x: x[:2]):
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
                else:
                    spans.append((start, end))
            yield n_words, spans, {x for _, _, items in found.get(i, ()) for x in items}


NAMES = ("n_words", "hit_spans", "item_ids")
_PRIVATE = ("_n_words_", "_hit_spans_", "_item_ids_")


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, max_bytes: int = MAX_BYTES, keep: list[str] | None = None, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """Adds n_words, hit_spans (merged spans of word numbers, end exclusive) and item_ids (sorted as strings) to each document, or columns of other `names`; a document's column of such a name is replaced."""
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > max_bytes:
        return _find_by_join(docs, items, text, width, kept, names)
    windows = Shipped(spark, [tuple(r) for r in items.collect()])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        held = worker_object(("windows", windows.id, width), lambda: WindowSet(windows.value, width))
        texts, rows = texts_of(batch, 0), []
        for at in range(0, len(texts), 256):
            rows += held.scan(texts[at : at + 256])
        spans = pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return [pa.array([r[0] for r in rows], pa.int64()), spans, pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))]

    out = map_columns(docs, [text], run, f"_words long, _spans {_SPANS}, _items array<string>", kept)
    return out.select(*kept, F.col("_words").alias(names[0]), F.col("_spans").alias(names[1]), F.array_sort(F.array_distinct("_items")).alias(names[2]))


class _Words(dict):
    """64-bit hash of a word; at most `MEMO_ENTRIES` are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _Words()
MEMOS.append(_WORDS)


def _places(words: list[bytes], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter for each window of n words."""
    h = WindowSet.hashes(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)), n)
    return tuple((x >> np.uint64(64 - bits)).astype(np.int64) for x in (h, (h ^ h >> np.uint64(31)) * _MULTIPLIER))


def _find_by_join(docs: DataFrame, items: DataFrame, text: str, width: int, kept: list[str], names: tuple[str, str, str]) -> DataFrame:
    """The same findings for benchmarks that can't be broadcast.

    A Bloom filter of the items' windows lets few of the documents' windows pass; those are joined with the items' windows by
    their words.  Windows that the same items have are one class, so a passage of many items and many documents is a row for
    each of both, not for each pair.  Findings belong to a text, so equal texts share them, and rows need no id."""
    spark = docs.sparkSession

    def of_item(words: list[bytes]) -> range:
        n = min(width, len(words))
        return range(len(words) - n + 1) if n else range(0)

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, sizes = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch, 1), strict=True):
                words = words_of(t)
                n = min(width, len(words))
                own = {b" ".join(words[k : k + n]) for k in of_item(words)}
                ids += [i] * len(own)
                found += own
                sizes += [n] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary()), pa.array(sizes, pa.int32())], names=["item", "window", "n"])

    windows = cut(items.mapInArrow(item_windows, "item string, window binary, n int"), spark)
    per_length = {r["n"]: r["k"] for r in windows.groupBy("n").agg(F.approx_count_distinct("window").alias("k")).collect()}  # at most `width`
    lengths, bits = [*per_length], min(MOST_BITS, max(LEAST_BITS, (8 * sum(per_length.values())).bit_length()))

    def filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for batch in batches:
            for t in texts_of(batch, 1):
                words = words_of(t)
                for places in _places(words, min(width, len(words)), bits) if words else ():
                    held[places] = True
        packed = np.packbits(held).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(packed[at])], names=["at", "bits"])

    parts = items.mapInArrow(filter_bits, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 1 << MOST_BITS - 6 rows
    packed = np.zeros(1 << bits - 6, np.int64)
    packed[parts["at"].to_numpy()] = parts["bits"].to_numpy()
    bloom = Shipped(spark, packed)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_object(("bloom", bloom.id), lambda: np.unpackbits(bloom.value.view(np.uint8)).view(bool))
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                keys, starts, sizes, found = [], [], [], []
                for key, t in zip(batch.column(0).to_pylist(), texts_of(batch, 1), strict=True):
                    words = words_of(t)
                    for n in lengths:
                        if len(words) >= n:
                            one, two = _places(words, n, bits)
                            for k in np.flatnonzero(held[one] & held[two]).tolist():
                                keys.append(key)
                                starts.append(k)
                                sizes.append(n)
                                found.append(b" ".join(words[k : k + n]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(found, pa.binary())], names=["key", "start", "n", "window"])

    def count(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([len(words_of(t)) for t in texts_of(batch, 0)], pa.int64())]

    key = F.sha2(F.col(text), 256)
    asked = docs.where(F.col(text).isNotNull()).select(key.alias("key"), F.col(text).alias("t"))
    passed = cut(asked.mapInArrow(candidates, "key string, start int, n int, window binary").distinct(), spark)
    both = lambda c: F.struct(F.bit_xor(F.xxhash64(c)).alias("one"), F.bit_xor(F.xxhash64(c, F.lit(1))).alias("two"), F.count(F.lit(1)).alias("n"))
    classes = cut(windows.groupBy("window").agg(both("item").alias("class")), spark)
    hits = cut(passed.join(classes, "window"), spark)
    spans = hits.groupBy("key").agg(merged_spans(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("_spans"))
    # Texts that hit the same classes have the same items, which are listed once.
    own = hits.select("key", "class").distinct()
    sets = cut(own.groupBy("key").agg(both("class").alias("set")), spark)
    first = sets.groupBy("set").agg(F.min("key").alias("key"))
    members = windows.select("window", "item").join(classes, "window").select("class", "item").distinct()
    listed = first.join(own, "key").join(members, "class").select("set", "item").distinct().groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("_items"))
    found = spans.join(sets.join(listed, "set"), "key").select("key", "_spans", "_items")
    counted = map_columns(docs.withColumn("_key", key), [text], count, "_words long", [*kept, "_key"])
    out = counted.join(found.withColumnRenamed("key", "_key"), "_key", "left")
    return out.select(*kept, F.col("_words").alias(names[0]), F.coalesce("_spans", F.array().cast(_SPANS)).alias(names[1]), F.coalesce("_items", F.array().cast("array<string>")).alias(names[2]))


def merged_spans(*spans):
    """Union of arrays of spans, merged and in order."""
    ordered = F.array_sort(F.concat(*spans))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def report(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated in place of the arrays."""
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    return (
        found.withColumn("n_hit", hits)
        .withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "item_ids"), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop("hit_spans", "item_ids")
    )


def without_hits(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (word numbers, end exclusive) and what stands between them."""
    places = [m.span() for m in _FIND.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` with every hit span cut out of its text; other columns stay."""
    found = find(docs, benchmark, text=text, names=_PRIVATE, **options)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        spans = [[(s["start"], s["end"]) for s in row] for row in batch.column(1).to_pylist()]
        return [pa.array([t if not s or t is None else without_hits(t, s) for t, s in zip(batch.column(0).to_pylist(), spans, strict=True)], pa.string())]

    return map_columns(found, [text, _PRIVATE[1]], run, f"`{text}` string", [c for c in docs.columns if c != text]).select(*docs.columns)


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit."""
    return find(docs, benchmark, names=_PRIVATE, **options).where(F.size(_PRIVATE[1]) == 0).select(*docs.columns)

