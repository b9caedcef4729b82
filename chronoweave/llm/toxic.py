"""Toxicity by a convolutional text classifier in numpy.

Words (lower-cased, of letters and digits) have hashed embeddings: the sum of a
row of each of three tables, two picked by the halves of the word's hash, so that
two words seldom share both, one by the hash of its first `Params.stem` letters,
which inflected forms share.  Filters of several widths slide over the text, each
filter's maximum over the text is taken, and a logistic layer scores them.
Embeddings start near zero: words never seen in training hardly move a score.

Training takes all labelled rows.  It starts from a fit, on the driver, of `Params.per_class` toxic rows and `Params.clean_times`
as many others, those with the smallest hash of their id.  From there every labelled row is learnt from: parts of the rows, at most `MAX_PARTS`,
go on from the start side by side, each in a task, and what they have moved is averaged, a table's row over the parts that moved it.
A fifth of the labelled rows is kept out of both; thresholds are calibrated by language on all of it, and languages with fewer than
`Params.least` rows of either label there take the threshold of all.

Null and empty texts score like a text without words.  A document labelled twice
counts as toxic if one label says so; labels without a document and documents
without a label are no training rows.  Without any labelled row of both labels the score is
0 throughout.  Repeated document rows are each scored; extra columns have no effect.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.util import MEMOS, Shipped, delete, give_back, map_columns, texts_of, worker_object, written

_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MEMO_ENTRIES = 400_000
#: Rows of a part, until there are `MAX_PARTS` of them, which then grow. A task holds so many words of a part at once (a longer text alone).
PART_ROWS, MAX_PARTS, HELD_WORDS = 4096, 256, 1 << 20
#: Rows of a table whose moves are averaged at once.
BLOCK = 4096


@dataclass(frozen=True)
class Params:
    bits: int = 17
    size: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    stem: int = 4
    per_class: int = 2500
    clean_times: int = 2
    epochs: int = 4
    passes: int = 1
    batch: int = 32
    rate: float = 0.03
    seed: int = 7
    least: int = 20


class _Words(dict):
    """Hash of a word, 40 bits, above that of its stem, 20 bits; at most `MEMO_ENTRIES` are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        stem = word.decode("utf-8", "replace")[: Params.stem]
        found = self[word] = xxhash.xxh3_64_intdigest(word) >> 24 << 20 | xxhash.xxh3_64_intdigest(stem.encode(), seed=1) >> 44
        return found


_WORDS = _Words()
MEMOS.append(_WORDS)


def word_hashes(text: str | None) -> np.ndarray:
    words = text.lower().encode().translate(_BYTES).split() if text else []
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


@dataclass
class Model:
    """The fitted classifier; thresholds by language, "" for all others."""

    params: Params
    tables: list[np.ndarray]
    kernel: np.ndarray
    shape: np.ndarray
    biases: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=lambda: {"": 0.5})

    @staticmethod
    def fresh(p: Params) -> Model:
        """All filters as columns of one matrix over the widest window; `shape` is 0 where a filter is narrower."""
        rng = np.random.default_rng(p.seed)
        tables = [(rng.standard_normal((1 << p.bits, p.size)) * 0.01).astype(np.float32) for _ in range(3)]
        widths = np.repeat(p.widths, p.filters)
        shape = (np.repeat(np.arange(max(p.widths)), p.size)[:, None] < widths).astype(np.float32)
        kernel = (rng.standard_normal(shape.shape) / np.sqrt(widths * p.size)).astype(np.float32) * shape
        return Model(p, tables, kernel, shape, np.zeros(len(widths), np.float32), (rng.standard_normal(len(widths)) * 0.3).astype(np.float32), 0.0)

    def rows(self, hashes: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64((1 << self.params.bits) - 1)
        return [(hashes >> np.uint64(shift) & mask).astype(np.int64) for shift in (20, 42, 0)]

    def forward(self, texts: list[np.ndarray]) -> dict:
        """Scores of texts given as word hashes, and what the gradients need. Every text is followed by zero rows, so no filter spans two."""
        pad, size = max(self.params.widths), self.params.size
        sizes = np.array([len(t) + pad for t in texts])
        starts = np.cumsum(sizes) - sizes
        real = np.ones(sizes.sum(), bool)
        for k in range(pad):
            real[starts + sizes - 1 - k] = False
        rows = self.rows(np.concatenate(texts))
        x = np.zeros((len(real) + pad, size), np.float32)
        x[: len(real)][real] = self.tables[0][rows[0]] + self.tables[1][rows[1]] + self.tables[2][rows[2]]
        windows = np.lib.stride_tricks.as_strided(x, (len(real), pad * size), x.strides[:1] + x.strides[1:], writeable=False)
        maps = windows @ self.kernel
        for k in range(pad - 1):  # windows that would reach into the next text
            maps[starts + sizes - 1 - k] = -np.inf
        pooled = np.maximum(np.maximum.reduceat(maps, starts, axis=0) + self.biases, 0)
        z = np.clip(pooled @ self.out + self.bias, -30, 30)
        return {"score": 1 / (1 + np.exp(-z)), "pooled": pooled, "maps": maps, "windows": windows, "real": real, "rows": rows, "starts": starts, "sizes": sizes}

    def scores(self, texts: list[np.ndarray], words: int = 1 << 16) -> np.ndarray:
        """Scores to six decimals, `words` words at a time (a longer text alone)."""
        out, block, total = [], [], 0
        for t in [*texts, None]:
            if block and (t is None or total + len(t) > words):
                out.append(self.forward(block)["score"])
                block, total = [], 0
            if t is not None:
                block.append(t)
                total += len(t)
        return np.round(np.concatenate(out).astype(np.float64), 6) if out else np.zeros(0)


class Trainer:
    """Adagrad on the mean log loss; gradients flow through each filter's maximum only. The model's arrays are changed where they are."""

    def __init__(self, model: Model, squares: dict[str, np.ndarray] | None = None):
        self.model, self.bias = model, np.full(1, model.bias, np.float32)
        self.squares = squares or {name: np.full(value.shape, 1e-4, np.float32) for name, value in self.values().items()}

    def values(self) -> dict[str, np.ndarray]:
        m = self.model
        return {**{f"table{t}": table for t, table in enumerate(m.tables)}, "kernel": m.kernel, "biases": m.biases, "out": m.out, "bias": self.bias}

    def _step(self, name: str, value: np.ndarray, gradient: np.ndarray, at=...) -> None:
        held = self.squares[name]
        held[at] += gradient * gradient
        value[at] -= self.model.params.rate * gradient / np.sqrt(held[at])

    def epochs(self, texts: list[np.ndarray], labels: np.ndarray, times: int) -> None:
        """So many epochs over rows in memory."""
        p = self.model.params
        rng, labels = np.random.default_rng(p.seed), labels.astype(np.float32)
        for _ in range(times):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), p.batch):
                chosen = order[k : k + p.batch]
                self.learn([texts[i] for i in chosen], labels[chosen])

    def learn(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """One step by a batch."""
        model, p = self.model, self.model.params
        state = model.forward(texts)
        error = ((state["score"] - labels) / len(labels)).astype(np.float32)
        down = error[:, None] * model.out[None, :] * (state["pooled"] > 0)
        grad_out = state["pooled"].T @ error
        best = np.array([s + state["maps"][s : s + n].argmax(axis=0) for s, n in zip(state["starts"], state["sizes"], strict=True)])
        grad = np.einsum("bfd,bf->df", state["windows"][best], down) * model.shape
        spread = (down[:, :, None] * model.kernel.T[None]).reshape(-1, len(model.kernel) // p.size, p.size)
        number = np.where(state["real"], np.cumsum(state["real"]) - 1, -1)
        at = np.minimum(best.reshape(-1, 1) + np.arange(spread.shape[1]), len(number) - 1)
        at, spread = number[at].ravel(), spread.reshape(-1, p.size)
        used = (at >= 0) & spread.any(axis=1)
        at, spread = at[used], spread[used]
        for t, table in enumerate(model.tables):
            rows, back = np.unique(state["rows"][t][at], return_inverse=True)
            own = np.zeros((len(rows), p.size), np.float32)
            np.add.at(own, back, spread)
            self._step(f"table{t}", table, own, rows)
        self._step("kernel", model.kernel, grad)
        self._step("biases", model.biases, down.sum(axis=0))
        self._step("out", model.out, grad_out)
        self._step("bias", self.bias, error.sum(keepdims=True))
        model.bias = float(self.bias[0])


def fit(texts: list[np.ndarray], labels: np.ndarray, p: Params) -> Trainer:
    """A fresh model fitted on rows in memory."""
    trainer = Trainer(Model.fresh(p))
    trainer.epochs(texts, labels, p.epochs)
    return trainer


_MOVES = "name string, block int, part int, n long, at binary, moved binary"


def _moves(part: int, n: int, before: dict[str, np.ndarray], after: dict[str, np.ndarray], size: int) -> pa.RecordBatch:
    """What a part has moved: for tables the rows that differ, by blocks, for other arrays the difference."""
    out = []
    for name, value in after.items():
        moved = (value - before[name]).reshape(-1, size if name.startswith("table") else 1)
        rows = np.flatnonzero(moved.any(axis=1))
        for block in np.unique(rows // BLOCK):
            at = rows[rows // BLOCK == block]
            out.append((name, int(block), part, n, at.astype(np.int32).tobytes(), moved[at].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["name", "block", "part", "n", "at", "moved"])


def _averaged(moves: pa.Table) -> pa.Table:
    """The mean, by rows learnt from, of the moves of a block over the parts that moved it, added in the order of the parts."""
    moves = moves.sort_by("part").to_pylist()
    rows = np.unique(np.concatenate([np.frombuffer(m["at"], np.int32) for m in moves]))
    total, weight = None, np.zeros(len(rows))
    for m in moves:
        at = np.searchsorted(rows, np.frombuffer(m["at"], np.int32))
        moved = np.frombuffer(m["moved"], np.float32).reshape(len(at), -1).astype(np.float64)
        total = np.zeros((len(rows), moved.shape[1])) if total is None else total
        total[at] += m["n"] * moved
        weight[at] += m["n"]
    mean = (total / weight[:, None]).astype(np.float32)
    return pa.table({"name": [moves[0]["name"]], "at": [rows.tobytes()], "moved": [mean.tobytes()]}, pa.schema([("name", pa.string()), ("at", pa.binary()), ("moved", pa.binary())]))


def refined(rows: DataFrame, trainer: Trainer, doc_id: str = "doc_id") -> Model:
    """The trainer's model after all `rows` (doc_id, hashes, _toxic), part by part in tasks, `Params.passes` epochs over what a task holds of a part before it goes on. The driver gets the moves of one model, whatever the rows."""
    model, p, spark = trainer.model, trainer.model.params, rows.sparkSession
    parts = min(MAX_PARTS, max(1, -(-rows.count() // PART_ROWS)))
    held = Shipped(spark, (model, trainer.squares))
    hashed = F.xxhash64(F.lit(p.seed), F.col(doc_id))
    dealt = rows.select(F.pmod(hashed, F.lit(parts)).cast("int").alias("_part"), hashed.alias("_order"), F.col(doc_id).alias("_id"), "hashes", "_toxic")
    dealt = dealt.repartition(parts, "_part").sortWithinPartitions("_part", "_order", "_id").select("_part", "hashes", "_toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, squares = worker_object(("toxic", held.id), lambda: held.value)
        before, own, part, n, words, texts, labels = Trainer(start, squares).values(), None, None, 0, 0, [], []

        def learnt() -> None:
            own.epochs(texts, np.array(labels), p.passes)
            texts.clear()
            labels.clear()

        def told() -> pa.RecordBatch:
            learnt()
            return _moves(part, n, before, own.values(), p.size)

        for batch in batches:
            for k, row_part in enumerate(batch.column(0).to_pylist()):
                if row_part != part:
                    if own is not None:
                        yield told()
                    copied = Model(p, [t.copy() for t in start.tables], start.kernel.copy(), start.shape, start.biases.copy(), start.out.copy(), start.bias)
                    own, part, n = Trainer(copied, {name: s.copy() for name, s in squares.items()}), row_part, 0
                    words = 0
                text = np.frombuffer(batch.column(1)[k].as_py(), np.uint64)
                if texts and words + len(text) > HELD_WORDS:
                    learnt()
                    words = 0
                texts.append(text)
                labels.append(batch.column(2)[k].as_py())
                n, words = n + 1, words + len(text)
        if own is not None:
            yield told()

    moves = dealt.mapInArrow(run, _MOVES).groupBy("name", "block").applyInArrow(_averaged, "name string, at binary, moved binary")
    values = trainer.values()
    for row in moves.collect():  # at most the size of the model
        at = np.frombuffer(row["at"], np.int32)
        value = values[row["name"]].reshape(-1, p.size if row["name"].startswith("table") else 1)
        value[at] += np.frombuffer(row["moved"], np.float32).reshape(len(at), -1)
    model.bias = float(trainer.bias[0])
    return model


def thresholds(scored: DataFrame, least: int) -> dict[str, float]:
    """By language (`_lang`, "" for all rows) the middle of the widest range of thresholds with the best F1; only where both labels have `least` rows.

    `scored` is (_lang, score, _toxic). Rows are counted by score first, of which there are at most a million and one, as scores have six decimals."""
    counted = scored.groupBy("_lang", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("_toxic").alias("hits"))
    named = counted.where("coalesce(_lang, '') <> ''")
    both = named.unionByName(counted.groupBy("score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(F.lit("").alias("_lang"), "score", "n", "hits"))
    every, down = W.partitionBy("_lang"), W.partitionBy("_lang").orderBy(F.desc("score"))
    placed = both.select("_lang", "score", F.sum("n").over(every).alias("rows"), F.sum("hits").over(every).alias("toxic"), F.sum("n").over(down).alias("above"), F.sum("hits").over(down).alias("caught"), F.lead("score", 1, 0.0).over(down).alias("after"))
    f1 = F.when(F.col("score") == F.col("after"), -1.0).otherwise(2 * F.col("caught") / (F.col("above") + F.col("toxic")))
    known = placed.where((F.col("toxic") >= least) & (F.col("rows") - F.col("toxic") >= least)).withColumn("f1", f1)
    top = known.withColumn("best", F.max("f1").over(every)).where(F.col("f1") >= F.col("best") - 1e-12)
    chosen = top.groupBy("_lang").agg(F.max_by(F.round((F.col("score") + F.col("after")) / 2, 6), F.struct(F.col("score") - F.col("after"), "score")).alias("limit"))
    return {r["_lang"]: r["limit"] for r in chosen.collect()}  # a row for each language


def _told(labels: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, _toxic) of labels that may be learnt from, one for each document; those held out are left out."""
    key = F.crc32(F.col(doc_id).cast("string"))
    return labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull() & (key % 4 != 2)).groupBy(doc_id).agg(F.max("toxic").alias("_toxic")).where("_toxic in (0, 1)")


def _hashed(docs: DataFrame, told: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """doc_id, _lang, _toxic and hashes of the words of documents with a label in `told`."""
    rows = docs.select(F.col(doc_id), F.col(text).alias("_text"), (F.col(lang) if lang in docs.columns else F.lit(None)).cast("string").alias("_lang")).join(told, doc_id)
    rows = rows.groupBy(doc_id).agg(F.min_by("_text", F.coalesce("_text", F.lit(""))).alias("_text"), F.min("_lang").alias("_lang"), F.max("_toxic").alias("_toxic"))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([word_hashes(t).tobytes() for t in texts_of(batch, 0)], pa.binary())]

    return map_columns(rows, ["_text"], run, "hashes binary", [doc_id, "_lang", "_toxic"])


def sample(docs: DataFrame, labels: DataFrame, p: Params, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"):
    """Labelled rows that training starts from: doc_id, hashes of the words, lang and label."""
    one, order = _told(labels, doc_id), [F.xxhash64(F.col(doc_id)), F.col(doc_id)]
    chosen = one.where("_toxic = 0").orderBy(*order).limit(p.per_class * p.clean_times).unionAll(one.where("_toxic = 1").orderBy(*order).limit(p.per_class))
    ids = chosen.collect()  # at most per_class * (1 + clean_times)
    if not ids:
        return []
    few = docs.sparkSession.createDataFrame(ids, chosen.schema)
    return sorted(_hashed(docs, F.broadcast(few), doc_id, text, lang).collect(), key=lambda r: r[doc_id])


def started(docs: DataFrame, labels: DataFrame, p: Params, doc_id: str) -> Trainer | None:
    """The fit that training starts from, on rows that go with the call; None without rows of both labels."""
    rows = sample(docs, labels, p, doc_id)
    aside = np.array([zlib.crc32(f"calibration {r[doc_id]}".encode()) % 5 == 0 for r in rows], dtype=bool)
    toxic = np.array([r["_toxic"] for r in rows], dtype=np.int64)[~aside]
    if len(set(toxic.tolist())) < 2:
        return None
    return fit([np.frombuffer(r["hashes"], np.uint64) for r, a in zip(rows, aside, strict=True) if not a], toxic, p)


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), doc_id: str = "doc_id") -> Model | None:
    """The classifier and its thresholds; None without labelled rows of both labels."""
    start = started(docs, labels, p, doc_id)
    if start is None:
        return None
    give_back()
    spark = docs.sparkSession
    every = _hashed(docs, _told(labels, doc_id), doc_id, "text", "lang")
    kept_out = F.crc32(F.concat(F.lit("calibration "), F.col(doc_id).cast("string"))) % 5 == 0
    path = written(every.withColumn("_aside", kept_out), spark)
    try:
        known = spark.read.parquet(path)
        model = refined(known.where("not _aside"), start, doc_id)
        held = Shipped(spark, model)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            own = worker_object(("toxic", held.id), lambda: held.value)
            return [pa.array(own.scores([np.frombuffer(h, np.uint64) for h in batch.column(0).to_pylist()]))]

        model.thresholds |= thresholds(map_columns(known.where("_aside"), ["hashes"], run, "score double", ["_lang", "_toxic"]), p.least)
    finally:
        delete(spark, path)
    give_back()
    return model


def score(df: DataFrame, model: Model | None, text: str = "text", lang: str = "lang", keep: list[str] | None = None, names: tuple[str, str, str] = ("score", "threshold", "rejected")) -> DataFrame:
    """Adds score (double), threshold (double, by the row's language) and rejected (boolean: score >= threshold), or columns of other `names`; a column of such a name is replaced."""
    held = Shipped(df.sparkSession, model)
    thresholds = model.thresholds if model else {"": 1.1}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        own = worker_object(("toxic", held.id), lambda: held.value)
        texts, out = texts_of(batch, 0), []
        for k in range(0, len(texts), 256):
            part = [word_hashes(t) for t in texts[k : k + 256]]
            out.append(own.scores(part) if own else np.zeros(len(part)))
        return [pa.array(np.concatenate(out))]

    scored = map_columns(df, [text], run, "_score_ double", list(dict.fromkeys([*kept, *([lang] if lang in df.columns else [])])))
    limit = F.lit(thresholds[""])
    if lang in df.columns:
        for name, value in thresholds.items():
            if name:
                limit = F.when(F.col(lang) == name, value).otherwise(limit)
    return scored.select(*kept, F.col("_score_").alias(names[0]), limit.alias(names[1]), (F.col("_score_") >= limit).alias(names[2]))


def drop(df: DataFrame, model: Model | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that aren't rejected, with their columns as they were."""
    return score(df, model, text, lang, names=("_own_score", "_own_threshold", "_own_rejected")).where("not _own_rejected").select(*df.columns)
