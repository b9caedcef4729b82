"""Embeddings from a client that takes texts in lots: batched, put back in order, tried again, charged, and made once a text.

A client is what `Registry` makes of a model's name and settings, where it is used: a worker keeps it until it is asked for another
model, or the same one with other settings.  It gets a list of texts and returns a `Reply`: vectors with the index of their
text, in any order, and the tokens that were used.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.text import query_prefix
from chronoweave.sources.tables import kept


@dataclass(frozen=True)
class Reply:
    """Vectors by the index of their text, and what the call has used."""

    vectors: list[tuple[int, list[float]]]
    tokens: int = 0


Client = Callable[[list[str]], Reply]
_LIVE: dict[str, Any] = {}


@dataclass(frozen=True)
class Handle:
    """A model with its settings, as it travels to workers."""

    name: str
    settings: str
    factory: Callable[[dict], Client]
    prefix: bool = False

    def client(self) -> Client:
        """The worker's client, made anew if the last one was another model's or had other settings."""
        if _LIVE.get("key") != (self.name, self.settings):
            _LIVE.clear()
            _LIVE.update(key=(self.name, self.settings), client=self.factory(json.loads(self.settings)))
        return _LIVE["client"]


@dataclass
class Registry:
    """Factories of clients by the model's name; an unknown one is the default's, under its own name."""

    factories: dict[str, Callable[[dict], Client]] = field(default_factory=dict)
    default: str | None = None

    def register(self, name: str, factory: Callable[[dict], Client]) -> None:
        self.factories[name] = factory
        self.default = self.default or name

    def handle(self, name: str, prefix: bool = False, **settings) -> Handle:
        factory = self.factories.get(name) or self.factories.get(self.default)
        if factory is None:
            raise KeyError(f"no encoder for {name!r}; known are {sorted(self.factories)}")
        return Handle(name, json.dumps({"model": name} | settings, sort_keys=True), factory, prefix)


def ordered(reply: Reply, n: int) -> list[list[float]]:
    """The vectors in the order of the texts; each index must be there once, and all vectors must have one length."""
    if sorted(i for i, _ in reply.vectors) != list(range(n)) or len({len(v) for _, v in reply.vectors}) != 1:
        raise ValueError(f"{n} texts were asked for, {len(reply.vectors)} vectors came back, or not each once, or of several lengths")
    return [v for _, v in sorted(reply.vectors, key=lambda x: x[0])]


def encode(texts: DataFrame, model: Handle, *, lot: int = 64, attempts: int = 4, backoff: float = 2.0, normalize: bool = True, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """text, embedding and tokens of each distinct text of the column `text`; a lot's tokens are on its first row, for all its calls that answered.

    Lots are filled across the batches that Spark sends, so all but a task's last one are full. A failed or unfit reply is asked for again,
    later each time; the last failure raises."""

    def ask(client: Client, part: list[str]) -> tuple[list[list[float]], int]:
        tokens = 0
        for attempt in range(attempts):
            try:
                reply = client(part)
                tokens += reply.tokens
                return ordered(reply, len(part)), tokens
            except Exception:
                if attempt == attempts - 1:
                    raise
                sleep(backoff**attempt)
        raise ValueError("attempts must be 1 or more")

    def rows(part: list[str]) -> pd.DataFrame:
        vectors, tokens = ask(model.client(), part)
        matrix = np.asarray(vectors, dtype=np.float64)
        if normalize:
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            matrix = matrix / np.where(norms == 0, 1, norms)
        return pd.DataFrame({"text": part, "embedding": list(matrix.astype(np.float32)), "tokens": [tokens] + [0] * (len(part) - 1)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for batch in batches:
            held += batch["text"].tolist()
            while len(held) >= lot:
                yield rows(held[:lot])
                held = held[lot:]
        if held:
            yield rows(held)

    return texts.select("text").where("text is not null").distinct().mapInPandas(run, "text string, embedding array<float>, tokens long")


def embed(df: DataFrame, model: Handle, column: str | Column = "text", *, query: bool = False, price: float = 0.0, **how) -> tuple[DataFrame, DataFrame]:
    """`df` with `embedding` (null for null texts), and the bill: tokens, and cost at a price for a million of them.

    Each distinct text is asked for once, and vectors are written before they are read. Queries get the prefix of a model that has one; passages never."""
    said = F.col(column) if isinstance(column, str) else column
    rows = kept(df.withColumn("_text", query_prefix(F.lit(model.name), said) if query and model.prefix else said))
    made = kept(encode(rows.select(F.col("_text").alias("text")), model, **how))
    bill = made.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    out = rows.join(made.select(F.col("text").alias("_text"), "embedding"), "_text", "left").drop("_text")
    return out.select(*[c for c in df.columns if c != "embedding"], "embedding"), bill.withColumn("cost", F.col("tokens") * price / 1e6)
