"""Token counts by rank-synchronous array merging.

The pre-tokens that a batch has and the worker doesn't know yet are laid out as
one ragged array of symbols.  In each round every sequence finds its
lowest-rank pair and merges all its occurrences, left to right, at the same
time as all other sequences; sequences without a pair drop out.  What is left
of a sequence is its token count.

The tokeniser file gives the vocabulary, the merges, the split pattern, the
end-of-word suffix and the special tokens.  Special strings inside a text count
as one token each, as the tokeniser's library takes them by default.

Null and empty texts have no tokens and no bytes.  Each row is handled alone,
so ties, repeated rows and extra columns have no effect.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chronoweave.llm.util import Shipped, file_bytes, map_columns, texts_of, worker_object

#: What a worker keeps: counts by stretch of text, and the longest stretch.
MEMO_ENTRIES, MEMO_CHARS = 600_000, 64
BLOCK_SYMBOLS = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return [chr(b) if b in plain else chr(0x100 + b - sum(p < b for p in plain)) for b in range(256)]


class MergeTable:
    """Pairs of symbols as sorted 64-bit keys, with the rank and the result of each."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        size = max(vocabulary.values()) + 1
        pairs = [(a, b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        result = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)
        self.size = size
        order = np.argsort(left * size + right, kind="stable")
        self.keys, self.ranks, self.results = (left * size + right)[order], order.astype(np.int32), result[order]
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], dtype=np.int32)
        self.final = np.array([vocabulary[s + suffix] for s in symbols], dtype=np.int32)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols of each non-empty word survive."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        found = sizes.copy()
        while len(symbols) > 1:
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            keys = symbols[inside].astype(np.int64) * self.size + symbols[inside + 1]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            inside, at = inside[hit], at[hit]
            if not len(inside):
                break
            whose, ranks = owner[inside], self.ranks[at]
            first = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
            lowest = np.minimum.reduceat(ranks, first)
            spans = np.diff(np.r_[first, len(whose)])
            taken = ranks == np.repeat(lowest, spans)
            inside, at = inside[taken], at[taken]
            # Occurrences that overlap, as in "aaa": every other one of a run, from its left end.
            run = np.flatnonzero(np.r_[True, np.diff(inside) > 1])
            place = np.arange(len(inside)) - np.repeat(run, np.diff(np.r_[run, len(inside)]))
            inside, at = inside[place % 2 == 0], at[place % 2 == 0]
            symbols[inside] = self.results[at]
            np.subtract.at(found, owner[inside], 1)
            stay = np.isin(owner, whose[first], assume_unique=False) if len(first) < len(words) else np.ones(len(owner), bool)
            stay[inside + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return found


#: White space to Python's split(), but not to the tokeniser.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACE = regex.compile(r"\s+")


class Counter:
    """Counts the tokens of whole texts for one tokeniser file; at most `MEMO_ENTRIES` stretches' counts are kept, of `MEMO_CHARS` characters each."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.matches = regex.compile(steps[0]["pattern"]["Regex"]).findall
        model = spec["model"]
        self.table = MergeTable(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))))
        self.marks = specials
        self.known: dict[str, int] = {}

    def stretches(self, text: str) -> tuple[list[str], int]:
        """Normalised stretches without white space, and how many special strings were cut out."""
        parts = [text]
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
        # Lower-casing goes character by character, so that a sigma never takes its final form.
        plain = (unicodedata.normalize("NFC", part).replace("Σ", "σ").lower() for part in parts)
        return [s for part in plain for s in (part.split() if not any(c in part for c in _SEPARATORS) else _SPACE.split(part)) if s], len(parts) - 1

    def learn(self, stretches: set[str]) -> list[str]:
        """Counts those that aren't known, and returns them."""
        new = [s for s in stretches if s not in self.known]
        if len(self.known) + len(new) > MEMO_ENTRIES:
            self.known.clear()
            new = list(stretches)
        pieces = [[p.encode() for p in self.matches(s)] for s in new]
        words = list({p for ps in pieces for p in ps})
        counts: dict[bytes, int] = {}
        while words:
            block, total = [], 0
            while words and (not block or total + len(words[-1]) <= BLOCK_SYMBOLS):
                total += len(words[-1])
                block.append(words.pop())
            counts.update(zip(block, self.table.counts(block).tolist(), strict=True))
        for s, ps in zip(new, pieces, strict=True):
            self.known[s] = sum(map(counts.__getitem__, ps))
        return new

    def count(self, texts: list[str], block: int = 400) -> list[int]:
        """Token counts of texts, `block` texts at a time."""
        out = []
        for k in range(0, len(texts), block):
            split = [self.stretches(t) for t in texts[k : k + block]]
            new = self.learn({s for stretches, _ in split for s in stretches})
            out += [sum(map(self.known.__getitem__, stretches)) + cut for stretches, cut in split]
            if len(self.known) > MEMO_ENTRIES:
                self.known.clear()
            for s in new:
                if len(s) > MEMO_CHARS:
                    self.known.pop(s, None)
        return out


def count_tokens(df: DataFrame, path: str, limit: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes (long), n_tokens (long) and over_limit (boolean) to each row."""
    tokenizer = Shipped(df.sparkSession, file_bytes(path))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        counter = worker_object(("count", tokenizer.id), lambda: Counter(tokenizer.value))
        texts = texts_of(batch, 0)
        tokens = np.array(counter.count(texts), dtype=np.int64)
        return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens), pa.array(tokens > limit)]

    return map_columns(df, [text], run, "n_bytes long, n_tokens long, over_limit boolean", keep)
