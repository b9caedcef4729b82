"""Secret scans: fixed patterns and a linear-chain conditional random field.

The base finds three kinds of matches, each leftmost and non-overlapping: an
assignment to a secret's name, an access key, and a long hexadecimal run.  The
field adds spans: it tags tokens as begin, inside or outside of a secret from their
shape, the words around them and features of the file, decoded by Viterbi.

All tokens of a text are one chain.  Scores of tokens and of what stands between them are
kept by worker, and added up for a whole text at once.  A token whose score as outside
is ahead of its others by more than all transitions around it could make up
for is outside on the best path; the path splits there, and only what lies between is
decoded step by step.  The result is that of Viterbi over the whole text.

The field is fitted by stochastic gradient on the log-likelihood of a bounded sample:
half of the `sample_docs` documents are those with a base match and the smallest hash of their
id, half those of the smallest hash among all, at most `sample_runs` pieces of each text's chain, labelled by the base: those around base
matches, those around other tokens with digits or inner capitals, and one at a place that the text's
checksum tells.  Every second piece with a match hides what stands before the secret, the
assignment's name too, so that the secret's own form is learned.  A corpus without any base match
gets no field, and only base spans are reported.

Offsets count code points, ends are exclusive.  Null and empty texts have no spans.
Every row is handled alone, so ties, repeated rows and extra columns have no effect.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.util import Shipped, give_back, map_columns, texts_of, worker_object

KINDS = ("assign", "access", "hex", "field")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_HEX_BYTES = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

MIN_LENGTH = 8
_TOKEN = re.compile(rb"[A-Za-z0-9_+/.\-]+=*")
_PIECE = re.compile(rb"([A-Za-z0-9_+/.\-]+=*)([^A-Za-z0-9_+/.\-]*)")
_CONSONANTS = re.compile(rb"[bcdfghjklmnpqrstvwxz]+")
#: Tokens around a match, around another odd token and at any place that are fitted, and the longest piece.
AROUND, AROUND_ODD, ANYWHERE, PIECE = 6, 2, 10, 32
MEMO_ENTRIES = 300_000
_ODD = re.compile(rb"[0-9]|[a-z][A-Z]")
BITS = 16
OUTSIDE, BEGIN, INSIDE = range(3)


def flat(text: str | None) -> bytes:
    """One byte for each code point: all patterns are of ASCII characters, others become question marks."""
    return (text or "").encode("ascii", "replace")


def base_spans(data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself), by start, then kind."""
    out = []
    low = data.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(data) if m.end() - m.start(2) >= MIN_ASSIGN]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= MIN_ACCESS]
    if b"h" * MIN_HEX in data.translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(data) if m.end() - m.start() >= MIN_HEX]
    return sorted(out)


def may_be_secret(token: bytes) -> bool:
    return len(token) >= MIN_LENGTH and _ODD.search(token) is not None


_CLASSES = bytes(48 if 48 <= c <= 57 else 65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else c for c in range(256))
_REPEAT = re.compile(rb"(.)\1+", re.DOTALL)


def _shape(classes: bytes) -> bytes:
    """Runs of character classes, without lengths, at most eight."""
    return _REPEAT.sub(rb"\1", classes)[:8]


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def _with(start: int, rest: bytes) -> int:
    """The number of a feature whose name's checksum is known."""
    return zlib.crc32(rest, start) & ((1 << BITS) - 1)


def _bucketed(name: str, *sizes: int) -> list:
    """The numbers of a feature's buckets, as nested lists."""
    return [_bucketed(f"{name}:{i}", *sizes[1:]) for i in range(sizes[0])] if sizes else _number(name)


_LENGTH, _DIGITS, _UPPER, _LOWER = _bucketed("length", 17), _bucketed("digits", 5), _bucketed("upper", 5), _bucketed("lower", 5)
_HEXADECIMAL, _KINDS, _HARD, _BIAS = _bucketed("hex", 2, 7), _bucketed("kinds", 9, 7), _bucketed("hard", 7, 7), _number("bias")
_HEX_DIGITS = b"0123456789abcdefABCDEF"
_NAMED = {n: zlib.crc32(n.encode()) for n in ("shape:", "starts:", "word:", "word-1:", "word-2:", "word+1:")}
_PLAIN, _PLAIN_AFTER = (_with(_NAMED[n], b"a") for n in ("shape:", "word+1:"))


def own_features(token: bytes) -> list[int]:
    size = len(token)
    if token.isalpha() and token.islower():
        digits, upper, lower, low, shape = 0, 0, 4, token, _PLAIN
    else:
        classes, low = token.translate(_CLASSES), token.lower()
        digits, upper, lower, shape = 4 * classes.count(b"0") // size, 4 * classes.count(b"A") // size, 4 * classes.count(b"a") // size, _with(_NAMED["shape:"], _shape(classes))
    long = min(size // 8, 6)
    hard = max(map(len, _CONSONANTS.findall(low)), default=0)
    return [
        shape, _LENGTH[min(size // 4, 16)], _DIGITS[digits], _UPPER[upper], _LOWER[lower], _HEXADECIMAL[not token.translate(None, _HEX_DIGITS)][long], _KINDS[len(set(token)).bit_length()][long],
        _HARD[min(hard, 6)][long], _with(_NAMED["starts:"], token[:4]), _with(_NAMED["word:"], low[:24]), _BIAS,
    ]


def near_features(token: bytes) -> tuple[int, int, int]:
    """What a token is for the next one, the one after that and the one before."""
    word = token.lower()[:24] or b"-"
    after = _PLAIN_AFTER if word.isalpha() else _with(_NAMED["word+1:"], _shape(word.translate(_CLASSES)))
    return _with(_NAMED["word-1:"], word), _with(_NAMED["word-2:"], word), after


def gap_features(gap: bytes) -> tuple[int, int]:
    """What stands between two tokens, for the second and for the first one."""
    return _number(f"before:{gap[-8:].decode().strip()}"), _number(f"after:{gap[:1].decode()}")


def file_features(data: bytes, odd: int, tokens: int) -> list[int]:
    lines = data.count(b"\n") + 1
    return [_number(n) for n in (f"f:assigns{min(4, 8 * data.count(b'=') // lines)}", f"f:dense{min(4, 40 * odd // tokens)}", f"f:lines{min(4, lines.bit_length() // 2)}")]


def features_at(data: bytes, tokens: list[tuple[int, int]], at: list[int], file: list[int]) -> list[tuple[int, int, list[int]]]:
    """Start, end and feature numbers of some tokens; those of what stands before come last."""
    word = lambda i: data[slice(*tokens[i])] if 0 <= i < len(tokens) else b""
    out = []
    for i in at:
        a, b = tokens[i]
        before = gap_features(data[tokens[i - 1][1] if i else 0 : a])[0]
        after = gap_features(data[b : tokens[i + 1][0] if i + 1 < len(tokens) else len(data)])[1]
        out.append((a, b, [*own_features(data[a:b]), *file, after, near_features(word(i + 1))[2], before, near_features(word(i - 1))[0], near_features(word(i - 2))[1]]))
    return out


def odd_tokens(data: bytes, tokens: list[tuple[int, int]]) -> list[int]:
    return [i for i, (a, b) in enumerate(tokens) if b - a >= MIN_LENGTH and may_be_secret(data[a:b])]


def runs(data: bytes) -> list[list[tuple[int, int, list[int]]]]:
    """The chain of all tokens, if there are any: each token's start, end and feature numbers."""
    tokens = [m.span() for m in _TOKEN.finditer(data)]
    return [features_at(data, tokens, list(range(len(tokens))), file_features(data, len(odd_tokens(data, tokens)), len(tokens)))] if tokens else []


def pieces(data: bytes, spans: list[tuple[int, int, int, int]], most: int, longest: int = PIECE) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of at most so many pieces of a text's chain, those with a match first."""
    tokens = [m.span() for m in _TOKEN.finditer(data)]
    if not tokens:
        return []
    odd, starts = odd_tokens(data, tokens), [a for a, _ in tokens]
    hits = {i for s in spans for i in range(max(0, bisect.bisect_right(starts, s[3]) - 1), bisect.bisect_left(starts, s[2])) if tokens[i][1] > s[3]}
    place = zlib.crc32(data) % len(tokens)
    wanted = [(i - AROUND, i + AROUND + 1) for i in sorted(hits)] + [(place, place + ANYWHERE)] + [(i - AROUND_ODD, i + AROUND_ODD + 1) for i in odd if i not in hits]
    file, out, seen = file_features(data, len(odd), len(tokens)), [], set()
    for a, b in wanted:
        at = [i for i in range(max(0, a), min(len(tokens), b)) if i not in seen]
        if len(out) == most:
            break
        # Neighbours in the chain only: what an earlier piece has ends this one.
        at = [i for k, i in enumerate(at) if i - at[0] == k][:longest]
        if at:
            seen.update(at)
            rows = features_at(data, tokens, at, file)
            labels = labels_of(rows, spans)
            hide = any(labels) and len(out) % 2 == place % 2
            out.append(([f[:-3] if hide and y else f for (_, _, f), y in zip(rows, labels, strict=True)], labels))
    return out


def labels_of(run: list[tuple[int, int, list[int]]], spans: list[tuple[int, int, int, int]]) -> list[int]:
    """Begin and inside where a token overlaps a base match's secret."""
    out, previous = [], None
    for a, b, _ in run:
        hit = next((s for s in spans if s[3] < b and a < s[2]), None)
        out.append(OUTSIDE if hit is None else INSIDE if hit == previous else BEGIN)
        previous = hit
    return out


#: Feature numbers of some tokens in a row, and how many each token has.
Packed = tuple[np.ndarray, np.ndarray]


def packed(features: list[list[int]] | Packed) -> Packed:
    if isinstance(features, tuple):
        return features
    widths = np.array([len(f) for f in features], np.int64)
    return np.fromiter((x for f in features for x in f), np.int64, int(widths.sum())), widths


@dataclass
class Field:
    """Weights of features by label, and of label pairs; inside can't follow outside or start a run."""

    weights: np.ndarray
    pairs: np.ndarray

    START = np.array([0.0, 0.0, -1e9])

    @staticmethod
    def fresh() -> Field:
        pairs = np.zeros((3, 3))
        pairs[OUTSIDE, INSIDE] = -1e9
        return Field(np.zeros((1 << BITS, 3), np.float32), pairs)

    def emissions(self, features: list[list[int]] | Packed) -> np.ndarray:
        flat, widths = packed(features)
        return np.add.reduceat(self.weights[flat].astype(np.float64), np.cumsum(widths) - widths, axis=0)

    def viterbi(self, features: list[list[int]]) -> list[int]:
        """The best labels of a run; of equal paths the one with smaller labels from the end on."""
        return self.path(self.emissions(features), self.START, np.zeros(3))

    def path(self, scores: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
        """The best labels of a part of the chain, given the scores of coming to its first label and from its last one."""
        best, back = scores[0] + start, []
        for row in scores[1:]:
            through = best[:, None] + self.pairs
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + row
        labels = [int((best + end).argmax())]
        for pointers in reversed(back):
            labels.append(int(pointers[labels[-1]]))
        return labels[::-1]

    def margins(self) -> tuple[float, float]:
        """The most that labels around gain if a token isn't outside: before a token that isn't inside, and before one that is, which would begin then."""
        pairs = np.zeros((4, 4))  # the last is the end of the chain
        pairs[:3, :3] = self.pairs
        pairs[3, INSIDE] = -1e9
        plain = [pairs[p, x] + pairs[x, q] - pairs[p, OUTSIDE] - pairs[OUTSIDE, q] for p in range(4) for x in (BEGIN, INSIDE) for q in (OUTSIDE, BEGIN, 3)]
        inside = [pairs[p, x] + pairs[x, INSIDE] + pairs[INSIDE, r] - pairs[p, OUTSIDE] - pairs[OUTSIDE, BEGIN] - pairs[BEGIN, r] for p in range(4) for x in (BEGIN, INSIDE) for r in range(4)]
        return max(plain), max(inside)

    def decode(self, scores: np.ndarray, margins: tuple[float, float]) -> list[tuple[int, int]]:
        """(token, label) of all that aren't outside on the best path."""
        plain, inside = margins
        ahead = scores[:, OUTSIDE] - scores[:, BEGIN:].max(axis=1)
        follow = np.full(len(scores), -np.inf)
        follow[:-1] = scores[1:, INSIDE] - scores[1:, BEGIN]
        opened = np.flatnonzero(ahead <= np.maximum(plain, inside + follow) + 1e-3)
        out = []
        for part in np.split(opened, np.flatnonzero(np.diff(opened) > 1) + 1) if len(opened) else ():
            start = self.pairs[OUTSIDE] if part[0] else self.START
            end = self.pairs[:, OUTSIDE] if part[-1] + 1 < len(scores) else np.zeros(3)
            out += [(i, y) for i, y in zip(part.tolist(), self.path(scores[part], start, end), strict=True) if y != OUTSIDE]
        return out

    def expectations(self, features: list[list[int]] | Packed) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels, and summed ones of label pairs, by forward and backward sums."""
        scores = self.emissions(features)
        n = len(scores)
        forward, backward = np.zeros((n, 3)), np.zeros((n, 3))
        forward[0] = scores[0] + self.START
        for i in range(1, n):
            forward[i] = np.logaddexp.reduce(forward[i - 1][:, None] + self.pairs, axis=0) + scores[i]
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(self.pairs + scores[i + 1] + backward[i + 1], axis=1)
        total = np.logaddexp.reduce(forward[-1])
        both = np.zeros((3, 3))
        for i in range(1, n):
            both += np.exp(forward[i - 1][:, None] + self.pairs + scores[i] + backward[i] - total)
        return np.exp(forward + backward - total), both


def fit(data: list[tuple[list[list[int]] | Packed, list[int]]], epochs: int = 6, rate: float = 0.2, decay: float = 1e-4, seed: int = 5) -> Field:
    """Adagrad over the runs, one at a time, in an order that the seed fixes."""
    field, rng = Field.fresh(), np.random.default_rng(seed)
    data = [(packed(features), np.asarray(labels)) for features, labels in data]
    held, held_pairs = np.full(field.weights.shape, 1e-2, np.float32), np.full((3, 3), 1e-2)
    for _ in range(epochs):
        for k in rng.permutation(len(data)).tolist():
            features, labels = data[k]
            each, both = field.expectations(features)
            truth = np.eye(3)[labels]
            some, place = np.unique(features[0], return_inverse=True)
            g = np.zeros((len(some), 3), np.float32)
            np.add.at(g, place, np.repeat(each - truth, features[1], axis=0).astype(np.float32))
            g += decay * field.weights[some]
            held[some] += g * g
            field.weights[some] -= rate * g / np.sqrt(held[some])
            np.subtract.at(both, (labels[:-1], labels[1:]), 1)
            both[OUTSIDE, INSIDE] = 0
            held_pairs += both * both
            field.pairs -= rate * both / np.sqrt(held_pairs)
    return field


class _Scores:
    """Row numbers of byte strings, and the rows: the summed weights of their first features and the weights of `single` more."""

    def __init__(self, features: Callable[[bytes], list[int]], single: int, weights: np.ndarray):
        self.features, self.single, self.weights = features, single, weights
        self.at: dict[bytes, int] = {}
        self.rows, self.odd = np.zeros((1024, 3 * (1 + single)), np.float32), np.zeros(1024, bool)

    def add(self, keys: list[bytes]) -> None:
        n = len(self.at)
        while n + len(keys) > len(self.rows):
            self.rows, self.odd = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.odd, np.zeros_like(self.odd)])
        each = self.weights[np.array([self.features(k) for k in keys])]
        cut = each.shape[1] - self.single
        self.rows[n : n + len(keys)] = np.concatenate([each[:, :cut].sum(axis=1), each[:, cut:].reshape(len(keys), -1)], axis=1)
        self.odd[n : n + len(keys)] = [len(k) >= MIN_LENGTH and may_be_secret(k) for k in keys]
        self.at.update(zip(keys, range(n, n + len(keys)), strict=True))

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        if len(self.at) > MEMO_ENTRIES:
            self.at.clear()
        if new := set(keys).difference(self.at):
            self.add(list(new))
        return np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))


class Tagger:
    """A field with the scores of what it has met."""

    def __init__(self, field: Field):
        self.field, self.margins = field, field.margins()
        self.tokens = _Scores(lambda t: [*own_features(t), *near_features(t)], 3, field.weights)
        self.gaps = _Scores(lambda g: [*gap_features(g)], 1, field.weights)
        self.none = [field.weights[n] for n in near_features(b"")]

    def scores(self, data: bytes, tokens: list[bytes], gaps: list[bytes]) -> np.ndarray:
        """Emissions of all tokens; `gaps` stand before the first one and after each."""
        at, between = self.tokens.numbers(tokens), self.gaps.numbers(gaps)
        own, between = self.tokens.rows[at], self.gaps.rows[between]
        odd = int(self.tokens.odd[at].sum())
        out = own[:, :3] + self.field.weights[file_features(data, odd, len(tokens))].sum(axis=0, dtype=np.float64)
        out += between[:-1, :3]
        out += between[1:, 3:]
        one, two, after = self.none
        out[1:] += own[:-1, 3:6]
        out[2:] += own[:-2, 6:9]
        out[:-1] += own[1:, 9:]
        out[0] += one
        out[:2] += two
        out[-1] += after
        return out

    def labels(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, label) of tokens that aren't outside."""
        found = _PIECE.findall(data)
        if not found:
            return []
        tokens, gaps = map(list, zip(*found, strict=True))
        first = len(data) - sum(map(len, tokens)) - sum(map(len, gaps))
        hits = self.field.decode(self.scores(data, tokens, [data[:first], *gaps]), self.margins)
        if not hits:
            return []
        ends = np.cumsum([first, *(len(t) + len(g) for t, g in found)])
        return [(int(ends[i]), int(ends[i]) + len(tokens[i]), y) for i, y in hits]


def field_spans(data: bytes, field: Field | Tagger | None, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans that the field finds and that overlap no base match."""
    if field is None:
        return []
    spans: list[list[int]] = []
    for a, b, label in (field if isinstance(field, Tagger) else Tagger(field)).labels(data):
        if label == BEGIN:
            spans.append([a, b])
        else:
            spans[-1][1] = b
    return [(a, 3, b, a) for a, b in spans if not any(s[0] < b and a < s[2] for s in base)]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 12_000, sample_runs: int = 20, piece_tokens: int = PIECE) -> Field | None:
    """The field, from the sample; None if the base finds nothing in any document with an id.

    The sample's bounds: documents, pieces of each, and tokens of a piece."""
    order = [F.xxhash64(F.col(doc_id)), F.col(doc_id)]

    def flag(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([bool(base_spans(flat(t))) for t in texts_of(batch, 0)], pa.bool_())]

    known = docs.where(F.col(doc_id).isNotNull())
    matched = map_columns(known.select(F.col(doc_id), F.col(text).alias("_text")), ["_text"], flag, "_hit boolean", [doc_id]).where("_hit")
    half = -(-sample_docs // 2)
    ids = [r[0] for r in matched.select(doc_id).distinct().orderBy(*order).limit(half).collect()]
    if not ids:
        return None
    ids += [r[0] for r in known.select(doc_id).orderBy(*order).limit(half).collect()]
    few = docs.sparkSession.createDataFrame([(i,) for i in set(ids)], docs.select(doc_id).schema)
    rows = docs.select(F.col(doc_id), F.col(text).alias("_text")).join(F.broadcast(few), doc_id)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for t in texts_of(batch, 0):
            data = flat(t)
            found = pieces(data, base_spans(data), sample_runs, piece_tokens)
            own = [packed(f) for f, _ in found]
            parts = [f.astype("<i4") for f, _ in own], [w.astype("<i4") for _, w in own], [np.array(y, "<i4") for _, y in found], [np.array([len(y) for _, y in found], "<i4")]
            out.append([np.concatenate(p).tobytes() if p else b"" for p in parts])
        return [pa.array([row[i] for row in out], pa.binary()) for i in range(4)]

    # Each document's pieces come as four packed arrays: features, how many a token has, labels, tokens of each piece.
    found = map_columns(rows, ["_text"], run, "features binary, widths binary, labels binary, lengths binary", [doc_id]).where(F.length("lengths") > 0)
    try:
        sample = _unpacked(sorted(found.limit(sample_docs).collect(), key=lambda row: (row[doc_id] is None, row[doc_id])))
        return fit(sample) if any(y.any() for _, y in sample) else None
    finally:
        sample = None
        give_back()


def _unpacked(rows: list) -> list[tuple[Packed, np.ndarray]]:
    """Features and labels of the pieces of all rows, as views into their packed arrays: nothing is held twice."""
    sample = []
    for row in rows:
        features, widths, labels, lengths = (np.frombuffer(row[c], "<i4") for c in ("features", "widths", "labels", "lengths"))
        at = np.cumsum(lengths)[:-1]
        ends = np.cumsum(np.add.reduceat(widths, np.append(0, at), dtype=np.int64))[:-1]
        sample += [((f, w), y) for f, w, y in zip(np.split(features, ends), np.split(widths, at), np.split(labels, at), strict=True)]
    return sample


def _all_spans(text: str | None, field: Field | Tagger | None) -> tuple[list, list]:
    data = flat(text)
    base = base_spans(data)
    return base, sorted([*base, *field_spans(data, field, base)]) if field is not None else base


def scan(docs: DataFrame, field: Field | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `base` and `found` (base and field), arrays of (kind, start, end, secret_start) by start, then kind."""
    held = Shipped(docs.sparkSession, field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret_start", pa.int32())]))
    rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b, "secret_start": s} for a, k, b, s in spans]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        own = worker_object(("field", held.id), lambda: held.value and Tagger(held.value))
        both = [_all_spans(t, own) for t in texts_of(batch, 0)]
        return [pa.array([rows(b) for b, _ in both], kind), pa.array([rows(f) for _, f in both], kind)]

    span = "array<struct<kind:string,start:int,end:int,secret_start:int>>"
    return map_columns(docs, [text], run, f"base {span}, found {span}", keep)


def report(scanned: DataFrame) -> DataFrame:
    """Counts, digest of the base and list of all spans in place of the arrays."""
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        *[c for c in scanned.columns if c not in ("base", "found")],
        *[count("base", k).alias(f"n_{k}") for k in KINDS[:3]],
        count("found", KINDS[3]).alias(f"n_{KINDS[3]}"),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("found").alias("spans"),
    )


def masked(text: str | None, field: Field | Tagger | None, mark: str = "[SECRET]") -> str | None:
    """The text with each found secret replaced; of an assignment only the value. Overlapping ones become one mark."""
    spans = sorted((s, b) for _, _, b, s in _all_spans(text, field)[1])
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """`docs` with the secrets in its texts replaced; columns and their order stay."""
    held = Shipped(docs.sparkSession, field)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        own = worker_object(("field", held.id), lambda: held.value and Tagger(held.value))
        return [pa.array([masked(t, own) for t in batch.column(0).to_pylist()], pa.string())]

    return map_columns(docs, [text], run, f"`{text}` string").select(*docs.columns)
