"""Byte-level BPE encoding and decoding.

Encoding compiles a rank table into a finite-state transducer.  The
non-deterministic machine has one state per (last token, trie node): it reads
bytes down the vocabulary trie and, where a token ends that may follow the last
one, it may emit that token and return to the root.  Two tokens may be
neighbours only if merging their joined bytes gives those two tokens again, so
every prefix has one tokenisation and every input one accepted path.  The
subset construction runs lazily, on the states that texts reach; each
deterministic state keeps, for every live path, the tokens that are not yet
shared by all of them.  Shared tokens are emitted at once, so the lookahead is
never longer than the longest token.

Decoding joins the tokens' bytes and reads them with an incremental UTF-8 state
machine that keeps an unfinished character across calls.

Nulls: a null text encodes as the empty text, null ids decode as no bytes.
Empty texts give no ids.  Each row is handled alone, so ties, repeated rows and
extra columns have no effect; columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chronoweave.llm.util import Shipped, file_bytes, map_columns, texts_of, worker_object

#: What a worker keeps: outputs by text and the longest text, states, chains and pairs of the machine.
MEMO_ENTRIES, MEMO_CHARS = 200_000, 64
STATE_ENTRIES, CHAIN_ENTRIES, PAIR_ENTRIES = 400_000, 300_000, 400_000
#: Bytes of pre-tokens that are encoded in one call, and when the few that are left of one go alone.
CALL_BYTES = 1 << 20
LONG, FEW = 64, 4

_LOW = 0xFFFFFFFF
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The rank table of a base64 rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain merging, lowest rank first and leftmost among equals; with `below`, only by smaller ranks."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank >= (1 << 60 if below is None else below):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class _Table:
    """Integers by integer key, in sorted arrays: a large one, and a small one of the latest keys."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None):
        none = np.zeros(0, np.int64)
        order = np.argsort(keys) if keys is not None else none
        self.large = (keys[order], values[order]) if keys is not None else (none, none)
        self.small = (none, none)

    def __len__(self) -> int:
        return len(self.large[0]) + len(self.small[0])

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where a key is missing."""
        out = np.full(len(keys), -1, np.int64)
        for own, values in (self.large, self.small):
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                out = np.where(own[at] == keys, values[at], out)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once, in order."""
        at = np.searchsorted(self.small[0], keys)
        self.small = np.insert(self.small[0], at, keys), np.insert(self.small[1], at, values)
        if 8 * len(self.small[0]) > len(self.large[0]) + 8192:
            at = np.searchsorted(self.large[0], self.small[0])
            self.large = np.insert(self.large[0], at, self.small[0]), np.insert(self.large[1], at, self.small[1])
            self.small = np.zeros(0, np.int64), np.zeros(0, np.int64)


class _Column:
    """An array that grows at its end."""

    def __init__(self, first: list[int]):
        self.held, self.used = np.zeros(1024, np.int64), 0
        self.extend(np.array(first, np.int64))

    def extend(self, values: np.ndarray) -> None:
        end = self.used + len(values)
        if end > len(self.held):
            self.held = np.concatenate([self.held[: self.used], np.zeros(end, np.int64)])
        self.held[self.used : end] = values
        self.used = end

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.held[at]


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many each."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


class Compiled:
    """What the driver makes of a rank table, for the workers: the trie, which two tokens each token's own merge joins, and all pairs of tokens that join to one."""

    def __init__(self, ranks: dict[bytes, int]):
        children: dict[int, int] = {}
        token_at, branches, size = [-1], [0], max(ranks.values(), default=-1) + 1
        joins: dict[int, int] = {}
        self.halves = np.full((size, 2), -1, np.int64)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                child = children.get(node << 8 | byte)
                if child is None:
                    child = children[node << 8 | byte] = len(token_at)
                    token_at.append(-1)
                    branches.append(0)
                    branches[node] += 1
                node = child
            token_at[node] = rank
            cuts = [(ranks[token[:k]], ranks[token[k:]]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
            joins |= {a << 32 | b: rank for a, b in cuts}
            if len(cuts) > 1:
                parts = merge_by_rank(token, ranks, rank)
                cuts = [(ranks[parts[0]], ranks[parts[1]])] if len(parts) == 2 else []
            if cuts:
                self.halves[rank] = cuts[0]
        table = lambda d: _Table(np.fromiter(d.keys(), np.int64, len(d)), np.fromiter(d.values(), np.int64, len(d)))
        self.trie, self.joins = table(children), table(joins)
        self.token_at, self.branches = np.array(token_at, np.int64), np.array(branches) > 0

    def stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joined bytes of two tokens gives the two again.

        The merges that built both are undone from the latest back; one across the border must not come before those still undone."""
        out, at, limit = np.zeros(len(left), bool), np.arange(len(left)), np.full(len(left), 1 << 60)
        while len(at):
            joined = self.joins.get(left << 32 | right)
            a, b = self.halves[left], self.halves[right]
            over = (a[:, 0] < 0) & (b[:, 0] < 0)
            fails = (joined >= 0) & (joined < limit)
            out[at[over & ~fails]] = True
            # Merges run by rank, then from the left: of two equal ranks the right one came last.
            from_left = (b[:, 0] < 0) | (a[:, 0] >= 0) & (left > right)
            limit = np.where(from_left, left, right + 1)
            left, right = np.where(from_left, a[:, 1], left), np.where(from_left, right, b[:, 0])
            stays = ~(over | fails)
            at, left, right, limit = at[stays], left[stays], right[stays], limit[stays]
        return out


class Transducer:
    """Lazily determinised tokeniser of one rank table.

    `encode_many(pieces)` gives the ids of pre-tokens, which go through the machine side by side,
    one byte of each at a time; only moves that no piece has taken before are computed, all those of a step at once.
    A state is a range of rows (trie node, last token, pending tokens), one for each live path; states are
    told apart by a 64-bit hash of their rows.  Sequences of tokens are chains, numbered by (chain without its
    last token, last token).  The tables are dropped and rebuilt when `STATE_ENTRIES` or `CHAIN_ENTRIES` is
    passed; results don't change.
    """

    def __init__(self, compiled: Compiled):
        self.compiled, self.pairs = compiled, _Table()  # key of a pair: left << 32 | right
        self.reset()

    def reset(self) -> None:
        self.chains, self.texts, self.head, self.tail = _Table(), [""], _Column([-1]), _Column([0])
        self.node, self.last, self.pending = _Column([0]), _Column([-1]), _Column([0])
        self.start, self.count, self.final = _Column([0]), _Column([1]), _Column([0])
        self.numbers, self.moves = _Table(), _Table()
        if len(self.pairs) > PAIR_ENTRIES:
            self.pairs = _Table()

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joined bytes of both gives (left, right) again; -1 on the left is the start."""
        keys = left << 32 | right
        found = np.where(left < 0, 1, self.pairs.get(keys))
        new = np.unique(keys[found < 0])
        if len(new):
            self.pairs.add(new, self.compiled.stable(new >> 32, new & _LOW).astype(np.int64))
            found = np.where(left < 0, 1, self.pairs.get(keys))
        return found > 0

    def extended(self, chains: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The chains with one token more each."""
        keys, at = np.unique(chains << 32 | tokens, return_inverse=True)
        found = self.chains.get(keys)
        new = keys[found < 0]
        if len(new):
            long = new[new >> 32 > 0]
            if len(long):
                self.extended(self.tail[long >> 32], long & _LOW)
            new = new[self.chains.get(new) < 0]
            before, token = new >> 32, new & _LOW
            self.chains.add(new, len(self.texts) + np.arange(len(new)))
            texts = self.texts
            texts += [f"{texts[b]} {t}" for b, t in zip(before.tolist(), token.tolist(), strict=True)]
            self.head.extend(np.where(before > 0, self.head[before], token))
            self.tail.extend(np.where(before > 0, self.chains.get(self.tail[before] << 32 | token), 0))
            found = self.chains.get(keys)
        return found[at]

    def _determinise(self, keys: np.ndarray) -> np.ndarray:
        """Moves (state << 32 | chain that is emitted) of keys (state << 8 | byte)."""
        m = len(keys)
        counts = self.count[keys >> 8]
        owner, rows = np.repeat(np.arange(m), counts), _ragged(self.start[keys >> 8], counts)
        child = self.compiled.trie.get(self.node[rows] << 8 | (keys & 255)[owner])
        live = np.flatnonzero(child >= 0)
        owner, child, last, pending = owner[live], child[live], self.last[rows[live]], self.pending[rows[live]]
        token = self.compiled.token_at[child]
        ends = np.flatnonzero(token >= 0)
        ends, on = ends[self.may_follow(last[ends], token[ends])], np.flatnonzero(self.compiled.branches[child])
        pending = np.concatenate([self.extended(pending[ends], token[ends]), pending[on]])
        last = np.concatenate([token[ends], last[on]])
        node = np.concatenate([np.zeros(len(ends), np.int64), child[on]])
        owner = np.concatenate([owner[ends], owner[on]])
        # Paths of a state have different nodes: in the order of these, equal states have equal rows.
        order = np.lexsort((node, owner))
        owner, node, last, pending = owner[order], node[order], last[order], pending[order]
        begins = np.searchsorted(owner, np.arange(m))
        if len(np.unique(owner)) < m:
            raise ValueError("the rank table lacks a byte")
        out = np.zeros(m, np.int64)
        while True:
            first = self.head[pending]
            shared = np.minimum.reduceat(first, begins)
            same = (shared >= 0) & (shared == np.maximum.reduceat(first, begins))
            if not same.any():
                break
            out[same] = self.extended(out[same], shared[same])
            pending = np.where(same[owner], self.tail[pending], pending)
        h = node.astype(np.uint64) * _MIX[0]
        for column in (last, pending):
            h = (h ^ h >> np.uint64(32)) + column.astype(np.uint64) + np.uint64(7)
            h *= _MIX[1]
        h = (h ^ h >> np.uint64(29)) * _MIX[0]
        hashes, first, at = np.unique(np.add.reduceat(h, begins).view(np.int64), return_index=True, return_inverse=True)
        numbers = self.numbers.get(hashes)
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            numbers[fresh] = self.start.used + np.arange(len(fresh))
            self.numbers.add(hashes[fresh], numbers[fresh])
            sizes = np.diff(np.append(begins, len(owner)))[first[fresh]]
            rows = _ragged(begins[first[fresh]], sizes)
            self.start.extend(self.node.used + np.cumsum(sizes) - sizes)
            self.count.extend(sizes)
            self.final.extend(np.where(node[begins[first[fresh]]] == 0, pending[begins[first[fresh]]], -1))
            for column, values in ((self.node, node), (self.last, last), (self.pending, pending)):
                column.extend(values[rows])
        return numbers[at] << 32 | out

    def encode_many(self, pieces: list[bytes]) -> list[str]:
        """The ids of each pre-token in decimal, each after a blank."""
        if self.start.used > STATE_ENTRIES or len(self.texts) > CHAIN_ENTRIES or len(self.pairs) > 2 * PAIR_ENTRIES:
            self.reset()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data, begins = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), np.cumsum(sizes) - sizes
        active, state, steps, level, rest = np.argsort(-sizes, kind="stable"), np.zeros(len(pieces), np.int64), [], 0, {}
        while True:
            active = active[: np.searchsorted(-sizes[active], -level)]
            if level >= LONG and len(active) < FEW:
                rest = {i: "".join(f" {t}" for t in self._follow(int(state[i]), pieces[i][level:])) for i in active.tolist()}
                break
            if not len(active):
                break
            keys, at = np.unique(state[active] << 8 | data[begins[active] + level], return_inverse=True)
            moves = self.moves.get(keys)
            new = moves < 0
            if new.any():
                moves[new] = self._determinise(keys[new])
                self.moves.add(keys[new], moves[new])
            moves = moves[at]
            state[active] = moves >> 32
            emits = moves & _LOW
            steps.append((active[emits > 0], emits[emits > 0]))
            level += 1
        ended = self.final[state]
        ended[list(rest)] = 0
        steps.append((np.flatnonzero(ended), ended[ended != 0]))
        owner, chain = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(owner, kind="stable")
        texts, ends = [self.texts[c] for c in chain[order].tolist()], np.searchsorted(owner[order], np.arange(len(pieces) + 1)).tolist()
        out = ["".join(texts[a:b]) for a, b in pairwise(ends)]
        for i, text in rest.items():
            out[i] += text
        return out

    def stream(self, piece: bytes) -> Iterator[int]:
        """The ids of one pre-token, each as soon as all live paths share it."""
        return self._follow(0, piece)

    def _follow(self, state: int, piece: bytes) -> Iterator[int]:
        """The ids from a state on, path by path and without keeping states: for the few pre-tokens that are long."""
        rows = slice(int(self.start.held[state]), int(self.start.held[state] + self.count.held[state]))
        paths = [(node, last, tuple(map(int, self.texts[p].split()))) for node, last, p in zip(self.node.held[rows].tolist(), self.last.held[rows].tolist(), self.pending.held[rows].tolist(), strict=True)]
        for byte in piece:
            nodes, lasts = np.array([p[0] for p in paths]), np.array([p[1] for p in paths])
            child = self.compiled.trie.get(nodes << 8 | byte)
            token = self.compiled.token_at[child]
            ends = (child >= 0) & (token >= 0)
            ends[ends] = self.may_follow(lasts[ends], token[ends])
            on = (child >= 0) & self.compiled.branches[child]
            paths = [(0, t, (*p[2], t)) for p, t, e in zip(paths, token.tolist(), ends, strict=True) if e] + [(c, *p[1:]) for p, c, o in zip(paths, child.tolist(), on, strict=True) if o]
            if not paths:
                raise ValueError("the rank table lacks a byte")
            shared = 0
            for step in zip(*(p[2] for p in paths), strict=False):
                if len(set(step)) > 1:
                    break
                shared += 1
            yield from paths[0][2][:shared]
            paths = [(node, last, pending[shared:]) for node, last, pending in paths]
        yield from next(pending for node, _, pending in paths if node == 0)

    def encode(self, piece: bytes) -> list[int]:
        return [int(x) for x in self.encode_many([piece])[0].split()]


class Encoder:
    """Encodes whole texts: splits by the pattern and runs the transducer on each match.

    Between two single blanks the pattern's matches depend on nothing outside,
    so outputs are kept by such stretches; texts with wider white space are
    split by the pattern itself.  Of a block of texts only what isn't kept yet goes through the machine, in one call.
    `MEMO_ENTRIES` and `MEMO_CHARS` bound what is kept from one block to the next.
    """

    def __init__(self, compiled: Compiled, pattern: str):
        self.machine = Transducer(compiled)
        self.matches = regex.compile(pattern).findall
        self.stretches: dict[str, str] = {}
        self.pieces: dict[str, str] = {}

    def encode_texts(self, texts: list[str]) -> list[str]:
        """Decimal ids joined by one blank, of each text."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and looking for cycles among all that is kept takes a fifth of the time
        try:
            return self._encode_texts(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_texts(self, texts: list[str]) -> list[str]:
        split = [None if _wide(t) else t.split(" ") for t in texts]
        whole = [self.matches(t) if parts is None else self.matches(parts[0]) for t, parts in zip(texts, split, strict=True)]
        used = set(chain.from_iterable(islice(p, 1, None) for p in split if p))
        fresh = list(used.difference(self.stretches))
        # One call for all: the matches of a stretch are those that end within it.
        matches = self.matches(" " + " ".join(fresh)) if fresh else []
        ends = np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))
        cuts = [0, *(np.searchsorted(ends, np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1)) + 1).tolist()]
        single = [k for k, (a, b) in enumerate(pairwise(cuts)) if b - a == 1]
        several = [k for k, (a, b) in enumerate(pairwise(cuts)) if b - a > 1]
        used_pieces = {*chain.from_iterable(whole), *(p for k in several for p in matches[cuts[k] : cuts[k + 1]])}
        pieces = list(used_pieces.difference(self.pieces))
        ids = self._encoded([*pieces, *(matches[cuts[k]] for k in single)])
        self.pieces.update(zip(pieces, ids))
        self.stretches.update(zip((fresh[k] for k in single), ids[len(pieces) :], strict=True))
        piece, stretch = self.pieces.__getitem__, self.stretches.__getitem__
        self.stretches.update((fresh[k], "".join(map(piece, matches[cuts[k] : cuts[k + 1]]))) for k in several)
        out = ["".join([*map(piece, first), *map(stretch, islice(parts or (), 1, None))])[1:] for first, parts in zip(whole, split, strict=True)]
        self.stretches, self.pieces = _bounded(self.stretches, fresh, used), _bounded(self.pieces, pieces, used_pieces)
        return out

    def _encoded(self, pieces: list[str]) -> list[str]:
        """In calls of at most so many bytes that the machine's tables stay bounded."""
        out, block, size = [], [], 0
        for p in pieces:
            data = p.encode()
            if block and size + len(data) > CALL_BYTES:
                out += self.machine.encode_many(block)
                block, size = [], 0
            block.append(data)
            size += len(data)
        return out + (self.machine.encode_many(block) if block else [])

    def encode_text(self, text: str) -> str:
        return self.encode_texts([text])[0]


def _bounded(memo: dict[str, str], fresh: list[str], used: set[str]) -> dict[str, str]:
    """`memo` without long keys, and if it is full, only what the last block has used."""
    for key in fresh:
        if len(key) > MEMO_CHARS:
            del memo[key]
    return {k: memo[k] for k in used.intersection(memo)} if len(memo) > MEMO_ENTRIES else memo


#: White space other than blanks and line feeds, which may stand beside a blank.
_OTHER_SPACE = re.compile(r"[^\S \n]").search


def _wide(text: str) -> bool:
    """Whether white space may stand beside a blank: a stretch that begins or ends with it isn't independent."""
    return "  " in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace() or bool(_OTHER_SPACE(text))

#: Byte classes and moves of the UTF-8 machine. States: 0 between characters, 1-3 that many continuation bytes to come, 4-7 a restricted second byte after E0, ED, F0 and F4, 8 malformed.
_RESTRICTED = {0xE0: (4, 0xA0, 0xBF, 1), 0xED: (5, 0x80, 0x9F, 1), 0xF0: (6, 0x90, 0xBF, 2), 0xF4: (7, 0x80, 0x8F, 2)}


def _utf8_moves() -> list[list[int]]:
    moves = [[8] * 256 for _ in range(9)]
    for byte in range(256):
        if byte < 0x80:
            moves[0][byte] = 0
        elif byte in _RESTRICTED:
            moves[0][byte] = _RESTRICTED[byte][0]
        elif 0xC2 <= byte <= 0xDF:
            moves[0][byte] = 1
        elif 0xE0 <= byte <= 0xEF:
            moves[0][byte] = 2
        elif 0xF1 <= byte <= 0xF3:
            moves[0][byte] = 3
        if 0x80 <= byte <= 0xBF:
            moves[1][byte], moves[2][byte], moves[3][byte] = 0, 1, 2
    for state, low, high, then in _RESTRICTED.values():
        for byte in range(low, high + 1):
            moves[state][byte] = then
    return moves


class Utf8Machine:
    """Incremental UTF-8: `feed` gives the characters that are complete, `close` ends the stream.

    A malformed byte gives U+FFFD; the machine starts again after it, or at it
    if it broke off a character."""

    MOVES = _utf8_moves()

    def __init__(self) -> None:
        self.state, self.held = 0, b""

    def feed(self, data: bytes) -> str:
        if not self.state and data.isascii():
            return data.decode("ascii")
        data, self.held, self.state = self.held + data, b"", 0
        # Only the last three bytes can be of an unfinished character: the machine reads from the last lead byte there.
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            if data[-back] & 0xC0 != 0x80:
                state = 0
                for byte in data[-back:]:
                    state = self.MOVES[state][byte]
                if 0 < state < 8:
                    cut, self.state = len(data) - back, state
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        held, self.held, self.state = self.held, b"", 0
        return held.decode("utf-8", "replace")


class Decoder:
    """Ids to bytes and text. An id outside the table raises ValueError."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        parts = [b""] * size
        for token, i in ranks.items():
            parts[i] = token
        self.lengths = np.array([len(x) for x in parts], dtype=np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def decode_bytes(self, ids: np.ndarray, block: int = 1 << 18) -> bytes:
        out = []
        for k in range(0, len(ids), block):
            part = ids[k : k + block]
            if part.min() < 0 or part.max() >= len(self.lengths) or not (lengths := self.lengths[part]).all():
                raise ValueError("no token has one of these ids")
            ends = np.cumsum(lengths)
            out.append(self.bytes[np.repeat(self.starts[part] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes())
        return b"".join(out)

    def stream(self, ids: Iterator[int]) -> Iterator[str]:
        """Text as it becomes complete, token by token."""
        machine = Utf8Machine()
        for i in ids:
            yield machine.feed(self.decode_bytes(np.array([i])))
        yield machine.close()

    def decode(self, ids: np.ndarray, block: int = 1 << 14) -> str:
        """The text of the ids; read through the machine in blocks of tokens."""
        machine = Utf8Machine()
        return "".join([*(machine.feed(self.decode_bytes(ids[k : k + block])) for k in range(0, len(ids), block)), machine.close()])


class _Shipped:
    """A compiled rank table for the workers; each keeps one coder of it."""

    def __init__(self, df: DataFrame, path: str, pattern: str):
        ranks = read_ranks(file_bytes(path))
        self.held, self.pattern = Shipped(df.sparkSession, (Compiled(ranks), Decoder(ranks))), pattern

    def coder(self) -> tuple[Encoder, Decoder]:
        def build():
            compiled, decoder = self.held.value
            return Encoder(compiled, self.pattern), decoder

        return worker_object(("bpe", self.held.id, self.pattern), build)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds `ids` (array<int>) and `n_tokens` (long) to each row."""
    vocabulary = _Shipped(df, path, pattern)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        encoder = vocabulary.coder()[0]
        ids = [np.fromstring(t, dtype=np.int32, sep=" ") for t in encoder.encode_texts(texts_of(batch, 0))]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))), pa.array(np.diff(ends).astype(np.int64))]

    return map_columns(df, [text], run, "ids array<int>, n_tokens long")


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded` (string) to each row."""
    vocabulary = _Shipped(df, path, "")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        decoder = vocabulary.coder()[1]
        return [pa.array([decoder.decode(np.array(row or (), dtype=np.int64)) for row in batch.column(0).to_pylist()], pa.string())]

    return map_columns(df, [ids], run, "decoded string")


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: both operators in one pass, without their arrays between."""
    vocabulary = _Shipped(df, path, pattern)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        encoder, decoder = vocabulary.coder()
        counts, digests, decoded = [], [], []
        for ids in encoder.encode_texts(texts_of(batch, 0)):
            counts.append(ids.count(" ") + bool(ids))
            digests.append(hashlib.sha256(ids.encode()).hexdigest())
            decoded.append(hashlib.sha256(decoder.decode(np.fromstring(ids, dtype=np.int32, sep=" ")).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]

    return map_columns(df, [text], run, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep)
