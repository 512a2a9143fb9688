"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the BPE of its bytes exactly if each adjacent pair is the BPE of its own bytes (Berglund and van
der Merwe 2023). So the merges compile into a nondeterministic transducer: a configuration is (node of the trie of
tokens, the token before, tokens not emitted yet); a byte goes down the trie, or ends a token that may follow the one
before and starts at the root. Sets of configurations are determinised when first met. Tokens that all configurations
share are emitted at once; they differ for at most the length of the longest token, which bounds the lookahead.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepared
from .flat import slices

#: States of the transducer and words whose ids are remembered in a worker; when full, the memory starts anew.
STATES = 200_000
WORDS = 200_000
#: Below nodes of the trie with so few tokens, tokens before are told apart only by which of these may follow.
FEW = 32
#: Longer words are not remembered.
LONGEST = 48
#: Texts of more code points are segmented as a stream.
STREAM = 1 << 18


def pattern() -> regex.Pattern:
    r"""The segmentation; ``\s`` is Unicode's White_Space, as in the library that the vocabulary is for."""
    white = r"\t-\r\x20\x85\xa0  -     　"
    p = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{white}").replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]")
    return regex.compile(p)


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.split: dict[int, tuple[int, int]] = {}
        #: Tokens that no merges lead to: they stand for a whole word only.
        self.whole: dict[bytes, int] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) == 2:
                    self.split[rank] = (parts[0], parts[1])
                else:
                    self.whole[token] = rank
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            if token in self.whole:
                continue
            node = 0
            for b in token:
                to = self.child.get(node << 8 | b)
                if to is None:
                    to = self.child[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                node = to
            self.ends[node] = rank
        self.below = self._tokens_below()
        self.pairs: dict[tuple[int, int], bool] = {}
        self._restart()

    def _merge(self, token: bytes, below: int) -> list[int]:
        """The merges of lower rank than ``below`` applied to the bytes of one token."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Is the BPE of the two tokens' bytes these two tokens?

        The merges of both are undone, latest first. The pair that meets at the border must not merge before the merge
        undone last; one of equal rank comes first only if it stands further left.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        x, y, limit, good = a, b, 1 << 62, True
        while True:
            rank = self.ranks.get(self.vocab[x] + self.vocab[y])
            if rank is not None and rank < limit:
                good = False
                break
            sx, sy = self.split.get(x), self.split.get(y)
            if sx is not None and (x > y or sy is None):
                limit, x = x, sx[1]
            elif sy is not None:
                limit, y = y + 1, sy[0]
            else:
                break
        if len(self.pairs) > STATES:
            self.pairs.clear()
        self.pairs[(a, b)] = good
        return good

    def _tokens_below(self) -> list[tuple[int, ...] | None]:
        """The tokens at and below each node of the trie, or None if there are more than FEW."""
        below: list = [(t,) if t >= 0 else () for t in self.ends]
        parent = sorted(((node, key >> 8) for key, node in self.child.items()), reverse=True)
        for node, up in parent:  # children have larger numbers
            own, more = below[up], below[node]
            below[up] = None if own is None or more is None or len(own) + len(more) > FEW else own + more
        return below

    def _like(self, node: int, before: int) -> int | None:
        """A token that allows the same tokens below ``node`` as ``before``, the same one for all such; -1 if all are
        allowed, None if none is."""
        tokens = self.below[node]
        if before < 0 or tokens is None:
            return before
        key = node << 20 | before
        found = self.likes.get(key, 0)
        if found == 0:
            allowed = tuple(self.follows(before, t) for t in tokens)
            if all(allowed):
                found = -1
            elif not any(allowed):
                found = None
            else:
                found = self.firsts.setdefault((node, allowed), before)
            if len(self.likes) > 2 * STATES:
                self.likes.clear()
            self.likes[key] = found
        return found

    def _restart(self) -> None:
        self.likes: dict[int, int | None] = {}
        self.firsts: dict[tuple, int] = {}
        start = ((0, -1, ()),)
        self.states: list[tuple] = [start]
        self.number: dict[tuple, int] = {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.last: dict[int, tuple[int, ...]] = {}

    def _ended(self, config: tuple) -> int:
        node, before, _ = config
        token = self.ends[node]
        return token if token >= 0 and (before < 0 or self.follows(before, token)) else -1

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        to: list[tuple] = []
        for config in self.states[state]:
            node, before, held = config
            down = self.child.get(node << 8 | byte)
            if down is not None and (like := self._like(down, before)) is not None:
                to.append((down, like, held))
            if node:
                token = self._ended(config)
                if token >= 0 and (like := self._like(self.child[byte], token)) is not None:
                    to.append((self.child[byte], like, (*held, token)))
        shared = 0
        first = to[0][2]
        for shared in range(len(first) + 1):
            if shared == len(first) or any(len(c[2]) <= shared or c[2][shared] != first[shared] for c in to[1:]):
                break
        key = tuple(sorted((node, before, held[shared:]) for node, before, held in to))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | byte] = (number, first[:shared])
        return move

    def _last(self, state: int) -> tuple[int, ...]:
        for config in self.states[state]:
            token = self._ended(config) if config[0] else -1
            if token >= 0:
                out = self.last[state] = (*config[2], token)
                return out
        raise ValueError("the vocabulary lacks single bytes")

    def word(self, data: bytes) -> list[int]:
        """The ids of one match of the segmentation; linear in its length."""
        if data in self.whole:
            return [self.whole[data]]
        if len(self.states) > STATES:
            self._restart()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in data:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state, said = move
            if said:
                out += said
        out += self.last.get(state) or self._last(state)
        return out


class _Words(dict):
    """Little-endian ids of words; asks the transducer for words not met lately."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> bytes:
        packed = array("I", self.transducer.word(word.encode()))
        if sys.byteorder == "big":
            packed.byteswap()
        ids = packed.tobytes()
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encodes whole texts; ids are bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer = Transducer(ranks)
        self.vocab = self.transducer.vocab
        self.words = _Words(self.transducer)
        self.pattern = pattern()

    def parts(self, text: str) -> Iterator[bytes]:
        look = self.words.__getitem__
        if len(text) <= STREAM:
            yield b"".join(map(look, self.pattern.findall(text)))
            return
        matches = (m.group() for m in self.pattern.finditer(text))
        while chunk := list(islice(matches, 1 << 15)):
            yield b"".join(map(look, chunk))


# ---------------------------------------------------------------- streaming decode


def _utf8() -> list[list[int]]:
    """The state machine of well-formed UTF-8: state 0 between characters, -1 an error.

    States 1 to 3 want that many continuation bytes; 4 to 7 want a restricted second byte after E0, ED, F0 and F4.
    """
    table = [[-1] * 256 for _ in range(8)]
    second = {4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
    special = {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}
    for b in range(256):
        if b < 0x80:
            table[0][b] = 0
        elif 0xC2 <= b <= 0xF4:
            table[0][b] = special.get(b, 1 if b < 0xE0 else 2 if b < 0xF0 else 3)
        if 0x80 <= b <= 0xBF:
            for state in (1, 2, 3):
                table[state][b] = state - 1
        for state, (lo, hi, to) in second.items():
            if lo <= b <= hi:
                table[state][b] = to
    return table


_NEXT = _utf8()
_BAD = "�".encode()


class Decoder:
    """Decodes ids as they come: ``feed`` returns the bytes of all characters that are complete, ``finish`` the rest.

    A byte that can't go on or begin a character gives U+FFFD for what it breaks off, so all output is well-formed.
    """

    def __init__(self, vocab: list[bytes], clean: np.ndarray | None = None):
        self.vocab = vocab
        self.clean = clean if clean is not None else clean_tokens(vocab)
        self.state, self.held = 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        if not self.state and bool(self.clean[ids].all()):
            return b"".join(map(self.vocab.__getitem__, ids.tolist()))
        out: list[bytes] = []
        at = 0
        odd = np.flatnonzero(~self.clean[ids]).tolist()
        tokens = list(map(self.vocab.__getitem__, ids.tolist()))
        for i in [*odd, len(tokens)]:
            if at < i:
                if self.state:
                    out.append(_BAD)
                    self.state, self.held = 0, b""
                out += tokens[at:i]
            if i < len(tokens):
                out.append(self._walk(tokens[i]))
            at = i + 1
        return b"".join(out)

    def _walk(self, data: bytes) -> bytes:
        out = b""
        for i, byte in enumerate(data):
            to = _NEXT[self.state][byte]
            if to < 0 and self.state:
                out += _BAD
                self.state, self.held = 0, b""
                to = _NEXT[0][byte]
            if to < 0:
                out += _BAD
                continue
            self.state, self.held = to, self.held + data[i : i + 1]
            if not to:
                out += self.held
                self.held = b""
        return out

    def finish(self) -> bytes:
        rest = _BAD if self.state else b""
        self.state, self.held = 0, b""
        return rest


def clean_tokens(vocab: list[bytes]) -> np.ndarray:
    """Which tokens are whole characters."""
    out = np.zeros(len(vocab), bool)
    for i, token in enumerate(vocab):
        state = 0
        for byte in token:
            state = _NEXT[state][byte]
            if state < 0:
                break
        out[i] = state == 0
    return out


# ---------------------------------------------------------------- on DataFrames

_ENCODERS: dict[str, tuple[Encoder, np.ndarray]] = {}


def encoder(path: str) -> tuple[Encoder, np.ndarray]:
    """The encoder of a vocabulary, once for each Python worker."""
    if path not in _ENCODERS:
        made = Encoder(path)
        _ENCODERS[path] = made, clean_tokens(made.vocab)
    return _ENCODERS[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(path)
        for batch in slices(batches):
            ids = [np.frombuffer(b"".join(enc.parts(t or "")), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            keys = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*[batch.column(c) for c in keys], column], [*keys, "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, clean = encoder(path)
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                d = Decoder(enc.vocab, clean)
                out.append((d.feed(ids.values.to_numpy(zero_copy_only=False)) + d.finish()).decode() if ids.is_valid else None)
            keys = [c for c in batch.schema.names if c != "ids"]
            yield pa.record_batch([*[batch.column(c) for c in keys], pa.array(out, pa.string())], [*keys, "text"])

    return run


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, clean = encoder(path)
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                ids, said, n = hashlib.sha256(), hashlib.sha256(), 0
                decoder = Decoder(enc.vocab, clean)
                for part in enc.parts(text or ""):
                    ids.update(part)
                    n += len(part) // 4
                    said.update(decoder.feed(np.frombuffer(part, "<u4")))
                said.update(decoder.finish())
                rows.append((n, ids.hexdigest(), said.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            keys = [c for c in batch.schema.names if c != "text"]
            made = [pa.array(list(columns[0]), pa.int64()), pa.array(list(columns[1]), pa.string()), pa.array(list(columns[2]), pa.string())]
            yield pa.record_batch([*[batch.column(c) for c in keys], *made], [*keys, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _typed(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def encode(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``df`` and ``ids`` (array<int>) of the text by the rank file at ``path``. A null text is empty.

    ``path`` must be readable on all executors. Other columns are not read; one named ids can't be kept. Repeated rows, and ties of any kind, are encoded each; an empty
    table gives none. A text is read whole and encoded in parts, so a long one takes its own length of memory. No shuffle.
    """
    rows = df.select(*keep, F.col(text).alias("text"))
    return rows.mapInArrow(_encode(path), f"{_typed(df, keep)}, ids array<int>")


def decode(df: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``text`` of its ``ids``; malformed UTF-8 gives U+FFFD; null ids a null text."""
    return df.select(*keep, "ids").mapInArrow(_decode(path), f"{_typed(df, keep)}, text string")


def round_trip(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the number and digests of ids and of what they decode to, chunk by chunk.

    Null texts are empty, repeated rows count each, an empty table gives none.
    """
    rows = df.select(*keep, F.col(text).alias("text"))
    return rows.mapInArrow(_digest(path), f"{_typed(df, keep)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their number of tokens, and digests of the ids and of the decoded bytes."""
    prepared(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ["doc_id"])


QUERIES = {"op5_bpe": op5_bpe}
ORACLE: dict[str, str] = {}
