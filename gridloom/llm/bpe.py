"""Byte-level BPE by prefix dynamic programming, and decoding.

For every byte prefix of a piece exactly one token can end its encoding: the last token of the
prefix's own BPE encoding. A token ending at byte e is that token if it is compatible with the last
token of the prefix before it, i.e. if BPE keeps the two apart. Storing the last token of every prefix
gives the encoding of each prefix by walking back, allows exact appends, and after an edit only the
prefixes near it change.

Two tokens a, b stay apart unless some merge crosses their boundary: for the pieces x on a's right
spine and y on b's left spine, x + y would have to be a token whose turn comes while both exist, that
is before x is merged into its parent, and not after y is (equal ranks are merged from the left).
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from gridloom.plans.lineage import ship

_NEVER = 1 << 62
#: Entries of a worker's memos, two generations of which are held; beyond it, what was not used lately is worked out again.
MEMO = 300_000
#: Characters after which a long text is split at the next safe place.
CHUNK = 1 << 20


class Memo(dict):
    """Results of ``made`` by key, keeping at least the ``most`` latest."""

    def __init__(self, made: Callable, most: int = MEMO):
        self.made, self.most, self.before = made, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.made(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """A rank file's tokens, how BPE forms each of them, and which can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        #: The rank of every token, and -1 for what only begins tokens.
        self.begun = {token[:k]: -1 for token in ranks for k in range(1, len(token))} | ranks
        self._right: dict[int, list[tuple[int, bytes, int]]] = {}
        self._left: dict[int, list[tuple[int, bytes, int]]] = {}
        self._apart = Memo(self._stay_apart, 2 * MEMO)  # of a << 20 | b

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge forms a token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, k = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                raise ValueError(f"no merges form the token {token!r}")
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts[0], parts[1]

    def _spine(self, token: int, side: int) -> list[tuple[int, bytes, int]]:
        """(rank that formed it, bytes, rank that merges it into its parent) from the token inwards, along one side."""
        memo = self._right if side else self._left
        if token not in memo:
            piece, gone, out = self.tokens[token], _NEVER, []
            while True:
                made = self.ranks[piece] if len(piece) > 1 else -1
                out.append((made, piece, gone))
                if len(piece) == 1:
                    break
                gone, piece = made, self._halves(piece)[side]
            memo[token] = out
        return memo[token]

    def _stay_apart(self, pair: int) -> bool:
        for made_x, x, gone_x in self._spine(pair >> 20, 1):
            for made_y, y, gone_y in self._spine(pair & 0xFFFFF, 0):
                rank = self.ranks.get(x + y)
                if rank is not None:
                    turn = max(rank, made_x, made_y)
                    if turn < gone_x and turn <= gone_y:
                        return False
        return True

    def extend(self, piece: bytes, last: list[int], known: int) -> None:
        """Fills last[e], the last token of piece[:e], for known < e <= len(piece)."""
        begun, apart, n = self.begun.get, self._apart, len(piece)
        for at in range(max(0, known - self.longest + 1), n):
            before = last[at] << 20
            for end in range(max(at, known) + 1, n + 1):
                token = begun(piece[at:end])
                if token is None:
                    break
                if token >= 0 > last[end] and (not at or apart[before | token]):
                    last[end] = token

    def back(self, last: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        last = [-1] * (len(piece) + 1)
        self.extend(piece, last, 0)
        return tuple(self.back(last, len(piece)))


class PrefixTable:
    """The last tokens of all prefixes of one piece, kept while it is appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        known = len(self.piece)
        self.piece += more
        self.last += [-1] * len(more)
        self.vocabulary.extend(self.piece, self.last, known)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces piece[start:stop]; returns how many prefixes were worked out again.

        The rest is taken over as soon as the last tokens agree over the longest token's length.
        """
        tail, old, longest = self.piece[stop:], self.last[stop:], self.vocabulary.longest
        self.piece, self.last = self.piece[:start], self.last[: start + 1]
        self.append(new)
        made, done = len(new), 0
        while done < len(tail):
            step = tail[done : done + longest]
            self.append(step)
            made, done = made + len(step), done + len(step)
            if len(step) == longest and self.last[-longest:] == old[done - longest + 1 : done + 1]:
                self.piece, self.last = self.piece + tail[done:], self.last + old[done + 1 :]
                break
        return made

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of a prefix, the whole piece by default."""
        return self.vocabulary.back(self.last, len(self.piece) if end is None else end)


class Encoder:
    """Texts to ids: pieces by the pattern, each encoded on its own."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = load_vocabulary(path)
        self.pieces = regex.compile(pattern).findall
        self.memo = Memo(lambda piece: array("i", self.vocabulary.encode_piece(piece.encode())).tobytes())

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as 32-bit numbers."""
        return np.frombuffer(b"".join([b"".join(map(self.memo.__getitem__, self.pieces(part))) for part in chunks(text)]), np.int32)


#: A piece of these patterns begins at a single space between two characters that are not white space.
_SAFE = regex.compile(r"\S(?= \S)")


def chunks(text: str) -> Iterator[str]:
    """A text in parts of about CHUNK characters, cut only where a piece begins in any case."""
    at = 0
    while len(text) - at > CHUNK:
        cut = _SAFE.search(text, at + CHUNK)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def load_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(load_ranks(path))


@cache
def load_encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _mapped(df: DataFrame, keep: list[str], column: str, out: str, kind: str, made: Callable) -> DataFrame:
    """Columns ``keep`` of df and ``out``, ``made()`` of the values of ``column``; rows cross in small batches."""
    ship(df.sparkSession)
    keep = [c for c in keep if c.lower() != out.lower()]  # the new column replaces it
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias("__in"))
    schema = source.drop("__in").withColumn(out, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = made()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], whole(part.column(len(keep)))], names=[*keep, out])

    return source.mapInArrow(run, schema)


def encode(df: DataFrame, keep: list[str], text: str, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """Columns ``keep`` and the ids of whole texts, as the rank file's BPE encodes them without special tokens.

    Null and empty texts have no ids. Rows are independent, so ties, repeats and an empty table need no care.
    """

    def made():
        encoder = load_encoder(path, pattern)

        def whole(texts: pa.Array) -> pa.Array:
            ids = [encoder.encode(text.as_py() or "") for text in texts]
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))

        return whole

    return _mapped(df, keep, text, out, "array<int>", made)


def decode(df: DataFrame, keep: list[str], ids: str, path: str, out: str = "bytes") -> DataFrame:
    """Columns ``keep`` and the bytes that ids stand for; null ids are none, an id outside the vocabulary is an error."""

    def made():
        token = load_vocabulary(path).tokens.__getitem__
        return lambda rows: pa.array([b"".join(map(token, row.values.to_numpy(zero_copy_only=False).tolist())) if row.is_valid else b"" for row in rows], pa.binary())

    return _mapped(df, keep, ids, out, "binary", made)
