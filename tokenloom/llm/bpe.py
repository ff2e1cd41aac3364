"""Byte-level BPE encoding and decoding.

Texts are cut by the pattern into pieces, and the distinct new pieces of a batch become rows of padded
matrices, one matrix for each range of lengths.  In each round every row merges its leftmost pair of
least rank.  Pairs are looked up in an open-addressing hash table; rows without a pair left are
taken out, so the matrix shrinks in both directions.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.pieces import Memory, pattern

NONE = np.int32(2**31 - 1)
#: Cells of a matrix at a time.
CELLS = 1 << 18
#: Pieces longer than this are merged one by one, all places of their least rank in a round.
LONG = 1 << 11
#: Chunks remembered by a worker; a worker that decodes what another one encodes stands beside it.
REMEMBERED = 250_000


class PairTable:
    """Rank of the token that two tokens make, by open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self._bits = max(int(np.ceil(np.log2(len(rank) + 1))) + 2, 4)
        size = 1 << self._bits
        self._keys = np.full(size, -1, dtype=np.int64)
        self._ranks = np.full(size, NONE, dtype=np.int32)
        keys, ranks = self._key(left, right), rank.astype(np.int32)
        slots = self._slot(keys)
        while len(keys):
            _, first = np.unique(slots, return_index=True)
            first = first[self._keys[slots[first]] < 0]
            self._keys[slots[first]], self._ranks[slots[first]] = keys[first], ranks[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, ranks, slots = keys[rest], ranks[rest], (slots[rest] + 1) & (size - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it makes no token; a negative id is padding."""
        out = np.full(len(left), NONE, dtype=np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left[at], right[at])
        slots = self._slot(keys)
        while len(at):
            there = self._keys[slots]
            hit = there == keys
            out[at[hit]] = self._ranks[slots[hit]]
            on = ~hit & (there >= 0)
            at, keys, slots = at[on], keys[on], (slots[on] + 1) & (len(self._keys) - 1)
        return out


class Vocabulary:
    """The ranks of a byte-level BPE vocabulary; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        pairs = []
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append((left, right, rank))
        self._pairs = PairTable(*np.array(pairs, dtype=np.int64).reshape(-1, 3).T)
        self.memory = Memory(self.encode_chunks, REMEMBERED)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian 32-bit numbers; equal pieces are merged once."""
        cut = list(map(pattern().findall, chunks))
        distinct = list(set(chain.from_iterable(cut)))
        ids = dict(zip(distinct, self.encode_pieces([p.encode() for p in distinct]), strict=True))
        return [ids[pieces[0]] if len(pieces) == 1 else b"".join(map(ids.__getitem__, pieces)) for pieces in cut]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is None and len(piece) > LONG:
                out[i] = self._merge_long(piece)
            elif rank is None and piece:
                rest.append(i)
            else:
                out[i] = b"" if rank is None else rank.to_bytes(4, "little")
        rest.sort(key=lambda i: len(pieces[i]))
        lengths, at = np.array([len(pieces[i]) for i in rest]), 0
        while at < len(rest):
            width = 1 << int(lengths[at] - 1).bit_length()  # lengths from width / 2 + 1 to width
            end = min(int(np.searchsorted(lengths, width, side="right")), at + max(CELLS // width, 1))
            bucket = rest[at:end]
            for i, ids in zip(bucket, self._merge([pieces[i] for i in bucket]), strict=True):
                out[i] = ids
            at = end
        return out

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """One matrix: rounds of merges, one in each row that still has a pair."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        width = int(lengths.max())
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        ids[np.arange(width) < lengths[:, None]] = self._bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ranks = self._pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        rows, out = np.arange(len(pieces)), [b""] * len(pieces)
        while True:
            every = np.arange(len(rows))
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            least = ranks[every, best] if ranks.shape[1] else np.full(len(rows), NONE)
            live = least < NONE
            done = np.flatnonzero(~live)
            if len(done):
                kept = ids[done] >= 0
                flat, ends = ids[done][kept].astype("<u4").tobytes(), np.cumsum(4 * kept.sum(axis=1)).tolist()
                for row, a, b in zip(rows[done].tolist(), [0, *ends], ends):
                    out[row] = flat[a:b]
            if len(done) == len(rows):
                return out
            if len(done):
                ids, ranks, rows, best, least = ids[live], ranks[live], rows[live], best[live], least[live]
                every = np.arange(len(rows))
            places = np.arange(ids.shape[1] - 1)
            later = places > best[:, None]
            ids = np.take_along_axis(ids, places + later, axis=1)
            ids[every, best] = least
            ranks = np.take_along_axis(ranks, places[:-1] + later[:, :-1], axis=1)
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self._pairs(ids[left, best[left] - 1], least[left])
            right = np.flatnonzero(best < ids.shape[1] - 1)
            ranks[right, best[right]] = self._pairs(least[right], ids[right, best[right] + 1])

    def _merge_long(self, piece: bytes) -> bytes:
        """One row, whose cells are linked: a round merges every place of the least rank, from the left.

        That is what merging the leftmost of them again and again comes to, up to the first merge that makes a pair of lower rank: the round ends
        there.  Dead cells stay until half are dead, so a round costs a look over the row and no copy of it.
        """
        ids = self._bytes[np.frombuffer(piece, dtype=np.uint8)]
        while True:
            n = len(ids)
            ranks = np.append(self._pairs(ids[:-1], ids[1:]), NONE)  # of a cell and the next living one
            before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
            live = n
            while True:
                least = ranks.min()
                if least == NONE:
                    return ids[ids >= 0].astype("<u4").tobytes()
                at = np.flatnonzero(ranks == least)
                # Of places that overlap in a chain every second one, from its left end.
                joined = np.zeros(len(at), dtype=bool)
                joined[1:] = after[at[:-1]] == at[1:]
                starts = np.flatnonzero(~joined)
                at = at[(np.arange(len(at)) - starts[np.cumsum(~joined) - 1]) % 2 == 0]
                gone = after[at]
                left, right = before[at], after[gone]
                # What each merge makes at its time: those to the left are done, those to the right not yet.
                merged = np.zeros(len(at), dtype=bool)
                merged[1:] = left[1:] == gone[:-1]
                on_left = np.where(merged, least, np.where(left >= 0, ids[left], -1))
                on_right = np.where(right < n, ids[np.minimum(right, n - 1)], -1)
                new = np.full(len(at), least, dtype=np.int32)
                lower = np.flatnonzero(np.minimum(self._pairs(on_left, new), self._pairs(new, on_right)) < least)
                if len(lower):
                    at, gone, right = at[: lower[0] + 1], gone[: lower[0] + 1], right[: lower[0] + 1]
                ids[at], ids[gone], ranks[gone] = least, -1, NONE
                after[at] = right
                inner = right < n
                before[right[inner]] = at[inner]
                left = before[at]
                ranks[at] = self._pairs(ids[at], np.where(inner, ids[np.minimum(right, n - 1)], -1))
                some = left >= 0
                ranks[left[some]] = self._pairs(ids[left[some]], ids[at[some]])
                live -= len(at)
                if 2 * live < n:
                    break
            ids = ids[ids >= 0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Once for each worker."""
    return Vocabulary.from_file(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts: ``id_col`` and ``ids``, the ids as little-endian unsigned 32-bit numbers in a binary.

    ``path`` names a rank file that every executor can open.  Very long texts, and long runs without a gap in them, take time in proportion to their length, about.  Null and empty texts have no ids.  Each row is
    encoded by itself, so repeated rows, ties and null ids pass through; other columns are left behind.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in batches:
            texts = (t or "" for t in batch.column(1).to_pylist())
            ids = pa.array(vocabulary.memory.ids(texts), type=pa.binary(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    chosen = docs.select(id_col, F.col(text_col).cast("string"))
    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Decode what ``encode`` returns: ``id_col``, ``ids`` and ``decoded``, the bytes of the text.  No ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in batches:
            texts = [vocabulary.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.binary())], names=[id_col, "ids", "decoded"])

    chosen = encoded.select(id_col, "ids")
    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")
