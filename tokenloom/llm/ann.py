"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample turns vectors into binary codes of up to 64 bits, cut into substrings of 8.  Each
substring of a block's codes is indexed.  By the pigeonhole principle a code within a Hamming radius r of a query's lies within
r div m or fewer bits of it in one of the m substrings, so probing these substrings retrieves every such code; those
within r are ranked by their exact distances.  The radius is learned too: the least that finds the wanted share of
true neighbours within the sample.  A query that finds fewer than k in a block widens its radius there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.blocks import search, take_best, usable
from tokenloom.llm.registry import hashed_sample

#: Rows that the rotation and the radius are learned from, about so many at most.
SAMPLE = 4096
#: Share of true neighbours that the radius must find in the sample.
RECALL = 0.98
ROUNDS = 30

_POP = np.array([bin(b).count("1") for b in range(256)])
_BY_BITS = [np.flatnonzero(_POP <= s) for s in range(9)]


@dataclass(frozen=True)
class Codes:
    """The learned projection: a code's bit is the sign of a rotated component."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    @property
    def parts(self) -> int:
        return self.rotation.shape[1] // 8

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """One byte for each substring."""
        return np.packbits((vectors - self.mean) @ self.rotation > 0, axis=1)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1)


def learn(sample: np.ndarray, k: int, recall: float = RECALL) -> Codes:
    """Rotate the principal components so that their signs lose least (iterative quantisation), then fit the radius."""
    rng = np.random.default_rng(7)
    dims = sample.shape[1]
    bits = min(64, max(8, dims // 8 * 8))
    mean = sample.mean(axis=0)
    _, axes = np.linalg.eigh((sample - mean).T @ (sample - mean))
    axes = axes[:, ::-1][:, :bits]
    if axes.shape[1] < bits:  # fewer components than bits: add directions at random
        axes = np.concatenate([axes, rng.normal(size=(dims, bits - axes.shape[1]))], axis=1)
    low = (sample - mean) @ axes
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
        turn = (u @ v).T
    codes = Codes(mean, axes @ turn, bits)
    packed, asked = codes.encode(sample), sample[:256]
    far = []
    for i, q in enumerate(asked):
        near = np.argsort(((sample - q) ** 2).sum(axis=1), kind="stable")[: k + 1]
        far.append(hamming(packed[near], packed[i]))
    radius = int(np.quantile(np.concatenate(far), recall)) if far else bits
    return Codes(mean, codes.rotation, min(radius, bits))


class SubstringIndex:
    """For each substring the rows ordered by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.orders = [np.argsort(codes[:, t], kind="stable") for t in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, t], np.arange(257)) for t, o in enumerate(self.orders)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs in ``radius`` bits at most."""
        parts = self.codes.shape[1]
        near, rest = divmod(radius, parts)
        found = np.zeros(len(self.codes), dtype=bool)
        for t in range(parts):
            # Were the first rest + 1 substrings further than near, and the others near or further, the sum would exceed radius.
            reach = near if t <= rest else near - 1
            if reach < 0:
                continue
            values = _BY_BITS[min(reach, 8)] ^ code[t]
            first, sizes = self.starts[t][values], self.starts[t][values + 1] - self.starts[t][values]
            at = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            found[self.orders[t][at]] = True
        rows = np.flatnonzero(found)
        return rows[hamming(self.codes[rows], code) <= radius]


def nearest(
    vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows found for each row whose id is divisible by ``every``: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``score`` is the Euclidean distance of the original vectors in double precision.  Rows whose id or vector is null, whose
    vector is empty or all zero, or holds a null or non-finite component take no part; see ``search`` for
    dimensions, equal ids and ties.  An empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vec_col, drop_zero=True)
    # a row that comes again and again is drawn or not as one
    sample = hashed_sample(rows, rows.count(), SAMPLE, "id", "vec").dropDuplicates(["id", "vec"])
    sample = sample.select("vec", F.size("vec").alias("dims")).orderBy("vec").collect()
    learned = {}
    for dims in {r.dims for r in sample}:
        learned[dims] = learn(np.array([r.vec for r in sample if r.dims == dims]), k)

    def run(query_ids, queries, ids, values):
        # A dimension too rare for the sample is learned where it is met, from rows all over the block; its codes need not agree between blocks.
        codes = learned.get(values.shape[1]) or learn(values[:: -(-len(values) // SAMPLE)], k)
        index, asked = SubstringIndex(codes.encode(values)), codes.encode(queries)
        at, found, scores = [], [], []
        for i, (own, q) in enumerate(zip(query_ids, queries, strict=True)):
            radius, rows_ = codes.radius, np.zeros(0, dtype=np.int64)
            while True:
                rows_ = index.within(asked[i], radius)
                rows_ = rows_[ids[rows_] != own]
                if len(rows_) >= k or radius >= 8 * codes.parts:
                    break
                radius = min(radius + codes.parts, 8 * codes.parts)
            distance = np.sqrt(((values[rows_] - q) ** 2).sum(axis=1))
            best = take_best(distance, ids[rows_], k, ascending=True)
            at.append(np.full(len(best), i))
            found.append(ids[rows_[best]])
            scores.append(distance[best])
        return np.concatenate(at), np.concatenate(found), np.concatenate(scores)

    return search(rows, F.col("id") % every == 0, k, run, ascending=True, score="DOUBLE")
