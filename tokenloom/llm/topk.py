"""Exact top-k by integer inner product from an impact-ordered index, score at a time.

In each dimension the integers of a block, less the smallest, are cut into binary digits: the rows that hold a digit are a posting
segment whose impact is the digit's value.  As dense vectors have a posting in every dimension, a segment is kept
as a column of a bit matrix.  Segments are processed by descending impact, all dimensions of a digit at once.
What the digits still to come can add or take away is known, and the k-th best score so far, so every row that
could still be a member is known too.  Processing stops when this proof leaves few rows; those
are scored exactly from their integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.blocks import search, take_best, usable

SCALE = 1024
#: Score cells of a block at a time.
CELLS = 1 << 21
#: Possible members for each query, as a multiple of k, at which the rest is scored directly.
ENOUGH = 4
#: Integers beyond this could overflow a score.
LARGEST = 1 << 27


class ImpactIndex:
    """The digits of a block's integers, by descending impact."""

    def __init__(self, integers: np.ndarray):
        self.integers = integers
        self.least = integers.min(axis=0)
        self._above = integers - self.least
        self.digits = int(self._above.max()).bit_length()

    def segments(self):
        """Impact of a digit and the rows that hold it, for each dimension a column."""
        for digit in range(self.digits - 1, -1, -1):
            yield 1 << digit, ((self._above >> digit) & 1).astype(np.float64)

    def members(self, queries: np.ndarray, excluded: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the rows that can be among the k best; ``excluded[i, j]`` marks rows that are no candidates."""
        n = len(self.integers)
        spread = np.abs(queries).sum(axis=1).astype(np.float64)  # what a unit of impact in all dimensions can move
        if n <= k or float(spread.max()) * float(1 << (self.digits + 1)) >= 2**52:
            return [np.flatnonzero(~excluded[i]) for i in range(len(queries))]
        weights = queries.T.astype(np.float64)
        scores = np.where(excluded.T, -np.inf, 0.0)
        possible = ~excluded.T
        for impact, held in self.segments():
            scores += impact * (held @ weights)
            kth = np.partition(scores, n - k, axis=0)[n - k]
            # Lower digits sum to impact - 1 at most, so two rows can change places by spread * (impact - 1).
            possible = (scores >= kth - spread * (impact - 1)) & ~excluded.T
            if possible.sum() <= ENOUGH * k * len(queries):
                break
        return [np.flatnonzero(possible[:, i]) for i in range(len(queries))]


def highest(
    vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The ``k`` highest integer inner products for each row whose id is divisible by ``every``: ``query_id``, ``rank``, ``vec_id``, ``score``.

    A component x counts as floor(1024 * x).  Rows whose id or vector is null, whose vector is empty, or holds a null or non-finite
    component take no part; components past 2^17 raise an error, as their scores could overflow.  See ``search``
    for dimensions, equal ids and ties.  An empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vec_col, drop_zero=False)

    def run(query_ids, queries, ids, values):
        queries, values = np.floor(queries * SCALE), np.floor(values * SCALE)
        if max(np.abs(queries).max(), np.abs(values).max()) > LARGEST:
            raise ValueError("a component is too large for integer scores")
        queries, index = queries.astype(np.int64), ImpactIndex(values.astype(np.int64))
        at, found, scores = [], [], []
        step = max(1, CELLS // len(ids))
        for start in range(0, len(queries), step):
            some = queries[start : start + step]
            own = query_ids[start : start + step, None] == ids[None, :]
            for i, rows_ in enumerate(index.members(some, own, k)):
                exact = index.integers[rows_] @ some[i]
                best = take_best(exact, ids[rows_], k, ascending=False)
                at.append(np.full(len(best), start + i))
                found.append(ids[rows_[best]])
                scores.append(exact[best])
        return np.concatenate(at), np.concatenate(found), np.concatenate(scores)

    return search(rows, F.col("id") % every == 0, k, run, ascending=False, score="BIGINT")
