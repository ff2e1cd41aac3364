"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A document is described by the shapes it is written in: runs of three characters, each reduced to one of twelve kinds, and how often a
word repeats the one or two before it.  A truncated singular value decomposition of the labelled sample
turns these counts, weighted by rarity, into vectors of 64 numbers.  The labelled vectors are broadcast, every document's
cosine with every one of them is computed in blocks, and the nearest vote with weights that fall with their distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.labelled import sample, training_labels
from tokenloom.llm.words import text_buffer, words

#: Labelled documents of each class that vote, at most.
PER_CLASS = 3_000
LATENT = 64
NEIGHBOURS = 25
#: Votes weigh exp((cosine - best cosine) / WIDTH).
WIDTH = 0.02
#: Documents multiplied with the labelled vectors at a time.
BLOCK = 256

KINDS = 12
SHAPES = KINDS**3
#: Shapes, then pairs of counts for words that repeat the word before, or the one before that, and those that don't.
TERMS = SHAPES + 4


def _kinds() -> np.ndarray:
    kind = np.full(256, 10, dtype=np.int64)
    kind[:32], kind[127], kind[128:] = 11, 11, 5
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    for characters, k in ((b" \t", 3), (b"\n\r", 4), (b".,;:?'\"()", 6), (b"!", 7), (b"|", 8), (b"#$%&*@^~", 9)):
        kind[list(characters)] = k
    return kind


_KIND = _kinds()


def describe(column: pa.Array) -> np.ndarray:
    """A row of term weights for each text, from whole texts; a text too short for a term has zeros."""
    buffer, offsets = text_buffer(column)
    out = np.zeros((len(column), TERMS), dtype=np.float32)
    found, bounds = words(buffer, offsets)
    once, twice = np.zeros(len(found), dtype=bool), np.zeros(len(found), dtype=bool)
    once[1:], twice[2:] = found[1:] == found[:-1], found[2:] == found[:-2]
    for i in range(len(column)):
        kinds = _KIND[buffer[offsets[i] : offsets[i + 1]]]
        if len(kinds) >= 3:
            shapes = np.bincount((kinds[:-2] * KINDS + kinds[1:-1]) * KINDS + kinds[2:], minlength=SHAPES)
            out[i, :SHAPES] = np.sqrt(shapes / len(kinds))
        a, b = bounds[i], bounds[i + 1]
        if b - a >= 3:
            for k, same in enumerate((once[a + 1 : b], twice[a + 2 : b])):
                out[i, SHAPES + 2 * k] = np.sqrt(same.mean())
                out[i, SHAPES + 2 * k + 1] = np.sqrt(1 - same.mean())
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Voters:
    """The projection, the labelled vectors, and what their votes weigh."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def scores(self, described: np.ndarray) -> np.ndarray:
        out = np.full(len(described), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for i in range(0, len(described), BLOCK):
            vectors = _unit(described[i : i + BLOCK] @ self.projection)
            cosine = vectors @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.tile(np.arange(k), (len(cosine), 1))
            at = np.take_along_axis(cosine, near, axis=1).astype(np.float64)
            votes = np.exp((at - at.max(axis=1, keepdims=True)) / WIDTH) * self.weights[near]
            share = (votes * self.labels[near]).sum(axis=1) / votes.sum(axis=1)
            out[i : i + BLOCK] = np.where(np.abs(vectors).sum(axis=1) > 0, share, self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(described: np.ndarray, labels: np.ndarray, sizes: dict[int, int], terms: np.ndarray | None = None) -> Voters:
    """Voters from the labelled sample, whose columns are ``terms`` (all, if none are given).

    A label's votes weigh as many documents as they stand for.
    """
    terms = np.arange(TERMS) if terms is None else terms
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    if not described.size:
        return Voters(np.zeros((TERMS, LATENT), np.float32), np.zeros((0, LATENT), np.float32), np.zeros(0), np.zeros(0), prior)
    rarity = np.log1p(len(described) / (1 + (described > 0).sum(axis=0)))
    gram = np.zeros((len(terms), len(terms)))
    for i in range(0, len(described), BLOCK):
        weighted = (described[i : i + BLOCK] * rarity).astype(np.float64)
        gram += weighted.T @ weighted
    axes = np.linalg.eigh(gram)[1][:, ::-1][:, :LATENT]
    projection = np.zeros((TERMS, LATENT), dtype=np.float32)
    projection[terms, : axes.shape[1]] = rarity[:, None] * axes
    taken = np.bincount(labels, minlength=2)
    weights = np.array([sizes.get(y, 0) / max(taken[y], 1) for y in (0, 1)])[labels]
    return Voters(projection, _unit(described @ projection[terms]).astype(np.float32), labels.astype(np.float64), weights, prior)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Voters:
    """Voters from the labelled documents outside the held-out fold, at most ``per_class`` of each label."""
    texts, sizes = sample(docs, training_labels(labels, "quality", id_col), per_class, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = describe(batch.column(0))
            held = [np.flatnonzero(r).astype("<u2") for r in rows]
            columns = [[h.tobytes() for h in held], [r[h].astype("<f4").tobytes() for r, h in zip(rows, held, strict=True)]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in columns), batch.column(1)], names=["terms", "weights", "label"])

    # Bounded by the sample, some hundred terms a row; in a fixed order, as sums depend on it.
    rows = texts.mapInArrow(run, "terms BINARY, weights BINARY, label INT").orderBy("terms", "weights", "label").collect()
    held = [np.frombuffer(r.terms, dtype="<u2") for r in rows]
    terms = np.unique(np.concatenate([np.zeros(0, dtype="<u2"), *held])).astype(np.int64)
    described = np.zeros((len(rows), len(terms)), dtype=np.float32)
    for i, (r, h) in enumerate(zip(rows, held, strict=True)):
        described[i, np.searchsorted(terms, h)] = np.frombuffer(r.weights, dtype="<f4")
    return fit(described, np.array([r.label for r in rows], dtype=np.int64), sizes, terms)


def score(docs: DataFrame, voters: Voters, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows of ``docs`` with the probability of good quality in ``score_col``, which replaces a column of that name.

    Only the text decides: null, empty and very short texts get the share of good ones among the labelled, equal texts score alike,
    and texts are described whole.  Other columns and repeated rows stay; an empty table stays empty.  No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)  # bounded by the sample

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        column = pa.array(texts, type=pa.string(), from_pandas=True)
        parts = [shared.value.scores(describe(column.slice(i, BLOCK))) for i in range(0, len(column), BLOCK)]
        return pd.Series(np.concatenate([np.zeros(0), *parts]))

    return docs.withColumn(score_col, scored(F.col(text_col).cast("string")))
