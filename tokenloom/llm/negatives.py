"""Hard negatives by threshold joins in the manner of L2AP.

A join asks for all rows whose inner product with a query reaches a threshold.  Rows of a block are indexed by dimension,
those of greatest energy first.  By Cauchy and Schwarz the part of a row from some dimension on adds at most the product of its suffix norm and the
query's, so the dimensions from there on, covered by that bound, are left out of the index, and a row none of whose
dimensions are needed is left out whole.  As rows are sorted by how many dimensions they keep, a posting list is
a stretch of a column.  Partial scores accumulate a stretch of dimensions at a time; after each, a row leaves the race where its partial score and the
norms that remain stay below the threshold.  Survivors are scored on all dimensions, in integers.

Anchors want the best rows within a window of scores.  A join starts with a high threshold and lowers it
until every window has its rows or the threshold has reached its lower end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.registry import written

SCALE = 256
#: Bounds of the negatives' scores in hundredths of the positive's.
LOW, HIGH, WHOLE = 30, 90, 100

#: Rows and anchors of a block, about; small tables are dealt into LEAST_BLOCKS for the sake of parallel work.
BLOCK_ROWS, ANCHOR_ROWS, LEAST_BLOCKS = 1 << 15, 1 << 10, 16
#: Dimensions that accumulate between two prunings.
STRETCH = 8
#: Partial scores held at a time.
CELLS = 1 << 21
#: Thresholds on the way down, as shares of the way from a window's upper end to its lower.
STEPS = (0.25, 0.5, 0.75)
#: Integers beyond this could overflow a score.
LARGEST = 1 << 24


class ThresholdIndex:
    """Integer rows, indexed for joins with queries whose threshold is at least ``least`` times their norm."""

    def __init__(self, rows: np.ndarray, least: float = -np.inf):
        self.rows = rows
        energy = (rows.astype(np.float64) ** 2).sum(axis=0)
        self.order = np.argsort(-energy, kind="stable")
        turned = rows[:, self.order].astype(np.float64)
        # rest[:, d]: the norm of what lies from dimension d on.
        self.rest = np.sqrt(np.concatenate([np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(rows), 1))], axis=1))
        # The first dimension whose suffix alone stays below the threshold; it and those after it are left out.
        self.kept = (self.rest[:, :-1] >= least * (1 - 1e-12)).sum(axis=1) if least > 0 else np.full(len(rows), rows.shape[1])
        self.by = np.argsort(-self.kept, kind="stable")
        self.turned, self.rest, self.kept = turned[self.by], self.rest[self.by], self.kept[self.by]

    def reaching(self, queries: np.ndarray, thresholds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows whose inner product reaches its threshold, and those products."""
        asked = queries[:, self.order].astype(np.float64)
        rest = np.sqrt(np.concatenate([np.cumsum((asked**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(asked), 1))], axis=1))
        slack = 1e-9 * (1 + rest[:, :1] * (self.rest[:, 0].max() if len(self.rest) else 0))
        alive = np.count_nonzero(self.kept)
        rows = np.arange(alive)  # rows that some query still wants
        partial = np.zeros((len(asked), alive))
        wanted = np.ones((len(asked), alive), dtype=bool)
        dims = asked.shape[1]
        for d in range(0, dims, STRETCH):
            e = min(d + STRETCH, dims)
            held = np.searchsorted(-self.kept[rows], -d, side="left")  # rows indexed at d or beyond
            if not held:
                break
            some = rows[:held]
            indexed = np.where(np.arange(d, e)[None, :] < self.kept[some, None], self.turned[some, d:e], 0.0)
            partial[:, :held] += asked[:, d:e] @ indexed.T
            # What a row has not added yet: from its first dimension that is left out, or from here.
            at = np.minimum(e, self.kept[rows])
            wanted &= partial + self.rest[rows, at][None, :] * rest[:, at] >= thresholds[:, None] - slack
            live = wanted.any(axis=0)
            if live.sum() < 0.7 * len(rows):
                rows, partial, wanted = rows[live], partial[:, live], wanted[:, live]
        for i in range(len(asked)):
            found = self.by[rows[wanted[i]]]
            scores = self.rows[found] @ queries[i]
            enough = scores >= thresholds[i]
            yield found[enough], scores[enough]


def best_in_windows(
    rows: np.ndarray, ids: np.ndarray, allowed: np.ndarray, queries: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window (of query ``query[w]``, scores ``low[w]`` to ``high[w]``) its ``k`` best rows: windows, positions, scores.

    ``allowed[q, r]`` says whether row r may answer query q.  Ties go to smaller ids.
    """
    most = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1).max())
    top, floor = np.minimum(high, most[query]), np.maximum(low, -most[query] - 1)
    out, open_ = [], floor <= top
    for share in (*STEPS, 1.0):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        # A query joins at the lowest threshold of its open windows.
        wanted = np.where(share < 1.0, top[at] - share * (top[at] - floor[at]), floor[at])
        asking, place = np.unique(query[at], return_inverse=True)
        thresholds = np.full(len(asking), np.inf)
        np.minimum.at(thresholds, place, wanted)
        norms = np.sqrt((queries[asking].astype(np.float64) ** 2).sum(axis=1))
        index = ThresholdIndex(rows, float(np.min(thresholds / np.maximum(norms, 1e-300))))
        step = max(1, CELLS // max(len(rows), 1))
        for start in range(0, len(asking), step):
            some = slice(start, start + step)
            for i, (found, scores) in enumerate(index.reaching(queries[asking[some]], thresholds[some]), start):
                fine = allowed[asking[i], found]
                found, scores = found[fine], scores[fine]
                order = np.lexsort((ids[found], -scores))
                found, scores = found[order], scores[order]
                for w in at[place == i]:
                    first = np.searchsorted(-scores, -high[w], side="left")
                    end = np.searchsorted(-scores, -low[w], side="right")
                    here = slice(first, min(first + k, end))
                    if here.stop - here.start == k or share == 1.0:
                        out.append((np.full(here.stop - here.start, w), found[here], scores[here]))
                        open_[w] = False
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def usable(vectors: DataFrame, label: Column, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``label``, ``vec``: rows with an id, a label and a non-empty vector of finite components, as integers."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), vec.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND size(vec) > 0").where(fine)
    return written(rows.select("id", "label", F.transform("vec", lambda x: F.floor(x * SCALE)).alias("vec")), "labelled-vectors")


def _blocks(rows: DataFrame, blocks: int, names: list[str]) -> DataFrame:
    """One row for each dimension and block: ids, labels, vectors one after another and whatever else ``rows`` has."""
    at = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")  # copies of a row are dealt out too
    packed = rows.withColumn("dims", F.size("vec")).withColumn("block", at).groupBy("dims", "block").agg(F.collect_list(F.struct("id", "label", "vec", *names)).alias("r"))
    return packed.select("dims", "block", F.col("r.id").alias("ids"), F.col("r.label").alias("labels"), F.flatten("r.vec").alias("values"), *(F.col(f"r.{n}").alias(n) for n in names))


_FOUND = "anchor BIGINT, place INT, id BIGINT, score BIGINT"


def _searched(blocks: DataFrame, n: int, anchors: DataFrame, asked: int, k: int, same: bool) -> DataFrame:
    """``anchor``, ``place`` (of the window), ``id``, ``score``: the ``k`` best rows of every block for every window of ``anchors``.

    ``anchors`` has ``id``, ``label``, ``vec`` and ``windows``, an array of (low, high); ``same`` asks for rows of the same label, else for those of others.
    """
    asking = _blocks(anchors, max(1, -(-asked // ANCHOR_ROWS)), ["windows"]).select(
        "dims", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("values").alias("a_values"),
        F.transform("windows", F.size).alias("a_counts"), F.flatten("windows").alias("a_windows"),
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"),
    )
    pairs = blocks.join(asking, ["dims", "block"]).repartition(n, "dims", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in range(batch.num_rows):
                dims = batch.column(0)[t].as_py()
                ids, labels, values, a_ids, a_labels, a_values, counts = (c[t].values.to_numpy(zero_copy_only=False) for c in batch.columns[1:8])
                windows = batch.column(8)[t].values
                low, high = (windows.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                rows, queries = values.reshape(-1, dims), a_values.reshape(-1, dims)
                if any(x.max() > LARGEST or x.min() < -LARGEST for x in (rows, queries)):
                    raise ValueError("a component is too large for integer scores")
                query = np.repeat(np.arange(len(a_ids)), counts)
                place = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
                alike = a_labels[:, None] == labels[None, :]
                allowed = alike & (a_ids[:, None] != ids[None, :]) if same else ~alike
                w, found, scores = best_in_windows(rows, ids, allowed, queries, query, low, high, k)
                columns = [pa.array(a_ids[query[w]]), pa.array(place[w].astype(np.int32)), pa.array(ids[found]), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "place", "id", "score"])

    found = pairs.select("dims", "ids", "labels", "values", "a_ids", "a_labels", "a_values", "a_counts", "a_windows").mapInArrow(run, _FOUND)
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, label: Column, positives: int = 5, negatives: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Negatives for every row whose id is divisible by ``every`` (an anchor) and each of its positives.

    Returns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.  A component x counts as floor(256 * x), and
    scores are integer inner products with the anchor.  An anchor's positives are its best ``positives`` other rows of the same ``label``; the negatives of
    a positive are the best ``negatives`` rows of other labels whose score lies between 0.3 and 0.9 of the positive's.  Ties go
    to smaller ids.

    Rows whose id, label or vector is null, whose vector is empty, or holds a null or non-finite component take no part; components past 2^16
    raise an error, as their scores could overflow.  Vectors are compared with those of their own dimension.  A row is no positive of anchors with its own id; of several
    anchor rows with one id the one with the smallest vector, then label, asks.  Other repeated rows are candidates of their own.  An anchor without
    positives, or a positive without negatives, gives no rows; so does an empty table.  Other columns are left behind.
    """
    rows = usable(vectors, label, id_col, vec_col)
    anchors = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("vec", "label")).alias("a")).select("id", "a.label", "a.vec")
    anchors = written(anchors, "anchors")
    n, asked = rows.count(), anchors.count()
    blocks_n = max(LEAST_BLOCKS, -(-n // BLOCK_ROWS))
    blocks = written(_blocks(rows, blocks_n, []), "vector-blocks")
    far = 1 << 62
    any_score = F.array(F.struct(F.lit(-far).cast("bigint").alias("low"), F.lit(far).cast("bigint").alias("high")))
    best = _searched(blocks, blocks_n, anchors.withColumn("windows", any_score), asked, positives, same=True)
    best = written(best.select("anchor", F.col("rank").alias("which"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # 30 * positive <= 100 * negative <= 90 * positive, in integers.
    low, high = F.expr(f"CAST(ceil(positive_score * {LOW} / {WHOLE}BD) AS BIGINT)"), F.expr(f"CAST(floor(positive_score * {HIGH} / {WHOLE}BD) AS BIGINT)")
    windows = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("which", low.alias("low"), high.alias("high")))).alias("w"))
    windows = windows.select(F.col("anchor").alias("id"), F.transform("w", lambda x: F.struct(x.low.alias("low"), x.high.alias("high"))).alias("windows"))
    found = _searched(blocks, blocks_n, anchors.join(windows, "id"), asked, negatives, same=False)
    found = found.select("anchor", (F.col("place") + 1).alias("which"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(best, ["anchor", "which"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
