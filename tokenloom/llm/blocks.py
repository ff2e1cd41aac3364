"""A stated set of query vectors against all vectors, block by block.

All vectors are dealt into blocks by a hash, and so are the queries.  Every pair of a query block and a vector block is
one row, searched in one task; each search returns a few rows for each query, which are merged at the end.
A vector that a third of all rows hold is dealt like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.registry import written

#: Vectors in a block at most, about; small tables are dealt into LEAST_BLOCKS for the sake of parallel work.
BLOCK_ROWS = 1 << 16
LEAST_BLOCKS = 32
QUERY_ROWS = 1 << 11

#: query ids, query vectors, ids, vectors -> positions of queries, ids found, scores
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(vectors: DataFrame, id_col: str, vec_col: str, drop_zero: bool) -> DataFrame:
    """``id``, ``vec``: rows with an id and a non-empty vector whose components are all finite; with ``drop_zero`` not all zero.

    Written to the shared folder, as they are counted, sampled and searched.
    """
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec")).where("id IS NOT NULL AND size(vec) > 0")
    rows = rows.where(fine)
    return written(rows.where(F.exists("vec", lambda x: x != 0)) if drop_zero else rows, "vectors")


def _packed(rows: DataFrame, blocks: int, names: tuple[str, str]) -> DataFrame:
    """One row for each dimension and block: the ids and the components one after another."""
    at = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")  # copies of a row are dealt out too
    return (
        rows.withColumn("dims", F.size("vec")).withColumn("block", at)
        .groupBy("dims", "block").agg(F.collect_list(F.struct("id", "vec")).alias("r"))
        .select("dims", "block", F.col("r.id").alias(names[0]), F.flatten("r.vec").alias(names[1]))
    )


def search(rows: DataFrame, is_query: Column, k: int, run: Search, ascending: bool, score: str) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` best rows that ``run`` finds for each query.

    ``rows`` as of ``usable``.  Vectors are compared with those of their own dimension; a row is no match for queries with its
    own id, and ties go to smaller ids.  Of several query rows with one id the one with the smallest vector
    asks.
    """
    queries = rows.where(is_query).groupBy("id").agg(F.min("vec").alias("vec"))
    n, asked = rows.count(), queries.count()
    blocks = max(LEAST_BLOCKS, -(-n // BLOCK_ROWS))
    packed = _packed(rows, blocks, ("ids", "values"))
    asking = _packed(queries, max(1, -(-asked // QUERY_ROWS)), ("query_ids", "query_values"))
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = packed.join(asking, ["dims", "block"]).repartition(blocks, "dims", "block")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims = batch.column(0)[i].as_py()
                qid, qv, ids, v = (c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
                at, found, scores = run(qid, qv.reshape(-1, dims), ids, v.reshape(-1, dims))
                yield pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    best = pairs.select("dims", "query_ids", "query_values", "ids", "values").mapInArrow(each, f"query_id BIGINT, vec_id BIGINT, score {score}")
    by_score = F.col("score").asc() if ascending else F.col("score").desc()
    order = Window.partitionBy("query_id").orderBy(by_score, "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def take_best(scores: np.ndarray, ids: np.ndarray, k: int, ascending: bool) -> np.ndarray:
    """Positions of the k best, best first, ties to smaller ids."""
    keys = scores if ascending else -scores
    if len(keys) > k:
        near = np.flatnonzero(keys <= np.partition(keys, k - 1)[k - 1])
    else:
        near = np.arange(len(keys))
    return near[np.lexsort((ids[near], keys[near]))][:k]
