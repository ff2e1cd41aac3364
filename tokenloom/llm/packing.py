"""Length buckets that minimise padding, and batches within a budget of tokens.

The histogram of all lengths, in bins of 64 to an octave of length, is the only thing gathered; dynamic programming over it
chooses the bucket bounds for which padding every document to its bucket's bound costs least.
Batches of a bucket hold as many documents as fit the budget at the bucket's bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.registry import written
from tokenloom.llm.running import bases


def byte_tokens(text: Column) -> Column:
    """Tokens of a byte-level text and its end token; a null text is empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def histogram(lengths: DataFrame) -> DataFrame:
    """``longest``, ``n`` and ``total`` of each bin, in order.  Up to 64 a length is its own bin, so bins number 64 times the bits of the longest."""
    step = F.expr("shiftleft(1L, greatest(length(bin(length)) - 7, 0))")
    return (
        lengths.groupBy(F.expr("length(bin(length))").alias("octave"), F.ceil(F.col("length") / step).alias("bin"))
        .agg(F.max("length").alias("longest"), F.count("*").alias("n"), F.sum("length").alias("total"))
        .select("longest", "n", "total").orderBy("longest")
    )


def best_bounds(longest: np.ndarray, n: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds, the last the greatest length, for which the padding of all documents is least.

    Of equally good choices the one with the smaller first bounds.
    """
    if not len(longest):
        return []
    count, sums = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(total)])
    bins = len(longest)
    # cost[i, j]: padding of bins i to j - 1 in one bucket
    cost = longest[None, :] * (count[None, 1:] - count[:-1, None]) - (sums[None, 1:] - sums[:-1, None])
    cost = np.where(np.arange(bins)[:, None] <= np.arange(bins)[None, :], cost.astype(float), np.inf)
    least, cuts = cost[0], []
    for _ in range(min(buckets, bins) - 1):
        # Bins up to i - 1 in the buckets so far, bins from i on in one more.
        choices = np.concatenate([[np.inf], least[:-1]])[:, None] + cost
        cut = choices.argmin(axis=0)
        better = choices[cut, np.arange(bins)] < least
        cuts.append(np.where(better, cut, -1))
        least = np.where(better, choices[cut, np.arange(bins)], least)
    bounds, end = [int(longest[-1])], bins - 1
    for cut in reversed(cuts):
        if cut[end] > 0:
            end = int(cut[end]) - 1
            bounds.append(int(longest[end]))
    return bounds[::-1]


def pack(
    docs: DataFrame,
    length: Column | None = None,
    buckets: int = 16,
    budget: int = 1 << 18,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Give every document a place in a batch: ``id_col``, ``length``, ``bucket``, ``bound``, ``batch``, ``row``, ``padding``.

    ``length`` defaults to the byte tokens of the text with an end token; null lengths count as 0.  ``batch`` numbers the batches of a
    bucket from 0 without gaps, ``row`` the documents of a batch; ``bound * rows <= budget`` but for a document longer
    than the budget, which is a batch of its own.  Null ids, equal ids and repeated rows are packed row by
    row; an empty table gives an empty result; other columns are left behind.
    """
    spark = docs.sparkSession
    lengths = F.coalesce(byte_tokens(F.col(text_col)) if length is None else length.cast("bigint"), F.lit(0).cast("bigint"))
    hashed = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), lengths)
    thin = written(docs.select(F.col(id_col).alias("__id"), lengths.alias("length"), hashed.alias("mixed")), "pack-lengths")
    bins = histogram(thin).collect()  # bounded by the bits of a length
    bounds = best_bounds(*(np.array([r[c] for r in bins], dtype=np.int64) for c in ("longest", "n", "total")), buckets)

    array = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array(F.lit(0).cast("bigint"))
    path = ["bucket", "d1", "d2", "d3"]
    placed = thin.withColumn("bucket", F.size(F.filter(array, lambda b: b < F.col("length"))))
    for i, digit in enumerate(path[1:]):
        placed = placed.withColumn(digit, F.pmod(F.shiftright("mixed", 8 * i), F.lit(256)).cast("int"))
    before = bases(placed.withColumn("one", F.lit(1).cast("bigint")), path, "one")
    rank = Window.partitionBy(*path).orderBy("__id", "length")
    return (
        placed.join(before, path)
        .withColumn("place", F.col("base") + F.row_number().over(rank) - 1)
        .withColumn("bound", F.element_at(array, F.col("bucket") + 1))
        .withColumn("rows", F.expr(f"greatest({budget} DIV greatest(bound, 1), 1)"))
        .select(
            F.col("__id").alias(id_col), "length", "bucket", "bound",
            F.expr("place DIV rows").alias("batch"), F.expr("CAST(place % rows AS INT)").alias("row"),
            (F.col("bound") - F.col("length")).alias("padding"),
        )
    )
