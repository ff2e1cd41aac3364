"""Counts and figures over sources, tokens and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.names import megabytes, rate
from tokenloom.operators.ordering import running_sums
from tokenloom.operators.shards import shard_plan


def source_counts(rows: DataFrame) -> DataFrame:
    """Documents and tokens per source."""
    return rows.groupBy("source_no").agg(
        F.count("*").alias("docs"), F.sum("n").cast("bigint").alias("n_tokens")
    )


def source_bases(counts: DataFrame) -> DataFrame:
    """Offset of each source in the global stream: the sum of the sources before it."""
    return running_sums(counts, {"n_tokens": "source_start"}, minor="source_no").rows


def token_totals(rows: DataFrame, val_ratio: float, shard_size: int) -> DataFrame:
    """One row: total, train and validation tokens and their shard counts."""
    total = F.col("total_tokens")
    train, val, train_shards, val_shards = shard_plan(total, val_ratio, shard_size)
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_tokens")).select(
        "total_tokens",
        train.alias("train_tokens"),
        val.alias("val_tokens"),
        train_shards.alias("train_shards"),
        val_shards.alias("val_shards"),
    )


def source_report(sizes: DataFrame, counts: DataFrame, seconds: Column | None = None) -> DataFrame:
    """Size and token count side by side, in source order; tokens per second where times are known."""
    joined = sizes.join(counts, "source_no").select(
        *sizes.columns, "n_tokens", megabytes(F.col("bytes")).alias("mb")
    )
    if seconds is not None:
        joined = joined.withColumn("tokens_per_sec", rate(F.col("n_tokens"), seconds))
    return joined.orderBy("source_no")


def category_report(files: DataFrame) -> DataFrame:
    """Documents per file, per category and overall; the level says which."""
    level = F.grouping_id("category", "file")
    return files.rollup("category", "file").agg(
        level.cast("bigint").alias("level"), F.count("*").alias("docs")
    )


def category_sizes(catalog: DataFrame, gb_per_file: float) -> DataFrame:
    """Files per category and the estimated size."""
    return catalog.groupBy("category").agg(
        F.count("*").alias("files"), (F.count("*") * F.lit(gb_per_file)).alias("estimated_gb")
    )


def shard_counts(shards: DataFrame) -> DataFrame:
    """Shards and tokens written per split; token arrays are not read."""
    return shards.groupBy("split").agg(F.count("*").alias("shards"), F.sum("n_tokens").alias("n_tokens"))


def split_mix(clipped: DataFrame) -> DataFrame:
    """Documents and tokens each source gives to each split."""
    return clipped.groupBy("split", "source_no").agg(
        F.count("*").alias("docs"), F.sum(F.col("s_end") - F.col("s_start")).alias("n_tokens")
    )


def vocab_check(tokens: DataFrame, vocab_size: int) -> DataFrame:
    """Tokens outside the vocabulary, per source."""
    outside = F.size(F.filter("tokens", lambda t: (t < 0) | (t >= vocab_size))).cast("bigint")
    return tokens.groupBy("source_no").agg(
        F.sum(F.size("tokens").cast("bigint")).alias("n_tokens"),
        F.sum(outside).alias("n_outside"),
        F.max(F.array_max("tokens")).cast("bigint").alias("max_id"),
    )
