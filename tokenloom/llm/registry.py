"""Registration of the queries of this subpackage and helpers that they share."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import scratch_dir, with_defaults

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its checking SQL, where SQL can express it."""

    def add(run: Query) -> Query:
        @wraps(run)
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(with_defaults(spark), sf_dir.rstrip("/"))

        QUERIES[name] = prepared
        if check is not None:
            CHECKS[name] = check
        return prepared

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """The rows of ``df``, written once to the shared scratch folder and read from there.

    Cuts lineage where several later steps need the same rows, and survives the loss of an executor.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, n: int, size: int, *key: str) -> DataFrame:
    """About ``size`` of the ``n`` rows of ``df``, all of them where they are no more; the hashes of ``key`` decide.

    More than ``size`` come once in 30,000 times.  No sort, and nothing meets in one task.
    """
    if n <= size:
        return df
    share = (size - 4 * size**0.5) / n
    return df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def vocabulary(name: str) -> str:
    """The path of a vocabulary file: under ``TOKENIZER_DIR`` where that is set, else of the public package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
