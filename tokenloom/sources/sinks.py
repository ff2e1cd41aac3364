"""Document sinks: what is appended to each document, and the figures reported for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text as tx
from tokenloom.functions.names import megabytes


def as_lines(docs: DataFrame) -> DataFrame:
    """One document per line."""
    return docs.withColumn("text", F.concat("text", F.lit(tx.LINE_SEPARATOR)))


def as_clean_blocks(docs: DataFrame, drop_empty: bool = False) -> DataFrame:
    """Normalized newlines, no blank lines inside, one blank line after."""
    cleaned = docs.withColumn("text", tx.clean_block(F.col("text")))
    if drop_empty:
        cleaned = cleaned.where(F.col("text") != "")
    return cleaned.withColumn("text", F.concat("text", F.lit(tx.BLOCK_SEPARATOR)))


def as_blocks(docs: DataFrame) -> DataFrame:
    """The document as it is, one blank line after."""
    return docs.withColumn("text", F.concat("text", F.lit(tx.BLOCK_SEPARATOR)))


def size_report(docs: DataFrame, *keys: str, more: Sequence[Column] = ()) -> DataFrame:
    """Documents, characters, bytes and megabytes, and ``more`` aggregates, by ``keys`` or in total."""
    n_bytes = F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0).cast("bigint"))
    return (
        docs.groupBy(*keys)
        .agg(
            F.count("*").alias("docs"),
            F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0).cast("bigint")).alias("chars"),
            n_bytes.alias("bytes"),
            *more,
        )
        .withColumn("mb", megabytes(F.col("bytes")))
    )


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``docs(source_no, doc_ord, text)``; a failed job leaves nothing a reader would see.

    Rows carry their order, so they are written where they are, without a shuffle.
    """
    docs.write.mode(mode).parquet(path)


def write_source_text(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The plain-text form: one folder per source, part files in document order."""
    # the writer ends every record with a newline, so the document gives up its last one
    body = F.regexp_replace("text", r"\n\z", "")
    docs.repartitionByRange("source_no", "doc_ord").sortWithinPartitions("source_no", "doc_ord").select(
        "source_no", body.alias("text")
    ).write.mode(mode).partitionBy("source_no").text(path)
