"""Files that arrive over time, tokenized once each.

``land_in_corpus`` commits every micro-batch to a corpus.  ``land_tokens`` only does the per-document work and writes every micro-batch to its
own folder, so a batch that is run again replaces itself; ``Corpus.add`` takes the landed tokens.  Landed documents keep the digest and the size of their texts,
so ``Corpus.add`` can tell by content which sources have changed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tokenloom import schemas
from tokenloom.operators.layout import stored_once, tokenize_with_prints
from tokenloom.operators.tokenizers import Tokenizer
from tokenloom.plans.corpus import Corpus


LANDED = T.StructType([*schemas.TOKEN_CACHE.fields, T.StructField("digest", T.LongType()), T.StructField("bytes", T.LongType())])

def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000, glob: str | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; the query's checkpoint remembers those already read."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def land_tokens(
    stream: DataFrame,
    to_docs: Callable[[DataFrame], DataFrame],
    tokenizer: Tokenizer,
    landing: str,
    checkpoint: str,
) -> StreamingQuery:
    """Clean and tokenize what has arrived, then stop.

    ``to_docs`` maps the raw columns to ``(source_no, doc_ord, text)``.
    """
    tokens = tokenize_with_prints(to_docs(stream), tokenizer)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{landing}/batch_id={batch_id}")

    return (
        tokens.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def land_in_corpus(stream: DataFrame, to_docs: Callable[[DataFrame], DataFrame], corpus: Corpus, checkpoint: str) -> StreamingQuery:
    """Make what has arrived part of ``corpus``, one commit per micro-batch, then stop.

    ``to_docs`` maps the raw columns to ``(source_no, doc_ord, text)``.  A batch that is run again adds nothing, nor does a
    document whose place is known, so a lost checkpoint only costs the reading.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Spark names a stream in its checkpoint; a new checkpoint numbers its batches anew, under another name.
        about = batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata").first()
        corpus.add_batch(batch, json.loads(about.value)["id"], batch_id)

    return (
        to_docs(stream).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def landed(spark: SparkSession, landing: str) -> DataFrame:
    """Landed documents, each once, however often its file was delivered.

    Where a key came with different content, the longest is kept.
    """
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    return stored_once(spark.read.schema(LANDED).parquet(landing).select(*LANDED.names, *place), "__file", "__row")


def landed_counts(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.groupBy("source_no").agg(F.count("*").alias("docs"), F.sum("n").cast("bigint").alias("n_tokens"), *more)

