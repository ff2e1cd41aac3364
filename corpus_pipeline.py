"""The corpus pipeline: toxic documents go, then poor ones, then near-duplicates, and what is kept is packed into batches.

Every stage works on all documents that the one before it kept, and is written as Parquet and read again
before the next one.  ``sf_dir`` holds the tables; the classifiers learn from its labels and the texts they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import packing, quality, setsketch, toxicity
from tokenloom.llm.registry import table, written
from tokenloom.session import with_defaults

#: Scores from which a document counts as toxic, and as good.
TOXIC, GOOD = 0.5, 0.3

_SCORE = "__pipeline_score"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``, with all their columns.  Texts that are null or empty stay."""
    with_defaults(spark)
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon, score_col=_SCORE).where(F.col(_SCORE) < TOXIC).drop(_SCORE)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``GOOD`` or more, with all their columns.  Texts too short to judge get the share of good labels."""
    with_defaults(spark)
    voters = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, voters, score_col=_SCORE).where(F.col(_SCORE) >= GOOD).drop(_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, with all its columns.

    Documents without words stay, and so do those without an id.  An id counts as one document: its rows stay
    together where one of them is kept.
    """
    with_defaults(spark)
    found = setsketch.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = found.where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in a batch."""
    with_defaults(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: SQL can express neither the classifiers nor the similarity classes; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    with_defaults(spark)
    sf_dir = sf_dir.rstrip("/")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
