"""Ids back to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.tokenizers import Tokenizer


def decode(rows: DataFrame, tokenizer: Tokenizer, tokens: str = "tokens", out: str = "text") -> DataFrame:
    """Replace ids by the text they stand for; end-of-text reads as its name."""
    return rows.withColumn(out, tokenizer.decode(F.col(tokens))).drop(tokens)


def numbered_texts(rows: DataFrame, number: str, text: str, out: str = "text") -> DataFrame:
    """Label each of several decoded sequences with its 1-based number."""
    return rows.withColumn(out, F.concat(F.lit("["), (F.col(number) + 1).cast("string"), F.lit("] "), F.col(text)))
