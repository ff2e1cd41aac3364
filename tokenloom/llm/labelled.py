"""Bounded samples of labelled rows for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.maxent import fold
from tokenloom.llm.registry import hashed_sample


def training_labels(labels: DataFrame, column: str, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """``id``, ``label`` (0 or 1) of the rows outside fold 0 of the ids; null ids and labels are left out, several labels of an id count as their maximum."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(column).isin(0, 1) & (fold(F.col(id_col), folds) != 0))
    return known.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(F.col(column).cast("int")).alias("label"))


def sample(docs: DataFrame, known: DataFrame, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """``text``, ``label`` of about ``per_class`` ids of each label at most, and how many ids each label has in all.

    Hashes of the ids decide, so the choice depends on nothing else.  The ids are broadcast: about twice ``per_class``.  An id counts once,
    with the least of its texts, however many rows it has.
    """
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = hashed_sample(known.where(F.col("label") == label), sizes.get(label, 0), per_class, "id")
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # reduced before it is shuffled
    return found.select("text", "label"), sizes
