"""Saved reading positions.

Positions mean something only within one build of the shards, so every row names the version it
belongs to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom import schemas
from tokenloom.operators import batches as bt
from tokenloom.operators.runlog import latest_cursor
from tokenloom.session import table_at

_SAVED = T.StructType([T.StructField("version", T.StringType()), *schemas.CURSOR.fields])


class Cursors:
    """An append-only table of positions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def save(self, version: str, step: int, shard: int, position: int) -> None:
        row = [(version, step, shard, position)]
        self.spark.createDataFrame(row, _SAVED).coalesce(1).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        return table_at(self.spark, self.path, _SAVED)

    def latest(self, version: str) -> Row | None:
        """The position with the highest step in this version, None where nothing was saved."""
        return latest_cursor(self.all().where(F.col("version") == version)).first()

    def resume(self, shards: DataFrame, version: str, shape: bt.BatchShape, more_epochs: int = 1) -> DataFrame:
        """What is still to be read, from the start where nothing was saved."""
        at = self.latest(version)
        shard, position = (at.data_shard, at.data_position) if at else (0, 0)
        return bt.resume(shards, shape, shard, position, more_epochs)
