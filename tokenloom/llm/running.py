"""Running sums over rows ordered by a path of bounded digits, without a window over an unbounded group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bases(rows: DataFrame, path: Sequence[str], value: str, within: int = 1) -> DataFrame:
    """For each distinct ``path`` the sum of ``value`` over the paths before it with the same first ``within`` columns.

    Every level is one partial aggregate and one window over the digits of the level above, so a window
    holds as many rows as its digit has values.  Returns the path columns and ``base``; null digits are not allowed.
    """
    levels = [rows.groupBy(*path).agg(F.sum(value).alias("__sum"))]
    for depth in range(len(path) - 1, within, -1):
        levels.append(levels[-1].groupBy(*path[:depth]).agg(F.sum("__sum").alias("__sum")))
    found = None
    for depth, level in zip(range(within + 1, len(path) + 1), reversed(levels), strict=True):
        above = Window.partitionBy(*path[: depth - 1]).orderBy(path[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("__before", F.coalesce(F.sum("__sum").over(above), F.lit(0).cast("bigint"))).drop("__sum")
        if found is not None:
            level = level.join(found, list(path[: depth - 1])).withColumn("__before", F.col("__before") + F.col("base")).drop("base")
        found = level.withColumnRenamed("__before", "base")
    return found
