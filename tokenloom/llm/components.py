"""Connected components of an edge table by alternating stars, and roots of a forest by doubling; no links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.registry import written


# What is joined is read from written tables on both sides: then each side of a join is a plain shuffle, which Spark splits at run time where one
# node has a large part of all edges.  Least neighbours are reduced before their shuffle.


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the least node around it."""
    around = _both(edges)
    least = written(around.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "star-least")
    return around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node``, ``component`` (the least node reachable) for every node that has an edge to another; edges with a null end count for nothing.

    Stops when a round changes no edge; each round is written to the shared folder.
    """
    edges = written(edges.select(F.col(left).cast("bigint").alias("u"), F.col(right).cast("bigint").alias("v")).where("u != v").distinct(), "edges")
    mark = None
    while True:
        edges = written(_small_star(written(_large_star(edges), "star-edges")), "star-edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == mark:
            break
        mark = (now.n, now.h)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def roots(forest: DataFrame, child: str, parent: str) -> DataFrame:
    """``node``, ``component``: the root above each child of a forest in which every child has one parent, smaller than itself.

    Every round doubles the distance that a row has climbed and is written to the shared folder.
    """
    climbed = written(forest.select(F.col(child).alias("node"), F.col(parent).alias("component"), F.lit(True).alias("moved")), "forest")
    while climbed.where("moved").limit(1).count():
        above = climbed.select(F.col("node").alias("component"), F.col("component").alias("next"))
        climbed = written(
            climbed.join(above, "component", "left")
            .select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved")),
            "forest",
        )
    return climbed.select("node", "component")
