"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 cells; a document lies in the cell of its text's hash, so equal texts lie
together.  Each shard owns the cells before its virtual nodes (an arc each).  No shard takes more
than its bound, (1 + slack) times the mean bytes: it keeps what lies on its arcs up to the bound, and the rest
continues clockwise to the next shard with room.  That walk is done once on the sums of the arcs, whose number
is a parameter; it cuts every arc into stretches of bytes, and a document goes to the stretch in
which its middle lies.  So a shard exceeds its bound by half a document at each of its cuts at most, documents
stay home wherever their shard has room, and one very frequent text is split only where a shard is full.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.registry import written
from tokenloom.llm.running import bases

CELLS = 1 << 16
#: Digits that split the rows of one cell, for texts that many documents share.
DIGITS = 256

_LAST_LEVELS = ["cell", "high", "low"]


def ring(spark, shards: int, points: int) -> DataFrame:
    """Cells with the arc each belongs to: ``cell``, ``arc`` (clockwise from 0), ``owner``."""
    nodes = (
        spark.range(shards * points)
        .select((F.col("id") % shards).cast("int").alias("owner"), (F.col("id") / shards).cast("int").alias("point"))
        .withColumn("at", F.pmod(F.xxhash64("owner", "point"), F.lit(CELLS)).cast("int"))
        # Of several virtual nodes in one cell the first owns it.
        .groupBy("at").agg(F.min(F.struct("point", "owner")).alias("node"))
    )
    clockwise = Window.orderBy("at")  # as many rows as virtual nodes
    nodes = nodes.select(
        "at", F.col("node.owner").alias("owner"), (F.row_number().over(clockwise) - 1).alias("arc"),
        F.lag("at", 1, -1).over(clockwise).alias("before"),
    )
    # Cells past the last virtual node belong to the first one; they are an arc of their own at the end.
    last = nodes.agg(F.max("at").alias("before"), F.max("arc").alias("arc"), F.min_by("owner", "at").alias("owner"))
    tail = last.where(F.col("before") < CELLS - 1).select(F.lit(CELLS - 1).alias("at"), "owner", (F.col("arc") + 1).alias("arc"), "before")
    return nodes.unionByName(tail).select(F.explode(F.sequence(F.col("before") + 1, "at")).alias("cell"), "arc", "owner")


def stretches(loads: DataFrame, arcs: DataFrame, shards: int, slack: float) -> DataFrame:
    """Cut the arcs: ``arc`` and ``parts``, an array of (upto, shard) ordered by the bytes of the arc that lie before ``upto``.

    ``loads`` holds the bytes of each arc (``arc``, ``bytes``), ``arcs`` the owner of each arc.
    """
    every = Window.partitionBy()  # as many rows as arcs
    owned = Window.partitionBy("owner").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    home = (
        arcs.join(loads, "arc", "left").fillna(0, ["bytes"])
        .withColumn("bound", F.ceil(F.sum("bytes").over(every) * F.lit(1 + slack) / shards))
        .withColumn("prior", F.coalesce(F.sum("bytes").over(owned), F.lit(0)))
        .withColumn("kept", F.expr("greatest(least(bytes, bound - prior), 0)"))
    )
    # The ring is part of the walk's state, as the optimizer would else compute it anew for every arc.
    # One row: the ring as an array, the room left in each shard, and what must move on.
    one = home.agg(
        F.expr("transform(array_sort(collect_list(struct(arc, owner))), x -> x.owner)").alias("around"),
        F.expr("array_sort(collect_list(CASE WHEN bytes > kept THEN struct(arc, bytes - kept AS rest) END))").alias("moving"),
        F.expr(f"transform(sequence(0, {shards - 1}), s -> CAST(max(bound) AS BIGINT))").alias("bounds"),
        F.expr("collect_list(struct(owner, kept))").alias("kepts"),
    ).withColumn("room", F.expr(
        "transform(bounds, (b, s) -> b - aggregate(filter(kepts, k -> k.owner = s), 0L, (t, k) -> t + k.kept))"
    ))
    walk = """
      aggregate(moving, named_struct('around', around, 'room', room, 'placed', CAST(array() AS array<struct<arc:int,shard:int,taken:bigint>>)),
        (state, m) -> aggregate(
          array_distinct(concat(slice(state.around, m.arc + 2, size(state.around)), slice(state.around, 1, m.arc + 1))),
          named_struct('rest', m.rest, 'room', state.room, 'placed', state.placed),
          (s, shard) -> CASE WHEN s.rest <= 0 OR s.room[shard] <= 0 THEN s ELSE named_struct(
            'rest', s.rest - least(s.rest, s.room[shard]),
            'room', transform(s.room, (r, i) -> IF(i = shard, r - least(s.rest, s.room[shard]), r)),
            'placed', concat(s.placed, array(named_struct('arc', m.arc, 'shard', shard, 'taken', least(s.rest, s.room[shard]))))) END,
          s -> named_struct('around', state.around, 'room', s.room, 'placed', s.placed)),
        state -> state.placed)
    """
    moved = one.select(F.posexplode(F.expr(walk)).alias("turn", "p")).select("p.arc", (F.col("turn") + 1).alias("turn"), "p.shard", "p.taken")
    stay = home.where("kept > 0").select("arc", F.lit(0).alias("turn"), F.col("owner").alias("shard"), F.col("kept").alias("taken"))
    along = Window.partitionBy("arc").orderBy("turn")
    return (
        stay.unionByName(moved)
        .select("arc", "shard", F.sum("taken").over(along).alias("upto"))
        .groupBy("arc").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("parts"))
    )


def shard(
    docs: DataFrame,
    shards: int = 24,
    points: int = 64,
    slack: float = 0.002,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Put every row into a shard: ``id_col``, ``size``, ``text_crc32``, ``shard``, ``slot`` (gapless from 0 in each shard).

    ``size`` is the UTF-8 bytes of the text plus 8; a null text counts as an empty one.  Rows with equal ids, null ids
    and repeated rows are placed one by one; an empty table gives an empty result; other columns are left
    behind.  Texts are read once and not shuffled, only their sizes and hashes are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = written(
        docs.select(
            F.col(id_col).alias("__id"),
            (F.octet_length(text) + F.lit(8).cast("bigint")).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("place"),
            F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("mixed"),
        )
        .withColumn("cell", F.shiftrightunsigned("place", 48).cast("int"))
        .withColumn("high", F.pmod("mixed", F.lit(DIGITS)).cast("int"))
        .withColumn("low", F.pmod(F.shiftright("mixed", 8), F.lit(DIGITS)).cast("int")),
        "ring-rows",
    )
    spark = docs.sparkSession
    cells = written(ring(spark, shards, points), "ring-cells")
    arcs = cells.groupBy("arc").agg(F.first("owner").alias("owner"))
    sums = thin.groupBy("cell").agg(F.sum("size").alias("bytes")).join(cells, "cell")
    parts = stretches(sums.groupBy("arc").agg(F.sum("bytes").alias("bytes")), arcs, shards, slack)

    placed = thin.join(cells.select("cell", "arc"), "cell")
    path = ["arc", *_LAST_LEVELS]
    order = Window.partitionBy(*path).orderBy("place", "__id", "size", "text_crc32")
    placed = (
        placed.join(bases(placed, path, "size"), path)
        .withColumn("middle", F.col("base") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("middle", F.coalesce("middle", "base") + F.col("size") / 2)
        .join(parts, "arc")
        .withColumn("shard", F.expr("coalesce(filter(parts, p -> p.upto > middle)[0].shard, parts[size(parts) - 1].shard)"))
        .withColumn("group", F.shiftright("cell", 8))
        .select("__id", "size", "text_crc32", "shard", "place", "group", *_LAST_LEVELS)
    )
    placed = written(placed, "ring-placed")
    path = ["shard", "group", *_LAST_LEVELS]
    rank = Window.partitionBy(*path).orderBy("place", "__id", "size", "text_crc32")
    ones = placed.withColumn("one", F.lit(1).cast("bigint"))
    return placed.join(bases(ones, path, "one"), path).select(
        F.col("__id").alias(id_col), "size", "text_crc32", "shard",
        (F.col("base") + F.row_number().over(rank) - 1).alias("slot"),
    )
