"""Batches, schedules, resuming, steps and lineage."""

from pyspark.sql import functions as F

from tokenloom.operators import batches as bt
from tokenloom.operators import layout as lay
from tokenloom.operators import tokenizers as tk
from tokenloom.plans.registered.layout import built_shards, shard_list
from tokenloom.plans.registered.registry import (
    BT,
    RATIO,
    SHAPE,
    SHARD,
    SQL_SHARDS,
    SQL_TOKENS,
    STEP_BATCHES,
    digest,
    docs,
    query,
)

_ID = "CAST(tok AS VARCHAR)"
_KEPT = f"""sized AS (SELECT *, count(*) OVER (PARTITION BY split, shard) AS n_tokens FROM shard_tok),
kept AS (SELECT *, (n_tokens - 1) // {BT} * {BT} AS used FROM sized)"""


def _xy(group: int, keys: str, having: str = "") -> str:
    """Inputs are tokens 0 .. used-1 of the shard, targets the same one place later."""
    side = f"""SELECT split, shard, CAST((slot - {{d}}) // {group} AS BIGINT) AS g,
        md5(string_agg({_ID}, ',' ORDER BY slot)) AS {{name}} FROM kept WHERE slot - {{d}} >= 0 AND slot - {{d}} < used GROUP BY ALL"""
    return f"""WITH {SQL_TOKENS}, {_KEPT}, xs AS ({side.format(d=0, name='x')}), ys AS ({side.format(d=1, name='y')})
    SELECT {keys}, x, y FROM xs JOIN ys USING (split, shard, g) {having}"""


@query("batch_xy", _xy(BT, "split, shard, g AS batch_in_shard"))
def _(spark, sf_dir):
    windows = bt.batch_windows(built_shards(spark, sf_dir), SHAPE)
    return windows.select("split", "shard", "batch_in_shard", digest("x").alias("x"), digest("y").alias("y"))


@query(
    "batch_rows",
    _xy(SHAPE.length, f"split, shard, CAST(g // {SHAPE.rows} AS BIGINT) AS batch_in_shard, CAST(g % {SHAPE.rows} AS BIGINT) AS row"),
)
def _(spark, sf_dir):
    rows = bt.batch_rows(built_shards(spark, sf_dir), SHAPE)
    return rows.select("split", "shard", "batch_in_shard", "row", digest("x").alias("x"), digest("y").alias("y"))


@query(
    "val_batches",
    _xy(BT, "split, shard, g AS batch_in_shard", f"WHERE split = 'val' AND shard * {(SHARD - 1) // BT} + g < {bt.VAL_BATCHES}"),
)
def _(spark, sf_dir):
    holding = -(-bt.VAL_BATCHES // SHAPE.of_full_shard(SHARD))
    head = bt.head_batches(built_shards(spark, sf_dir, val_only=True, first_shards=holding), SHAPE, shard_size=SHARD)
    return head.select("split", "shard", "batch_in_shard", digest("x").alias("x"), digest("y").alias("y"))


@query("batch_counts", f"WITH {SQL_SHARDS} SELECT split, shard, n_tokens, batches FROM counts")
def _(spark, sf_dir):
    return bt.batch_counts(shard_list(spark, sf_dir), SHAPE).drop("dropped")


@query(
    "dropped_tail",
    f"WITH {SQL_SHARDS} SELECT split, shard, n_tokens, CAST(n_tokens - batches * {BT} AS BIGINT) AS dropped FROM counts",
)
def _(spark, sf_dir):
    return bt.batch_counts(shard_list(spark, sf_dir), SHAPE).drop("batches")


@query(
    "batch_schedule",
    f"""WITH {SQL_SHARDS} SELECT split, CAST(epoch AS BIGINT) AS epoch, shard, batch_in_shard,
    batch_in_shard * {BT} AS data_position,
    CAST(epoch * count(*) OVER (PARTITION BY split, epoch) + global_batch AS BIGINT) AS global_batch
    FROM batches, (SELECT unnest(range(2)) AS epoch)""",
)
def _(spark, sf_dir):
    return bt.schedule(shard_list(spark, sf_dir), SHAPE, epochs=2)


_CURSOR_SHARD, _CURSOR_POSITION = 3, 10 * BT


@query(
    "batch_resume",
    f"""WITH {SQL_SHARDS}, ordered AS (
      SELECT split, 0 AS epoch, shard, batch_in_shard * {BT} AS data_position FROM batches
      WHERE shard > {_CURSOR_SHARD} OR (shard = {_CURSOR_SHARD} AND batch_in_shard * {BT} >= {_CURSOR_POSITION})
      UNION ALL SELECT split, 1, shard, batch_in_shard * {BT} FROM batches)
    SELECT split, CAST(epoch AS BIGINT) AS epoch, shard, data_position,
           row_number() OVER (PARTITION BY split ORDER BY epoch, shard, data_position) - 1 AS global_batch
    FROM ordered""",
)
def _(spark, sf_dir):
    return bt.resume(shard_list(spark, sf_dir), SHAPE, _CURSOR_SHARD, _CURSOR_POSITION)


@query(
    "step_manifest",
    f"""WITH {SQL_SHARDS} SELECT split, CAST(global_batch // {STEP_BATCHES} AS BIGINT) AS step,
    CAST(global_batch % {STEP_BATCHES} AS BIGINT) AS micro_step, shard, batch_in_shard * {BT} AS data_position FROM batches""",
)
def _(spark, sf_dir):
    manifest = bt.step_manifest(bt.schedule(shard_list(spark, sf_dir), SHAPE), STEP_BATCHES)
    return manifest.select("split", "step", "micro_step", "shard", "data_position")


@query(
    "step_lineage",
    f"""WITH {SQL_SHARDS},
    placed AS (SELECT split, shard, batch_in_shard, global_batch // {STEP_BATCHES} AS step,
      shard * {SHARD} + batch_in_shard * {BT} + CASE WHEN split = 'val' THEN 0 ELSE cut END AS lo FROM batches, tot)
    SELECT split, CAST(step AS BIGINT) AS step, shard, source_no, doc_ord,
           CAST(sum(least(g_end, lo + {BT}) - greatest(g_end - n, lo)) AS BIGINT) AS n_tokens
    FROM placed JOIN spans ON greatest(g_end - n, lo) < least(g_end, lo + {BT}) GROUP BY ALL""",
)
def _(spark, sf_dir):
    rows = lay.thin_rows(docs(spark, sf_dir), tk.codepoint()).select("source_no", "doc_ord", "n")
    sums = lay.global_offsets(rows)
    plan = lay.SplitPlan.over(sums.total("n"), RATIO, SHARD)
    return bt.step_lineage(sums.rows, plan, SHAPE, STEP_BATCHES)


@query(
    "batch_numbers",
    f"WITH {SQL_SHARDS} SELECT split, shard, batch_in_shard, CAST(global_batch AS BIGINT) AS global_batch FROM batches",
)
def _(spark, sf_dir):
    numbered = bt.numbered_batches(built_shards(spark, sf_dir), SHAPE, SHARD)
    return numbered.where(F.size("x") == BT).select("split", "shard", "batch_in_shard", "global_batch")
