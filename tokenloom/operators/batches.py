"""Next-token batches: windows of B*T tokens over shards, their order, and resuming in it.

Counting and ordering need only ``(split, shard, n_tokens)``, never the tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.names import int_div
from tokenloom.operators.layout import SplitPlan
from tokenloom.operators.ordering import running_sums
from tokenloom.operators.shards import shard_overlaps
from tokenloom.session import MAX_PARTITIONS, join_thin

# The batch shape and the tokens of one optimizer step at full scale.
BATCH_ROWS = 2
ROW_TOKENS = 2048
STEP_TOKENS = 524_288
VAL_BATCHES = 10

#: Shards that hold the head of a schedule are broadcast to the shard scan up to so many, past it they are joined.
MAX_BROADCAST_HEAD = 100_000

#: Scheduled batches that one task expands.
TASK_BATCHES = 1_000_000


@dataclass(frozen=True)
class BatchShape:
    rows: int = BATCH_ROWS
    length: int = ROW_TOKENS

    def __post_init__(self):
        if self.rows < 1 or self.length < 1:
            raise ValueError("a batch has at least one row of at least one token")

    @property
    def tokens(self) -> int:
        return self.rows * self.length

    def per_step(self, step_tokens: int = STEP_TOKENS) -> int:
        """Batches of one optimizer step."""
        if step_tokens < self.tokens or step_tokens % self.tokens:
            raise ValueError(f"{step_tokens} tokens per step are no multiple of {self.tokens} tokens per batch")
        return step_tokens // self.tokens

    def count(self, n_tokens: Column) -> Column:
        """Batches of a shard: each reads B*T + 1 tokens and moves on by B*T."""
        return F.greatest(int_div(n_tokens - 1, self.tokens), F.lit(0).cast("bigint"))

    def of_full_shard(self, shard_size: int) -> int:
        return max(0, (shard_size - 1) // self.tokens)


def _size(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _slice(tokens: Column, start: Column, length: int) -> Column:
    return F.slice(tokens, (start + 1).cast("int"), F.lit(length))


def _numbers(count: Column) -> Column:
    """0 .. count-1; rows with count 0 are filtered by the caller."""
    return F.explode(F.sequence(_size(0), count - 1))


def batch_counts(shards: DataFrame, shape: BatchShape) -> DataFrame:
    """Batches per shard, tokens used as inputs, and the tail no batch reads as input."""
    batches = shape.count(F.col("n_tokens"))
    return shards.select(
        "split",
        "shard",
        "n_tokens",
        batches.alias("batches"),
        (F.col("n_tokens") - batches * _size(shape.tokens)).alias("dropped"),
    )


def batch_windows(shards: DataFrame, shape: BatchShape) -> DataFrame:
    """One row per batch with flat ``x`` and its next-token targets ``y``.  No shuffle."""
    start = F.col("batch_in_shard") * _size(shape.tokens)
    return (
        shards.withColumn("__batches", shape.count(F.col("n_tokens")))
        .where(F.col("__batches") > 0)
        .withColumn("batch_in_shard", _numbers(F.col("__batches")))
        .select(
            "split",
            "shard",
            "batch_in_shard",
            _slice(F.col("tokens"), start, shape.tokens).alias("x"),
            _slice(F.col("tokens"), start + 1, shape.tokens).alias("y"),
        )
    )


def batch_rows(shards: DataFrame, shape: BatchShape) -> DataFrame:
    """One row per batch row: ``x`` and ``y`` of length T, cut straight from the shard."""
    start = F.col("__i") * _size(shape.length)
    return (
        shards.withColumn("__batches", shape.count(F.col("n_tokens")))
        .where(F.col("__batches") > 0)
        .withColumn("__i", _numbers(F.col("__batches") * _size(shape.rows)))
        .select(
            "split",
            "shard",
            int_div(F.col("__i"), shape.rows).alias("batch_in_shard"),
            (F.col("__i") % shape.rows).alias("row"),
            _slice(F.col("tokens"), start, shape.length).alias("x"),
            _slice(F.col("tokens"), start + 1, shape.length).alias("y"),
        )
    )


def _pass_over(counts: DataFrame, first: str) -> tuple[DataFrame, DataFrame]:
    """Batches before each shard in one pass, and the batches of a whole pass per split."""
    sums = running_sums(counts, {"batches": first}, minor="shard", restart=["split"])
    # one row per split, and there are two; a shuffle by split would put a pass into one task
    return sums.rows, F.broadcast(sums.totals_by(["split"], ["batches"]))


def _spread(thin: DataFrame, counts: DataFrame, passes: int) -> DataFrame:
    """Deal a thin table of shards out by the batches it will be expanded to.

    The number of partitions is asked for, so it is kept where a few kilobytes would be coalesced into one task.
    """
    batches = counts.agg(F.coalesce(F.sum("batches"), _size(0)).alias("n")).first().n * passes
    wanted = min(-(-batches // TASK_BATCHES), MAX_PARTITIONS)
    return thin.repartition(max(wanted, 2 * thin.sparkSession.sparkContext.defaultParallelism), "split", "shard")


def schedule(shards: DataFrame, shape: BatchShape, epochs: int = 1) -> DataFrame:
    """The order batches are read in: shard by shard, wrapping to the first shard after the last.

    Works for shards of any length; a shard too short for a batch is passed over.
    """
    counts = batch_counts(shards, shape)
    placed, totals = _pass_over(counts, "__first")
    return (
        _spread(placed.where(F.col("batches") > 0).join(totals, "split"), counts, epochs)
        .withColumn("batch_in_shard", _numbers(F.col("batches")))
        .withColumn("epoch", _numbers(_size(epochs)))
        .select(
            "split",
            "epoch",
            "shard",
            "batch_in_shard",
            (F.col("batch_in_shard") * _size(shape.tokens)).alias("data_position"),
            (F.col("epoch") * F.col("total_batches") + F.col("__first") + F.col("batch_in_shard")).alias("global_batch"),
        )
    )


def resume(shards: DataFrame, shape: BatchShape, shard: int, position: int, more_epochs: int = 1) -> DataFrame:
    """The schedule from a saved cursor: the rest of the current pass (epoch 0), then whole passes.

    ``position`` may be any token of the shard; batches of the first shard start there.
    ``global_batch`` counts from the cursor.  ``resume(..., 0, 0)`` is a reset.
    """
    if shard < 0 or position < 0:
        raise ValueError("a cursor is never negative")
    counts = batch_counts(shards, shape)
    at = F.when(F.col("shard") == shard, _size(position)).otherwise(_size(0))
    rest = (
        counts.where(F.col("shard") >= shard)
        .withColumn("__at", at)
        .withColumn("batches", shape.count(F.col("n_tokens") - F.col("__at")))
    )
    rest_placed, rest_totals = _pass_over(rest, "__first")
    whole_placed, whole_totals = _pass_over(counts, "__first")
    current = rest_placed.select("split", "shard", "batches", "__first", "__at", _size(0).alias("epoch"))
    later = (
        whole_placed.join(whole_totals, "split")
        .join(rest_totals.withColumnRenamed("total_batches", "__rest"), "split", "left")
        .withColumn("epoch", F.explode(F.sequence(_size(1), _size(more_epochs))))
        .select(
            "split",
            "shard",
            "batches",
            (
                F.coalesce("__rest", _size(0)) + (F.col("epoch") - 1) * F.col("total_batches") + F.col("__first")
            ).alias("__first"),
            _size(0).alias("__at"),
            "epoch",
        )
    )
    both = current.unionByName(later) if more_epochs > 0 else current
    return (
        _spread(both.where(F.col("batches") > 0), counts, more_epochs + 1)
        .withColumn("__i", _numbers(F.col("batches")))
        .select(
            "split",
            "epoch",
            "shard",
            (F.col("__at") + F.col("__i") * _size(shape.tokens)).alias("data_position"),
            (F.col("__first") + F.col("__i")).alias("global_batch"),
        )
    )


def numbered_batches(shards: DataFrame, shape: BatchShape, shard_size: int) -> DataFrame:
    """``batch_windows`` with ``global_batch``, for shards made by ``build_shards``.

    All shards of a split but the last are full, so the number is arithmetic: no join
    brings the thin counts back to the fat rows.
    """
    full = _size(shape.of_full_shard(shard_size))
    return batch_windows(shards, shape).withColumn("global_batch", F.col("shard") * full + F.col("batch_in_shard"))


def head_batches(
    shards: DataFrame, shape: BatchShape, n: int = VAL_BATCHES, split: str = "val", shard_size: int | None = None
) -> DataFrame:
    """The first ``n`` batches of a split after a reset.

    For shards made by ``build_shards`` with this ``shard_size`` all but the last are full, and which shards hold the head is arithmetic: they are
    named in a filter, and nothing is joined.  Without it shards may have any length: at most ``n`` of them can hold the head; their keys are
    broadcast to the shard scan, or joined where they are many.
    """
    if n < 1:
        raise ValueError("a head has at least one batch")
    mine = shards.where(F.col("split") == split)
    start = F.col("batch_in_shard") * _size(shape.tokens)
    if shard_size is not None:
        full = shape.of_full_shard(shard_size)
        # a full shard too short for a batch leaves them all to the last one, which is shorter still
        holding = mine.where(F.col("shard") < F.lit(-(-n // full))) if full else mine.limit(0)
        first = F.col("shard") * _size(full)
        joined = holding.withColumn("__first", first).where((F.col("__first") < n) & (shape.count(F.col("n_tokens")) > 0))
    else:
        placed, _ = _pass_over(batch_counts(mine, shape), "__first")
        heads = placed.where((F.col("batches") > 0) & (F.col("__first") < n)).select("split", "shard", "__first")
        keys = ["split", "shard"]
        if n <= MAX_BROADCAST_HEAD:  # there are no more shards than batches, so nothing needs to be counted
            joined = mine.join(F.broadcast(heads), keys)
        else:
            joined = join_thin(mine, heads, keys, "inner", F.col("shard"), MAX_BROADCAST_HEAD)
    take = F.least(shape.count(F.col("n_tokens")), _size(n) - F.col("__first"))
    return joined.withColumn("batch_in_shard", _numbers(take)).select(
        "split",
        "shard",
        "batch_in_shard",
        (F.col("__first") + F.col("batch_in_shard")).alias("global_batch"),
        _slice(F.col("tokens"), start, shape.tokens).alias("x"),
        _slice(F.col("tokens"), start + 1, shape.tokens).alias("y"),
    )


def step_manifest(scheduled: DataFrame, batches_per_step: int) -> DataFrame:
    """Which optimizer step, and which micro-step of it, reads each scheduled batch."""
    return scheduled.withColumns(
        {
            "step": int_div(F.col("global_batch"), batches_per_step),
            "micro_step": F.col("global_batch") % batches_per_step,
        }
    )


def step_lineage(spans: DataFrame, plan: SplitPlan, shape: BatchShape, batches_per_step: int) -> DataFrame:
    """Which documents fed which optimizer step, with the number of input tokens.

    Spans, shards, batches and steps all nest by arithmetic, so this is a projection of the
    spans: no join and no shuffle.
    """
    width = _size(shape.tokens)
    per_step = _size(batches_per_step)
    first = F.col("__first")
    return (
        shard_overlaps(spans, plan)
        .withColumns(
            {
                "__first": F.col("shard") * _size(shape.of_full_shard(plan.shard_size)),
                "__batches": shape.count(F.col("shard_tokens")),
            }
        )
        .withColumns(
            {
                "__b_lo": int_div(F.col("p_start"), shape.tokens),
                "__b_hi": F.least(int_div(F.col("p_end") - 1, shape.tokens), F.col("__batches") - 1),
            }
        )
        .where(F.col("__b_lo") <= F.col("__b_hi"))
        .withColumn(
            "step",
            F.explode(
                F.sequence(
                    int_div(first + F.col("__b_lo"), batches_per_step), int_div(first + F.col("__b_hi"), batches_per_step)
                )
            ),
        )
        .withColumns(
            {
                "__t_lo": F.greatest(F.col("step") * per_step - first, _size(0)) * width,
                "__t_hi": F.least((F.col("step") + 1) * per_step - first, F.col("__batches")) * width,
            }
        )
        .select(
            "split",
            "step",
            "shard",
            "source_no",
            "doc_ord",
            (F.least("p_end", "__t_hi") - F.greatest("p_start", "__t_lo")).alias("n_tokens"),
        )
    )
