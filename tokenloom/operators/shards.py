"""Fixed-size shards of the global token stream.

A shard is at most ``shard_size`` tokens by construction, so shuffling by runs of shards
cannot be skewed by a large source or document: long spans are cut before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.functions.names import ceil_div, int_div, shard_name
from tokenloom.operators.layout import TOKEN_GROWTH, SplitPlan, counted_rows, stored_tokens, text_or_tokens
from tokenloom.operators.ordering import running_sums
from tokenloom.operators.tokenizers import Tokenizer
from tokenloom.session import row_partitions, written_with

# The sizes of a full-scale corpus.
SHARD_SIZE = 1_000_000
VAL_RATIO = 0.01

ROW_GROUP_SHARDS = 16

#: Parts that one task of ``build_shards`` builds, about, and blocks of documents in a part.
PARTS_PER_TASK, BLOCKS_PER_PART = 4, 16
MAX_BLOCK_BITS = 14
#: Up to so many blocks their places are broadcast to the documents, past it they are joined.
MAX_BROADCAST_BLOCKS = 1 << 20

_IDS = "array<int>"


def shard_overlaps(spans: DataFrame, plan: SplitPlan) -> DataFrame:
    """Span × shard overlap without a range join: a span's shards are an arithmetic sequence.

    Adds ``split``, ``shard``, ``shard_tokens``, ``p_start``/``p_end`` (position inside the shard)
    and ``skip`` (tokens of the span that lie before the overlap).
    """
    no = F.col("__no")
    staged, plan = plan.attached(spans.where(F.col("n") > 0))
    return (
        staged.withColumn("__no", F.explode(F.sequence(plan.shard_of(F.col("g_start")), plan.shard_of(F.col("g_end") - 1))))
        .withColumns({"__at": plan.shard_start(no), "__to": plan.shard_end(no)})
        .withColumns({"__lo": F.greatest("g_start", "__at"), "__hi": F.least("g_end", "__to")})
        .withColumns(
            {
                "split": F.when(plan.is_val(no), F.lit("val")).otherwise(F.lit("train")),
                "shard": F.when(plan.is_val(no), no).otherwise(no - plan.val_shards),
                "shard_tokens": F.col("__to") - F.col("__at"),
                "p_start": F.col("__lo") - F.col("__at"),
                "p_end": F.col("__hi") - F.col("__at"),
                "skip": F.col("__lo") - F.col("g_start"),
            }
        )
        .drop("__no", "__at", "__to", "__lo", "__hi", "__total", "__cut", "__val_shards")
    )


def assemble(pieces: DataFrame, partitions: int | None = None) -> DataFrame:
    """Concatenate the pieces of each shard in order: the one shuffle that moves tokens.

    ``pieces`` is ``(split, shard, shard_tokens, p_start, piece)``; the size of a shard comes from arithmetic, so that
    no filter on it concatenates the tokens once more.  Repartitioning first keeps the list
    aggregate out of the map side, where it could combine nothing.
    """
    keyed = (
        pieces.repartition("split", "shard") if partitions is None else pieces.repartition(partitions, "split", "shard")
    )
    return _concatenated(keyed, "split", "shard")


def _concatenated(pieces: DataFrame, *keys: str) -> DataFrame:
    gathered = pieces.groupBy(*keys).agg(
        F.first("shard_tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("p_start", "piece"))).alias("pieces"),
    )
    return gathered.select("split", "shard", "n_tokens", F.flatten(F.col("pieces.piece")).alias("tokens"))


@dataclass(frozen=True)
class Placement:
    """Which task builds which shards, and where every block of documents goes.

    A part is a run of consecutive shards.  ``homes`` has one row for each block of documents: its offset, its size, and the first and last part it
    touches (``most_parts`` at most).  A block lies in one part, or straddles a boundary and goes to both sides; only blocks of very long documents touch more.
    """

    plan: SplitPlan
    homes: DataFrame
    n_blocks: int
    most_parts: int
    block_bits: int
    shards_in_part: int

    @staticmethod
    def over(thin: DataFrame, n_docs: int, n_tokens: int, shard_size: int, val_ratio: float, partitions: int) -> Placement:
        """``n_docs`` and ``n_tokens`` only set the sizes of parts and blocks."""
        shards = max(1, -(-n_tokens // shard_size))
        in_part = max(1, -(-shards // (partitions * PARTS_PER_TASK)))
        rows_in_part = max(1, n_docs * in_part // shards)
        bits = min(MAX_BLOCK_BITS, max(0, (rows_in_part // BLOCKS_PER_PART).bit_length() - 1))
        sums = running_sums(thin, {"n": "g_start"}, minor="doc_ord", majors=["source_no"], block_bits=bits)
        plan = SplitPlan.over(sums.total("n"), val_ratio, shard_size)
        sized = sums.base.withColumnRenamed("__base_n", "base").join(sums.blocks.withColumnRenamed("n", "size"), ["source_no", "__block"])

        def part(position: Column) -> Column:
            return int_div(plan.shard_of(position), in_part)

        homes, facts = written_with(
            sized.where("size > 0").select(
                "source_no", "__block", "base", "size", part(F.col("base")).alias("first"), part(F.col("base") + F.col("size") - 1).alias("last")
            ),
            "homes",
            n=F.count(F.lit(1)),
            most=F.max(F.col("last") - F.col("first") + 1),
        )
        return Placement(plan, homes, facts["n"], facts["most"] or 0, bits, in_part)

    def part_of(self, position: Column) -> Column:
        return int_div(self.plan.shard_of(position), self.shards_in_part)

    def start(self, part: Column) -> Column:
        return self.plan.shard_start(part * self.shards_in_part)

    def end(self, part: Column) -> Column:
        return F.least(self.start(part + 1), self.plan.total)

    def blocked(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__block", F.shiftright(F.col("doc_ord"), self.block_bits))

    def at_home(self, rows: DataFrame, homes: DataFrame) -> DataFrame:
        """Rows of the given blocks with their columns; broadcast where the blocks are few enough."""
        few = self.n_blocks <= MAX_BROADCAST_BLOCKS
        return self.blocked(rows).join(F.broadcast(homes) if few else homes, ["source_no", "__block"])


def build_shards(
    docs: DataFrame,
    tokenizer: Tokenizer,
    shard_size: int = SHARD_SIZE,
    val_ratio: float = VAL_RATIO,
    eos: str = "source",
    sources: DataFrame | None = None,
    partitions: int | None = None,
    val_only: bool = False,
    first_shards: int | None = None,
) -> DataFrame:
    """``shards(split, shard, n_tokens, tokens)`` of documents or of a token cache.

    Documents are counted first, in thin rows.  Then each goes, as text where it can be counted without tokenizing, to the task
    that builds the shards around it, which tokenizes it, finds its exact place and cuts it: one shuffle carries texts or
    tokens.  Documents of a block on a boundary between two parts go to both.  Blocks that touch more parts hold very long documents; those are
    tokenized and cut before the shuffle, so no part grows past its shards.

    ``val_only`` builds the validation shards, ``first_shards`` of them where that is given; documents past them are then neither moved nor tokenized.
    """
    partitions = partitions or row_partitions(docs, TOKEN_GROWTH) or docs.sparkSession.sparkContext.defaultParallelism
    docs = stored_tokens(docs, tokenizer)
    thin, n_docs, n_tokens = counted_rows(docs, tokenizer, eos, sources)
    place = Placement.over(thin, n_docs, n_tokens, shard_size, val_ratio, partitions)
    homes, plan = place.homes, place.plan
    if val_only:
        edge = plan.cut if first_shards is None else F.least(plan.cut, F.lit(first_shards * shard_size).cast("bigint"))
        homes = homes.where(F.col("base") < edge)
        last = homes.agg(F.max("source_no")).first()[0]
        bound = F.lit(False) if last is None else F.col("source_no") <= last
        docs, thin = docs.where(bound), thin.where(bound)

    payload, made = text_or_tokens(docs, tokenizer, eos)
    kind = docs.schema[payload].dataType
    counts = F.col("n") if "tokens" in docs.columns else tokenizer.count(F.col("text"))
    counted = counts + 1 if eos == "document" else counts
    rows = docs.select("source_no", "doc_ord", counted.alias("n"), payload, F.lit(False).alias("is_end"))
    ends = thin.where("is_end").select("source_no", "doc_ord", "n", F.lit(None).cast(kind).alias(payload), "is_end")
    rows = rows.unionByName(ends).where("n > 0")
    tokens = F.when(F.col("is_end"), F.array(F.lit(tokenizer.eos_id))).otherwise(made)

    long_ = homes.where("last > first + 1")
    any_long = place.most_parts > 2
    # A document goes where its block goes ...
    near = place.at_home(rows, homes.where("last <= first + 1")).withColumn("part", F.explode(F.sequence("first", "last")))
    moved = near.select("part", "source_no", "__block", "doc_ord", "base", "n", payload, "is_end", *([F.lit(None).cast(_IDS).alias("cut")] if any_long else []))
    if any_long:  # ... and of a block that touches many parts to its own ones, as the tokens that belong there.
        before = Window.partitionBy("source_no", "__block").orderBy("doc_ord").rowsBetween(Window.unboundedPreceding, -1)
        exact = place.at_home(rows, long_).withColumn("g_start", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        exact = exact.select("source_no", "doc_ord", "g_start", (F.col("g_start") + F.col("n")).alias("g_end"), tokens.alias("tokens"))
        part = F.col("part")
        exact = exact.withColumn("part", F.explode(F.sequence(place.part_of(F.col("g_start")), place.part_of(F.col("g_end") - 1)))).withColumns(
            {"base": F.greatest("g_start", place.start(part)), "__hi": F.least("g_end", place.end(part))}
        )
        length = F.col("__hi") - F.col("base")
        pieces = exact.select(
            "part", "source_no", (-1 - F.col("doc_ord")).alias("__block"), "doc_ord", "base", length.alias("n"),
            F.lit(None).cast(kind).alias(payload), F.lit(False).alias("is_end"),
            F.slice("tokens", (F.col("base") - F.col("g_start") + 1).cast("int"), length.cast("int")).alias("cut"),
        )
        moved = moved.unionByName(pieces)
        tokens = F.coalesce("cut", tokens)

    # Parts are dealt out in turn, as hashes of few parts would leave tasks uneven.  The window and the aggregate below find their rows together: nothing
    # moves again.
    here = moved.withColumn("task", F.pmod("part", F.lit(partitions).cast("bigint")).cast("int")).repartitionById(partitions, "task")
    in_block = Window.partitionBy("task", "part", "source_no", "__block").orderBy("doc_ord").rowsBetween(Window.unboundedPreceding, -1)
    spans = here.withColumn("g_start", F.col("base") + F.coalesce(F.sum("n").over(in_block), F.lit(0)))
    spans = spans.withColumn("g_end", F.col("g_start") + F.col("n")).where(
        (F.col("g_end") > place.start(F.col("part"))) & (F.col("g_start") < place.end(F.col("part")))
    )
    overlaps = shard_overlaps(spans.select("task", "part", "n", "g_start", "g_end", tokens.alias("tokens")), plan)
    through = F.col("shard") + F.when(F.col("split") == "val", F.lit(0)).otherwise(plan.val_shards)
    mine = overlaps.where(int_div(through, place.shards_in_part) == F.col("part"))
    piece = F.slice("tokens", (F.col("skip") + 1).cast("int"), (F.col("p_end") - F.col("p_start")).cast("int")).alias("piece")
    kept = mine.where(F.col("split") == "val") if val_only else mine
    kept = kept.where(F.col("shard") < first_shards) if val_only and first_shards is not None else kept
    return _concatenated(kept.select("task", "part", "split", "shard", "shard_tokens", "p_start", piece), "task", "part", "split", "shard")


def shard_plan(total: Column, val_ratio: float, shard_size: int) -> tuple[Column, Column, Column, Column]:
    """``(train tokens, val tokens, train shards, val shards)`` as columns of the total."""
    plan = SplitPlan.over(total, val_ratio, shard_size)
    train = total - plan.cut
    return train, plan.cut, ceil_div(train, shard_size), plan.val_shards


def write_shards(shards: DataFrame, path: str) -> None:
    """Parquet by split, few shards per row group.

    A reader decodes a row group's worth of rows at once, and a row here is megabytes.
    """
    shards.write.partitionBy("split").option("parquet.block.row.count.limit", ROW_GROUP_SHARDS).parquet(path)


def named(shards: DataFrame) -> DataFrame:
    return shards.withColumn("shard_name", shard_name(F.col("split"), F.col("shard")))


def require_both_splits(total_tokens: int, val_ratio: float) -> None:
    """A corpus too small for one validation token cannot be loaded; say so before writing."""
    if int(total_tokens * val_ratio) < 1 or total_tokens - int(total_tokens * val_ratio) < 1:
        raise ValueError(
            f"{total_tokens} tokens at val_ratio={val_ratio} leave a split empty; add data or change the ratio"
        )
