"""Every token's place: end-of-text rows, global offsets, split by position, chunks of text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.names import ceil_div, int_div
from tokenloom.operators.ordering import RunningSums, running_sums
from tokenloom.operators.tokenizers import Tokenizer
from tokenloom.session import row_partitions, scratch_dir, shared_root, spread, written_with

EOS_MODES = ("source", "document", "none")

#: Size of shuffled text and of shuffled ids against compressed input, generously.
TEXT_GROWTH = 4.0
TOKEN_GROWTH = 12.0

#: Up to this many repeated documents are broadcast by key, past it all rows are shuffled.
MAX_BROADCAST_REPEATS = 1_000_000

#: Rows of a file whose choice is one bit each of one BIGINT, and up to how many of those are broadcast; past it they are joined.
MASK_BITS = 6
MAX_BROADCAST_MASKS = 1 << 18


def text_or_tokens(docs: DataFrame, tokenizer: Tokenizer, eos: str) -> tuple[str, Column]:
    """The column of ``docs`` that token rows are made from, and the expression that makes them (before the end of a source)."""
    payload = "tokens" if "tokens" in docs.columns else "text"
    tokens = F.col("tokens") if payload == "tokens" else tokenizer.encode(F.col("text"))
    return payload, F.concat(tokens, F.array(F.lit(tokenizer.eos_id))) if eos == "document" else tokens


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def tokenize(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``docs`` with ``tokens`` and ``n``, without the text."""
    return _encoded(docs, tokenizer)


def tokenize_with_prints(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``tokenize`` with ``digest`` and ``bytes`` of the text, by which changed documents are noticed later."""
    return _encoded(docs, tokenizer, *_prints())


def _encoded(docs: DataFrame, tokenizer: Tokenizer, *more: Column) -> DataFrame:
    rows = spread(docs).select("source_no", "doc_ord", tokenizer.encode(F.col("text")).alias("tokens"), *more)
    return rows.withColumn("n", F.size("tokens").cast("bigint"))


def eos_rows(docs: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(source_no, doc_ord)`` of the one row that ends each source.

    ``sources`` names sources that may hold no document at all; they still get their end row.
    """
    ends = docs.groupBy("source_no").agg((F.max("doc_ord") + 1).alias("doc_ord"))
    if sources is None:
        return ends
    return sources.select("source_no").join(ends, "source_no", "left").select(
        "source_no", F.coalesce("doc_ord", _long(0)).alias("doc_ord")
    )


def _prints() -> list[Column]:
    """What tells two texts apart: a hash of the document and its size."""
    return [F.xxhash64("doc_ord", "text").alias("digest"), F.octet_length("text").cast("bigint").alias("bytes")]


def stored_tokens(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``docs`` as a token cache, where lengths are known only after tokenizing.

    Layout and assembly both need the rows; storing them means tokenizing once.  Documents that
    are a cache already, or can be counted without tokenizing, come back as they are.
    """
    if "tokens" in docs.columns or tokenizer.count is not None:
        return docs
    path = scratch_dir(docs.sparkSession, "tokens")
    rows = tokenize_with_prints(docs, tokenizer)
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def each_once(docs: DataFrame) -> DataFrame:
    """Documents that may have been delivered several times, each once: the one with most tokens, or the longest text.

    Repeats are looked for among the keys alone; as a rule there are few, and then no texts or tokens move but theirs.
    """
    shared_root(docs.sparkSession)
    keys = ["source_no", "doc_ord"]
    repeated = docs.groupBy(*keys).count().where(F.col("count") > 1).select(*keys).checkpoint()
    n = repeated.limit(MAX_BROADCAST_REPEATS + 1).count()
    if n == 0:
        return docs
    if n > MAX_BROADCAST_REPEATS:
        return _longest(docs, keys)
    repeated = F.broadcast(repeated)
    once = docs.join(repeated, keys, "left_anti")
    return once.unionByName(_longest(docs.join(repeated, keys, "left_semi"), keys))


def stored_once(rows: DataFrame, file: str, index: str) -> DataFrame:
    """``each_once`` of token rows in files, where most of them may be repeats: ``file`` and ``index`` name the place of a row, and go.

    Which copy counts is settled on thin rows: size, digest, place.  The chosen places come back as bits, one BIGINT for 64 rows of a file,
    so tokens stay where they are read.  Only documents of one size with different digests, or without one, are compared by their tokens.
    """
    shared_root(rows.sparkSession)
    keys = ["source_no", "doc_ord"]
    plain = rows.drop(file, index)
    if rows.groupBy(*keys).count().where(F.col("count") > 1).isEmpty():
        return plain
    size = F.coalesce("n", _long(-1)).alias("size")
    best = rows.groupBy(*keys).agg(
        F.max(F.struct(size, "digest", F.col(file).alias("file"), F.col(index).alias("index"))).alias("best"),
        F.max(F.struct(size, F.bitwise_not("digest").alias("digest"))).alias("least"),  # of that size, the other end of the digests
        F.count("*").alias("copies"),
        F.bool_or(F.col("digest").isNull()).alias("unknown"),
    )
    alike = (F.col("copies") == 1) | (~F.col("unknown") & (F.col("best.digest") == F.bitwise_not("least.digest")))
    chosen, facts = written_with(
        best.select(*keys, F.col("best.file").alias(file), F.col("best.index").alias(index), alike.alias("alike")), "chosen", unlike=F.count_if(~F.col("alike"))
    )
    word, bit = F.shiftright(F.col(index), MASK_BITS), F.col(index).bitwiseAND((1 << MASK_BITS) - 1).cast("int")
    bits = F.bit_or(F.call_function("shiftleft", _long(1), bit)).alias("__bits")
    masks, told = written_with(chosen.where("alike").groupBy(file, word.alias("__word")).agg(bits), "masks", n=F.count(F.lit(1)))
    masks = F.broadcast(masks) if told["n"] <= MAX_BROADCAST_MASKS else masks.hint("shuffle_hash")
    once = rows.withColumn("__word", word).join(masks, [file, "__word"]).where(F.getbit("__bits", bit) == 1).select(plain.columns)
    if not facts["unlike"]:
        return once
    unlike = chosen.where(~F.col("alike")).select(*[F.col(k).alias(f"__{k}") for k in keys])
    unlike = F.broadcast(unlike) if facts["unlike"] <= MAX_BROADCAST_REPEATS else unlike
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return once.unionByName(_longest(plain.join(unlike, same, "left_semi"), keys))


def _longest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with one key the longest, the greater content where they are as long: the same row in every run."""
    more = [c for c in rows.columns if c not in keys]
    size = F.col("n") if "n" in more else F.length("text").cast("bigint")
    first = [c for c in ("tokens", "text") if c in more]
    best = F.max(F.struct(F.coalesce(size, F.lit(-1).cast("bigint")).alias("__size"), *first, *[c for c in more if c not in first])).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col("r")[c].alias(c) for c in more]).select(rows.columns)


def token_rows(
    docs: DataFrame,
    tokenizer: Tokenizer,
    eos: str = "source",
    sources: DataFrame | None = None,
) -> tuple[DataFrame, Column]:
    """Rows with ``n``, a content ``digest`` and ``bytes``, and the expression that yields their ``tokens``.

    Input is ``(source_no, doc_ord, text)`` or the token cache ``(source_no, doc_ord, n, tokens)``.
    Where the tokenizer can count without encoding, rows keep their text and the
    tokens are built after the layout is known: offsets then never pay for tokenizing.
    """
    if eos not in EOS_MODES:
        raise ValueError(f"eos is one of {EOS_MODES}, not {eos!r}")
    end = F.array(F.lit(tokenizer.eos_id))
    cached = "tokens" in docs.columns
    counted = not cached and tokenizer.count is not None
    if cached:
        known = [
            F.col(c) if c in docs.columns else F.lit(None).cast("bigint").alias(c) for c in ("digest", "bytes")
        ]
        payload, rows = "tokens", docs.select("source_no", "doc_ord", "n", "tokens", *known)
    elif counted:
        payload = "text"
        rows = docs.select("source_no", "doc_ord", tokenizer.count(F.col("text")).alias("n"), "text", *_prints())
    else:
        payload, encoded = "tokens", tokenizer.encode(F.col("text")).alias("tokens")
        rows = docs.select("source_no", "doc_ord", encoded, *_prints()).withColumn("n", F.size("tokens").cast("bigint"))

    tokens = tokenizer.encode(F.col("text")) if counted else F.col("tokens")
    if eos == "document":
        return rows.withColumn("n", F.col("n") + 1), F.concat(tokens, end)
    if eos == "none":
        return rows, tokens
    ends = eos_rows(docs, sources).select(
        "source_no",
        "doc_ord",
        _long(1).alias("n"),
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (payload, "digest", "bytes")],
    )
    rows = rows.withColumn("is_end", F.lit(False)).unionByName(ends.withColumn("is_end", F.lit(True)))
    return rows, F.when(F.col("is_end"), end).otherwise(tokens)


def thin_rows(docs: DataFrame, tokenizer: Tokenizer, eos: str = "source", sources: DataFrame | None = None) -> DataFrame:
    """``source_no``, ``doc_ord``, ``n``, ``is_end`` of ``token_rows``: what offsets need, without texts and tokens.

    Documents are read once, and what they count is written; end rows and offsets come from there.
    """
    return counted_rows(docs, tokenizer, eos, sources)[0]


def counted_rows(docs: DataFrame, tokenizer: Tokenizer, eos: str, sources: DataFrame | None) -> tuple[DataFrame, int, int]:
    """``thin_rows``, the number of documents and the tokens in them."""
    if eos not in EOS_MODES:
        raise ValueError(f"eos is one of {EOS_MODES}, not {eos!r}")
    counted = F.col("n") if "tokens" in docs.columns else None
    if counted is None:
        counted = F.size(tokenizer.encode(F.col("text"))).cast("bigint") if tokenizer.count is None else tokenizer.count(F.col("text"))
    sized = docs.select("source_no", "doc_ord", (counted + (1 if eos == "document" else 0)).alias("n"))
    thin, facts = written_with(sized, "counted", docs=F.count(F.lit(1)), tokens=F.sum("n"))
    rows = thin.withColumn("is_end", F.lit(False))
    if eos == "source":
        ends = eos_rows(thin, sources).select("source_no", "doc_ord", _long(1).alias("n"), F.lit(True).alias("is_end"))
        rows = rows.unionByName(ends)
    return rows, int(facts["docs"] or 0), int(facts["tokens"] or 0)


@dataclass(frozen=True)
class Offsets:
    """Spans ``[g_start, g_end)`` in the one global token stream."""

    sums: RunningSums

    @property
    def n_tokens(self) -> int:
        return self.sums.totals["n"]

    def total(self, name: str = "n") -> Column:
        return self.sums.total(name)

    @property
    def rows(self) -> DataFrame:
        return self._ended(self.sums.rows)

    def rows_before(self, position: int) -> DataFrame:
        """The rows that begin before ``position``; blocks beyond it are not read further."""
        return self._ended(self.sums.rows_before("n", position)).where(F.col("g_start") < position)

    @staticmethod
    def _ended(rows: DataFrame) -> DataFrame:
        return rows.withColumn("g_end", F.col("g_start") + F.col("n"))


def global_offsets(rows: DataFrame, partitions: int | None = None) -> Offsets:
    """Half-open span ``[g_start, g_end)`` of every row in the one global token stream."""
    return Offsets(running_sums(rows, {"n": "g_start"}, minor="doc_ord", majors=["source_no"], partitions=partitions))


@dataclass(frozen=True)
class SplitPlan:
    """Total, validation cut-off and shard numbering as columns.

    Validation is the head of the stream, ``[0, cut)``; training is the rest.
    Shards are numbered through: validation first, then training.
    """

    total: Column
    cut: Column
    val_shards: Column
    shard_size: int

    @staticmethod
    def over(total: Column, val_ratio: float, shard_size: int) -> SplitPlan:
        if shard_size < 1 or not 0.0 <= val_ratio <= 1.0:
            raise ValueError("shard_size must be positive and val_ratio within [0, 1]")
        cut = F.floor(total * F.lit(float(val_ratio))).cast("bigint")
        return SplitPlan(total, cut, ceil_div(cut, shard_size), shard_size)

    def attached(self, df: DataFrame) -> tuple[DataFrame, SplitPlan]:
        """The figures as columns of ``df``, and the plan over those.

        Expressions then name a column where they would each carry the subquery.
        """
        names = ("__total", "__cut", "__val_shards")
        staged = df.withColumns(dict(zip(names, (self.total, self.cut, self.val_shards))))
        return staged, SplitPlan(*(F.col(n) for n in names), self.shard_size)

    def shard_of(self, position: Column) -> Column:
        return F.when(position < self.cut, int_div(position, self.shard_size)).otherwise(
            self.val_shards + int_div(position - self.cut, self.shard_size)
        )

    def is_val(self, through_no: Column) -> Column:
        return through_no < self.val_shards

    def shard_start(self, through_no: Column) -> Column:
        size = _long(self.shard_size)
        return F.when(self.is_val(through_no), through_no * size).otherwise(
            self.cut + (through_no - self.val_shards) * size
        )

    def shard_end(self, through_no: Column) -> Column:
        limit = F.when(self.is_val(through_no), self.cut).otherwise(self.total)
        return F.least(self.shard_start(through_no) + _long(self.shard_size), limit)


def split_spans(spans: DataFrame, plan_total: Column, val_ratio: float) -> DataFrame:
    """Clip every span to the two splits; the document on the cut yields one row in each.

    Adds ``split``, ``s_start``/``s_end`` (position inside the split) and ``skip`` (tokens of the
    document that lie before the clipped span).
    """
    plan = SplitPlan.over(plan_total, val_ratio, 1)
    staged = spans.withColumns({"__cut": plan.cut}).where(F.col("n") > 0)
    crosses = (F.col("g_start") < F.col("__cut")) & (F.col("g_end") > F.col("__cut"))
    sides = F.when(crosses, F.array(F.lit("val"), F.lit("train"))).otherwise(
        F.array(F.when(F.col("g_start") < F.col("__cut"), F.lit("val")).otherwise(F.lit("train")))
    )
    val = F.col("split") == "val"
    clipped = staged.withColumn("split", F.explode(sides)).withColumns(
        {
            "__lo": F.when(val, F.col("g_start")).otherwise(F.greatest("g_start", "__cut")),
            "__hi": F.when(val, F.least("g_end", "__cut")).otherwise(F.col("g_end")),
        }
    )
    origin = F.when(val, _long(0)).otherwise(F.col("__cut"))
    return clipped.withColumns(
        {
            "s_start": F.col("__lo") - origin,
            "s_end": F.col("__hi") - origin,
            "skip": F.col("__lo") - F.col("g_start"),
        }
    ).drop("__cut", "__lo", "__hi")


def text_chunks(docs: DataFrame, chunk_chars: int) -> DataFrame:
    """The character stream of every source cut into chunks of ``chunk_chars``.

    A source of any size is cut by position, so one task handles one chunk, not one source.
    """
    sized = docs.select("source_no", "doc_ord", "text", F.length("text").cast("bigint").alias("chars"))
    partitions = row_partitions(docs, TEXT_GROWTH)
    placed = running_sums(
        sized, {"chars": "c_start"}, minor="doc_ord", restart=["source_no"], partitions=partitions
    ).rows
    end = F.col("c_start") + F.col("chars")
    pieces = (
        placed.where(F.col("chars") > 0)
        .withColumn("c_end", end)
        .withColumn(
            "chunk_no",
            F.explode(F.sequence(int_div(F.col("c_start"), chunk_chars), int_div(F.col("c_end") - 1, chunk_chars))),
        )
        .withColumn("__lo", F.greatest(F.col("c_start"), F.col("chunk_no") * _long(chunk_chars)))
        .withColumn("__hi", F.least(F.col("c_end"), (F.col("chunk_no") + 1) * _long(chunk_chars)))
        .select(
            "source_no",
            "chunk_no",
            (F.col("__lo") - F.col("chunk_no") * _long(chunk_chars)).alias("at"),
            F.substring(
                F.col("text"), (F.col("__lo") - F.col("c_start") + 1).cast("int"), (F.col("__hi") - F.col("__lo")).cast("int")
            ).alias("piece"),
        )
    )
    keyed = pieces if partitions is None else pieces.repartition(partitions, "source_no", "chunk_no")
    gathered = keyed.groupBy("source_no", "chunk_no").agg(
        F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces")
    )
    return gathered.select("source_no", "chunk_no", F.array_join(F.col("pieces.piece"), "").alias("chunk"))


def chunked_docs(docs: DataFrame, chunk_chars: int) -> DataFrame:
    """Chunks as documents, for a tokenizer that is to see ``chunk_chars`` characters at a time."""
    return text_chunks(docs, chunk_chars).select(
        "source_no", F.col("chunk_no").alias("doc_ord"), F.col("chunk").alias("text")
    )
