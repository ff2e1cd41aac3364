"""A corpus on disk: token cache, manifest, versioned shards.

Layout below one root folder::

    cache/run=<n>/      tokenized documents of one ingest run, with their place in the source
    manifest/claim=<n>/ one row per source and run; the newest whole run of a source counts, and the parts after it
    manifest/stream=<id>/batch=<n>/  the same for a micro-batch of a stream, whose runs are parts
    shards/version=<n>/ shards of one build, partitioned by split
    published/claim=<n>/ one row per version; the newest is current

    claims/             one empty file per run and version number in use

Data is written before the row that makes it visible, so a job that dies half-way, or loses
executors, leaves readers where they were.  Numbers are claimed by creating a file that must not exist, so writers at the same time never share
one, nor a folder to write in.  Documents are tokenized where they are read and written without a shuffle; a rebuild counts the cache's thin columns and shuffles its tokens once.
What a newer run or version replaces is deleted by ``vacuum`` and ``expire`` after a grace period, so that scans begun before may end.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tokenloom import schemas
from tokenloom.operators.layout import Offsets, each_once, global_offsets, stored_tokens, token_rows
from tokenloom.operators.shards import SHARD_SIZE, VAL_RATIO, build_shards, require_both_splits, write_shards
from tokenloom.operators.tokenizers import Tokenizer
from tokenloom.session import claim_number, delete_older, is_complete, join_thin, partitions_for, shared_root, spread, table_at

#: Up to this many sources the manifest is broadcast to the cache scan, past it it is joined.
MAX_BROADCAST_SOURCES = 500_000

#: Seconds for which replaced data stays, for the sake of scans under way.
GRACE = 24 * 3600.0

_CACHE = T.StructType(
    [
        *schemas.TOKEN_CACHE.fields,
        T.StructField("digest", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("run", T.StringType()),
    ]
)
_MANIFEST = T.StructType(
    [
        T.StructField("source_no", T.IntegerType()),
        T.StructField("docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("prints", T.LongType()),
        T.StructField("text_bytes", T.LongType()),
        T.StructField("text_xor", T.LongType()),
        T.StructField("last_ord", T.LongType()),
        T.StructField("part", T.BooleanType()),
        T.StructField("run", T.StringType()),
        T.StructField("run_seq", T.LongType()),
    ]
)
_PUBLISHED = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("published_at", T.DoubleType()),
    ]
)


def _content() -> list[Column]:
    """What is known of the contents of a source; figures of its parts add up."""
    return [F.count("digest").alias("prints"), F.sum("bytes").alias("text_bytes"), F.bit_xor("digest").alias("text_xor")]


def _signature() -> Column:
    parts = [F.sum("prints").cast("string"), F.sum("text_bytes").cast("string"), F.hex(F.bit_xor("text_xor"))]
    return F.concat_ws("-", *parts).alias("signature")


def signatures(docs: DataFrame) -> DataFrame:
    """Content signature per source: document count, bytes, and an order-free hash of all documents."""
    if "digest" in docs.columns:  # tokenized documents carry them
        prints = docs.select("source_no", "digest", "bytes")
    else:
        text = [F.xxhash64("doc_ord", "text").alias("digest"), F.octet_length("text").cast("bigint").alias("bytes")]
        prints = docs.select("source_no", *text)
    return prints.groupBy("source_no").agg(*_content()).groupBy("source_no").agg(_signature())


class Corpus:
    """Token cache and shards of one tokenizer under ``root``."""

    def __init__(self, spark: SparkSession, root: str, tokenizer: Tokenizer, eos: str = "source"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.tokenizer = tokenizer
        self.eos = eos
        shared_root(spark)

    # -- cache ---------------------------------------------------------------------------

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        return table_at(self.spark, f"{self.root}/{name}", schema, nested=name != "cache")

    def _valid(self) -> DataFrame:
        """The manifest rows that count: of every source the newest whole run, and the parts added after it."""
        rows = self._table("manifest", _MANIFEST)
        whole = rows.where(~F.col("part")).groupBy("source_no").agg(F.max("run_seq").alias("__since"))
        return rows.join(whole, "source_no", "left").where(F.col("run_seq") >= F.coalesce("__since", F.lit(0))).drop("__since")

    def manifest(self) -> DataFrame:
        """One row per source, for all of its valid runs; ``run`` is the newest."""
        # parts hold no end of their source; without a whole run it is not counted yet
        ends = F.min(F.col("part").cast("bigint")) if self.eos == "source" else F.lit(0).cast("bigint")
        return self._valid().groupBy("source_no").agg(
            (F.sum("docs") + ends).alias("docs"), (F.sum("n_tokens") + ends).alias("n_tokens"), _signature(), F.max_by("run", "run_seq").alias("run")
        )

    def fresh(self, docs: DataFrame, detect: str = "number") -> DataFrame:
        """Documents of sources that still need tokenizing.

        ``number`` trusts the source number alone; ``content`` also notices changed text.
        """
        known = self.manifest()
        if detect == "number":
            return self._without(docs, known.select("source_no"))
        if detect == "content":
            same = signatures(docs).join(known, ["source_no", "signature"], "left_semi").select("source_no")
            return self._without(docs, same.checkpoint())
        raise ValueError(f"detect is number or content, not {detect!r}")

    @staticmethod
    def _without(docs: DataFrame, sources: DataFrame) -> DataFrame:
        return join_thin(docs, sources, ["source_no"], "left_anti", F.col("doc_ord"), MAX_BROADCAST_SOURCES)

    def add(
        self, docs: DataFrame, force: bool = False, detect: str = "number", sources: DataFrame | None = None
    ) -> str | None:
        """Tokenize what is new (everything, with ``force``) and make it part of the corpus.

        Returns the run, or None where nothing was new.
        """
        if "tokens" in docs.columns and "digest" not in docs.columns:
            docs = docs.withColumns({"digest": F.xxhash64("doc_ord", "tokens"), "bytes": F.col("n") * 4})
        fresh = docs if force else self.fresh(docs, detect)
        if sources is not None and not force:
            sources = sources.join(self.manifest().select("source_no"), "source_no", "left_anti")
        if fresh.isEmpty() and (sources is None or sources.isEmpty()):
            return None
        # lengths a tokenizer cannot count are known only after tokenizing: do that once
        rows, tokens = token_rows(spread(stored_tokens(fresh, self.tokenizer)), self.tokenizer, self.eos, sources)
        return self._commit(rows, tokens)

    def add_batch(self, docs: DataFrame, stream: str, batch_id: int) -> str | None:
        """Add the documents of a micro-batch to their sources, which may grow with every batch.

        The batch is one commit under ``(stream, batch_id)``: run again after it, it adds nothing; run again after an attempt that
        died, it replaces what that left.  A document whose place in a source is taken adds nothing, and of several with one
        place in the batch the longest counts.  Nothing that is stored is written again.  One stream at a time may add to a source.
        Returns the run, or None where nothing was new.
        """
        if not re.fullmatch(r"[\w.-]+", stream) or batch_id < 0:
            raise ValueError(f"no name of a micro-batch: {stream!r}, {batch_id!r}")
        place = f"manifest/stream={stream}/batch={batch_id}"
        if is_complete(self.spark, f"{self.root}/{place}"):
            return None
        docs = docs.select("source_no", "doc_ord", "text")
        touched = docs.select("source_no").distinct().checkpoint()
        runs = self._valid().select("source_no", "run").join(touched, "source_no", "left_semi").checkpoint()
        if not runs.isEmpty():
            held = self._held(runs).where(F.col("digest").isNotNull()).select("source_no", "doc_ord")
            taken = docs.select("source_no", "doc_ord").join(held, ["source_no", "doc_ord"], "left_semi").checkpoint()
            docs = join_thin(docs, taken.distinct(), ["source_no", "doc_ord"], "left_anti", F.col("doc_ord"), MAX_BROADCAST_SOURCES)
        docs = each_once(docs)
        if docs.isEmpty():
            return None
        rows, tokens = token_rows(spread(docs), self.tokenizer, "none" if self.eos == "source" else self.eos)
        return self._commit(rows, tokens, place)

    def _commit(self, rows: DataFrame, tokens: Column, place: str | None = None) -> str:
        """Write a run, then the manifest rows that make it visible, at ``place`` for a part."""
        run = uuid.uuid4().hex
        rows.select("source_no", "doc_ord", "n", tokens.alias("tokens"), "digest", "bytes").write.parquet(f"{self.root}/cache/run={run}")
        seq = claim_number(self.spark, f"{self.root}/claims/runs", lambda: self._highest("manifest", _MANIFEST, "run_seq"))
        # from the thin columns of what was written
        figures = [F.count("*").alias("docs"), F.sum("n").cast("bigint").alias("n_tokens"), *_content()]
        last = F.max(F.when(F.col("digest").isNotNull(), F.col("doc_ord"))).alias("last_ord")
        counts = self.spark.read.schema(_CACHE).parquet(f"{self.root}/cache/run={run}").groupBy("source_no").agg(*figures, last)
        mine = {"part": F.lit(place is not None), "run": F.lit(run), "run_seq": F.lit(seq).cast("bigint")}
        counts.withColumns(mine).select(_MANIFEST.names).write.mode("overwrite" if place else "error").parquet(f"{self.root}/{place or f'manifest/claim={seq}'}")
        return run

    def _highest(self, table: str, schema: T.StructType, number: str) -> int:
        return self._table(table, schema).agg(F.coalesce(F.max(number), F.lit(-1)).alias("n")).first().n

    def _held(self, runs: DataFrame) -> DataFrame:
        return join_thin(self._table("cache", _CACHE), runs, ["source_no", "run"], "left_semi", F.col("doc_ord"), MAX_BROADCAST_SOURCES)

    def cache(self) -> DataFrame:
        """The valid documents of every source: ``source_no``, ``doc_ord``, ``n``, ``tokens``; an end-of-text id is a row of its own."""
        columns = ["source_no", "doc_ord", "n", "tokens"]
        valid = self._valid()
        rows = self._held(valid.select("source_no", "run"))
        if self.eos != "source":
            return rows.select(columns)
        # The end of a source that has grown stands behind its last part.
        sums = valid.groupBy("source_no").agg(F.max("part").alias("grown"), F.max("last_ord").alias("last_ord"))
        grown = sums.where("grown").select("source_no", "grown", (F.coalesce("last_ord", F.lit(-1)) + 1).alias("doc_ord")).checkpoint()
        if grown.isEmpty():
            return rows.select(columns)
        ends = grown.select("source_no", "doc_ord", F.lit(1).cast("bigint").alias("n"), F.array(F.lit(self.tokenizer.eos_id)).alias("tokens"))
        rows = join_thin(rows, grown.select("source_no", "grown"), ["source_no"], "left", F.col("doc_ord"), MAX_BROADCAST_SOURCES)
        return rows.where(F.col("grown").isNull() | F.col("digest").isNotNull()).select(columns).unionByName(ends)

    def offsets(self) -> Offsets:
        """Global spans of the documents, from the cache's thin columns."""
        return global_offsets(self.cache().select("source_no", "doc_ord", "n"))

    # -- shards --------------------------------------------------------------------------

    def shards(self, shard_size: int = SHARD_SIZE, val_ratio: float = VAL_RATIO) -> DataFrame:
        """Shards of the whole corpus, not yet written."""
        total = self.manifest().agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("n")).first().n
        require_both_splits(total, val_ratio)
        # the cache holds the ends already
        return build_shards(self.cache(), self.tokenizer, shard_size, val_ratio, eos="none", partitions=partitions_for(self.spark, total * 4))

    def publish(self, shard_size: int = SHARD_SIZE, val_ratio: float = VAL_RATIO) -> str:
        """Build shards beside the current ones, then make them current by one appended row."""
        version = uuid.uuid4().hex
        built = self.shards(shard_size, val_ratio)
        total = self.manifest().agg(F.sum("n_tokens").cast("bigint")).scalar()
        write_shards(built, f"{self.root}/shards/version={version}")
        seq = claim_number(self.spark, f"{self.root}/claims/versions", lambda: self._highest("published", _PUBLISHED, "seq"))
        self.spark.range(1).select(
            F.lit(version).alias("version"), F.lit(seq).cast("bigint").alias("seq"), total.alias("total_tokens"), F.lit(time.time()).alias("published_at")
        ).write.parquet(f"{self.root}/published/claim={seq}")
        return version

    def current_version(self) -> str | None:
        """Versions are file names, so this one value does come to the driver."""
        row = self._table("published", _PUBLISHED).agg(F.max_by("version", "seq").alias("version")).first()
        return row.version

    def current(self, split: str | None = None) -> DataFrame:
        """Published shards; a split is pruned by partition."""
        version = self.current_version()
        if version is None:
            raise FileNotFoundError(f"nothing is published under {self.root}")
        return read_shards(self.spark, f"{self.root}/shards/version={version}", split)

    def expire(self, keep: int = 1, grace: float = GRACE) -> int:
        """Delete all but the newest ``keep`` published versions; returns how many went.

        A version stays until ``grace`` seconds after the one that replaced it was published: whoever began to read it has that long to finish.
        """
        if keep < 1:
            raise ValueError("the current version is never deleted")
        log = self._table("published", _PUBLISHED)
        replaced = log.select("version", "seq", F.lead("published_at").over(Window.orderBy("seq")).alias("replaced_at"))  # one row per version
        due = F.coalesce("replaced_at", F.lit(0.0)) <= F.lit(time.time() - grace)
        old = replaced.join(log.orderBy(F.desc("seq")).limit(keep), "version", "left_anti").where(due)
        return sum(delete_older(self.spark, f"{self.root}/shards/version={row.version}") for row in old.select("version").toLocalIterator())

    def vacuum(self, grace: float = GRACE) -> int:
        """Delete the cache runs from which no source is read any more and that are older than ``grace`` seconds; returns how many went.

        Runs that were never registered are left alone: they may be under way.
        """
        runs = self._table("manifest", _MANIFEST).select("run").distinct()
        unused = runs.join(self._valid().select("run").distinct(), "run", "left_anti")
        return sum(delete_older(self.spark, f"{self.root}/cache/run={row.run}", grace) for row in unused.toLocalIterator())


def read_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Shards written by ``write_shards``; a split is pruned by partition."""
    if split not in (None, "train", "val"):
        raise ValueError(f"a split is train or val, not {split!r}")
    shards = spark.read.schema(schemas.SHARDS).parquet(path)
    return shards if split is None else shards.where(F.col("split") == split)


__all__ = ["Corpus", "read_shards", "signatures"]
