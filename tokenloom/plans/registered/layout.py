"""Tokenizing, offsets, splits, shards, caching, publishing and streaming."""

from pyspark.sql import functions as F

from tokenloom.functions import names as nm
from tokenloom.operators import layout as lay
from tokenloom.operators import reports, shards as sh
from tokenloom.operators import tokenizers as tk
from tokenloom.operators.decoding import decode
from tokenloom.plans import fixtures as fx
from tokenloom.plans.corpus import Corpus, read_shards
from tokenloom.plans.registered.registry import (
    CACHED_BELOW,
    RATIO,
    SHARD,
    SQL_DOCS,
    SQL_SHARDS,
    SQL_SPANS,
    SQL_TOKENS,
    digest,
    docs,
    mark,
    query,
    sql_mark,
)
from tokenloom.session import TARGET_BYTES, estimated_bytes, scratch_dir, spread
from tokenloom.streaming import ingest

CODEPOINT = tk.codepoint()


def _rank_tokenizer():
    """The public rank file; where its package is missing the query fails and says so."""
    import public_tokenizers

    return tk.rank_file_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def _rows(spark, sf_dir, eos="source"):
    return lay.token_rows(docs(spark, sf_dir), CODEPOINT, eos)[0]


def _spans(spark, sf_dir):
    """Thin spans: offsets need no tokens and no text."""
    return lay.global_offsets(lay.thin_rows(docs(spark, sf_dir), CODEPOINT))


def _encoded(spark, sf_dir, tokenizer):
    return lay.tokenize(docs(spark, sf_dir), tokenizer).select("source_no", "doc_ord", "n", digest("tokens").alias("digest"))


@query(
    "tokenize_codepoint",
    f"""WITH {SQL_DOCS} SELECT source_no, doc_ord, CAST(length(text) AS BIGINT) AS n,
    md5(array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c)), ',')) AS digest FROM docs""",
)
def _(spark, sf_dir):
    return _encoded(spark, sf_dir, CODEPOINT)


@query(
    "tokenize_bytes",
    f"""WITH {SQL_DOCS}, h AS (SELECT source_no, doc_ord, hex(encode(text)) AS h, strlen(text) AS n FROM docs),
    b AS (SELECT source_no, doc_ord, n, unnest(range(n)) AS i, h FROM h)
    SELECT source_no, doc_ord, CAST(n AS BIGINT) AS n,
           md5(string_agg(CAST(CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS INT) AS VARCHAR), ',' ORDER BY i)) AS digest
    FROM b GROUP BY source_no, doc_ord, n""",
)
def _(spark, sf_dir):
    return _encoded(spark, sf_dir, tk.utf8_bytes())


@query("decode_roundtrip", f"WITH {SQL_DOCS} SELECT source_no, doc_ord, md5(text || '<|endoftext|>') AS digest FROM docs")
def _(spark, sf_dir):
    rows = lay.tokenize(docs(spark, sf_dir), CODEPOINT)
    ended = rows.withColumn("tokens", F.concat("tokens", F.array(F.lit(CODEPOINT.eos_id))))
    return decode(ended, CODEPOINT).select("source_no", "doc_ord", F.md5("text").alias("digest"))


@query("tokenize_bpe")
def _(spark, sf_dir):
    return _encoded(spark, sf_dir, _rank_tokenizer())


@query("decode_bpe", f"WITH {SQL_DOCS} SELECT source_no, doc_ord, md5(text) AS digest FROM docs")
def _(spark, sf_dir):
    tokenizer = _rank_tokenizer()
    rows = lay.tokenize(docs(spark, sf_dir), tokenizer)
    return decode(rows, tokenizer).select("source_no", "doc_ord", F.md5("text").alias("digest"))


@query(
    "vocab_range_check",
    f"""WITH {SQL_TOKENS} SELECT source_no, count(*) AS n_tokens,
    count(*) FILTER (WHERE tok < 0 OR tok >= 151680) AS n_outside, CAST(max(tok) AS BIGINT) AS max_id,
    CAST(ceil(151643 / 128.0) * 128 AS BIGINT) AS vocab_size FROM stream GROUP BY source_no""",
)
def _(spark, sf_dir):
    rows, tokens = lay.token_rows(docs(spark, sf_dir), CODEPOINT)
    checked = reports.vocab_check(rows.select("source_no", tokens.alias("tokens")), 151_680)
    return checked.withColumn("vocab_size", nm.padded_size(151_643))


@query(
    "eos_per_source",
    f"WITH {SQL_SPANS} SELECT source_no, doc_ord, CAST(g_end - n AS BIGINT) AS g_start, g_end FROM spans WHERE is_end",
)
def _(spark, sf_dir):
    return _spans(spark, sf_dir).rows.where("is_end").select("source_no", "doc_ord", "g_start", "g_end")


@query(
    "eos_per_doc",
    f"""WITH {SQL_DOCS}, r AS (SELECT source_no, doc_ord, length(text) + 1 AS n FROM docs)
    SELECT source_no, doc_ord, CAST(n AS BIGINT) AS n,
    CAST(sum(n) OVER (ORDER BY source_no, doc_ord ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS g_start FROM r""",
)
def _(spark, sf_dir):
    rows = lay.thin_rows(docs(spark, sf_dir), CODEPOINT, eos="document").select("source_no", "doc_ord", "n")
    return lay.global_offsets(rows).rows.select("source_no", "doc_ord", "n", "g_start")


@query(
    "global_offsets",
    f"WITH {SQL_SPANS} SELECT source_no, doc_ord, n, CAST(g_end - n AS BIGINT) AS g_start, g_end FROM spans",
)
def _(spark, sf_dir):
    return _spans(spark, sf_dir).rows.select("source_no", "doc_ord", "n", "g_start", "g_end")


@query(
    "token_totals",
    f"""WITH {SQL_SPANS} SELECT total AS total_tokens, total - cut AS train_tokens, cut AS val_tokens,
    CAST(ceil((total - cut) / {SHARD}.0) AS BIGINT) AS train_shards, CAST(ceil(cut / {SHARD}.0) AS BIGINT) AS val_shards FROM tot""",
)
def _(spark, sf_dir):
    return reports.token_totals(_rows(spark, sf_dir), RATIO, SHARD)


@query(
    "cache_counts",
    f"WITH {SQL_SPANS} SELECT source_no, count(*) AS docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM spans GROUP BY source_no",
)
def _(spark, sf_dir):
    """From the manifest of a cache that was written and read back."""
    corpus = Corpus(spark, scratch_dir(spark, "cache"), CODEPOINT)
    corpus.add(docs(spark, sf_dir))
    return corpus.manifest().select("source_no", "docs", "n_tokens")


@query(
    "source_stats",
    f"""WITH {SQL_SPANS}, sizes AS (SELECT source_no, count(*) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes
      FROM docs GROUP BY source_no)
    SELECT source_no, docs, bytes, n_tokens, bytes / 1048576.0::DOUBLE AS mb, n_tokens / (docs * 0.5::DOUBLE) AS tokens_per_sec
    FROM sizes JOIN (SELECT source_no, CAST(sum(n) AS BIGINT) AS n_tokens FROM spans GROUP BY source_no) USING (source_no)""",
)
def _(spark, sf_dir):
    sizes = docs(spark, sf_dir).groupBy("source_no").agg(
        F.count("*").alias("docs"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes")
    )
    counts = reports.source_counts(_rows(spark, sf_dir)).drop("docs")
    # no clock in the tables: half a second per document stands in for the measured time
    return reports.source_report(sizes, counts, F.col("docs").cast("double") * 0.5)


_SPLIT = """clipped AS (
  SELECT source_no, doc_ord, split, greatest(g_end - n, lo) - lo AS s_start, least(g_end, hi) - lo AS s_end,
         greatest(g_end - n, lo) - (g_end - n) AS skip
  FROM spans, (SELECT 'val' AS split, 0 AS lo, cut AS hi FROM tot UNION ALL SELECT 'train', cut, total FROM tot)
  WHERE greatest(g_end - n, lo) < least(g_end, hi))"""


def _split(spark, sf_dir):
    sums = _spans(spark, sf_dir)
    return lay.split_spans(sums.rows, sums.total("n"), RATIO)


@query("split_spans", f"WITH {SQL_SPANS}, {_SPLIT} SELECT source_no, doc_ord, split, s_start, s_end, skip FROM clipped")
def _(spark, sf_dir):
    return _split(spark, sf_dir).select("source_no", "doc_ord", "split", "s_start", "s_end", "skip")


@query(
    "split_report",
    f"""WITH {SQL_SPANS}, {_SPLIT} SELECT split, source_no, count(*) AS docs,
    CAST(sum(s_end - s_start) AS BIGINT) AS n_tokens FROM clipped GROUP BY split, source_no""",
)
def _(spark, sf_dir):
    return reports.split_mix(_split(spark, sf_dir))


@query(
    "shard_overlap",
    f"""WITH {SQL_SHARDS},
    src AS (SELECT source_no, min(g_end - n) AS lo, max(g_end) AS hi FROM spans GROUP BY source_no),
    placed AS (SELECT split, shard, n_tokens, shard * {SHARD} + CASE WHEN split = 'val' THEN 0 ELSE cut END AS s_at FROM shards, tot)
    SELECT source_no, split, shard, CAST(greatest(lo, s_at) - s_at AS BIGINT) AS p_start,
           CAST(least(hi, s_at + n_tokens) - s_at AS BIGINT) AS p_end, CAST(greatest(lo, s_at) - lo AS BIGINT) AS skip
    FROM src JOIN placed ON greatest(lo, s_at) < least(hi, s_at + n_tokens)""",
)
def _(spark, sf_dir):
    counts = reports.source_counts(_rows(spark, sf_dir)).select("source_no", "n_tokens")
    spans = reports.source_bases(counts).select(
        "source_no",
        F.col("n_tokens").alias("n"),
        F.col("source_start").alias("g_start"),
        (F.col("source_start") + F.col("n_tokens")).alias("g_end"),
    )
    plan = lay.SplitPlan.over(counts.agg(F.sum("n_tokens")).scalar(), RATIO, SHARD)
    return sh.shard_overlaps(spans, plan).select("source_no", "split", "shard", "p_start", "p_end", "skip")


def shard_list(spark, sf_dir):
    """Shard sizes by arithmetic on the total."""
    totals = reports.token_totals(_rows(spark, sf_dir), RATIO, SHARD).first()
    sides = [
        spark.range(count).select(
            F.lit(split).alias("split"),
            F.col("id").alias("shard"),
            F.least(F.lit(SHARD).cast("bigint"), F.lit(tokens).cast("bigint") - F.col("id") * SHARD).alias("n_tokens"),
        )
        for split, tokens, count in (("val", totals.val_tokens, totals.val_shards), ("train", totals.train_tokens, totals.train_shards))
    ]
    return sides[0].unionByName(sides[1])


@query("shard_plan", f"WITH {SQL_SHARDS} SELECT split, shard, n_tokens FROM shards")
def _(spark, sf_dir):
    return shard_list(spark, sf_dir)


@query(
    "shard_names",
    f"WITH {SQL_SHARDS} SELECT split, shard, n_tokens, format('{{}}_{{:04d}}.npy', split, shard) AS shard_name FROM shards",
)
def _(spark, sf_dir):
    return sh.named(shard_list(spark, sf_dir))


_SHARDS_CHECK = f"""WITH {SQL_TOKENS} SELECT split, shard, count(*) AS n_tokens,
    md5(string_agg(CAST(tok AS VARCHAR), ',' ORDER BY slot)) AS digest FROM shard_tok"""


def _digested(shards):
    return shards.select("split", "shard", "n_tokens", digest("tokens").alias("digest"))


def built_shards(spark, sf_dir, **head):
    return sh.build_shards(docs(spark, sf_dir), CODEPOINT, SHARD, RATIO, **head)


@query("shard_build", _SHARDS_CHECK + " GROUP BY split, shard")
def _(spark, sf_dir):
    return _digested(built_shards(spark, sf_dir))


@query("shard_scan", _SHARDS_CHECK + " WHERE split = 'val' GROUP BY split, shard")
def _(spark, sf_dir):
    path = scratch_dir(spark, "shards")
    sh.write_shards(built_shards(spark, sf_dir), path)
    return _digested(read_shards(spark, path, "val"))


@query("incremental_equals_full", _SHARDS_CHECK + " GROUP BY split, shard")
def _(spark, sf_dir):
    corpus = Corpus(spark, scratch_dir(spark, "incremental"), CODEPOINT)
    everything = docs(spark, sf_dir)
    corpus.add(everything.where(F.col("source_no") >= CACHED_BELOW))
    corpus.add(everything)
    return _digested(corpus.shards(SHARD, RATIO))


@query("force_rebuild", _SHARDS_CHECK + " GROUP BY split, shard")
def _(spark, sf_dir):
    """Cached text that has changed since is replaced by force, and only then."""
    corpus = Corpus(spark, scratch_dir(spark, "forced"), CODEPOINT)
    everything = docs(spark, sf_dir)
    corpus.add(everything.withColumn("text", F.concat("text", F.lit("stale"))))
    corpus.add(everything)
    corpus.add(everything, force=True)
    return _digested(corpus.shards(SHARD, RATIO))


@query("publish_current", _SHARDS_CHECK + " GROUP BY split, shard")
def _(spark, sf_dir):
    corpus = Corpus(spark, scratch_dir(spark, "published"), CODEPOINT)
    everything = docs(spark, sf_dir)
    corpus.add(everything.where(F.col("source_no") < CACHED_BELOW))
    corpus.publish(SHARD, RATIO)
    corpus.add(everything)
    corpus.publish(SHARD, RATIO)
    corpus.expire()
    return _digested(corpus.current())


_LANDED = f"""WITH {SQL_DOCS}, t AS (
      SELECT *, array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c)), ',') AS tokens FROM docs)
    SELECT source_no, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS n_tokens,
           CAST(sum({sql_mark('doc_ord', 'tokens')}) AS BIGINT) AS digest FROM t GROUP BY source_no"""


def _landed(spark, sf_dir, states):
    """Land the documents once for each name in ``states``; a name that comes again goes on where it was."""
    root = scratch_dir(spark, "stream")
    arrived = f"{root}/arrived"
    spread(fx.table(spark, sf_dir, "documents").select("doc_id", "source", "text")).write.parquet(arrived)

    def to_docs(df):
        return df.select(
            nm.number_in(F.col("source"), r"^src([0-9]+)$").alias("source_no"),
            F.col("doc_id").alias("doc_ord"),
            F.concat("text", F.lit("\n")).alias("text"),
        )

    for i, state in enumerate(states):
        stream = ingest.file_stream(spark, arrived, spark.read.parquet(arrived).schema)
        # another state numbers its batches anew, so they land beside the first ones
        landing = f"{root}/landing" if state == states[0] else f"{root}/landing-{i}"
        ingest.land_tokens(stream, to_docs, CODEPOINT, landing, f"{root}/{state}").awaitTermination()
    content = F.sum(mark("doc_ord", F.array_join(F.col("tokens").cast("array<string>"), ","))).alias("digest")
    return root, content


@query("stream_ingest", _LANDED)
def _(spark, sf_dir):
    root, content = _landed(spark, sf_dir, ["state"])
    return ingest.landed_counts(ingest.landed(spark, f"{root}/landing"), content)


@query("stream_replay", _LANDED)
def _(spark, sf_dir):
    """The same files twice with one state and once more with a new one: every document counts once."""
    root, content = _landed(spark, sf_dir, ["state", "state", "lost"])
    return ingest.landed_counts(ingest.landed(spark, f"{root}/landing*/*"), content)


def deliver(everything, arrived):
    """Write the documents as files that each hold some of every source, four of them or as many as keep a file small; returns the number."""
    files = max(4, -(-int((estimated_bytes(everything) or 0) * lay.TEXT_GROWTH) // TARGET_BYTES))
    everything.repartition(files, "doc_ord").write.parquet(arrived)
    return files


@query("stream_into_corpus", _SHARDS_CHECK + " GROUP BY split, shard")
def _(spark, sf_dir):
    """Sources that grow with every micro-batch, files read again by one state, and all of them once more by a new one."""
    root = scratch_dir(spark, "stream-corpus")
    arrived = f"{root}/arrived"
    files = deliver(docs(spark, sf_dir), arrived)
    corpus = Corpus(spark, f"{root}/corpus", CODEPOINT)
    for state in ("state", "state", "lost"):
        stream = ingest.file_stream(spark, arrived, spark.read.parquet(arrived).schema, files_per_batch=-(-files // 2))
        ingest.land_in_corpus(stream, lambda df: df, corpus, f"{root}/{state}").awaitTermination()
    return _digested(corpus.shards(SHARD, RATIO))


__all__ = ["built_shards", "deliver", "shard_list"]
