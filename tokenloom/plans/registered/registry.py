"""Registration, parameters and the SQL blocks shared by several checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.batches import BatchShape
from tokenloom.plans import fixtures as fx
from tokenloom.session import with_defaults

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

# Parameters: small enough for many shards, batches and steps at test scale.
SHARD = 50_000
RATIO = 0.01
CHUNK = 10_000
SHAPE = BatchShape(4, 64)
BT = SHAPE.tokens
STEP_BATCHES = SHAPE.per_step(2048)
CACHED_BELOW = 10


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its checking SQL."""

    def add(run: Query) -> Query:
        @wraps(run)
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(with_defaults(spark), sf_dir.rstrip("/"))

        QUERIES[name] = prepared
        if check is not None:
            CHECKS[name] = check
        return prepared

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.fixture(spark, sf_dir, fx.DOCS)


def digest(tokens: Column | str) -> Column:
    """Order-sensitive digest of an id array, the same as the check computes."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.md5(F.array_join(c.cast("array<string>"), ","))


def mark(*parts: Column | str) -> Column:
    """A number that stands for a row's content; sums of it notice a changed, swapped or lost row without ordering rows."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def sql_mark(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT)"


# The white-space characters, written for the check's regular expressions.
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(expr: str) -> str:
    return rf"regexp_replace(regexp_replace({expr}, '\A{_WS}+', ''), '{_WS}+\z', '')"


def sql_clean(expr: str) -> str:
    lines = f"string_split(replace(replace({expr}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
    return f"array_to_string(list_filter({lines}, lambda l: {sql_strip('l')} <> ''), chr(10))"


SQL_DOCS = f"docs AS ({fx.for_check(fx.DOCS)})"

#: Spans of documents and of the end-of-text row of each source.
SQL_SPANS = f"""
{SQL_DOCS},
rows_ AS (
  SELECT source_no, doc_ord, CAST(length(text) AS BIGINT) AS n, false AS is_end FROM docs
  UNION ALL
  SELECT source_no, max(doc_ord) + 1, 1, true FROM docs GROUP BY source_no),
spans AS (
  SELECT *, CAST(sum(n) OVER (ORDER BY source_no, doc_ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g_end FROM rows_),
tot AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(floor(sum(n) * 0.01::DOUBLE) AS BIGINT) AS cut FROM rows_)
"""

#: One row per token with its split, shard and place in the shard.
SQL_TOKENS = f"""
{SQL_SPANS},
chars AS (
  SELECT source_no, doc_ord, unnest(string_split(text, '')) AS ch,
         generate_subscripts(string_split(text, ''), 1) AS i FROM docs),
stream AS (
  SELECT source_no, doc_ord, tok, row_number() OVER (ORDER BY source_no, doc_ord, i) - 1 AS pos
  FROM (SELECT source_no, doc_ord, i, unicode(ch) AS tok FROM chars
        UNION ALL SELECT source_no, doc_ord, 1, 1114112 FROM rows_ WHERE is_end)),
split_tok AS (
  SELECT source_no, doc_ord, tok, CASE WHEN pos < cut THEN 'val' ELSE 'train' END AS split,
         CASE WHEN pos < cut THEN pos ELSE pos - cut END AS sp
  FROM stream, tot),
shard_tok AS (
  SELECT split, CAST(sp // {SHARD} AS BIGINT) AS shard, CAST(sp % {SHARD} AS BIGINT) AS slot, tok, source_no, doc_ord
  FROM split_tok)
"""

#: Shard sizes and batch numbers without tokens.
SQL_SHARDS = f"""
{SQL_SPANS},
sides AS (SELECT 'val' AS split, cut AS size FROM tot UNION ALL SELECT 'train', total - cut FROM tot),
shards AS (
  SELECT split, CAST(s AS BIGINT) AS shard, CAST(least({SHARD}, size - s * {SHARD}) AS BIGINT) AS n_tokens
  FROM (SELECT split, size, unnest(range(CAST(ceil(size / {SHARD}.0) AS BIGINT))) AS s FROM sides)),
counts AS (
  SELECT split, shard, n_tokens, CAST(greatest((n_tokens - 1) // {BT}, 0) AS BIGINT) AS batches FROM shards),
batches AS (
  SELECT split, shard, CAST(b AS BIGINT) AS batch_in_shard,
         row_number() OVER (PARTITION BY split ORDER BY shard, b) - 1 AS global_batch
  FROM (SELECT split, shard, unnest(range(batches)) AS b FROM counts))
"""
