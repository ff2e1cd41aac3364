"""Cleaning, composing and counting documents."""

from pyspark.sql import functions as F

from tokenloom.functions import names as nm
from tokenloom.functions import text as tx
from tokenloom.operators import ordering, reports
from tokenloom.plans import fixtures as fx
from tokenloom.plans.registered.registry import CHUNK, SQL_DOCS, docs, mark, query, sql_clean, sql_mark, sql_strip
from tokenloom.sources import readers, sinks
from tokenloom.operators.layout import text_chunks

_FORUM = fx.for_check(fx.FORUM)
_QA = fx.for_check(fx.QA)
_NEWS = fx.for_check(fx.NEWS)


def _one_column(name, sql, function):
    @query(name, sql)
    def run(spark, sf_dir):
        return fx.fixture(spark, sf_dir, fx.FORUM).select("doc_id", function(F.col("body")).alias("text"))

    return run


_one_column("fn_unicode_strip", f"SELECT doc_id, {sql_strip('body')} AS text FROM ({_FORUM})", tx.unicode_strip)
_one_column(
    "fn_newlines",
    rf"SELECT doc_id, regexp_replace(body, '\r\n?', chr(10), 'g') AS text FROM ({_FORUM})",
    tx.normalize_newlines,
)
_one_column(
    "fn_drop_blank_lines",
    f"""SELECT doc_id, array_to_string(list_filter(string_split(body, chr(10)),
        lambda l: {sql_strip('l')} <> ''), chr(10)) AS text FROM ({_FORUM})""",
    tx.drop_blank_lines,
)
_one_column("null_text_literal", f"SELECT doc_id, coalesce(body, 'None') AS text FROM ({_FORUM})", tx.null_as_literal)


@query("fn_url_encode", "SELECT doc_id, url_encode(text) AS encoded FROM documents")
def _(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.percent_encode(F.col("text")).alias("encoded"))


_STRIPPED_QA = f"""SELECT conv_id, turn, {sql_strip("coalesce(q, '')")} AS q, {sql_strip("coalesce(a, '')")} AS a
FROM ({_QA})"""


@query(
    "qa_compose",
    f"""SELECT conv_id, turn, '問：' || q || chr(10) || '答：' || a AS text
    FROM ({_STRIPPED_QA}) WHERE q <> '' AND a <> ''""",
)
def _(spark, sf_dir):
    q, a = (tx.unicode_strip(tx.empty_if_missing(F.col(c))) for c in ("q", "a"))
    pairs = fx.fixture(spark, sf_dir, fx.QA).select("conv_id", "turn", q.alias("q"), a.alias("a"))
    return pairs.where(tx.qa_is_complete(F.col("q"), F.col("a"))).select(
        "conv_id", "turn", tx.compose_qa(F.col("q"), F.col("a")).alias("text")
    )


_TITLED = f"""SELECT doc_id, CASE WHEN title IS NOT NULL AND title <> ''
  THEN {sql_strip('title')} || chr(10) || {sql_strip('body')} ELSE {sql_strip('body')} END AS text FROM ({_NEWS})"""


def _news(spark, sf_dir):
    return fx.fixture(spark, sf_dir, fx.NEWS).select(
        "doc_id", tx.title_and_body(F.col("title"), F.col("body")).alias("text")
    )


@query("title_body", _TITLED)
def _(spark, sf_dir):
    return _news(spark, sf_dir)


@query(
    "sink_articles",
    f"""SELECT count(*) AS articles, CAST(sum(length(text)) AS BIGINT) AS chars,
       CAST(sum(strlen(text) + 2) AS BIGINT) AS bytes, sum(strlen(text) + 2) / 1048576.0::DOUBLE AS mb FROM ({_TITLED})""",
)
def _(spark, sf_dir):
    # characters are counted before the separator is added, bytes after
    articles = _news(spark, sf_dir).withColumn("chars", F.length("text").cast("bigint"))
    return (
        sinks.as_blocks(articles)
        .agg(
            F.count("*").alias("articles"),
            F.sum("chars").alias("chars"),
            F.sum(F.octet_length("text").cast("bigint")).alias("bytes"),
        )
        .withColumn("mb", nm.megabytes(F.col("bytes")))
    )


@query(
    "sink_line_docs",
    f"""WITH {SQL_DOCS} SELECT source_no, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars,
    CAST(sum(strlen(text)) AS BIGINT) AS bytes, sum(strlen(text)) / 1048576.0::DOUBLE AS mb,
    CAST(sum({sql_mark('doc_ord', 'text')}) AS BIGINT) AS digest FROM docs GROUP BY source_no""",
)
def _(spark, sf_dir):
    source = nm.number_in(F.col("source"), r"^src([0-9]+)$")
    raw = fx.table(spark, sf_dir, "documents").select(source.alias("source_no"), "doc_id", "text")
    content = F.sum(mark("doc_id", "text")).alias("digest")
    return sinks.size_report(sinks.as_lines(readers.treat_nulls(raw, "drop")), "source_no", more=[content])


_CLEAN = f"""SELECT doc_id, {sql_clean(sql_strip('body'))} || chr(10) || chr(10) AS text FROM ({_FORUM})
WHERE body IS NOT NULL AND body <> '' AND body <> 'None' AND block_type = '文本'"""


@query("sink_clean_docs", _CLEAN)
def _(spark, sf_dir):
    blocks = fx.fixture(spark, sf_dir, fx.FORUM).where(tx.is_forum_text(F.col("body"), F.col("block_type")))
    return sinks.as_clean_blocks(blocks.select("doc_id", tx.unicode_strip(F.col("body")).alias("text")))


@query(
    "corpus_union",
    f"""SELECT kind, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
       sum(strlen(text)) / 1048576.0::DOUBLE AS mb, CAST(sum({sql_mark('text')}) AS BIGINT) AS digest
    FROM (SELECT 'web' AS kind, text || chr(10) AS text FROM documents
          UNION ALL SELECT 'news', text || chr(10) || chr(10) FROM ({_TITLED})
          UNION ALL SELECT 'forum', text FROM ({_CLEAN})
          UNION ALL SELECT 'qa', {sql_clean("'問：' || q || chr(10) || '答：' || a")} || chr(10) || chr(10)
                    FROM ({_STRIPPED_QA}) WHERE q <> '' AND a <> '') GROUP BY kind""",
)
def _(spark, sf_dir):
    q, a = (tx.unicode_strip(tx.empty_if_missing(F.col(c))) for c in ("q", "a"))
    pairs = fx.fixture(spark, sf_dir, fx.QA).select(q.alias("q"), a.alias("a"))
    qa = pairs.where(tx.qa_is_complete(F.col("q"), F.col("a"))).select(tx.compose_qa(F.col("q"), F.col("a")).alias("text"))
    blocks = fx.fixture(spark, sf_dir, fx.FORUM).where(tx.is_forum_text(F.col("body"), F.col("block_type")))
    parts = {
        "web": sinks.as_lines(fx.table(spark, sf_dir, "documents").select("text")),
        "news": sinks.as_blocks(_news(spark, sf_dir).select("text")),
        "forum": sinks.as_clean_blocks(blocks.select(tx.unicode_strip(F.col("body")).alias("text"))),
        "qa": sinks.as_clean_blocks(qa),
    }
    tagged = [part.select(F.lit(kind).alias("kind"), "text") for kind, part in parts.items()]
    union = tagged[0]
    for part in tagged[1:]:
        union = union.unionByName(part)
    return sinks.size_report(union, "kind", more=[F.sum(mark("text")).alias("digest")])


@query(
    "src_chunks",
    f"""WITH {SQL_DOCS}, chars AS (
      SELECT source_no, ch, row_number() OVER (PARTITION BY source_no ORDER BY doc_ord, i) - 1 AS pos
      FROM (SELECT source_no, doc_ord, unnest(string_split(text, '')) AS ch,
                   generate_subscripts(string_split(text, ''), 1) AS i FROM docs))
    SELECT source_no, CAST(pos // {CHUNK} AS BIGINT) AS chunk_no, count(*) AS chars,
           md5(string_agg(ch, '' ORDER BY pos)) AS digest FROM chars GROUP BY ALL""",
)
def _(spark, sf_dir):
    return text_chunks(docs(spark, sf_dir), CHUNK).select(
        "source_no", "chunk_no", F.length("chunk").cast("bigint").alias("chars"), F.md5("chunk").alias("digest")
    )


@query(
    "category_counts",
    """SELECT lang AS category, source AS file, CAST(grouping(lang, source) AS BIGINT) AS level, count(*) AS docs
    FROM documents GROUP BY ROLLUP (lang, source)""",
)
def _(spark, sf_dir):
    files = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.col("source").alias("file"))
    return reports.category_report(files)


@query(
    "corpus_size",
    """SELECT count(DISTINCT source) AS inputs, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
       sum(strlen(text)) / 1073741824.0::DOUBLE AS gb FROM documents""",
)
def _(spark, sf_dir):
    per_source = fx.table(spark, sf_dir, "documents").groupBy("source").agg(
        F.sum(F.octet_length("text").cast("bigint")).alias("bytes")
    )
    return per_source.agg(F.count("*").alias("inputs"), F.sum("bytes").alias("bytes")).withColumn(
        "gb", F.col("bytes").cast("double") / 1073741824.0
    )


@query(
    "progress_samples",
    f"""WITH {SQL_DOCS}, run AS (
      SELECT source_no, doc_ord, row_number() OVER (ORDER BY source_no, doc_ord) AS ordinal,
             CAST(sum(length(text)) OVER (ORDER BY source_no, doc_ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars_so_far
      FROM docs)
    SELECT * FROM run WHERE ordinal % 100 = 0""",
)
def _(spark, sf_dir):
    sized = docs(spark, sf_dir).select("source_no", "doc_ord", F.length("text").cast("bigint").alias("chars"))
    return ordering.every_nth(sized, 100, {"chars": "chars_so_far"}, "doc_ord", ["source_no"]).select(
        "source_no", "doc_ord", "ordinal", "chars_so_far"
    )
