"""Scans of files, catalogs, manifests and numbering."""

from pyspark.sql import functions as F

from tokenloom.functions import names as nm
from tokenloom.functions import text as tx
from tokenloom.operators.ordering import ordinals
from tokenloom.operators.reports import category_sizes
from tokenloom.operators.runlog import latest_cursor, latest_named
from tokenloom.operators import tokenizers as tk
from tokenloom.plans import fixtures as fx
from tokenloom.plans.corpus import Corpus
from tokenloom.plans.cursors import Cursors
from tokenloom.plans.registered.registry import CACHED_BELOW, SQL_DOCS, docs, mark, query, sql_mark, sql_strip
from tokenloom.session import scratch_dir
from tokenloom.sources import catalog as cat
from tokenloom.sources import readers, sinks

_FORUM = fx.for_check(fx.FORUM)
_QA = fx.for_check(fx.QA)
_CATALOG = fx.for_check(fx.CATALOG)
_STRIPPED_QA = f"""SELECT {sql_strip("coalesce(q, '')")} AS q, {sql_strip("coalesce(a, '')")} AS a FROM ({_QA})"""

CATEGORIES = (
    cat.Category("qa_site", "qa/site/", ".jsonl.gz"),
    cat.Category("qa_assistant", "qa/assistant/", ".jsonl.gz"),
    cat.Category("forum", "forum/blocks/", ".parquet", first=10),
)
_TAGGED = f"""SELECT path, CASE WHEN path LIKE 'qa/site/%.jsonl.gz' THEN 'qa_site'
    WHEN path LIKE 'qa/assistant/%.jsonl.gz' THEN 'qa_assistant'
    WHEN path LIKE 'forum/blocks/%.parquet' THEN 'forum' END AS category FROM ({_CATALOG})"""
_CHOSEN = f"""SELECT path, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY path) AS rn
    FROM ({_TAGGED}) WHERE category IS NOT NULL) WHERE category <> 'forum' OR rn <= 10"""


def _catalog(spark, sf_dir):
    return fx.fixture(spark, sf_dir, fx.CATALOG).select("path")


def _source_files(spark, path):
    """Catalog of a tree written by ``write_source_text``: the part number is the file order."""
    return cat.list_files(spark, path, "*.txt").select(
        "path",
        nm.number_in(F.col("path"), r"source_no=([0-9]+)/").alias("source_no"),
        nm.number_in(F.col("name"), r"^part-([0-9]+)").alias("file_ord"),
    )


@query(
    "src_discover",
    """SELECT DISTINCT replace(source, 'src', 'input') || '.txt' AS name,
       CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS source_no FROM documents""",
)
def _(spark, sf_dir):
    good = F.concat(F.replace("source", F.lit("src"), F.lit("input")), F.lit(".txt"))
    listing = fx.table(spark, sf_dir, "documents").select("source").distinct().select(
        F.explode(F.array(good, F.concat(good, F.lit(".tmp")), F.concat(F.lit("x"), good))).alias("name")
    )
    return cat.numbered(listing).select("name", "source_no").orderBy("source_no")


@query(
    "src_text_scan",
    f"""WITH {SQL_DOCS}, lines AS (
      SELECT source_no, doc_ord, unnest(string_split(text[:-2], chr(10))) AS line,
             generate_subscripts(string_split(text[:-2], chr(10)), 1) AS i FROM docs),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY doc_ord, i) AS ordinal FROM lines)
    SELECT source_no, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars,
           CAST(sum(ordinal * length(line)) AS BIGINT) AS weighted FROM numbered GROUP BY source_no""",
)
def _(spark, sf_dir):
    path = scratch_dir(spark, "text")
    sinks.write_source_text(docs(spark, sf_dir), path)
    lines = readers.documents_by_line(spark, path)
    placed = readers.place(lines, _source_files(spark, path))
    sized = placed.select("source_no", "doc_ord", (F.length("text") - 1).cast("bigint").alias("chars"))
    counted = ordinals(sized, "doc_ord", "ordinal", restart=["source_no"])
    return counted.groupBy("source_no").agg(
        F.count("*").alias("lines"),
        F.sum("chars").alias("chars"),
        F.sum(F.col("ordinal") * F.col("chars")).alias("weighted"),
    )


@query(
    "scan_books",
    f"""WITH {SQL_DOCS}, cut AS (SELECT source_no, doc_ord, string_split(text, chr(10)) AS parts FROM docs),
    line AS (SELECT source_no, doc_ord, unnest(range(1, len(parts))) AS i, unnest(parts[1:len(parts) - 1]) || chr(10) AS text FROM cut),
    numbered AS (SELECT source_no, text, row_number() OVER (PARTITION BY source_no ORDER BY doc_ord, i) AS line_no FROM line)
    SELECT source_no, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
           CAST(sum({sql_mark('line_no', 'text')}) AS BIGINT) AS digest FROM numbered GROUP BY source_no""",
)
def _(spark, sf_dir):
    path = scratch_dir(spark, "books")
    sinks.write_source_text(docs(spark, sf_dir), path)
    good, _ = readers.book_lines(spark, path)
    lines = good.select(
        nm.number_in(F.col("path"), r"source_no=([0-9]+)/").alias("source_no"),
        nm.number_in(F.col("path"), r"part-([0-9]+)").alias("file_no"),
        "row_in_file",
        "text",
    )
    lines = ordinals(lines, "row_in_file", "line_no", ["file_no"], ["source_no"])
    return lines.groupBy("source_no").agg(
        F.count("*").alias("lines"),
        F.sum(F.length("text").cast("bigint")).alias("chars"),
        F.sum(F.octet_length("text").cast("bigint")).alias("bytes"),
        F.sum(mark("line_no", "text")).alias("digest"),
    )


@query("scan_qa_json", _STRIPPED_QA)
def _(spark, sf_dir):
    path = scratch_dir(spark, "qa")
    raw = fx.fixture(spark, sf_dir, fx.QA).select(F.col("q").alias("问"), F.col("a").alias("答"))
    raw.write.option("compression", "gzip").json(path)
    return readers.qa_records(spark, path)[0].select("q", "a")


@query(
    "scan_forum",
    f"""SELECT {sql_strip('body')} AS text FROM ({_FORUM})
    WHERE body IS NOT NULL AND body <> '' AND body <> 'None' AND block_type = '文本'""",
)
def _(spark, sf_dir):
    path = scratch_dir(spark, "forum")
    fx.fixture(spark, sf_dir, fx.FORUM).select(F.col("body").alias("文本"), F.col("block_type").alias("块类型")).write.parquet(path)
    return readers.forum_blocks(spark, path).select("text")


@query("scan_web_docs", "SELECT md5(text) AS digest, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL")
def _(spark, sf_dir):
    web = readers.text_column(spark, f"{sf_dir}/documents.parquet")
    return web.select(F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("chars"))


@query(
    "scan_articles",
    f"SELECT md5(coalesce(body, '')) AS digest, CAST(length(coalesce(body, '')) AS BIGINT) AS chars FROM ({_FORUM})",
)
def _(spark, sf_dir):
    path = scratch_dir(spark, "articles")
    fx.fixture(spark, sf_dir, fx.FORUM).select(F.col("body").alias("text")).write.parquet(path)
    articles = readers.text_column(spark, path, nulls="empty")
    return articles.select(F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("chars"))


@query(
    "strict_file_drop",
    f"""WITH r AS (SELECT 'file' || CAST(conv_id % 50 AS VARCHAR) AS path, q, a, conv_id % 97 = 0 AS broken FROM ({_QA}))
    SELECT path, {sql_strip('q')} AS q, {sql_strip('a')} AS a FROM r
    WHERE path NOT IN (SELECT path FROM r WHERE broken OR q IS NULL OR a IS NULL)""",
)
def _(spark, sf_dir):
    record = F.to_json(F.struct(F.col("q").alias("问"), F.col("a").alias("答")), {"ignoreNullFields": "false"})
    lines = fx.fixture(spark, sf_dir, fx.QA).select(
        F.concat(F.lit("file"), (F.col("conv_id") % 50).cast("string")).alias("path"),
        F.col("turn").alias("row_in_file"),
        F.when(F.col("conv_id") % 97 == 0, F.lit("{broken")).otherwise(record).alias("line"),
    )
    return readers.strict_records(lines)[0].select("path", "q", "a")


@query(
    "catalog_filter",
    f"""SELECT path, category, substring(string_split(path, '/')[-1], 1, 50) AS base,
    replace(path, '/', '_') AS flat FROM ({_CHOSEN})""",
)
def _(spark, sf_dir):
    chosen = cat.categorize(_catalog(spark, sf_dir), CATEGORIES)
    path = F.col("path")
    return chosen.select("path", "category", nm.base_name(path, 50).alias("base"), nm.flat_path(path).alias("flat")).orderBy("path")


@query("catalog_slice", f"SELECT path FROM ({_CATALOG}) ORDER BY path LIMIT 7 OFFSET 5")
def _(spark, sf_dir):
    return cat.slice_of(_catalog(spark, sf_dir), 5, 7)


@query(
    "category_select",
    f"""SELECT category, count(*) AS files, count(*) * 1.5::DOUBLE AS estimated_gb FROM ({_CHOSEN})
    WHERE category IN ('forum', 'qa_assistant') GROUP BY category""",
)
def _(spark, sf_dir):
    chosen = cat.choose(CATEGORIES, ["forum", "qa_assistant"])
    return category_sizes(cat.categorize(_catalog(spark, sf_dir), chosen), 1.5)


def _sources(spark, sf_dir):
    number = nm.number_in(F.col("source"), r"^src([0-9]+)$")
    return fx.table(spark, sf_dir, "documents").select(number.alias("source_no")).distinct()


_SOURCES = "SELECT DISTINCT CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS source_no FROM documents"


def _cached(spark, sf_dir):
    """A corpus that holds some of the sources."""
    corpus = Corpus(spark, scratch_dir(spark, "cached"), tk.codepoint())
    corpus.add(docs(spark, sf_dir).where(F.col("source_no") < CACHED_BELOW))
    return corpus


@query("new_sources_anti", f"SELECT source_no FROM ({_SOURCES}) WHERE source_no >= {CACHED_BELOW}")
def _(spark, sf_dir):
    """Sources that the manifest of a corpus does not know."""
    return cat.unseen(_sources(spark, sf_dir), _cached(spark, sf_dir).manifest(), ["source_no"])


@query(
    "cached_sources_semi",
    f"""WITH {SQL_DOCS} SELECT source_no, count(*) AS docs FROM docs WHERE source_no < {CACHED_BELOW} GROUP BY source_no""",
)
def _(spark, sf_dir):
    per_source = docs(spark, sf_dir).groupBy("source_no").agg(F.count("*").alias("docs"))
    return cat.seen(per_source, _cached(spark, sf_dir).manifest(), ["source_no"])


@query(
    "next_source_no",
    f"""SELECT path, CAST((SELECT max(source_no) FROM ({_SOURCES})) + row_number() OVER (ORDER BY path) AS INT) AS source_no
    FROM ({_CATALOG})""",
)
def _(spark, sf_dir):
    return cat.allot_numbers(_catalog(spark, sf_dir), _sources(spark, sf_dir)).select("path", "source_no")


@query(
    "cursor_latest",
    f"SELECT step, data_shard, CAST(data_position AS BIGINT) AS data_position FROM ({fx.for_check(fx.CURSOR)}) ORDER BY step DESC LIMIT 1",
)
def _(spark, sf_dir):
    return latest_cursor(fx.fixture(spark, sf_dir, fx.CURSOR))


@query(
    "cursor_saved",
    f"SELECT step, data_shard, CAST(data_position AS BIGINT) AS data_position FROM ({fx.for_check(fx.CURSOR)}) ORDER BY step DESC LIMIT 1",
)
def _(spark, sf_dir):
    """The latest position, saved after an older one and beside another version's, and read back."""
    at = latest_cursor(fx.fixture(spark, sf_dir, fx.CURSOR)).first()
    saved = Cursors(spark, scratch_dir(spark, "cursors"))
    saved.save("one", at.step - 1, 0, 0)
    saved.save("one", at.step, at.data_shard, at.data_position)
    saved.save("two", at.step + 1, 0, 0)
    return latest_cursor(saved.all().where(F.col("version") == "one")).select("step", "data_shard", "data_position")


@query(
    "ckpt_latest_by_name",
    f"""SELECT path, CAST(regexp_extract(path, 'step_([0-9]+)', 1) AS BIGINT) AS step FROM ({fx.for_check(fx.CHECKPOINT_PATHS)})
    WHERE path LIKE '%step\\_%' ESCAPE '\\' ORDER BY step DESC LIMIT 1""",
)
def _(spark, sf_dir):
    return latest_named(fx.fixture(spark, sf_dir, fx.CHECKPOINT_PATHS), nm.CHECKPOINT_PATTERN)
