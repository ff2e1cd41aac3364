"""Typed readers.  Each yields ``(path, row_in_file, ...)`` so that file order is never lost.

Text and JSON lines get ``row_in_file`` = twice the byte offset of the file split + line number in the
task: a split of n bytes has n + 1 lines at most, so this rises along the file without any shuffle and never
repeats.  Parquet carries its own row index.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom import schemas
from tokenloom.functions import text as tx
from tokenloom.session import join_thin, shared_root

#: Up to this many files the file order is broadcast to the scan, past it it is joined.
MAX_BROADCAST_FILES = 200_000

#: Rows of one file get an order below this, fewer where a source has very many files; the file's own order goes above.  Both are checked.
FILE_BITS = 40


@dataclass(frozen=True)
class Files:
    """Files below a folder, found by the scan itself: however many there are, no list of them passes through the driver.

    ``first`` and ``last`` bound the paths, as ``_metadata.file_path`` writes them, and ``since`` (microseconds) the time of change; ``excluded`` names a few that
    are passed over.  Spark applies all of them to its listing, so files outside are never opened.
    """

    folder: str
    name: str = "*"
    first: str | None = None
    last: str | None = None
    since: int | None = None
    excluded: tuple[str, ...] = ()

    def without(self, path: str) -> Files:
        return replace(self, excluded=(*self.excluded, path))

    def load(self, spark: SparkSession, kind: str, schema: T.StructType | None = None) -> DataFrame:
        reader = spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", self.name)
        rows = (reader if schema is None else reader.schema(schema)).load(self.folder)
        path, changed = F.col("_metadata.file_path"), F.col("_metadata.file_modification_time")
        bounds = [
            None if self.first is None else path >= F.lit(self.first),
            None if self.last is None else path <= F.lit(self.last),
            None if self.since is None else changed >= F.timestamp_micros(F.lit(self.since)),
            ~path.isin(*self.excluded) if self.excluded else None,
        ]
        for bound in bounds:
            rows = rows if bound is None else rows.where(bound)
        return rows


Paths = str | Sequence[str] | Files


def _load(spark: SparkSession, paths: Paths, kind: str, schema: T.StructType | None = None) -> DataFrame:
    if isinstance(paths, Files):
        return paths.load(spark, kind, schema)
    reader = spark.read.format(kind)
    return (reader if schema is None else reader.schema(schema)).load([paths] if isinstance(paths, str) else list(paths))


def _line_order() -> Column:
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return 2 * F.col("_metadata.file_block_start") + in_task


def _path() -> Column:
    return F.col("_metadata.file_path").alias("path")


def text_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """Lines of UTF-8 text, split at LF, CR and CR LF; compression by file extension."""
    return _load(spark, paths, "text").select(_path(), _line_order().alias("row_in_file"), F.col("value").alias("line"))


def documents_by_line(spark: SparkSession, paths: Paths) -> DataFrame:
    """Every line with its newline, so that concatenation gives the file back."""
    lines = text_lines(spark, paths)
    return lines.select("path", "row_in_file", F.concat("line", F.lit(tx.LINE_SEPARATOR)).alias("text"))


def qa_records(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """Stripped question/answer pairs of JSON lines, and the lines that did not parse."""
    return checked_records(text_lines(spark, paths))


def checked_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``qa_records`` over ``(path, row_in_file, line)``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.where(tx.unicode_strip(F.col("line")) != "").select(
        "path", "row_in_file", "line", F.from_json("line", schemas.QA_RECORD_CHECKED, options).alias("r")
    )
    good = parsed.where(F.col("r._corrupt_record").isNull()).select(
        "path",
        "row_in_file",
        tx.unicode_strip(tx.empty_if_missing(F.col("r.问"))).alias("q"),
        tx.unicode_strip(tx.empty_if_missing(F.col("r.答"))).alias("a"),
    )
    bad = parsed.where(F.col("r._corrupt_record").isNotNull()).select("path", "row_in_file", F.col("line").alias("raw"))
    return good, bad


def qa_documents(records: DataFrame) -> DataFrame:
    """Composed documents of the records that have both parts."""
    return records.where(tx.qa_is_complete(F.col("q"), F.col("a"))).select(
        "path", "row_in_file", tx.compose_qa(F.col("q"), F.col("a")).alias("text")
    )


def strict_qa_records(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """All-or-nothing per file: one bad line, or a field that is present but no string, drops the file.

    Returns records of the good files and the dropped paths.
    """
    return strict_records(text_lines(spark, paths))


def strict_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``strict_qa_records`` over ``(path, row_in_file, line)``."""
    parsed = lines.withColumn("__v", F.try_parse_json("line"))

    def field(name: str) -> Column:
        return F.try_variant_get(F.col("__v"), f"$['{name}']", "variant")

    def bad_field(name: str) -> Column:
        return field(name).isNotNull() & (F.schema_of_variant(field(name)) != "STRING")

    is_object = F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT"))
    bad = F.col("__v").isNull() | ~is_object | bad_field("问") | bad_field("答")
    checked = parsed.select(
        "path",
        "row_in_file",
        F.coalesce(bad, F.lit(True)).alias("bad"),
        F.try_variant_get(F.col("__v"), "$['问']", "string").alias("q"),
        F.try_variant_get(F.col("__v"), "$['答']", "string").alias("a"),
    )
    dropped = _noted(checked.where("bad").select("path").distinct())
    kept = join_thin(checked, dropped, ["path"], "left_anti", F.col("row_in_file"), MAX_BROADCAST_FILES).select(
        "path",
        "row_in_file",
        tx.unicode_strip(tx.empty_if_missing(F.col("q"))).alias("q"),
        tx.unicode_strip(tx.empty_if_missing(F.col("a"))).alias("a"),
    )
    return kept, dropped


def forum_blocks(spark: SparkSession, paths: Paths) -> DataFrame:
    """Text blocks; both conditions are pushed to the Parquet scan."""
    raw = _load(spark, paths, "parquet", schemas.FORUM_BLOCK)
    return raw.where(tx.is_forum_text(F.col("文本"), F.col("块类型"))).select(
        _path(), F.col("_metadata.row_index").alias("row_in_file"), tx.unicode_strip(F.col("文本")).alias("text")
    )


def text_column(spark: SparkSession, paths: Paths, nulls: str = "drop") -> DataFrame:
    """The ``text`` column of Parquet files; NULL is dropped, or written as a word, or as nothing."""
    raw = _load(spark, paths, "parquet", schemas.TEXT_ONLY).select(
        _path(), F.col("_metadata.row_index").alias("row_in_file"), "text"
    )
    return treat_nulls(raw, nulls)


def treat_nulls(df: DataFrame, nulls: str) -> DataFrame:
    if nulls == "drop":
        return df.where(F.col("text").isNotNull())
    if nulls == "literal":
        return df.withColumn("text", tx.null_as_literal(F.col("text")))
    if nulls == "empty":
        return df.withColumn("text", tx.empty_if_missing(F.col("text")))
    raise ValueError(f"nulls is drop, literal or empty, not {nulls!r}")


def books(spark: SparkSession, paths: Paths) -> DataFrame:
    """Lines of the valid books with their newlines, and a blank line at the end of each book."""
    return _closed(book_lines(spark, paths)[0])


def _closed(lines: DataFrame) -> DataFrame:
    ends = lines.groupBy("path").agg((F.max("row_in_file") + 1).alias("row_in_file")).withColumn("text", F.lit(tx.LINE_SEPARATOR))
    return lines.select("path", "row_in_file", "text").unionByName(ends.select("path", "row_in_file", "text"))


def news_articles(spark: SparkSession, paths: Paths) -> DataFrame:
    raw = _load(spark, paths, "parquet", schemas.NEWS_ARTICLE)
    return raw.select(
        _path(),
        F.col("_metadata.row_index").alias("row_in_file"),
        tx.title_and_body(F.col("title"), F.col("text")).alias("text"),
    )


def book_lines(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """Lines of books, and the paths of books that are no valid UTF-8.

    A bad book is left out whole, the others are not affected.
    """
    lines = documents_by_line(spark, paths)
    bad = _noted(lines.where(~F.is_valid_utf8("text")).select("path").distinct())
    return join_thin(lines, bad, ["path"], "left_anti", F.col("row_in_file"), MAX_BROADCAST_FILES), bad


def _noted(paths: DataFrame) -> DataFrame:
    """Keep a short list of paths, so that neither its size check nor its use reads the files again."""
    shared_root(paths.sparkSession)
    return paths.checkpoint()


def place(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Join ``files(path, source_no, file_ord)`` and fold file and row order into ``doc_ord``.

    Rows of other files are left out.  A file's rows have 40 bits, or what the number of files of a source leaves: a source of 2^30 files
    has 33 for each, which are lines of 4 GB.  Where files and rows need more than 63 bits together, that is an error.
    """
    order = files.select("path", "source_no", "file_ord")
    most = files.agg(F.coalesce(F.max("file_ord"), F.lit(0)).cast("bigint").alias("most")).first().most
    bits = min(FILE_BITS, 63 - int(most).bit_length())
    folded = F.shiftleft(F.col("file_ord").cast("bigint"), bits) + F.col("row_in_file")
    too_many = F.raise_error(F.concat(F.lit("no order left for "), F.col("path"))).cast("bigint")
    return join_thin(rows, order, ["path"], "inner", F.col("row_in_file"), MAX_BROADCAST_FILES).select(
        F.col("source_no").cast("int").alias("source_no"),
        F.when(F.col("row_in_file") < F.lit(1 << bits), folded).otherwise(too_many).alias("doc_ord"),
        "text",
    )


#: Category kind → reader of its documents, before cleaning.
EXTRACTORS: Mapping[str, Callable[[SparkSession, Paths], DataFrame]] = {
    "qa_site": lambda spark, paths: qa_documents(qa_records(spark, paths)[0]),
    "qa_assistant": lambda spark, paths: qa_documents(qa_records(spark, paths)[0]),
    "forum": forum_blocks,
    "web": text_column,
    "articles": lambda spark, paths: text_column(spark, paths, nulls="empty"),
    "news": news_articles,
    "books": books,
}

#: Readers that can drop a file for a bad record, and those that let the caller say what becomes of a missing text.
STRICT = frozenset({"qa_site", "qa_assistant"})
WITH_NULLS = frozenset({"web", "articles"})


def extract(spark: SparkSession, kind: str, paths: Paths) -> DataFrame:
    """Documents of one category by its registered reader."""
    if kind not in EXTRACTORS:
        raise ValueError(f"no reader for {kind!r}; there are {sorted(EXTRACTORS)}")
    return EXTRACTORS[kind](spark, paths)


def extract_checked(
    spark: SparkSession, kind: str, paths: Paths, strict: bool = False, nulls: str | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Documents of one category, and the paths of files that its reader drops whole, where it does such a thing.

    With ``strict`` one bad record drops a file of ``STRICT`` categories; ``nulls`` says what becomes of a missing text
    in ``WITH_NULLS`` categories.
    """
    if strict and kind in STRICT:
        kept, dropped = strict_qa_records(spark, paths)
        return qa_documents(kept), dropped
    if nulls is not None and kind in WITH_NULLS:
        return text_column(spark, paths, nulls), None
    if kind == "books":
        lines, dropped = book_lines(spark, paths)
        return _closed(lines), dropped
    return extract(spark, kind, paths), None
