"""From files as they were fetched to numbered sources of cleaned documents.

The manifest is keyed by category and path: a file is extracted once, and
running again adds only what is new.  New files are numbered by Spark and read by folder, bounded by path and time of
change; which rows belong to them is a join with their manifest rows.  The driver sees counts and bounds, never the paths.

A file that cannot be read (cut short, not what its name says) is set aside by name and the others go on; each such file costs one more pass over its
category.  So are files that a strict reader drops.  They stay out of the manifest, so the next run tries them again.
"""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom import schemas
from tokenloom.session import join_thin, scratch_dir, table_at
from tokenloom.sources import catalog as cat
from tokenloom.sources import readers, sinks

log = logging.getLogger(__name__)

#: Categories whose readers write separators themselves.
WHOLE = frozenset({"books"})
#: Categories whose documents are cleaned line by line; the others keep their text.
CLEANED = frozenset({"qa_site", "qa_assistant", "forum"})
#: Categories that close a document with one newline instead of a blank line.
LINE_PER_DOCUMENT = frozenset({"web", "articles"})
#: Up to this many sources the manifest is broadcast to the documents, past it it is joined.
MAX_BROADCAST_SOURCES = 500_000

#: Categories in which every file is a source of its own.
FILE_IS_SOURCE = frozenset({"web"})

_MANIFEST = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("source_no", T.IntegerType()),
        T.StructField("file_ord", T.LongType()),
        T.StructField("run", T.StringType()),
    ]
)
_SET_ASIDE = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("run", T.StringType()),
    ]
)
#: Why a file was set aside.
UNREADABLE, INVALID = "unreadable", "invalid records"

_DOCS = T.StructType([*schemas.DOCS.fields, T.StructField("run", T.StringType())])


def finished(kind: str, rows: DataFrame) -> DataFrame:
    """The text a category writes: cleaned or not, and its separator."""
    if kind in WHOLE:
        return rows
    if kind in CLEANED:
        return sinks.as_clean_blocks(rows)
    return sinks.as_lines(rows) if kind in LINE_PER_DOCUMENT else sinks.as_blocks(rows)


class Extraction:
    """Sources below ``out``: ``out/files`` is the manifest, ``out/docs`` the documents."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark = spark
        self.out = out.rstrip("/")

    def manifest(self) -> DataFrame:
        return table_at(self.spark, f"{self.out}/files", _MANIFEST)

    def docs(self) -> DataFrame:
        """All documents of registered sources.

        The manifest is written last, so documents of a run that died are left out by the join.
        """
        known = self.manifest().select("source_no", "run").distinct()
        docs = table_at(self.spark, f"{self.out}/docs", _DOCS)
        kept = join_thin(docs, known, ["source_no", "run"], "left_semi", F.col("doc_ord"), MAX_BROADCAST_SOURCES)
        return kept.drop("run")

    def set_aside(self) -> DataFrame:
        """``(category, path, reason, run)`` of files that runs so far have left out."""
        return table_at(self.spark, f"{self.out}/set_aside", _SET_ASIDE)

    def run(
        self,
        folder: str,
        categories: Sequence[cat.Category],
        wanted: Iterable[str] = ("all",),
        start: int = 0,
        count: int | None = None,
        first_number: int = 1,
        strict: bool = False,
        nulls: str | None = None,
    ) -> DataFrame:
        """Extract the new files of the wanted categories; returns their manifest rows.

        ``start`` and ``count`` take a slice of each category's sorted paths.  ``strict`` and ``nulls`` are those of ``readers.extract_checked``.
        """
        runs: list[str] = []
        for category in cat.choose(categories, wanted):
            # Listed paths are percent-encoded, the folder is not: both are compared as plain text.
            listed = cat.list_files(self.spark, _escaped(folder)).select(
                F.col("path").alias("full"), "changed", F.regexp_replace(_plain("path"), r"^.*?" + _quoted(folder) + "/", "").alias("path")
            )
            chosen = cat.categorize(listed, [category])
            if start or count is not None:
                chosen = chosen.orderBy("path").offset(start)
                chosen = chosen if count is None else chosen.limit(count)
            known = self.manifest().where(F.col("category") == category.name)
            run = uuid.uuid4().hex
            fresh = self._numbered(category.name, cat.unseen(chosen, known), run, first_number)
            seen = fresh.agg(
                F.count("*").alias("n"), F.min("full").alias("first"), F.max("full").alias("last"), F.min(F.unix_micros("changed")).alias("since")
            ).first()
            if not seen.n:
                log.warning("%s: no new file, skipped (%d files listed, %d of this category)", category.name, listed.count(), chosen.count())
                continue
            inner, _, _ = category.prefix.rpartition("/")
            at = "/".join(part for part in (folder.rstrip("/"), inner) if part)
            files = readers.Files(_escaped(at), "*" + _escaped(category.suffix.rpartition("/")[2]), seen.first, seen.last, seen.since)
            self._extract(category.name, files, fresh, run, strict, nulls)
            runs.append(run)
        return self.manifest().where(F.col("run").isin(runs)) if runs else self.manifest().limit(0)

    def _numbered(self, kind: str, fresh: DataFrame, run: str, first_number: int) -> DataFrame:
        """The manifest rows of new files, with ``full`` and ``changed``; written, so that every later step sees the same numbers."""
        base = cat.next_number(self.manifest(), default=first_number).first().next_source_no
        at = F.col("__at")
        per_file = kind in FILE_IS_SOURCE
        entries = cat.sorted_positions(fresh.select("path", "full", "changed"), "path", "__at").select(
            F.lit(kind).alias("category"),
            "path",
            (F.lit(base) + (at if per_file else F.lit(0))).cast("int").alias("source_no"),
            (F.lit(0).cast("bigint") if per_file else at).alias("file_ord"),
            F.lit(run).alias("run"),
            "full",
            "changed",
        )
        path = scratch_dir(self.spark, "numbered-files")
        entries.write.parquet(path)
        return self.spark.read.schema(entries.schema).parquet(path)

    def _extract(self, kind: str, files: readers.Files, entries: DataFrame, run: str, strict: bool, nulls: str | None) -> None:
        """Write the documents of the files that can be read, then the report of the others, then the manifest."""
        good = entries
        while True:
            order = good.select(F.col("full").alias("path"), "source_no", "file_ord")
            try:
                rows, dropped = readers.extract_checked(self.spark, kind, files, strict, nulls)
                # the folder is this run's own, so what a failed attempt left there may go
                sinks.write_documents(readers.place(finished(kind, rows), order), f"{self.out}/docs/run={run}", mode="overwrite")
                break
            except Exception as e:
                path = unreadable_path(e)
                found = path and good.where(_one_slash(F.col("full")) == path).first()
                if not found:
                    raise
                log.warning("%s: %s cannot be read, set aside", kind, found.path)
                self._report(good.where(F.col("full") == found.full), UNREADABLE)
                files, good = files.without(found.full), good.where(F.col("full") != found.full)
        if dropped is not None:
            bad = dropped.select(F.col("path").alias("full"))
            self._report(good.join(bad, "full", "left_semi"), INVALID)
            good = good.join(bad, "full", "left_anti")
        good.select(*_MANIFEST.names).write.mode("append").parquet(f"{self.out}/files")

    def _report(self, files: DataFrame, reason: str) -> None:
        found = files.select("category", "path", F.lit(reason).alias("reason"), "run")
        found.write.mode("append").parquet(f"{self.out}/set_aside")


def unreadable_path(error: Exception) -> str | None:
    """The file that Spark says it could not read, None where the error is another one."""
    named = re.search(r"\[FAILED_READ_FILE[^\]]*\] Encountered error while reading file (\S+)\.\s", str(error))
    return named and re.sub(r"^file:/+", "file:/", named[1])


def _one_slash(path: Column) -> Column:
    """Local paths as ``unreadable_path`` writes them."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _plain(path: str) -> Column:
    """A listed path without percent-encoding."""
    return F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))


def _escaped(path: str) -> str:
    """A plain path as readers take it, with the characters escaped that would make it a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _quoted(text: str) -> str:
    """``text`` as a literal of a regular expression."""
    return r"\Q" + text.rstrip("/").replace(r"\E", r"\E\\E\Q") + r"\E"
