"""File catalogs: what exists, what is wanted, what is new, and which number it gets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.functions.names import SOURCE_FILE_PATTERN, number_in
from tokenloom.operators.ordering import ordinals
from tokenloom.session import shared_root


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, name, n_bytes, changed)`` of every file below ``path``; contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_size").cast("bigint").alias("n_bytes"),
        F.col("_metadata.file_modification_time").alias("changed"),
    )


def numbered(files: DataFrame, pattern: str = SOURCE_FILE_PATTERN, name: str = "name") -> DataFrame:
    """Keep the names that match and add their number as ``source_no``."""
    return files.where(F.col(name).rlike(pattern)).withColumn("source_no", number_in(F.col(name), pattern))


def numbered_sources(spark: SparkSession, folder: str, pattern: str = SOURCE_FILE_PATTERN) -> DataFrame:
    """The numbered inputs of a folder; a folder without any is an error."""
    found = numbered(list_files(spark, folder), pattern)
    if found.isEmpty():
        raise FileNotFoundError(f"no file in {folder} matches {pattern}")
    return found


@dataclass(frozen=True)
class Category:
    """A named part of a catalog: path prefix and suffix, and how many files at most."""

    name: str
    prefix: str
    suffix: str
    first: int | None = None


def choose(categories: Sequence[Category], wanted: Iterable[str] = ("all",)) -> list[Category]:
    """Requested categories in catalog order of the request; ``all`` means every one."""
    wanted = list(wanted)
    known = {c.name: c for c in categories}
    if "all" in wanted:
        return list(categories)
    unknown = [w for w in wanted if w not in known]
    if unknown:
        raise ValueError(f"unknown categories {unknown}; there are {sorted(known)}")
    return [known[w] for w in wanted]


def in_category(path: Column, category: Category) -> Column:
    return F.startswith(path, F.lit(category.prefix)) & F.endswith(path, F.lit(category.suffix))


def categorize(files: DataFrame, categories: Sequence[Category]) -> DataFrame:
    """Tag paths with their category, drop the rest, and keep the first files where a category says so."""
    tag = reduce(
        lambda otherwise, c: F.when(in_category(F.col("path"), c), F.lit(c.name)).otherwise(otherwise),
        reversed(list(categories)),
        F.lit(None).cast("string"),
    )
    tagged = files.withColumn("category", tag).where(F.col("category").isNotNull())
    limits = {c.name: c.first for c in categories if c.first is not None}
    if not limits:
        return tagged
    # Only limited categories pay for a ranking, and Spark keeps just the first rows per task for it.
    most = max(limits.values())
    limit = reduce(
        lambda otherwise, kv: F.when(F.col("category") == kv[0], F.lit(kv[1])).otherwise(otherwise),
        limits.items(),
        F.lit(most),
    )
    limited = tagged.where(F.col("category").isin(*limits))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("path"))
    kept = limited.withColumn("__rank", rank).where(F.col("__rank") <= most).where(F.col("__rank") <= limit).drop("__rank")
    return tagged.where(~F.col("category").isin(*limits)).unionByName(kept)


def slice_of(files: DataFrame, start: int, count: int) -> DataFrame:
    """``count`` paths from position ``start`` of the sorted list."""
    return files.orderBy("path").offset(start).limit(count)


def sorted_positions(df: DataFrame, key: str, out: str, partitions: int | None = None) -> DataFrame:
    """Dense 0-based position of every row in the order of a unique key of any type.

    Rows are range-partitioned and sorted; partition and row number make a sortable id
    that the running count turns into a dense one.  The id is checkpointed: a range partitioning
    that was planned twice, or lost with an executor, could number rows differently.
    """
    shared_root(df.sparkSession)
    n = partitions or max(2, df.sparkSession.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(n, key).sortWithinPartitions(key)
    stamped = ranged.withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    parts = stamped.withColumns(
        {"__part": F.shiftright("__id", 33), "__row": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    placed = ordinals(parts, minor="__row", out=out, majors=["__part"])
    return placed.withColumn(out, F.col(out) - 1).drop("__id", "__part", "__row")


def next_number(sources: DataFrame, number: str = "source_no", default: int = 1) -> DataFrame:
    """One row: the number after the highest one in use."""
    return sources.agg(
        (F.coalesce(F.max(number).cast("bigint") + 1, F.lit(default).cast("bigint"))).alias("next_source_no")
    )


def allot_numbers(new_files: DataFrame, sources: DataFrame, default: int = 1) -> DataFrame:
    """Give new paths consecutive numbers, in path order, after the highest one in use."""
    base = next_number(sources, default=default).scalar()
    return sorted_positions(new_files, "path", "__at").withColumn("source_no", (base + F.col("__at")).cast("int")).drop("__at")


def unseen(files: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Files the manifest does not know."""
    return files.join(manifest.select(*keys), list(keys), "left_anti")


def seen(files: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    return files.join(manifest.select(*keys), list(keys), "left_semi")
