"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Safe on any session, set only where the session says nothing.
_RUNTIME_DEFAULTS = {
    # Texts differ in size by four orders of magnitude, so Arrow batches are bounded in bytes too.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

#: Salts per key of a join whose small side turns out not to be small.
SALTS = 64

#: Aim for shuffle partitions and tasks of about this size.
TARGET_BYTES = 256 << 20
MAX_PARTITIONS = 100_000

#: The optimizer answers with a number near the largest BIGINT where it knows nothing.
UNKNOWN_SIZE = 1 << 60


def with_defaults(spark: SparkSession) -> SparkSession:
    """Apply the runtime defaults this library relies on to settings left unset."""
    for key, value in _RUNTIME_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tokenloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return with_defaults(spark)


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="tokenloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, removed by Hadoop when the application ends."""
    path = os.path.join(shared_root(spark), "tokenloom-scratch", f"{label}-{uuid.uuid4().hex}")
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, written once to the scratch folder and read from there."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, label: str, **figures: Column) -> tuple[DataFrame, dict]:
    """``written``, and aggregates of the rows that are taken as they are written, without a job of their own."""
    seen = Observation()
    rows = written(df.observe(seen, *[figure.alias(name) for name, figure in figures.items()]), label)
    return rows, seen.get


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def claim_number(spark: SparkSession, folder: str, highest: Callable[[], int]) -> int:
    """A number above ``highest()`` that nobody else gets: its file under ``folder`` is created, and creation fails where it exists."""
    number = highest() + 1
    while True:
        fs, path = _file_system(spark, f"{folder}/{number}")
        fs.mkdirs(path.getParent())
        try:
            fs.create(path, False).close()  # one call: a check before it would leave a gap
            return number
        except Py4JJavaError:
            if not fs.exists(path):
                raise
        number += 1


def delete_older(spark: SparkSession, path: str, grace: float = 0.0) -> bool:
    """Delete a folder that was last changed more than ``grace`` seconds ago; whether it went."""
    fs, hadoop_path = _file_system(spark, path)
    if not fs.exists(hadoop_path):
        return False
    if grace and fs.getFileStatus(hadoop_path).getModificationTime() / 1000 > time.time() - grace:
        return False
    return bool(fs.delete(hadoop_path, True))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has ended: Spark's committer leaves its mark then."""
    fs, mark = _file_system(spark, f"{path}/_SUCCESS")
    return bool(fs.exists(mark))


def table_at(spark: SparkSession, path: str, schema: T.StructType, nested: bool = False) -> DataFrame:
    """The Parquet table at ``path``, empty where nothing has been written yet; ``nested`` looks into all folders below."""
    fs, hadoop_path = _file_system(spark, path)
    if not fs.exists(hadoop_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", str(nested).lower()).parquet(path)


def estimated_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables a DataFrame reads, from the file listing; None where a table's size is not known.

    Inputs are added up: the optimizer's figure for a join is a product and says nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return None if any(size >= UNKNOWN_SIZE for size in sizes) else sum(sizes)


def join_thin(
    big: DataFrame, thin: DataFrame, keys: Sequence[str], how: str, salt: Column, max_rows: int
) -> DataFrame:
    """Join a table of keys to the rows they belong to, for inner, left, semi and anti joins.

    Up to ``max_rows`` the thin side is counted and broadcast, so the rows stay where they are.  Past it
    both sides are shuffled by key and salt, so that a key with a third of all rows spreads too.
    """
    if thin.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(thin), list(keys), how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS).cast("bigint")))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    return salted.join(thin.withColumn("__salt", copies), [*keys, "__salt"], how).drop("__salt")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input too small to fill them with full file splits.

    The size is the optimizer's estimate.  A large input comes back as it is:
    its splits already outnumber the cores, and moving it would cost a shuffle.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = estimated_bytes(df)
    return df.repartition(cores) if size is not None and size < cores * split else df


def partitions_for(spark: SparkSession, total_bytes: int) -> int:
    """Partitions of about ``TARGET_BYTES``, at least one per core.

    Past ``MAX_PARTITIONS`` partitions grow instead: the driver tracks every one of them.
    """
    wanted = min(-(-total_bytes // TARGET_BYTES), MAX_PARTITIONS)
    return max(wanted, spark.sparkContext.defaultParallelism)


def row_partitions(df: DataFrame, growth: float) -> int | None:
    """How many partitions to shuffle whole rows of this input into, None where its size is not known.

    ``growth`` is the size of a shuffled row against its size in the (compressed) input.  A number that is
    asked for is not coalesced at run time: what follows the shuffle is work on whole texts, and a few
    megabytes of them still deserve every core.
    """
    size = estimated_bytes(df)
    return None if size is None else partitions_for(df.sparkSession, int(size * growth))
