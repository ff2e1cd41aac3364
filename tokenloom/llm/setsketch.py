"""Near-duplicates by SetSketch registers.

A document's shingles are sketched into registers: the least of exponential random numbers, on a logarithmic scale, truncated
to 16 bits.  Registers of a union are the maxima of registers, and two sets agree in a register about as often as they share shingles, so bands of
registers bring similar documents together.  The joint likelihood of two sketches, given both set sizes, estimates the
similarity and leaves out pairs that are far from the threshold; full shingle sets decide about the rest.

Rows with equal sets form a class.  One of its rows of smallest id represents it, and the number of that row names the class
as ``node``: ids may repeat with other texts, rows do not.  Then

1. every class is compared with the one of its bands' leaders (smallest nodes) that it resembles most;
2. where a band still joins several components, the classes around it form a cluster.  Its members
   outside the largest component are compared with all others in chunks; a task compares two chunks and
   returns only the links that join something.  No pair that shares a band is left out unless its ends are linked already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.components import components, roots
from tokenloom.llm.registry import written
from tokenloom.llm.words import mix, shingle_sets, text_buffer

REGISTERS = 128
#: Registers in a band: a pair at the threshold shares none of the 32 bands once in 190,000 times.
BAND = 4
#: Linked if 100 * common >= PERCENT * union.
PERCENT = 75
#: Estimates this far below the threshold are left out: five standard deviations of 128 registers.
MARGIN = 0.2
#: Base of the logarithmic scale, rate of the exponential numbers, greatest register.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Classes in a chunk, and shingles in all of them, about: some tens of megabytes of text.
CHUNK, CHUNK_SHINGLES = 128, 1 << 22

_SALTS = np.random.default_rng(11).integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set that is not empty."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, (_SALTS[:, None] * low[at : at + 2048] + high[at : at + 2048]).min(axis=1), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarities of most joint likelihood; one pair of sketches in each row, whose set sizes are known."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    share_a = size_a / (size_a + size_b)
    share_b = 1 - share_a

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        more, less = p(share_a - share_b * j), p(share_b - share_a * j)
        return above * np.log(more) + below * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-12, 1))

    low, high = np.zeros(len(a)), np.minimum(share_a / share_b, share_b / share_a)
    for _ in range(30):  # the likelihood has one peak
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


def _digests(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums by which equal sets are known."""
    if not len(shingles):
        return 0, 0
    return tuple(int(mix(shingles, salt).sum(dtype=np.uint64).astype(np.int64)) for salt in (1, 2))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text``, ``n``, ``d1``, ``d2``, ``registers`` of every row; a set without shingles has null registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, registers = [], [], [], []
            for s in shingle_sets(*text_buffer(batch.column(1))):
                first, second = _digests(s)
                n.append(len(s))
                d1.append(first)
                d2.append(second)
                registers.append(sketch(s).tobytes() if len(s) else None)
            columns = [*batch.columns, pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n", "d1", "d2", "registers"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id BIGINT, text STRING, n BIGINT, d1 BIGINT, d2 BIGINT, registers BINARY")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def linked(common: np.ndarray | int, size_a: np.ndarray | int, size_b: np.ndarray | int):
    return 100 * common >= PERCENT * (size_a + size_b - common)


def _closest_leader(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """``a`` (the leader), ``b``: for each class the leader of its bands with the greatest estimate, if that is near enough."""
    pairs = (
        shared.where("node != leader.node AND 100 * least(n, leader.n) >= 75 * greatest(n, leader.n)")
        .select(F.col("leader.node").alias("a"), F.col("node").alias("b")).distinct()
    )
    side = classes.select("node", "n", "registers")
    pairs = pairs.join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = estimate(_registers(batch.column(4)), _registers(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], names=["a", "b", "near"])

    rated = pairs.mapInArrow(run, "a BIGINT, b BIGINT, near DOUBLE").where(F.col("near") >= PERCENT / 100 - MARGIN)
    best = F.max(F.struct("near", (-F.col("a")).alias("a")))
    return rated.groupBy("b").agg(best.alias("best")).select((-F.col("best.a")).alias("a"), "b")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose full sets are similar enough; ``texts`` has one row for each class."""
    rows = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(shingle_sets(*text_buffer(batch.column(2))), shingle_sets(*text_buffer(batch.column(3))), strict=True)
            keep = [bool(linked(_common(a, b), len(a), len(b))) for a, b in both]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a BIGINT, b BIGINT")


class _Chunk:
    """Classes of one chunk with their sets."""

    def __init__(self, rows: pa.StructArray):
        self.nodes, self.component = rows.field("node").to_numpy(), rows.field("component").to_numpy()
        self.registers = _registers(rows.field("registers"))
        self.bands = self.registers.view("<u8")
        self.sets = list(shingle_sets(*text_buffer(rows.field("text"))))
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)


def _candidates(a: _Chunk, b: _Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Pairs from two chunks that share a band, lie in two components and may be similar enough."""
    share = np.zeros((len(a.nodes), len(b.nodes)), dtype=bool)
    for t in range(a.bands.shape[1]):
        share |= a.bands[:, t, None] == b.bands[None, :, t]
    share &= a.component[:, None] != b.component[None, :]
    small, large = np.minimum(a.sizes[:, None], b.sizes[None, :]), np.maximum(a.sizes[:, None], b.sizes[None, :])
    i, j = np.nonzero(share & (100 * small >= PERCENT * large))
    if a is b:
        i, j = i[i < j], j[i < j]
    parts = range(0, len(i), 1 << 15)
    near = [estimate(a.registers[i[p : p + (1 << 15)]], b.registers[j[p : p + (1 << 15)]], a.sizes[i[p : p + (1 << 15)]], b.sizes[j[p : p + (1 << 15)]]) for p in parts]
    near = np.concatenate([np.zeros(0), *near])
    order = np.argsort(-near, kind="stable")
    order = order[near[order] >= PERCENT / 100 - MARGIN]
    return i[order], j[order]


def _joining(a: _Chunk, b: _Chunk) -> list[tuple[int, int]]:
    """Components that a link between two chunks joins, the link confirmed on full sets; pairs joined already are passed over."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for i, j in zip(*_candidates(a, b)):
        x, y = root(int(a.component[i])), root(int(b.component[j]))
        if x != y and linked(_common(a.sets[i], b.sets[j]), a.sizes[i], b.sizes[j]):
            parent[max(x, y)] = min(x, y)
            found.append((int(a.component[i]), int(b.component[j])))
    return found


def _across(shared: DataFrame, classes: DataFrame, joined: DataFrame, texts: DataFrame) -> DataFrame:
    """Components ``a``, ``b`` of ``joined`` that share a band and that a link joins."""
    members = shared.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    members = written(members.join(open_, "key").select("node", "component", F.col("leader.node").alias("leader")).distinct(), "open-members")

    clusters = components(members, "node", "leader").select("node", F.col("component").alias("cluster"))
    nodes = members.select("node", "component").distinct().join(clusters, "node").join(classes.select("node", F.col("n").alias("size")), "node")

    def chunks(n: str, size: str) -> str:
        return f"greatest(ceil({n} / {CHUNK}), ceil({size} / {CHUNK_SHINGLES}))"

    main = (
        nodes.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy("cluster")
        .agg(F.max(F.struct("n", "component", "size")).alias("top"), F.sum("n").alias("all"), F.sum("size").alias("sizes"))
        .withColumn("one", F.expr(f"{chunks('all', 'sizes')} <= 1"))
        .select(
            "cluster", F.col("top.component").alias("main"),
            F.expr(f"IF(one, 1, CAST({chunks('(all - top.n)', '(sizes - top.size)')} AS INT))").alias("minor_chunks"),
            F.expr(f"IF(one, 0, CAST({chunks('top.n', 'top.size')} AS INT))").alias("main_chunks"),
        )
    )
    # Chunks from 0 hold the members outside the largest component (all members of a small cluster), those after them the rest.
    nodes = nodes.join(main, "cluster").withColumn("chunk", F.expr(
        "IF(component = main AND main_chunks > 0, minor_chunks + pmod(xxhash64(node), main_chunks), pmod(xxhash64(node), minor_chunks))"
    ).cast("int"))
    filled = (
        nodes.select("node", "component", "cluster", "chunk").join(classes.select("node", "registers"), "node").join(texts, "node")
        .groupBy("cluster", "chunk").agg(F.collect_list(F.struct("node", "component", "registers", "text")).alias("rows"))
    )
    filled = written(filled, "chunks")
    turns = (
        main.select("cluster", "minor_chunks", "main_chunks", F.explode(F.expr("sequence(0, minor_chunks - 1)")).alias("i"))
        .select("cluster", "i", F.explode(F.expr("sequence(i, minor_chunks + main_chunks - 1)")).alias("j"))
    )
    first, second = filled.toDF("cluster", "i", "a"), filled.toDF("cluster", "j", "b")
    spread = max(docs_parallel(classes), 1)
    work = turns.join(first, ["cluster", "i"]).join(second, ["cluster", "j"]).withColumn("b", F.when(F.col("i") != F.col("j"), F.col("b")))
    work = work.select("a", "b", "cluster", "i", "j").repartition(spread, "cluster", "i", "j").select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in range(batch.num_rows):
                a = _Chunk(batch.column(0)[t].values)
                b = a if not batch.column(1)[t].is_valid else _Chunk(batch.column(1)[t].values)
                links = _joining(a, b)
                columns = [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return work.mapInArrow(run, "a BIGINT, b BIGINT")


def docs_parallel(df: DataFrame) -> int:
    """Tasks for work on chunks: the session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id``, ``kept`` for every row.

    Shingles are distinct runs of five words, or all words of a shorter text.  Rows without words are linked with nothing and kept; so
    are rows without an id, whose component is null.  ``component_id`` is the smallest id that links reach, ``kept`` says
    whether the row has that id.  Repeated rows share component and verdict.  An empty table gives an empty
    result; other columns are left behind.  Very long texts are hashed in slices, and few of them share a chunk.
    """
    rows = written(sketches(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    first = F.min(F.struct("id", "row"))
    classes = (
        rows.where("n > 0 AND id IS NOT NULL").groupBy("d1", "d2")
        .agg(first.alias("first"), F.first("n").alias("n"), F.first("registers").alias("registers"))
        .select(F.col("first.row").alias("node"), F.col("first.id").alias("id"), "d1", "d2", "n", "registers")
    )
    classes = written(classes, "classes")
    texts = rows.select(F.col("row").alias("node"), "text")
    keys = F.expr(f"transform(sequence(0, {REGISTERS // BAND - 1}), t -> xxhash64(t, substring(registers, t * {2 * BAND} + 1, {2 * BAND})))")
    bands = classes.select(F.explode(keys).alias("key"), "node", "n")
    leaders = bands.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("leader"))
    shared = written(bands.join(leaders.where("members > 1").select("key", "leader"), "key"), "shared-bands")

    links = _confirmed(_closest_leader(shared, classes), texts)
    joined = roots(links, "b", "a")  # a class has one closest leader, whose node is smaller
    more = components(written(_across(shared, classes, joined, texts), "cross-links"), "a", "b")

    members = classes.select("node", "id", "d1", "d2").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = written(members.select("component", "id", "d1", "d2"), "members")
    ids = members.groupBy("component").agg(F.min("id").alias("id")).join(more.toDF("component", "least"), "component", "left")
    ids = ids.withColumn("least", F.coalesce("least", "component"))
    names = ids.select("component", "least").join(ids.groupBy("least").agg(F.min("id").alias("name")), "least").select("component", "name")
    named = members.join(names, "component").select("d1", "d2", F.col("name").alias("component"))
    out = rows.join(named, ["d1", "d2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
