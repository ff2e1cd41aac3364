"""A Merkle manifest of a table: one tree of three-way hashes per source, and one over the sources.

Leaves of a source ascend by document id.  A tree is stored as blocks: aligned subtrees of up to seven levels of
hashes over up to 3^7 leaves, whose roots are the leaves of the blocks one tier above, and so on until one block spans the tree.
Inside a block the nodes lie in van Emde Boas order: the subtree is split at half height, the upper part comes first and
the lower parts follow from left to right, each of them laid out in the same way.  A node's address follows from its level
and place by arithmetic alone; a walk from a leaf to the root touches few neighbouring stretches whatever the size of a cache line.

No task sees more than one block or one range of sorted leaves: a source with a third of all rows is many blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.registry import written

#: Children of a node, columns of a leaf in order.
ARITY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

#: Levels of hashes in a block.
HEIGHT = 7
LEAVES = ARITY**HEIGHT
DIGEST = 32

#: Tree number of the tree over the sources.
TOP = -1

#: Runs of one source in one range of sorted leaves are broadcast up to so many.
FEW = 1 << 17


def node_hash(children: list[bytes]) -> bytes:
    """The digest of the children's digests, written one after another as lowercase hex."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def leaf_column(text: Column | None = None) -> Column:
    """The digest of a row of documents; ``text`` takes the place of its text."""

    def field(name: str) -> Column:
        value = (F.col(name) if text is None or name != "text" else text).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(field, COLUMNS)), 256))


def levels_over(n: int) -> int:
    """Levels of hashes above ``n`` leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


@lru_cache(maxsize=16)
def layout(height: int) -> list[np.ndarray]:
    """Addresses of the nodes of a full subtree, for each level from the leaves (0) to the root (``height``)."""

    def place(levels: int) -> list[np.ndarray]:  # from the root downwards
        if levels == 1:
            return [np.zeros(1, dtype=np.int64)]
        upper = levels // 2
        above, below = place(upper), place(levels - upper)
        size = sum(map(len, above))
        step = sum(map(len, below))
        starts = size + step * np.arange(ARITY**upper, dtype=np.int64)
        return above + [(starts[:, None] + part[None, :]).reshape(-1) for part in below]

    return place(height + 1)[::-1]


class Block:
    """The nodes of an aligned subtree over ``n`` leaves, hashed up to ``height`` levels."""

    def __init__(self, nodes: bytearray | bytes, n: int, height: int):
        self.nodes, self.n, self.height = nodes, n, height
        self._at = layout(height)

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Block:
        size = sum(ARITY**k for k in range(height + 1))
        block = cls(bytearray(size * DIGEST), len(leaves), height)
        level = leaves
        for up in range(height + 1):
            for address, digest in zip(block._at[up].tolist(), level):
                block.nodes[address * DIGEST : (address + 1) * DIGEST] = digest
            if up < height:
                level = [node_hash(level[i : i + ARITY]) for i in range(0, len(level), ARITY)]
        return block

    def node(self, level: int, place: int) -> bytes:
        address = int(self._at[level][place]) * DIGEST
        return bytes(self.nodes[address : address + DIGEST])

    @property
    def root(self) -> bytes:
        return self.node(self.height, 0)

    def paths(self) -> list[bytes]:
        """For each leaf its way to the block's root: level by level a byte for the siblings to the left, one for those to the right, then all of them."""
        paths, count = [b""] * self.n, self.n
        for level in range(self.height):
            at = (self._at[level][:count] * DIGEST).tolist()
            run = [bytes(self.nodes[a : a + DIGEST]) for a in at]
            steps = []
            for i in range(count):
                first, end = i - i % ARITY, min(i - i % ARITY + ARITY, count)
                steps.append(bytes((i - first, end - i - 1)) + b"".join(run[first:i] + run[i + 1 : end]))
            width = ARITY**level
            paths = [path + steps[i // width] for i, path in enumerate(paths)]
            count = -(-count // ARITY)
        return paths


def steps_of(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The digests to the left and to the right, level by level."""
    at = 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        middle = at + 2 + left * DIGEST
        at = middle + right * DIGEST
        yield path[middle - left * DIGEST : middle], path[middle:at]


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in steps_of(path):
        leaf = hashlib.sha256((left + leaf + right).hex().encode()).digest()
    return leaf


def proof_digest(path: bytes) -> str:
    """The digest of all siblings of a path, as lowercase hex."""
    return hashlib.sha256("".join((left + right).hex() for left, right in steps_of(path)).encode()).hexdigest()


@dataclass(frozen=True)
class Manifest:
    """Tables of a manifest.

    ``rows``: ``tree``, ``place`` (in the tree), ``doc_id``, ``leaf``, ``claim`` of every document.
    ``tiers``: blocks from the leaves upwards: ``tree``, ``place`` (of the block in its tier), ``height``, ``n``, ``nodes``, ``root``, ``last``
    (whether it spans its tree).  Blocks of tree ``TOP`` are the tree over the sources, whose leaves are the other trees' roots by number.
    """

    rows: DataFrame
    tiers: list[DataFrame]
    top: list[DataFrame]


def _numbered(docs: DataFrame, claim: Column) -> DataFrame:
    """``tree``, ``place``, ``doc_id``, ``leaf``, ``claim``: sources numbered in order, and their documents within them."""
    source = F.col("source").cast("string")
    rows = docs.select(
        source.alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf_column().alias("leaf"), claim.alias("claim"),
        F.monotonically_increasing_id().alias("row"),
    )
    # ``row`` splits copies of one row over ranges; which of them comes first changes nothing.
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "claim", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("part", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at, last = -1, 0, None
        for batch in batches:
            sources = batch.column(0)
            n = batch.num_rows
            if not n:
                continue
            codes = sources.dictionary_encode(null_encoding="encode")
            numbers = codes.indices.to_numpy()
            new = np.empty(n, dtype=bool)
            new[1:] = numbers[1:] != numbers[:-1]
            new[0] = run < 0 or sources[0].as_py() != last
            runs = run + np.cumsum(new)
            starts = np.where(new, np.arange(n), 0)
            np.maximum.accumulate(starts, out=starts)
            places = np.arange(n) - starts + np.where(runs == run, at, 0)
            run, at, last = int(runs[-1]), int(places[-1]) + 1, sources[n - 1].as_py()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(runs, pa.int64()), pa.array(places, pa.int64())], names=["source", "doc_id", "leaf", "claim", "part", "run", "within"]
            )

    schema = "source STRING, doc_id BIGINT, leaf BINARY, claim BINARY, part INT, run BIGINT, within BIGINT"
    leaves = written(ranged.mapInArrow(count, schema), "merkle-leaves")
    runs = written(leaves.groupBy("part", "run").agg(F.min("source").alias("source"), F.count("*").alias("n")), "merkle-runs")

    # One row for each range: how many sources begin in it.  The first may have begun in the range before.
    ends = runs.groupBy("part").agg(
        F.count("*").alias("runs"), F.min(F.struct("run", "source")).alias("first"), F.max(F.struct("run", "source")).alias("last")
    )
    ranges = Window.orderBy("part")
    same = F.lag(F.lit(True)).over(ranges).isNotNull() & F.lag("last.source").over(ranges).eqNullSafe(F.col("first.source"))
    ends = ends.withColumn("goes_on", same.cast("bigint"))
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum(F.col("runs") - F.col("goes_on")).over(before), F.lit(0))
    ends = ends.select("part", (begun - F.col("goes_on")).alias("first_tree"))
    runs = runs.join(ends, "part").withColumn("tree", F.col("first_tree") + F.col("run"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    few = runs.limit(FEW + 1).count() <= FEW
    runs = runs.select("part", "run", "tree", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return leaves.join(F.broadcast(runs) if few else runs, ["part", "run"]).select("tree", (F.col("base") + F.col("within")).alias("place"), "doc_id", "leaf", "claim")


def _tiers(leaves: DataFrame) -> list[DataFrame]:
    """Blocks of each tier over leaves ``tree``, ``place``, ``leaf``; roots of a tier are the next one's leaves until every tree is one block."""
    tiers, sizes = [], leaves.groupBy("tree").agg(F.count("*").alias("of"))
    while True:
        last = F.col("of") <= LEAVES
        grouped = (
            leaves.withColumn("block", F.floor(F.col("place") / LEAVES).cast("bigint")).groupBy("tree", "block")
            .agg(F.sort_array(F.collect_list(F.struct("place", "leaf"))).alias("rows"))
            .join(sizes, "tree").select("tree", F.col("block").alias("place"), F.col("rows.leaf").alias("leaves"), last.alias("last"))
        )

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blocks = [
                    Block.build(leaves, levels_over(len(leaves)) if last else HEIGHT)
                    for leaves, last in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array([b.height for b in blocks], pa.int32()), pa.array([b.n for b in blocks], pa.int32()),
                        pa.array([bytes(b.nodes) for b in blocks], pa.binary()), pa.array([b.root for b in blocks], pa.binary()), batch.column(3),
                    ],
                    names=["tree", "place", "height", "n", "nodes", "root", "last"],
                )

        schema = "tree BIGINT, place BIGINT, height INT, n INT, nodes BINARY, root BINARY, last BOOLEAN"
        tier = written(grouped.mapInArrow(build, schema), "merkle-blocks")
        tiers.append(tier)
        open_ = tier.where(~F.col("last")).select("tree", "place", F.col("root").alias("leaf"))
        if not open_.limit(1).count():
            return tiers
        leaves, sizes = open_, open_.groupBy("tree").agg(F.count("*").alias("of"))


def build(docs: DataFrame, claim: Column | None = None) -> Manifest:
    """The manifest of ``docs`` with the columns ``COLUMNS``; other columns are left behind.

    ``claim`` is the digest of what is said to be the row, where that differs from the row itself; ``prove`` checks it.
    Nulls are values of their own: a null source is a source and comes first, null ids come first in theirs.  Rows of equal ids
    ascend by their digests and repeated rows are leaves of their own.  Texts are hashed where they are read; what is sorted and
    shuffled are digests.  An empty table has no blocks.
    """
    rows = written(_numbered(docs, leaf_column() if claim is None else claim), "merkle-rows")
    tiers = _tiers(rows)
    return Manifest(rows, tiers, _tiers(subroots(tiers).select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("leaf"))))


def subroots(tiers: list[DataFrame]) -> DataFrame:
    """``tree``, ``subroot`` of every tree."""
    found = [tier.where("last").select("tree", F.col("root").alias("subroot")) for tier in tiers]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_WAY = "tree BIGINT, place BIGINT, path BINARY, roots BINARY"


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks with the way above them to the ways of their leaves."""
    for batch in batches:
        for i in range(batch.num_rows):
            tree, first, height, n, nodes, path, roots = (c[i].as_py() for c in batch.columns)
            paths = [p + path for p in Block(nodes, n, height).paths()]
            places = np.arange(first, first + n, dtype=np.int64)
            columns = [pa.array(np.full(n, tree, dtype=np.int64)), pa.array(places), pa.array(paths, pa.binary()), pa.array([roots] * n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "place", "path", "roots"])


def _below(ways: DataFrame) -> DataFrame:
    first = (F.col("place") * LEAVES).alias("first")
    return ways.select("tree", first, "height", "n", "nodes", "path", "roots").mapInArrow(_down, _WAY)


def _ways(tiers: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The blocks of the lowest tier, each with ``path``, the siblings from its root upwards, and ``roots``, the roots of its tree and of those above.

    ``above`` has ``tree``, ``path``, ``roots`` of the tree that the roots are leaves of.
    """
    block, found = ["tree", "place", "height", "n", "nodes"], None
    for tier in reversed(tiers):
        ends = tier.where("last")
        if above is None:
            ways = ends.select(*block, F.lit(b"").alias("path"), F.col("root").alias("roots"))
        else:
            ways = ends.join(above, "tree").select(*block, "path", F.concat("root", "roots").alias("roots"))
        if found is not None:
            ways = ways.unionByName(tier.where(~F.col("last")).select(block).join(found, ["tree", "place"]))
        found = written(_below(ways), "merkle-ways") if tier is not tiers[0] else ways
    return found


def prove(manifest: Manifest) -> DataFrame:
    """For every row of the manifest ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    The siblings are read from the blocks on the way up, block root by block root.  ``folded_root`` is what they and the claimed digest lead to,
    ``verified`` says whether that is the root.  Digests are lowercase hex.
    """
    top = _below(_ways(manifest.top, None)).select(F.col("place").alias("tree"), "path", "roots")
    of_block = (
        manifest.rows.withColumn("block", F.floor(F.col("place") / LEAVES).cast("bigint")).groupBy("tree", "block")
        .agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "claim"))).alias("r"))
        .select("tree", F.col("block").alias("place"), F.col("r.doc_id").alias("ids"), F.col("r.leaf").alias("leaves"), F.col("r.claim").alias("claims"))
    )
    joined = _ways(manifest.tiers, top).join(of_block, ["tree", "place"]).select("height", "n", "nodes", "path", "roots", "ids", "leaves", "claims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                height, n, nodes, path, roots = (c[i].as_py() for c in batch.columns[:5])
                ids, leaves, claims = (c[i].values for c in batch.columns[5:])
                paths = [p + path for p in Block(nodes, n, height).paths()]
                ends = [folded(c, p) for c, p in zip(claims.to_pylist(), paths, strict=True)]
                columns = [
                    ids, leaves, pa.array([roots[:DIGEST]] * n, pa.binary()), pa.array([roots[DIGEST:]] * n, pa.binary()),
                    pa.array(map(proof_digest, paths), pa.string()), pa.array(ends, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded"])

    out = joined.mapInArrow(run, "doc_id BIGINT, leaf BINARY, subroot BINARY, root BINARY, proof_sha256 STRING, folded BINARY")
    text = {name: F.lower(F.hex(name)) for name in ("leaf", "subroot", "root", "folded")}
    return out.select(
        "doc_id", *(text[n].alias(n) for n in ("leaf", "subroot", "root")), "proof_sha256",
        text["folded"].alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
