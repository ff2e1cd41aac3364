"""Near-duplicates by SimHash fingerprints that lie within three bits of each other.

Fingerprints are matched by ball hashing that meets in the middle.  Half of three is not whole, so one differing bit is taken up
by erasing a group: the 64 bits form four groups of sixteen, and for each group in turn a fingerprint emits, with that group
erased, every variant of the other 48 bits within radius one.  Two fingerprints that differ in three bits or fewer either

* differ in two or fewer of the 48 bits, and in one or none of the erased ones, for some group: then they share a variant there; or
* differ in three bits of one group and nowhere else: then they share the plain 48 bits.

All members of a variant lie within one bit of it, so two of them differ in two of the 48 bits at most.  Members whose erased bits are equal,
or differ in one, are therefore linked, whoever they are: a variant's members fall into classes of erased values that one-bit steps join, and each
class is a star of links.  No pairs are formed within a class, however large.  Members that are the variant itself differ in
erased bits only; those up to three bits apart are linked as well.  Links are checked on the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.components import components
from tokenloom.llm.registry import written
from tokenloom.session import partitions_for

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Erased bits in turn, and variants of a fingerprint for each of them.
GROUP = 16
GROUPS = 64 // GROUP
VARIANTS = 1 + 64 - GROUP

#: Shingle hashes counted at a time.
SLICE = 1 << 16
#: Bytes that a variant takes in a shuffle, about.
VARIANT_BYTES = 24


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text: a bit is set if it is set in over half the hashes of its runs of three words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(len(words) - SHINGLE + 1, 1)
    if n == 1:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLICE):
        first, last = starts[at : min(at + SLICE, n)].tolist(), ends[at + SHINGLE - 1 : min(at + SLICE, n) + SHINGLE - 1].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``fp`` (the fingerprint's bits as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id BIGINT, fp BIGINT")


def _rotated(fps: np.ndarray, group: int) -> np.ndarray:
    """The bits with one group moved to the low end."""
    by = np.uint64(group * GROUP)
    return fps >> by | fps << (np.uint64(64) - by) if group else fps


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints, one for each variant: the 48 bits that are left, with the group's number where the erased bits were."""
    flips = np.concatenate([[0], 1 << np.arange(GROUP, 64, dtype=np.uint64)]).astype(np.uint64)
    keys = [((_rotated(fps, g) >> np.uint64(GROUP) << np.uint64(GROUP))[:, None] ^ flips | np.uint64(g)).reshape(-1) for g in range(GROUPS)]
    return np.concatenate(keys), np.tile(np.repeat(fps, VARIANTS), GROUPS)


_ERASED = np.uint64((1 << GROUP) - 1)
_ONE = [1 << i for i in range(GROUP)]
_THREE = [sum(1 << i for i in bits) for bits in combinations(range(GROUP), RADIUS)]


def _steps(seats: np.ndarray, masks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs among sorted seats (run number and erased bits) that lie in one run and differ by a mask."""
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for mask in masks:
        other = seats ^ mask
        at = np.minimum(np.searchsorted(seats, other), len(seats) - 1)
        hit = np.flatnonzero((seats[at] == other) & (seats < other))
        left.append(hit)
        right.append(at[hit])
    return np.concatenate(left), np.concatenate(right)


def links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that all variants found here give rise to; rows of one variant stand side by side.

    Their number follows that of the members, not that of their pairs: members of equal erased bits hang on the first of them, and a value has
    sixteen neighbours of one bit.
    """
    shared = np.zeros(len(keys), dtype=bool)
    shared[1:] = keys[1:] == keys[:-1]
    shared[:-1] |= shared[1:]
    keys, fps = keys[shared], fps[shared]
    if not len(keys):
        return fps, fps
    run = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    group = keys & np.uint64(GROUPS - 1)
    turned = np.empty_like(fps)
    for g in range(GROUPS):
        turned[group == g] = _rotated(fps[group == g], g)
    seat = run << GROUP | (turned & _ERASED).astype(np.int64)
    order = np.argsort(seat, kind="stable")
    seat, fps, central = seat[order], fps[order], (turned >> np.uint64(GROUP) == keys >> np.uint64(GROUP))[order]
    seats, first, which = np.unique(seat, return_index=True, return_inverse=True)
    others = np.flatnonzero(first[which] != np.arange(len(seat)))
    left, right = [fps[first[which[others]]]], [fps[others]]
    a, b = _steps(seats, _ONE)
    left.append(fps[first[a]])
    right.append(fps[first[b]])
    inner = np.flatnonzero(central)
    crowded = np.bincount(seat[inner] >> GROUP)[seat[inner] >> GROUP] > 1
    inner = inner[crowded]  # central members are distinct, and so are their erased bits
    if len(inner):
        a, b = _steps(seat[inner], _THREE)
        left.append(fps[inner[a]])
        right.append(fps[inner[b]])
    left, right = np.concatenate(left), np.concatenate(right)
    near = np.bitwise_count(left ^ right) <= RADIUS
    return left[near], right[near]


def _linked(distinct: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints ``fp`` that join all that lie within the radius."""
    n = distinct.count()
    tasks = max(partitions_for(distinct.sparkSession, n * GROUPS * VARIANTS * VARIANT_BYTES * 8), 1)  # sorted in memory

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, fps = variants(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps.view(np.int64))], names=["key", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        held, size = [], 0

        def found(keys, fps):
            a, b = links(keys, fps)
            pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1).view(np.int64)
            pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            held.append([c.to_numpy().view(np.uint64) for c in batch.columns])
            size += batch.num_rows
            if size >= SLICE * 4:
                keys, fps = (np.concatenate(x) for x in zip((keys, fps), *held))
                held, size = [], 0
                if keys[0] != keys[-1]:  # the last variant may go on
                    cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
                    yield found(keys[:cut], fps[:cut])
                    keys, fps = keys[cut:], fps[cut:]
        keys, fps = (np.concatenate(x) for x in zip((keys, fps), *held))
        yield found(keys, fps)

    emitted = distinct.select("fp").repartition(tasks, "fp").mapInArrow(emit, "key BIGINT, fp BIGINT")
    return emitted.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(join, "a BIGINT, b BIGINT").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 lowercase hex digits), ``component_id`` (the smallest id that links reach) for every row.

    Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased.  A text of fewer than three words has one shingle; null and
    wordless texts have fingerprint zero and are linked like any other.  Rows without an id link too but name nothing: a component
    without ids has a null name.  Rows of equal fingerprints are one node, so repeated rows share their component, and copies
    cost nothing beyond their first.  An empty table gives an empty result; other columns are left behind.  Very long
    texts are counted in slices.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("id")), "distinct-fingerprints")
    joined = components(written(_linked(nodes), "fingerprint-links"), "a", "b").select(F.col("node").alias("fp"), "component")
    members = written(nodes.join(joined, "fp"), "fingerprint-members")
    names = written(members.groupBy("component").agg(F.min("id").alias("name")), "fingerprint-names")
    named = members.join(names, "component").select("fp", "name")
    labels = written(nodes.join(named, "fp", "left").select("fp", F.coalesce("name", "id").alias("component_id")), "fingerprint-labels")
    return rows.join(labels, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
