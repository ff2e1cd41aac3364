"""The hash ring against a walk done one row at a time, and its promises."""

import zlib
from collections import defaultdict

import pytest
import xxhash

from tests.llm.fixtures import docs, odd_docs
from tokenloom.llm.registry import table
from tokenloom.llm.sharding import CELLS, ring, shard

SF_DIR = "/root/testdata/sf0.001"


def _hash(text):
    return xxhash.xxh64((text or "").encode(), seed=42).intdigest()


def model(cells, rows, shards, slack):
    """Bytes of each shard by the walk on sums of arcs, and for each arc the shards it may go to."""
    arc_of = {r.cell: r.arc for r in cells}
    owner = {r.arc: r.owner for r in cells}
    loads = defaultdict(int)
    for _, t in rows:
        loads[arc_of[_hash(t) >> 48]] += len((t or "").encode()) + 8
    bound = -(-sum(loads.values()) * (1 + slack) // shards)
    room, cut = {s: bound for s in range(shards)}, defaultdict(list)
    for arc in sorted(owner):
        kept = min(loads[arc], room[owner[arc]])
        room[owner[arc]] -= kept
        if kept:
            cut[arc].append((owner[arc], kept))
        loads[arc] -= kept
    for arc in sorted(owner):
        at = arc
        while loads[arc] > 0:
            at = (at + 1) % len(owner)
            taken = min(loads[arc], room[owner[at]])
            if taken > 0:
                cut[arc].append((owner[at], taken))
                room[owner[at]] -= taken
                loads[arc] -= taken
    return arc_of, cut


@pytest.mark.parametrize("shards,points,slack", [(24, 64, 0.002), (5, 3, 0.1), (1, 1, 0.0)])
def test_placement_follows_the_walk(spark, shards, points, slack):
    rows = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").collect()]
    arc_of, cut = model(ring(spark, shards, points).collect(), rows, shards, slack)
    got = {r.doc_id: r for r in shard(table(spark, SF_DIR, "documents"), shards, points, slack).collect()}
    assert got.keys() == {i for i, _ in rows}
    placed = defaultdict(int)
    for i, t in rows:
        parts = cut[arc_of[_hash(t) >> 48]]
        assert got[i]["shard"] in {s for s, _ in parts}
        assert got[i].size == len(t.encode()) + 8 and got[i].text_crc32 == zlib.crc32(t.encode())
        placed[arc_of[_hash(t) >> 48], got[i]["shard"]] += got[i].size
    largest = max(r.size for r in got.values())
    for arc, parts in cut.items():
        for s, taken in parts:
            assert abs(placed[arc, s] - taken) <= largest


def test_cells_cover_the_ring(spark):
    cells = ring(spark, 24, 64).collect()
    assert sorted(r.cell for r in cells) == list(range(CELLS))
    assert len({r.owner for r in cells}) == 24


def test_slots_sizes_and_equal_texts(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    got = shard(df).toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    by_shard = got.groupby("shard")["size"].sum()
    assert len(by_shard) == 24 and by_shard.max() - by_shard.min() <= 3 * got["size"].max()
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).mean() > 0.98


def test_one_text_in_a_third_of_all_rows_is_split_where_shards_are_full(spark):
    rows = [(i, "the same text again") for i in range(400)] + [(1000 + i, f"text number {i}") for i in range(800)]
    got = shard(docs(spark, rows)).toPandas()
    by_shard = got.groupby("shard")["size"].sum()
    assert by_shard.max() - by_shard.min() <= 4 * got["size"].max()


def test_odd_rows_and_empty_table(spark):
    df, rows = odd_docs(spark)
    got = shard(df).collect()
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 8 for _, t in rows)
    assert [(r.size, r.text_crc32) for r in got if r.doc_id == 0] == [(8, 0)]
    assert shard(docs(spark, [])).count() == 0
