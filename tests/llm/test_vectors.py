"""The two vector searches against brute force."""

import math

import numpy as np
import pytest

from tokenloom.llm import ann, topk
from tokenloom.llm.blocks import take_best
from tokenloom.llm.topk import ImpactIndex

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, id STRING, vec INT, score INT"


def frame(spark, rows):
    """Rows of (vec_id, embedding) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = centres[rng.integers(0, 20, 1500)] + rng.normal(scale=0.3, size=(1500, 16))
    vectors[200:700] = vectors[7]  # a third are one vector, two queries among them
    out = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(vectors)]
    out += [(None, out[0][1]), (5000, None), (5001, [1.0, None] * 8), (5002, [float("nan")] * 16), (5003, [math.inf] * 16)]
    out += [(5004, []), (5100, [0.0] * 16), (17, out[3][1]), (17, out[3][1])]
    out += [(6000 + i, [float(i), 1.0, -1.0]) for i in range(5)]  # another dimension
    return out


def brute(rows, k, every, measure, ascending, drop_zero):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    if drop_zero:
        good = [(i, v) for i, v in good if v.any()]
    out = {}
    for q, qv in good:
        if q % every == 0:
            found = [(measure(qv, v), i) for i, v in good if i != q and len(v) == len(qv)]
            found.sort(key=lambda x: (x[0] if ascending else -x[0], x[1]))
            out[q] = [(i, s) for s, i in found[:k]]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_inner_products_are_exact(spark, rows):
    def integers(v):
        return np.floor(1024 * v).astype(np.int64)

    want = brute(rows, 10, 100, lambda a, b: int(integers(a) @ integers(b)), False, False)
    assert collected(topk.highest(frame(spark, rows))) == want


def test_nearest_recall_and_distances(spark, rows):
    want = brute(rows, 10, 100, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), True, True)
    got = collected(ann.nearest(frame(spark, rows)))
    assert got.keys() == want.keys()
    vectors = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and None not in v}
    hits = 0
    for q, found in got.items():
        assert len(found) == len(want[q])
        assert [i for i, _ in found] != [] and q not in [i for i, _ in found]
        for i, s in found:
            assert s == pytest.approx(float(np.linalg.norm(vectors[q] - vectors[i])), abs=1e-12)
        hits += len(set(found) & set(want[q])) if q >= 6000 or q in (200, 300) else sum(s <= want[q][-1][1] + 1e-12 for _, s in found)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert ann.nearest(empty).count() == 0 and topk.highest(empty).count() == 0
    only = frame(spark, [(0, [1.0, 2.0])])
    assert ann.nearest(only).count() == 0 and topk.highest(only).count() == 0


def test_substring_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (3000, 4), dtype=np.uint8)
    codes[:1000] = codes[0] ^ (1 << rng.integers(0, 8, (1000, 4), dtype=np.uint8))
    index = ann.SubstringIndex(codes)
    for radius in (0, 1, 3, 4, 5, 8, 11, 32):
        want = np.flatnonzero(ann.hamming(codes, codes[0]) <= radius)
        assert np.array_equal(index.within(codes[0], radius), want)


def test_members_hold_every_top_row_and_leave_others_out():
    rng = np.random.default_rng(6)
    integers = rng.integers(-500, 500, (4000, 8))
    integers[:300] = integers[5]
    queries = rng.integers(-500, 500, (20, 8))
    members = ImpactIndex(integers).members(queries, np.zeros((20, 4000), dtype=bool), 10)
    ids = np.arange(4000)
    for q, rows_ in zip(queries, members):
        exact = integers @ q
        assert set(take_best(exact, ids, 10, False)) <= set(rows_)
    assert sum(map(len, members)) < 20 * 1000


