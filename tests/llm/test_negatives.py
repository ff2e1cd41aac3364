"""Hard negatives against brute force, and the threshold index against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import QUERIES, negatives

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, id STRING, vec INT, score INT, `rank` INT, windows INT"


def frame(spark, rows):
    """Rows of (vec_id, embedding, label) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "x", 2, 3, 4, 5) for r in rows], SCHEMA)


def brute(rows):
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    anchors = {}
    for i, v, label in good:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (v, label)), (v, label))
    out = []
    for a, (av, alabel) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, label) for i, v, label in good if len(v) == len(av))
        for which, (p, positive, _) in enumerate([s for s in scored if s[2] == alabel and s[1] != a][:5]):
            fitting = [s for s in scored if s[2] != alabel and 30 * -p <= 100 * -s[0] <= 90 * -p]
            out += [(a, positive, rank, s[1], -p, -s[0]) for rank, s in enumerate(fitting[:10], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(10, 24))
    labels = rng.integers(0, 10, 1600)
    vectors = 0.4 * centres[labels] + rng.normal(size=(1600, 24))
    vectors[300:800] = vectors[5]  # a third are one vector, five anchors among them
    vectors[900:905] = 0
    out = [(i, [float(x) for x in v.astype(np.float32)], int(k)) for i, (v, k) in enumerate(zip(vectors, labels))]
    v = out[3][1]
    out += [(None, v, 1), (5000, None, 1), (5001, [1.0, None] * 12, 1), (5002, [float("nan")] * 24, 1), (5003, [math.inf] * 24, 2), (5004, [], 1), (5005, v, None)]
    out += [(17, v, 4), (17, v, 4), (200, v, 4), (200, out[9][1], 5)]
    out += [(6000 + i, [float(i % 4), 1.0, -1.0], i % 3) for i in range(12)] + [(7000, [1.0] * 5, 1), (7100, [-1.0, 2.0], 1), (7101, [1.0, -3.0], 1), (7102, [1.0, -2.0], 2)]
    return out


def query(spark, path, df):
    df.write.parquet(f"{path}/embeddings.parquet")
    got = QUERIES["op13_hard_negatives"](spark, str(path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_equals_brute_force(spark, rows, tmp_path):
    want = brute(rows)
    assert len({r[0] for r in want}) > 10
    assert query(spark, tmp_path, frame(spark, rows).repartition(4)) == want


def test_small_windows_and_one_row_a_third_of_the_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)], i % 4) for i in range(400)]
    rows += [(41, rows[41][1], 1)] * 200
    assert query(spark, tmp_path, frame(spark, rows)) == brute(rows)


def test_tables_that_give_nothing(spark):
    label = F.col("label")
    for some in ([], [(0, [1.0, 2.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)], [(100, None, 1)]):
        assert negatives.mine(frame(spark, some), label).count() == 0


def test_components_too_large_are_refused(spark):
    rows = [(0, [1e9, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 2)]
    with pytest.raises(Exception, match="too large"):
        negatives.mine(frame(spark, rows), F.col("label")).collect()


@pytest.mark.parametrize("seed", range(4))
def test_joins_find_every_row_that_reaches_the_threshold(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-200, 200, (700, 19)) // rng.integers(1, 30, (700, 1))
    rows[:50] = 0
    rows[50:200] = rows[300]
    queries = rng.integers(-100, 100, (25, 19))
    queries[3] = 0
    exact = queries @ rows.T
    for share in (-1.0, 0.0, 0.1, 0.4, 0.9):
        thresholds = share * exact.max(axis=1).astype(float)
        norms = np.maximum(np.linalg.norm(queries, axis=1), 1e-300)
        index = negatives.ThresholdIndex(rows, float((thresholds / norms).min()))
        for q, (found, scores) in enumerate(index.reaching(queries, thresholds)):
            assert sorted(found.tolist()) == np.flatnonzero(exact[q] >= thresholds[q]).tolist()
            assert np.array_equal(scores, exact[q][found])


def test_bounds_leave_dimensions_and_rows_out():
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(2000, 32)) * 0.7 ** np.arange(32) * 1000).astype(np.int64)
    index = negatives.ThresholdIndex(rows, 1500.0)
    assert (index.kept == 0).sum() > 500
    assert index.kept.sum() < 0.2 * rows.size


def test_windows_lower_their_thresholds_until_they_fill(monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.integers(-100, 100, (3000, 16))
    queries = rng.integers(-100, 100, (6, 16))
    asked = []
    reaching = negatives.ThresholdIndex.reaching
    monkeypatch.setattr(negatives.ThresholdIndex, "reaching", lambda self, q, t: asked.append(len(q)) or reaching(self, q, t))
    ids, allowed = np.arange(3000), np.ones((6, 3000), dtype=bool)
    exact = queries @ rows.T
    high = np.array([10**6, 10**6, 1000, 0, 50, 20_000])
    low = np.array([0, -(10**6), 990, 0, -50, 10_000])
    w, found, scores = negatives.best_in_windows(rows, ids, allowed, queries, np.arange(6), low, high, 10)
    for k in range(6):
        fitting = sorted((-s, i) for i, s in enumerate(exact[k].tolist()) if low[k] <= s <= high[k])[:10]
        assert [(-s, i) for s, i in zip(scores[w == k].tolist(), found[w == k].tolist())] == fitting
    assert len(asked) > 1 and asked == sorted(asked, reverse=True)
