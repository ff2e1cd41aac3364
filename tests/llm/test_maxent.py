"""The language model: base scores by hand, probabilities that sum to one, and gain on texts held out."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import docs, odd_docs
from tokenloom.llm import QUERIES, maxent
from tokenloom.llm.registry import table


def plain(rows, training):
    counts = Counter()
    words = lambda t: [*(t or "").encode().lower().split(), None]
    for i, t in rows:
        if training(i):
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    total = math.log10(n + 0.5 * (v + 1))
    return n, [(len(words(t)), sum(counts[w] > 0 for w in words(t)), sum(math.log10(counts[w] + 0.5) - total for w in words(t))) for _, t in rows]


def agrees(got, rows, training):
    n, want = plain(rows, training)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens) for r in got), key=key)
    want = sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-9) and g[5] == n and math.isfinite(g[4]) and g[4] <= 0


@pytest.mark.parametrize("head", [5, 200_000])
def test_base_scores(spark, head):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    got = maxent.score(df, maxent.fold(df["doc_id"], 5) != 1, head=head).collect()
    agrees(got, [(r.doc_id, r.text) for r in df.collect()], lambda i: zlib.crc32(str(i).encode()) % 5 != 1)


def test_odd_rows_no_training_and_empty_table(spark):
    df, rows = odd_docs(spark)
    agrees(maxent.score(df, maxent.fold(df["doc_id"], 5) != 1).collect(), rows, lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1)
    agrees(maxent.score(df, df["doc_id"] < 0).collect(), rows, lambda i: False)
    none = docs(spark, [])
    assert maxent.score(none, none["doc_id"] > 0).count() == 0


def test_class_shares_sum_to_one_and_learning_follows_the_gradient():
    rng = np.random.default_rng(3)
    weights = maxent.Weights(rng.normal(size=maxent.CLASSES), rng.normal(size=(maxent.FEATURES, maxent.CLASSES)).astype(np.float32))
    at = rng.integers(0, 300, (500, 3))
    assert np.exp(weights.log_shares(at)).sum(axis=1) == pytest.approx(1, abs=1e-5)
    classes, squares = at[:, 0] % 7, np.zeros(maxent.FEATURES, dtype=np.float32)
    before = weights.log_shares(at)[np.arange(500), classes].mean()
    for _ in range(20):
        weights.learn(at, classes, squares)
    assert weights.log_shares(at)[np.arange(500), classes].mean() > before + 1


def test_history_does_not_cross_texts():
    texts = ["a b c", "", "d", "a b c"]
    (_, ids, classes, bounds), = maxent.tokens(pa.array(texts))
    at = maxent.features(ids, bounds)
    assert bounds.tolist() == [0, 4, 5, 7, 11] and classes[bounds[1:] - 1].tolist() == [maxent.END_CLASS] * 4
    assert np.array_equal(at[0:4], at[7:11]) and np.array_equal(at[0], at[4]) and np.array_equal(at[0], at[5])


def test_model_beats_base_on_held_out_texts(spark):
    got = QUERIES["op9_maxent"](spark, "/root/testdata/sf0.1").toPandas()
    for held_out in (True, False):
        part = got[got.held_out == held_out]
        assert part.score.sum() > 0.99 * part.base_score.sum()  # both negative: at least 1 % better


def test_head_is_bounded(spark):
    known = spark.createDataFrame([(i, 0, 1000 // (i + 1) + 1) for i in range(500)], "word BIGINT, class INT, c BIGINT")
    for head in (0, 1, 7, 100, 499, 500, 10_000):
        taken = known.where(known["c"] >= maxent._least_count(known, head)).count()
        assert taken <= head and (head < 500 or taken == 500)
