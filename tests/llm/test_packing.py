"""Length buckets against all choices of bounds."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import docs, odd_docs
from tokenloom.llm.packing import best_bounds, histogram, pack
from tokenloom.llm.registry import table


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


@pytest.mark.parametrize("seed", range(6))
def test_bounds_are_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 40, 60)
    longest, n = np.unique(lengths, return_counts=True)
    for k in (1, 2, 3, 4):
        got = best_bounds(longest, n, longest * n, k)
        best = min(padding(lengths, [*c, longest[-1]]) for c in combinations(longest[:-1], min(k, len(longest)) - 1))
        assert len(got) <= k and got[-1] == longest[-1] and padding(lengths, got) == best


def test_few_lengths():
    one = np.array([7])
    assert best_bounds(one, np.array([3]), np.array([21]), 16) == [7]
    assert best_bounds(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 4) == []


def test_bins_hold_every_row_and_are_few(spark):
    rows = spark.range(1, 200_000, 7).select((F.col("id")).alias("length"))
    bins = histogram(rows).collect()
    assert sum(r.n for r in bins) == rows.count() and sum(r.total for r in bins) == rows.agg(F.sum("length")).first()[0]
    assert [r.longest for r in bins] == sorted(r.longest for r in bins) and len(bins) <= 64 * 18


def check(rows, got, budget):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1) for i, t in rows)
    batches = {}
    for r in got:
        assert 0 <= r.padding == r.bound - r.length
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), members in batches.items():
        assert sorted(r["row"] for r in members) == list(range(len(members)))
        assert len(members) * members[0].bound <= budget or len(members) == 1
        assert batch == 0 or len(batches[bucket, batch - 1]) == max(budget // members[0].bound, 1)
    return batches


def test_batches_of_all_documents(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    check([(r.doc_id, r.text) for r in df.collect()], pack(df, budget=20_000).collect(), 20_000)


def test_odd_rows_and_empty_table(spark):
    df, rows = odd_docs(spark)
    check(rows, pack(df, buckets=4, budget=2_000).collect(), 2_000)
    assert pack(docs(spark, [])).count() == 0
