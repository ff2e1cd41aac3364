import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators.ordering import every_nth, ordinals, running_sums
from tokenloom.sources.catalog import sorted_positions


def rows_with_a_hot_key(n=600):
    rng = random.Random(3)
    keys = [(0 if rng.random() < 0.4 else rng.randint(1, 6), rng.randint(0, 1 << 34)) for _ in range(n)]
    return sorted({k: rng.randint(0, 9) for k in keys}.items())


@pytest.mark.parametrize("bits", [(1, 1), (3, 2), (12, 16), (30, 2), (0, 5)])
def test_global_sums(spark, bits):
    rows = rows_with_a_hot_key()
    df = spark.createDataFrame([(a, b, n) for (a, b), n in rows], "a int, b bigint, n bigint")
    sums = running_sums(df.repartition(5), {"n": "before"}, "b", ["a"], block_bits=bits[0], group_bits=bits[1])
    got = [r.before for r in sums.rows.orderBy("a", "b").collect()]
    expected, total = [], 0
    for _, n in rows:
        expected.append(total)
        total += n
    assert got == expected
    assert spark.range(1).select(sums.total("n").alias("t")).first().t == total


def test_restarting_sums(spark):
    rows = rows_with_a_hot_key()
    df = spark.createDataFrame([(a, b, n) for (a, b), n in rows], "a int, b bigint, n bigint")
    sums = running_sums(df, {"n": "before"}, "b", restart=["a"], block_bits=2, group_bits=2)
    expected, at, total = [], None, 0
    for (a, _), n in rows:
        at, total = (at, total) if a == at else (a, 0)
        expected.append(total)
        total += n
    assert [r.before for r in sums.rows.orderBy("a", "b").collect()] == expected
    assert sums.rows.count() == len(rows)


def test_a_row_without_place_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, 1), (None, 2, 1)], "a int, b bigint, n bigint")
    with pytest.raises(Exception, match="order key a is NULL"):
        running_sums(df, {"n": "before"}, "b", ["a"]).rows.collect()


def test_no_window_holds_a_whole_source(spark):
    df = spark.range(10).select(F.lit(1).alias("a"), F.col("id").alias("b"), F.lit(1).cast("bigint").alias("n"))
    plan = running_sums(df, {"n": "s"}, "b", ["a"]).rows._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    for line in windows:
        assert "__block" in line or "__group" in line


def test_ordinals_and_samples(spark):
    df = spark.createDataFrame([(b * 3,) for b in range(1000)], "b bigint").withColumn("n", F.lit(2).cast("bigint"))
    assert [r.o for r in ordinals(df, "b", "o").orderBy("b").collect()] == list(range(1, 1001))
    samples = every_nth(df, 250, {"n": "sum"}, "b").orderBy("b").collect()
    assert [(r.ordinal, r.sum) for r in samples] == [(250, 500), (500, 1000), (750, 1500), (1000, 2000)]


def test_sorted_positions_are_dense(spark):
    names = [f"p/{i:x}" for i in range(500)]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = sorted_positions(df, "path", "at", partitions=7).collect()
    assert {r.path: r["at"] for r in got} == {n: i for i, n in enumerate(sorted(names))}


def test_thin_joins_agree_however_they_run(spark):
    from tokenloom.session import join_thin

    big = spark.range(200).select((F.col("id") % 3).alias("k"), "id").where("k < 2 or id > 150")
    thin = spark.createDataFrame([(0, "a"), (2, "b"), (5, "c")], "k bigint, v string")
    for how in ("inner", "left_semi", "left_anti"):
        small, salted = (join_thin(big, thin, ["k"], how, F.col("id"), limit) for limit in (10, 2))
        expected = big.join(thin, "k", how).orderBy("id").collect()
        assert small.orderBy("id").collect() == salted.orderBy("id").collect() == expected
        plan = salted._jdf.queryExecution().optimizedPlan().toString()
        assert "__salt" in plan


def test_only_an_input_too_small_for_the_cores_is_spread(spark, monkeypatch):
    from tokenloom import session

    df = spark.range(10)
    assert session.estimated_bytes(df) == 80
    assert session.estimated_bytes(df.join(spark.range(5), "id")) == 120
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(df) is not df and session.row_partitions(df, 2.0) == cores
    unknown = spark.createDataFrame([(1,)], "id int")
    assert session.spread(unknown) is unknown and session.row_partitions(unknown, 2.0) is None
    monkeypatch.setattr(session, "estimated_bytes", lambda _: 1 << 40)
    assert session.spread(df) is df
    assert session.row_partitions(df, 2.0) == (2 << 40) // session.TARGET_BYTES
    monkeypatch.setattr(session, "estimated_bytes", lambda _: 1 << 50)
    assert session.row_partitions(df, 2.0) == session.MAX_PARTITIONS


def test_hash_like_orders_meet_no_large_window(spark):
    rng = random.Random(5)
    rows = [(b, 1) for b in sorted(rng.sample(range(1 << 62), 3000))]
    df = spark.createDataFrame(rows, "b bigint, n bigint")
    sums = running_sums(df, {"n": "before"}, "b", group_bits=8)  # more blocks than one window is to hold
    assert [r.before for r in sums.rows.orderBy("b").collect()] == list(range(3000))
    plan = sums.rows._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 9  # 52 bits of blocks by eight: six levels of groups and the blocks, the rows, and none without a key but the top
    top = [line for line in windows if "__group7" in line and "__group6" not in line]
    assert len(top) == 1 and all("__block" not in line for line in top)


def test_few_blocks_need_one_window_and_rows_are_read_twice(spark):
    df = spark.range(5000).select(F.col("id").alias("b"), F.lit(2).cast("bigint").alias("n"))
    sums = running_sums(df, {"n": "before"}, "b")
    plan = sums.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("Range (") == 1
    assert sums.totals == {"n": 10_000}


def test_rows_before_a_limit(spark):
    rows = rows_with_a_hot_key()
    df = spark.createDataFrame([(a, b, n) for (a, b), n in rows], "a int, b bigint, n bigint")
    sums = running_sums(df, {"n": "before"}, "b", ["a"], block_bits=20)
    want = sorted((r.a, r.b, r.before) for r in sums.rows.collect())
    for limit in (0, 1, 700, 10**9):
        got = sorted((r.a, r.b, r.before) for r in sums.rows_before("n", limit).collect())
        assert got == want[: len(got)] and [r for r in want if r[2] < limit] == [r for r in got if r[2] < limit]
    assert len(sums.rows_before("n", 1).collect()) < len(want) / 2
