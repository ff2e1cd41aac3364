import pytest
from pyspark.sql import functions as F

from tests import model
from tokenloom.operators import batches as bt
from tokenloom.operators import layout as lay
from tokenloom.operators import tokenizers as tk
from tokenloom.operators.shards import build_shards

SHAPE = bt.BatchShape(4, 64)
LENGTHS = [1000, 257, 256, 100, 1025, 513]


def shards_of(spark, lengths, split="train"):
    rows = [(split, i, n, list(range(i * 10_000, i * 10_000 + n))) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "split string, shard bigint, n_tokens bigint, tokens array<int>")


def in_order(df):
    rows = df.orderBy("global_batch").collect()
    assert [r.global_batch for r in rows] == list(range(len(rows)))
    return [(r.shard, r.data_position) for r in rows]


def test_schedule_is_what_a_reader_visits(spark):
    got = in_order(bt.schedule(shards_of(spark, LENGTHS), SHAPE, epochs=3))
    assert got == model.read_order(LENGTHS, SHAPE.tokens, reads=len(got))
    assert len(got) == 3 * sum(max(0, (n - 1) // SHAPE.tokens) for n in LENGTHS)


@pytest.mark.parametrize("shard, position", [(0, 0), (0, 256), (1, 0), (2, 0), (4, 300), (4, 512), (5, 256)])
def test_resume_continues_the_reading(spark, shard, position):
    got = in_order(bt.resume(shards_of(spark, LENGTHS), SHAPE, shard, position, more_epochs=2))
    assert got == model.read_order(LENGTHS, SHAPE.tokens, shard, position, reads=len(got))


def test_resume_on_a_batch_is_the_rest_of_the_schedule(spark):
    whole = in_order(bt.schedule(shards_of(spark, LENGTHS), SHAPE, epochs=2))
    for k in (0, 1, 3, 5, len(whole) // 2):
        rest = in_order(bt.resume(shards_of(spark, LENGTHS), SHAPE, *whole[k], more_epochs=1))
        assert rest[: len(whole) - k] == whole[k:]


def test_a_pass_that_is_over_goes_on_with_the_next(spark):
    got = in_order(bt.resume(shards_of(spark, LENGTHS), SHAPE, 6, 0))
    assert got == model.read_order(LENGTHS, SHAPE.tokens, reads=len(got))
    with pytest.raises(ValueError):
        bt.resume(shards_of(spark, LENGTHS), SHAPE, -1, 0)


def test_windows_shift_by_one_token(spark):
    shards = shards_of(spark, LENGTHS)
    windows = bt.batch_windows(shards, SHAPE).collect()
    for r in windows:
        start = r.shard * 10_000 + r.batch_in_shard * SHAPE.tokens
        assert r.x == list(range(start, start + SHAPE.tokens))
        assert r.y == [t + 1 for t in r.x]
    rows = bt.batch_rows(shards, SHAPE).collect()
    assert len(rows) == 4 * len(windows)
    flat = {}
    for r in sorted(rows, key=lambda r: r.row):
        flat.setdefault((r.shard, r.batch_in_shard), []).extend(zip(r.x, r.y))
    assert flat == {(r.shard, r.batch_in_shard): list(zip(r.x, r.y)) for r in windows}


def test_counts_and_tails(spark):
    rows = bt.batch_counts(shards_of(spark, [*LENGTHS, 1]), SHAPE).orderBy("shard").collect()
    assert [(r.batches, r.dropped) for r in rows] == [(3, 232), (1, 1), (0, 256), (0, 100), (4, 1), (2, 1), (0, 1)]
    full = bt.batch_counts(spark.createDataFrame([("train", 0, 1_000_000)], "split string, shard bigint, n_tokens bigint"), bt.BatchShape())
    assert (full.first().batches, full.first().dropped) == (244, 576)


def test_no_shuffle_makes_batches(spark):
    plan = bt.batch_rows(shards_of(spark, LENGTHS), SHAPE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_head_of_a_split(spark):
    shards = shards_of(spark, LENGTHS, "val").unionByName(shards_of(spark, [5000], "train"))
    head = bt.head_batches(shards, SHAPE, 5).orderBy("global_batch").collect()
    assert [(r.shard, r.batch_in_shard, r.global_batch) for r in head] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 3), (4, 0, 4)]
    assert head[4].x == list(range(40_000, 40_256))
    assert bt.head_batches(shards, SHAPE, 500).count() == 10
    with pytest.raises(ValueError):
        bt.head_batches(shards, SHAPE, 0)


def test_head_of_built_shards_by_arithmetic(spark):
    docs = spark.createDataFrame([(s, i, "abc" * 150) for s in range(1, 9) for i in range(20)], "source_no int, doc_ord bigint, text string")
    shape = bt.BatchShape(2, 32)
    for n in (1, 15, 16, 40, 500):
        whole = bt.head_batches(build_shards(docs, tk.codepoint(), 1000, 0.3), shape, n)
        holding = -(-n // shape.of_full_shard(1000))
        built = build_shards(docs, tk.codepoint(), 1000, 0.3, val_only=True, first_shards=holding)
        head = bt.head_batches(built, shape, n, shard_size=1000)
        assert sorted(map(tuple, head.collect())) == sorted(map(tuple, whole.collect()))
    assert bt.head_batches(built, bt.BatchShape(10, 100), 5, shard_size=1000).count() == 0
    plan = bt.head_batches(built, shape, 5, shard_size=1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4 and plan.count("shufflepartitionidpassthrough(") == 1


def test_steps(spark):
    assert bt.BatchShape().per_step() == 128
    with pytest.raises(ValueError, match="no multiple"):
        bt.BatchShape(3, 2048).per_step()
    manifest = bt.step_manifest(bt.schedule(shards_of(spark, LENGTHS), SHAPE), 4)
    got = [(r.step, r.micro_step) for r in manifest.orderBy("global_batch").collect()]
    assert got == [divmod(i, 4) for i in range(10)]


def test_lineage_accounts_for_every_input_token(spark):
    docs = [(s, i, "x" * ((i * 37) % 190)) for s in (1, 2) for i in range(60)]
    df = spark.createDataFrame(docs, "source_no int, doc_ord bigint, text string")
    shape, size, per_step, ratio = bt.BatchShape(2, 8), 500, 3, 0.1
    rows, _ = lay.token_rows(df, tk.codepoint())
    sums = lay.global_offsets(rows.select("source_no", "doc_ord", "n"))
    plan = lay.SplitPlan.over(sums.total("n"), ratio, size)
    got = {}
    for r in bt.step_lineage(sums.rows, plan, shape, per_step).collect():
        key = (r.split, r.step, r.source_no, r.doc_ord)
        got[key] = got.get(key, 0) + r.n_tokens

    owners = []
    for source in (1, 2):
        mine = [d for d in docs if d[0] == source]
        for _, order, text in mine:
            owners += [(source, order)] * len(text)
        owners.append((source, max(d[1] for d in mine) + 1))
    expected = {}
    for split in ("val", "train"):
        batch = 0
        for (name, _), part in sorted(model.shards(owners, size, ratio).items()):
            if name != split:
                continue
            for b in range(max(0, (len(part) - 1) // shape.tokens)):
                for owner in part[b * shape.tokens : (b + 1) * shape.tokens]:
                    key = (split, batch // per_step, *owner)
                    expected[key] = expected.get(key, 0) + 1
                batch += 1
    assert got == expected


def test_arithmetic_numbers_equal_the_schedule(spark):
    docs = spark.createDataFrame([(1, i, "ab" * 150) for i in range(40)], "source_no int, doc_ord bigint, text string")
    shards = build_shards(docs, tk.codepoint(), 1000, 0.1)
    shape = bt.BatchShape(2, 32)
    keys = ["split", "shard", "batch_in_shard", "global_batch"]
    numbered = bt.numbered_batches(shards, shape, 1000).select(keys)
    scheduled = bt.schedule(shards, shape).select(keys)
    assert sorted(map(tuple, numbered.collect())) == sorted(map(tuple, scheduled.collect()))
    assert numbered.agg(F.countDistinct("split")).first()[0] == 2
