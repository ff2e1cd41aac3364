import math

from pyspark.sql import functions as F

from tokenloom.functions.names import CHECKPOINT_PATTERN
from tokenloom.operators import runlog as rl

LINES = [
    "2024-01-02 03:04:05,678 trainer INFO step 7: loss 3.25, grad_norm 0.500000, lr 6.00e-04, dt 40000.50ms, tok/sec 13107.04",
    "step 8: loss nan, grad_norm inf, lr 6.00e-05, dt 1.00ms, tok/sec 1.00",
    "2024-01-02 03:04:06,001 trainer INFO step 100: validation loss 2.5",
    "Using gradient accumulation over 128 steps",
    "step x: loss 1, grad_norm 1, lr 1, dt 1ms, tok/sec 1",
    "",
]


def frame(spark):
    return spark.createDataFrame([(line,) for line in LINES], "line string")


def test_step_and_validation_lines(spark):
    first, second = rl.step_lines(frame(spark)).orderBy("step").collect()
    assert tuple(first) == (7, 3.25, 0.5, 6e-4, 40000.5, 13107.04)
    assert second.step == 8 and math.isnan(second.loss) and math.isinf(second.grad_norm)
    assert [tuple(r) for r in rl.val_lines(frame(spark)).collect()] == [(100, 2.5)]


def test_line_times(spark):
    times = [r.t for r in frame(spark).select(rl.line_time(F.col("line")).alias("t")).collect()]
    assert [t.microsecond if t else None for t in times] == [678000, None, 1000, None, None, None]


def schedule(step):
    first = rl.MAX_LR / rl.WARMUP_STEPS
    if step < rl.WARMUP_STEPS:
        return first + step * (rl.MAX_LR - first) / rl.WARMUP_STEPS
    done = min((step - rl.WARMUP_STEPS) / (rl.MAX_STEPS - rl.WARMUP_STEPS), 1)
    return rl.MIN_LR + (rl.MAX_LR - rl.MIN_LR) * (1 + math.cos(math.pi * done)) / 2


def test_learning_rate(spark):
    rows = spark.range(0, 14_000, 7).select("id", rl.learning_rate(F.col("id")).alias("lr")).collect()
    assert all(math.isclose(r.lr, schedule(r.id), rel_tol=1e-9) for r in rows)


def test_progress(spark):
    steps = spark.createDataFrame([(10, 50_000.0), (12, 0.0), (200, 1000.0)], "step bigint, dt_ms double")
    rows = rl.progress(steps, 0, 190, 524_288).orderBy("step").collect()
    assert (rows[0].eta_hours, rows[0].eta_minutes) == (2, 30)
    assert math.isclose(rows[0].tokens_per_sec, 10485.76) and math.isclose(rows[0].pct_done, 10 / 190 * 100)
    assert rows[1].tokens_per_sec is None
    assert (rows[2].eta_hours, rows[2].eta_minutes) == (-1, 59)


def test_mean_losses(spark):
    micro = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "step bigint, loss double")
    assert sorted(map(tuple, rl.mean_loss_by_step(micro).collect())) == [(1, 3.0, 2), (2, 5.0, 1)]
    rounds = spark.createDataFrame([(100, b, float(b)) for b in range(20)], "step bigint, batch bigint, loss double")
    assert tuple(rl.mean_validation_loss(rounds, 10).first()) == (100, 4.5, 10)


def test_latest_positions(spark):
    cursors = spark.createDataFrame(
        [("a", 50, 1, 2), ("a", 1000, 3, 4), ("b", 950, 5, 6), ("b", None, 7, 8)],
        "run string, step bigint, data_shard bigint, data_position bigint",
    )
    assert tuple(rl.latest_cursor(cursors).first()) == (1000, 3, 4)
    assert sorted(map(tuple, rl.latest_cursor(cursors, ("run",)).collect())) == [("a", 1000, 3, 4), ("b", 950, 5, 6)]
    assert rl.latest_cursor(cursors.where("step is null")).count() == 0


def test_checkpoint_numbers_compare_as_numbers(spark):
    paths = spark.createDataFrame([("c/step_950",), ("c/step_1000",), ("c/final",)], "path string")
    assert tuple(rl.latest_named(paths, CHECKPOINT_PATTERN).first()) == ("c/step_1000", 1000)
    assert rl.latest_named(paths.where("path = 'c/final'"), CHECKPOINT_PATTERN).count() == 0


def test_lines_read_back(spark):
    rows = spark.createDataFrame(
        [(3, 2.123456789, 0.5, 6e-4, 40000.25, 13107.04), (4, 1e-7, 0.25, 5.9e-4, 1.0, 2.0)],
        "step bigint, loss double, grad_norm double, lr double, dt_ms double, tok_per_sec double",
    )
    lines = rows.select(rl.step_line(*(F.col(c) for c in rows.columns)).alias("line"))
    assert sorted(map(tuple, rl.step_lines(lines).collect())) == sorted(map(tuple, rows.collect()))
    assert lines.first().line.startswith("step 3: loss 2.123456789, grad_norm 0.500000, lr 6.00e-04, dt 40000.25ms")
    val = rows.select(rl.val_line(F.col("step"), F.col("loss")).alias("line"))
    assert rl.val_lines(val).count() == 2 and rl.step_lines(val).count() == 0


def test_saved_cursors(spark, tmp_path):
    from tests import model
    from tests.test_batches import LENGTHS, SHAPE, in_order, shards_of
    from tokenloom.plans.cursors import Cursors

    cursors = Cursors(spark, str(tmp_path / "cursors"))
    assert cursors.latest("v1") is None
    shards = shards_of(spark, LENGTHS)
    assert in_order(cursors.resume(shards, "v1", SHAPE))[0] == (0, 0)
    cursors.save("v1", 950, 0, 256)
    cursors.save("v1", 1000, 4, 512)
    cursors.save("v2", 2000, 5, 0)
    assert tuple(cursors.latest("v1")) == (1000, 4, 512)
    got = in_order(cursors.resume(shards, "v1", SHAPE))
    assert got == model.read_order(LENGTHS, SHAPE.tokens, 4, 512, reads=len(got))
