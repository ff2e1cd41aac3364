"""Metrics from run logs."""

from pyspark.sql import functions as F

from tokenloom.functions.names import int_div
from tokenloom.operators import runlog as rl
from tokenloom.operators.batches import STEP_TOKENS, VAL_BATCHES
from tokenloom.plans import fixtures as fx
from tokenloom.plans.registered.registry import query

_STEP = r"step ([0-9]+): loss ([-0-9.e+]+), grad_norm ([0-9.]+), lr ([0-9.e+-]+), dt ([0-9.]+)ms, tok/sec ([0-9.]+)$"
_LOG = fx.for_check(fx.LOG)
_PARSED = f"""SELECT CAST(regexp_extract(line, '{_STEP}', 1) AS BIGINT) AS step,
    CAST(regexp_extract(line, '{_STEP}', 2) AS DOUBLE) AS loss, CAST(regexp_extract(line, '{_STEP}', 3) AS DOUBLE) AS grad_norm,
    CAST(regexp_extract(line, '{_STEP}', 4) AS DOUBLE) AS lr, CAST(regexp_extract(line, '{_STEP}', 5) AS DOUBLE) AS dt_ms,
    CAST(regexp_extract(line, '{_STEP}', 6) AS DOUBLE) AS tok_per_sec FROM ({_LOG})"""


@query("runlog_steps", _PARSED)
def _(spark, sf_dir):
    return rl.step_lines(fx.fixture(spark, sf_dir, fx.LOG))


@query(
    "runlog_vals",
    f"""SELECT step, CAST(regexp_extract(line, 'validation loss (.*)$', 1) AS DOUBLE) AS val_loss
    FROM ({fx.for_check(fx.VAL_LOG)}) WHERE line LIKE '%validation loss%'""",
)
def _(spark, sf_dir):
    return rl.val_lines(fx.fixture(spark, sf_dir, fx.VAL_LOG))


@query(
    "runlog_progress",
    f"""SELECT step, round({STEP_TOKENS} / (dt_ms / 1000.0::DOUBLE), 6) AS tokens_per_sec,
    round(step / {rl.MAX_STEPS}.0::DOUBLE * 100, 6) AS pct_done,
    CAST(floor(eta / 3600) AS BIGINT) AS eta_hours, CAST(floor((eta - floor(eta / 3600) * 3600) / 60) AS BIGINT) AS eta_minutes
    FROM (SELECT *, ({rl.MAX_STEPS} - step) * (dt_ms / 1000.0::DOUBLE) AS eta FROM ({_PARSED}))""",
)
def _(spark, sf_dir):
    steps = rl.step_lines(fx.fixture(spark, sf_dir, fx.LOG))
    done = rl.progress(steps, 0, rl.MAX_STEPS, STEP_TOKENS)
    return done.withColumns({c: F.round(c, 6) for c in ("tokens_per_sec", "pct_done")})


@query(
    "lr_schedule",
    f"""SELECT step, round(CASE WHEN step < {rl.WARMUP_STEPS}
      THEN 6e-4::DOUBLE / {rl.WARMUP_STEPS} + step * (6e-4::DOUBLE - 6e-4::DOUBLE / {rl.WARMUP_STEPS}) / {rl.WARMUP_STEPS}
      ELSE 6e-5::DOUBLE + 0.5 * (1 + cos(pi() * least((step - {rl.WARMUP_STEPS}) / {rl.MAX_STEPS - rl.WARMUP_STEPS}.0::DOUBLE, 1)))
           * (6e-4::DOUBLE - 6e-5::DOUBLE) END, 12) AS lr
    FROM (SELECT event_id AS step FROM events)""",
)
def _(spark, sf_dir):
    steps = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("step"))
    return steps.select("step", F.round(rl.learning_rate(F.col("step")), 12).alias("lr"))


@query(
    "runlog_micro_mean",
    """SELECT CAST(event_id // 128 AS BIGINT) AS step, round(avg(value), 6) AS loss, count(*) AS micro_steps
    FROM events GROUP BY 1""",
)
def _(spark, sf_dir):
    micro = fx.table(spark, sf_dir, "events").select(int_div(F.col("event_id"), 128).alias("step"), F.col("value").alias("loss"))
    return rl.mean_loss_by_step(micro).withColumn("loss", F.round("loss", 6))


@query(
    "runlog_val_mean",
    f"""SELECT CAST(event_id // 25 AS BIGINT) AS step, round(avg(value), 6) AS val_loss, count(*) AS batches
    FROM events WHERE event_id % 25 < {VAL_BATCHES} GROUP BY 1""",
)
def _(spark, sf_dir):
    rounds = fx.table(spark, sf_dir, "events").select(
        int_div(F.col("event_id"), 25).alias("step"), (F.col("event_id") % 25).alias("batch"), F.col("value").alias("loss")
    )
    return rl.mean_validation_loss(rounds, VAL_BATCHES).withColumn("val_loss", F.round("val_loss", 6))
