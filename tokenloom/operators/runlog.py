"""Metrics of training runs, read from their log lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.names import int_div

# The shapes of log lines; a time stamp and logger name may come first.
_NUMBER = r"(nan|-?inf|[0-9.eE+-]+)"
STEP_LINE = rf"step ([0-9]+): loss {_NUMBER}, grad_norm {_NUMBER}, lr {_NUMBER}, dt {_NUMBER}ms, tok/sec {_NUMBER}$"
VAL_LINE = rf"step ([0-9]+): validation loss {_NUMBER}$"
LINE_TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}),([0-9]{3}) "

# The learning-rate schedule.
MAX_LR = 6e-4
MIN_LR = MAX_LR * 0.1
WARMUP_STEPS = 715
MAX_STEPS = 13179


def _double(line: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(line, pattern, group).try_cast("double")


def step_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Step metrics of the lines that are step lines."""
    c = F.col(line)
    names = ["loss", "grad_norm", "lr", "dt_ms", "tok_per_sec"]
    return lines.where(c.rlike(STEP_LINE)).select(
        F.regexp_extract(c, STEP_LINE, 1).try_cast("bigint").alias("step"),
        *[_double(c, STEP_LINE, i + 2).alias(name) for i, name in enumerate(names)],
    )


def val_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    c = F.col(line)
    return lines.where(c.rlike(VAL_LINE)).select(
        F.regexp_extract(c, VAL_LINE, 1).try_cast("bigint").alias("step"),
        _double(c, VAL_LINE, 2).alias("val_loss"),
    )


def step_line(step: Column, loss: Column, grad_norm: Column, lr: Column, dt_ms: Column, tok_per_sec: Column) -> Column:
    """The log line of a step; ``step_lines`` reads it back."""
    metrics = F.format_string(", grad_norm %.6f, lr %.2e, dt %.2fms, tok/sec %.2f", grad_norm, lr, dt_ms, tok_per_sec)
    return F.concat(F.lit("step "), step.cast("string"), F.lit(": loss "), loss.cast("string"), metrics)


def val_line(step: Column, val_loss: Column) -> Column:
    return F.concat(F.lit("step "), step.cast("string"), F.lit(": validation loss "), val_loss.cast("string"))


def line_time(line: Column) -> Column:
    """The time stamp of a log line, NULL where it has none."""
    text = F.concat(F.regexp_extract(line, LINE_TIME, 1), F.lit("."), F.regexp_extract(line, LINE_TIME, 2))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS"))


def progress(steps: DataFrame, start_step: int, max_steps: int, step_tokens: int) -> DataFrame:
    """Tokens per second, per cent done and time left after each step."""
    total = max_steps - start_step
    elapsed = F.col("step") - start_step
    eta = (F.lit(total) - elapsed).cast("double") * (F.col("dt_ms") / 1000.0)
    pct = elapsed.cast("double") / F.lit(float(total)) * 100.0 if total > 0 else F.lit(0.0)
    return steps.select(
        "step",
        F.try_divide(F.lit(float(step_tokens)), F.col("dt_ms") / 1000.0).alias("tokens_per_sec"),
        pct.alias("pct_done"),
        F.floor(eta / 3600.0).cast("bigint").alias("eta_hours"),
        # the floored remainder: positive also past the planned end
        F.floor(F.pmod(eta, F.lit(3600.0)) / 60.0).cast("bigint").alias("eta_minutes"),
    )


def learning_rate(
    step: Column,
    max_lr: float = MAX_LR,
    min_lr: float = MIN_LR,
    warmup: int = WARMUP_STEPS,
    max_steps: int = MAX_STEPS,
) -> Column:
    """Linear warm-up from ``max_lr / warmup``, then half a cosine down to ``min_lr``."""
    first = max_lr / warmup
    s = step.cast("double")
    done = F.least((s - float(warmup)) / float(max_steps - warmup), F.lit(1.0))
    falling = F.lit(min_lr) + (F.cos(done * math.pi) + 1.0) * 0.5 * (max_lr - min_lr)
    return F.when(step < warmup, s * ((max_lr - first) / warmup) + first).otherwise(falling)


def mean_loss_by_step(micro: DataFrame) -> DataFrame:
    """Loss of a step as the mean over its micro-steps."""
    return micro.groupBy("step").agg(F.avg("loss").alias("loss"), F.count("*").alias("micro_steps"))


def mean_validation_loss(rounds: DataFrame, first_batches: int) -> DataFrame:
    """Mean over the first batches of every validation round ``(step, batch, loss)``."""
    return (
        rounds.where(F.col("batch") < first_batches)
        .groupBy("step")
        .agg(F.avg("loss").alias("val_loss"), F.count("*").alias("batches"))
    )


def latest_cursor(cursors: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The saved position with the highest step (of every run, if ``keys`` names one)."""
    saved = cursors.where(F.col("step").isNotNull())
    newest = F.max_by(F.struct("step", "data_shard", "data_position"), "step").alias("at")
    return saved.groupBy(*keys).agg(newest).select(*keys, "at.*").where(F.col("step").isNotNull())


def latest_named(paths: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """The path with the highest number in its name; numbers compare as numbers."""
    numbered = paths.select(path, F.regexp_extract(path, pattern, 1).try_cast("bigint").alias("step"))
    return (
        numbered.where(F.col("step").isNotNull())
        .agg(F.max_by(path, "step").alias(path), F.max("step").alias("step"))
        .where(F.col("step").isNotNull())
    )


def step_of(batch: Column, batches_per_step: int) -> Column:
    return int_div(batch, batches_per_step)
