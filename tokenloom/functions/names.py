"""File and shard names, sizes and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns of numbered inputs and saved checkpoints.
SOURCE_FILE_PATTERN = r"^input([0-9]+)\.txt$"
CHECKPOINT_PATTERN = r"step_([0-9]+)"

MEGABYTE = 1048576.0


def number_in(name: Column, pattern: str, as_type: str = "int") -> Column:
    """The first group of ``pattern`` as a number, NULL where the name does not match."""
    return F.regexp_extract(name, pattern, 1).try_cast(as_type)


def base_name(path: Column, width: int | None = None) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return name if width is None else F.substring(name, 1, width)


def flat_path(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("_"))


def shard_name(split: Column, shard: Column) -> Column:
    """At least four digits, more where the number needs them."""
    return F.format_string("%s_%04d.npy", split, shard)


def ceil_div(value: Column, size: int) -> Column:
    """Exact integer ceiling division of a non-negative BIGINT."""
    return int_div(value + F.lit(size - 1).cast("bigint"), size)


def int_div(value: Column, size: Column | int) -> Column:
    divisor = F.lit(size).cast("bigint") if isinstance(size, int) else size
    return F.call_function("div", value, divisor)


def padded_size(size: Column | int, multiple: int = 128) -> Column:
    value = F.lit(size).cast("bigint") if isinstance(size, int) else size
    return ceil_div(value, multiple) * F.lit(multiple).cast("bigint")


def megabytes(n_bytes: Column) -> Column:
    return n_bytes.cast("double") / F.lit(MEGABYTE)


def rate(amount: Column, seconds: Column) -> Column:
    """Amount per second, NULL when no time passed."""
    return F.try_divide(amount.cast("double"), seconds.cast("double"))
