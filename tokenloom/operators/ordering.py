"""Running sums over a global order, without a task that sees all rows.

Rows are ordered by ``(majors..., minor)``.  ``minor`` is cut into blocks of 1,024 values.  The sum before a row is

    (sum before its block) + (sum before it in the block)

The blocks' own sums, one thin row for each, are written once; the full rows are read once for them and once for the result.  Up to
262,144 blocks are summed in one window.  More of them are cut into groups of as many, those into larger groups, until one
group holds all, and every window stays that small, whether order values are dense or hash-like; the top level has one row
per value of the majors.  Only the last term touches the full rows, in windows of at most 1,024 of them, however many rows one source holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tokenloom.session import written_with

BLOCK_BITS = 10
GROUP_BITS = 18

_BLOCK = "__block"
_GROUP = "__group"


@dataclass(frozen=True)
class RunningSums:
    """Exclusive running sums: ``blocks`` is the written thin table of the blocks' sums, ``base`` has the sums before each block."""

    blocks: DataFrame
    base: DataFrame
    totals: Mapping[str, int]
    _blocked: DataFrame
    _columns: Sequence[str]
    _values: Mapping[str, str]
    _outer: Sequence[str]
    _minor: str
    _partitions: int | None

    @property
    def rows(self) -> DataFrame:
        """All rows with their sums."""
        return self._summed(self._blocked, self._partitions)

    def rows_before(self, value: str, limit: int) -> DataFrame:
        """The rows of the blocks that begin before ``limit`` in the sum of ``value``; the others are left out where they are read.

        Only without ``restart``: the blocks are then those up to one place in the order.
        """
        first = self.base.where(F.col(f"__base_{value}") < limit)
        order = [*self._outer, _BLOCK]
        last = first.agg(F.max(F.struct(*order)).alias("last")).first().last
        if last is None:
            return self._summed(self._blocked.where(F.lit(False)), None)
        within, same = F.lit(False), F.lit(True)
        for name in order:
            within = within | (same & (F.col(name) < F.lit(last[name])))
            same = same & (F.col(name) == F.lit(last[name]))
        # The leading key alone as well: a plain bound reaches the scan.
        return self._summed(self._blocked.where(F.col(order[0]) <= F.lit(last[order[0]])).where(within | same), None)

    def _summed(self, blocked: DataFrame, partitions: int | None) -> DataFrame:
        in_block = [*self._outer, _BLOCK]
        before_row = Window.partitionBy(*in_block).orderBy(self._minor)
        # the window wants this partitioning anyway; only the number is new
        full = blocked if partitions is None else blocked.repartition(partitions, *in_block)
        return (
            full.select("*", *[_before(v, before_row).alias(f"__r_{v}") for v in self._values])
            .join(self.base, in_block)
            .select(
                *self._columns,
                *[(F.col(f"__r_{v}") + F.col(f"__base_{v}")).alias(out) for v, out in self._values.items()],
            )
        )

    def total(self, name: str) -> Column:
        """The sum over all rows, known since the blocks were written."""
        return F.lit(self.totals[name]).cast("bigint")

    def totals_by(self, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
        return self.blocks.groupBy(*keys).agg(*[F.sum(n).alias(f"total_{n}") for n in names])


def _before(value: str, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))


def _present(df: DataFrame, name: str) -> Column:
    """The key itself, an error where it is NULL: such a row would have no place and be lost."""
    kind = df.schema[name].dataType
    fallback = F.lit("" if isinstance(kind, T.StringType) else -1).cast(kind)
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"order key {name} is NULL")).cast(kind), fallback)


def running_sums(
    df: DataFrame,
    values: Mapping[str, str],
    minor: str,
    majors: Sequence[str] = (),
    restart: Sequence[str] = (),
    block_bits: int = BLOCK_BITS,
    group_bits: int = GROUP_BITS,
    partitions: int | None = None,
) -> RunningSums:
    """Add ``values[column] = output``: the sum of ``column`` over all earlier rows.

    ``minor`` is a non-negative BIGINT, unique within ``(restart, majors)``; sums start again for
    every value of ``restart``.  ``partitions`` sets how many the full rows are shuffled into, where
    the session's number is not to decide.  Windows over thin rows hold 2^``group_bits`` of them.
    """
    outer = [*restart, *majors]
    keyed = df.withColumns({k: _present(df, k) for k in [*outer, minor]})
    blocked = keyed.withColumn(_BLOCK, F.shiftright(F.col(minor), block_bits))
    sums = blocked.groupBy(*outer, _BLOCK).agg(*[F.sum(v).cast("bigint").alias(v) for v in values])
    figures = {"__n": F.count(F.lit(1)), "__top": F.max(_BLOCK), **{f"__sum_{v}": F.sum(v) for v in values}}
    blocks, facts = written_with(sums, "blocks", **figures)

    levels, names = [blocks], [_BLOCK]  # each level with the key of the one above
    top = facts["__top"] or 0
    while facts["__n"] > 1 << group_bits and top > 0:
        names.append(f"{_GROUP}{len(names)}")
        top >>= group_bits
        levels[-1] = levels[-1].withColumn(names[-1], F.shiftright(F.col(names[-2]), group_bits))
        levels.append(levels[-1].groupBy(*outer, names[-1]).agg(*[F.sum(v).alias(v) for v in values]))

    highest = Window.partitionBy(*restart).orderBy(*majors, names[-1])
    base = levels[-1].select(*outer, names[-1], *[_before(v, highest).alias(f"__base_{v}") for v in values])
    for i in range(len(names) - 2, -1, -1):
        above = [*outer, names[i + 1]]
        window = Window.partitionBy(*above).orderBy(names[i])
        inner = levels[i].select(*above, names[i], *[_before(v, window).alias(f"__in_{v}") for v in values])
        base = inner.join(base, above).select(
            *outer, names[i], *[(F.col(f"__in_{v}") + F.col(f"__base_{v}")).alias(f"__base_{v}") for v in values]
        )
    totals = {v: int(facts[f"__sum_{v}"] or 0) for v in values}
    return RunningSums(blocks, base, totals, blocked, df.columns, dict(values), outer, minor, partitions)


def ordinals(df: DataFrame, minor: str, out: str, majors: Sequence[str] = (), restart: Sequence[str] = ()) -> DataFrame:
    """Add the 1-based position of every row in the order."""
    one = df.withColumn("__one", F.lit(1).cast("bigint"))
    summed = running_sums(one, {"__one": out}, minor, majors, restart).rows
    return summed.withColumn(out, F.col(out) + 1).drop("__one")


def every_nth(df: DataFrame, n: int, values: Mapping[str, str], minor: str, majors: Sequence[str] = ()) -> DataFrame:
    """Progress samples: the rows whose position is a multiple of ``n``, with inclusive running totals."""
    one = df.withColumn("ordinal", F.lit(1).cast("bigint"))
    summed = running_sums(one, {"ordinal": "__before", **values}, minor, majors).rows
    return (
        summed.withColumn("ordinal", F.col("__before") + 1)
        .where(F.col("ordinal") % n == 0)
        .withColumns({out: F.col(out) + F.col(v) for v, out in values.items()})
        .drop("__before")
    )
