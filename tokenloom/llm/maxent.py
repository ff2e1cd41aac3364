"""A hashed maximum-entropy language model with a class-factored softmax.

A word's class follows from its last two bytes; the end of a text is a class of its own.  The class is predicted by a softmax
over hashed features of the history: the word before, the word before that (a skip), and both together.  Within a
class a word has its smoothed share of the training counts, which is the maximum-entropy solution for features
of single words.  So  P(word | history) = P(class | history) * (c + 0.5) / (N_class + 0.5 * (V_class + 1)),
which sums to one over the known words and one unknown word for each class.

Training goes in rounds.  In each one, every task starts from the current weights and makes gradient steps over its documents in
small batches; the changes of all tasks are averaged by tokens.  A document takes part in one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.registry import written
from tokenloom.llm.words import mix, text_buffer, words

CLASSES = 32
END_CLASS = CLASSES - 1
#: The number of the end token.
END = np.uint64(0x5851F42D4C957F2D)
#: Buckets of the features: word before, skip, both.
BUCKETS = (4096, 4096, 8192)
FEATURES = sum(BUCKETS)
ROUNDS = 2
RATE = 0.5
BATCH = 8192
#: The most frequent training words are sent to all tasks, so many at most; counts of the others are joined.
HEAD = 200_000
#: Rows of weights that travel together, and groups of tasks whose changes are added up first.
ROWS, GROUPS = 512, 64

#: Bytes of text that become tokens at a time.
SLICE_BYTES = 4 << 20

_CLASS_OF = (mix(np.arange(1 << 16, dtype=np.uint64), 3) % np.uint64(END_CLASS)).astype(np.int64)


def tokens(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the column, and their tokens: numbers, classes, and the n + 1 places where rows begin and end."""
    buffer, offsets = text_buffer(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        found: list[np.ndarray] = []
        ids, bounds = words(buffer[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], found)
        suffixes = np.concatenate([np.zeros(0, dtype=np.uint16), *found])
        ids = np.insert(ids, bounds[1:], END)
        classes = np.insert(_CLASS_OF[suffixes], bounds[1:], END_CLASS)
        yield slice(at, end), ids, classes, bounds + np.arange(len(bounds))
        at = end


def features(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Three columns of weights' rows for each token."""
    starts = bounds[:-1]
    one, two = np.roll(ids, 1), np.roll(ids, 2)
    one[starts] = 0
    two[starts] = 0
    two[starts[np.diff(bounds) > 1] + 1] = 0
    sizes = np.array(BUCKETS, dtype=np.uint64)
    at = np.empty((len(ids), 3), dtype=np.int64)
    at[:, 0] = mix(one, 5) % sizes[0]
    at[:, 1] = mix(two, 6) % sizes[1]
    at[:, 2] = mix(one * np.uint64(0x9E3779B97F4A7C15) + two, 7) % sizes[2]
    at[:, 1] += BUCKETS[0]
    at[:, 2] += BUCKETS[0] + BUCKETS[1]
    return at


class Weights:
    """Rows for the features and a bias, one column for each class."""

    def __init__(self, bias: np.ndarray, table: np.ndarray | None = None):
        self.bias = bias.astype(np.float32)
        self.table = np.zeros((FEATURES, CLASSES), dtype=np.float32) if table is None else table

    def log_shares(self, at: np.ndarray) -> np.ndarray:
        """Natural logarithms of P(class | history)."""
        scores = self.table[at[:, 0]] + self.table[at[:, 1]] + self.table[at[:, 2]] + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    def learn(self, at: np.ndarray, classes: np.ndarray, squares: np.ndarray) -> None:
        """One gradient step; ``squares`` adds up what the rows have moved so far (AdaGrad by rows)."""
        slope = np.exp(self.log_shares(at))
        slope[np.arange(len(classes)), classes] -= 1
        for column in range(at.shape[1]):
            order = np.argsort(at[:, column], kind="stable")
            rows = at[order, column]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            total = np.add.reduceat(slope[order], first, axis=0)
            rows = rows[first]
            squares[rows] += (total * total).sum(axis=1)
            self.table[rows] -= RATE * total / np.sqrt(squares[rows] + 1e-6)[:, None]


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % folds


def counts(texts: DataFrame) -> DataFrame:
    """``word`` (its number), ``class``, ``c``: how often each token occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, classes, _ in tokens(batch.column(0)):
                word, first, n = np.unique(ids, return_index=True, return_counts=True)
                columns = [pa.array(word.view(np.int64)), pa.array(classes[first].astype(np.int32)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "class", "c"])

    rows = texts.select("text").mapInArrow(run, "word BIGINT, class INT, c BIGINT")
    return rows.groupBy("word").agg(F.first("class").alias("class"), F.sum("c").alias("c"))


def _round(texts: DataFrame, weights: Weights) -> Weights:
    """One round of gradient steps in all tasks, and the mean of their changes weighted by tokens."""
    shared = texts.sparkSession.sparkContext.broadcast((weights.bias, weights.table))  # FEATURES * CLASSES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        start = shared.value[1]
        own, squares, seen = Weights(shared.value[0], start.copy()), np.zeros(FEATURES, dtype=np.float32), 0
        for batch in batches:
            for _, ids, classes, bounds in tokens(batch.column(0)):
                at = features(ids, bounds)
                for i in range(0, len(ids), BATCH):
                    own.learn(at[i : i + BATCH], classes[i : i + BATCH], squares)
                seen += len(ids)
        if seen:
            change = (own.table - start) * seen
            parts = [change[i : i + ROWS].astype("<f4").tobytes() for i in range(0, FEATURES, ROWS)]
            group = TaskContext.get().partitionId() % GROUPS
            columns = [pa.array(range(len(parts)), pa.int32()), pa.array([group] * len(parts), pa.int32())]
            columns += [pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "grp", "seen", "change"])

    def add(key, rows):
        total = sum(np.frombuffer(change, dtype="<f4").astype(np.float64) for change in rows["change"].to_pylist())
        return pa.table({
            "part": pa.array([key[0].as_py()], pa.int32()), "grp": pa.array([0], pa.int32()),
            "seen": pa.array([sum(rows["seen"].to_pylist())], pa.int64()), "change": pa.array([total.astype("<f4").tobytes()], pa.binary()),
        })

    schema = "part INT, grp INT, seen BIGINT, change BINARY"
    changes = texts.select("text").mapInArrow(run, schema).groupBy("part", "grp").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema)
    table = weights.table.copy()
    for row in changes.collect():  # as many rows as the weights have parts
        part = np.frombuffer(row.change, dtype="<f4").reshape(-1, CLASSES)
        table[row.part * ROWS : row.part * ROWS + len(part)] += part / row.seen
    shared.unpersist()
    return Weights(weights.bias, table)


def _least_count(known: DataFrame, head: int) -> int:
    """The least count with which a word belongs to the head, so that the head has ``head`` words at most.

    Only a histogram of the counts is gathered, in bins of 64 to an octave.
    """
    step = F.expr("shiftleft(1L, greatest(length(bin(c)) - 7, 0))")
    bins = known.groupBy((F.floor(F.col("c") / step) * step).alias("least")).agg(F.count("*").alias("n")).collect()
    taken, least = 0, 1 << 62
    for r in sorted(bins, key=lambda r: -r.least):
        taken += r.n
        if taken > head:
            break
        least = r.least
    return least


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Learn from the rows for which ``training`` holds and score all rows.

    Returns ``id_col``, ``n_tokens``, ``n_known`` (tokens that occur in training), ``train_tokens``, ``base_score`` (log10
    probability under smoothed training frequencies), ``score`` (log10 probability under the model).  A null or empty text is the end token alone.
    Ids may be null or repeat, rows are scored one by one, and other columns are left behind.  Without training rows
    no token is known.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    trained = _text(docs.where(training), id_col, text_col)
    known = written(counts(trained), "word-counts")
    mass = np.zeros((CLASSES, 2))
    for r in known.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        mass[r["class"]] = r.n, r.v
    train_tokens, distinct = int(mass[:, 0].sum()), int(mass[:, 1].sum())
    top = known.where(F.col("c") >= _least_count(known, head)).select("word", "c").toPandas()  # bounded by ``head``
    top = top.sort_values("word", key=lambda w: w.to_numpy().view(np.uint64))

    weights = Weights(np.log((mass[:, 0] + 1) / (train_tokens + CLASSES)))
    turn = F.pmod(F.xxhash64("__id", "text"), F.lit(ROUNDS))
    for i in range(ROUNDS if train_tokens else 0):
        weights = _round(trained.where(turn == i), weights)

    within = np.log10(mass[:, 0] + 0.5 * (mass[:, 1] + 1))
    # Bounded by ``head`` and the size of the weights.
    shared = spark.sparkContext.broadcast((
        top["word"].to_numpy().view(np.uint64), top["c"].to_numpy().astype(np.int64), weights.bias, weights.table, within,
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, c, bias, table, per_class = shared.value
        model, logs = Weights(bias, table), np.log10(c + 0.5)
        for batch in batches:
            for rows, ids, classes, bounds in tokens(batch.column(1)):
                at = features(ids, bounds)
                shares = np.empty(len(ids))
                for i in range(0, len(ids), BATCH):
                    part = slice(i, i + BATCH)
                    shares[part] = model.log_shares(at[part])[np.arange(len(at[part])), classes[part]]
                place = np.minimum(np.searchsorted(word, ids), max(len(word) - 1, 0))
                frequent = word[place] == ids if len(word) else np.zeros(len(ids), dtype=bool)
                gain = np.where(frequent, logs[place], 0.0) if len(word) else np.zeros(len(ids))
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (gain, shares / np.log(10) - per_class[classes], frequent.astype(np.int64))]
                rare = np.flatnonzero(~frequent)
                ends = np.searchsorted(rare, bounds).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[rare].view(np.int64)))
                columns = [batch.column(0)[rows], pa.array(np.diff(bounds)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), tail]
                yield pa.RecordBatch.from_arrays(columns, names=["__id", "n_tokens", "frequent", "gain", "context", "rare"])

    texts = _text(docs, id_col, text_col)
    kind = texts.schema[0].dataType.simpleString()
    schema = f"__id {kind}, n_tokens BIGINT, frequent BIGINT, gain DOUBLE, context DOUBLE, rare ARRAY<BIGINT>"
    rows = written(texts.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored-rows")
    tails = rows.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n"))
    gains = (
        tails.join(known.select("word", "c"), "word", "left").groupBy("row")
        .agg(
            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        )
    )
    gain = F.col("gain") + F.coalesce("more", F.lit(0.0))
    total = float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    return rows.join(gains, "row", "left").select(
        F.col("__id").alias(id_col), "n_tokens", (F.col("frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (gain - F.col("n_tokens") * total).alias("base_score"), (gain + F.col("context")).alias("score"),
    )
