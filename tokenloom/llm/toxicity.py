"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, undoes accents, homoglyphs, digits and signs in the place of letters, and turns everything else into single spaces.
The lexicon is learned from a bounded sample of labelled documents: words and beginnings of words that occur far more often
in toxic documents than in others.  Phrases around a lexicon word that occur in clean documents
without doing so in toxic ones are exceptions: a hit inside of one does not count.  Weights of the hits,
alone and by length of the text, are turned into a probability by logistic regression.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.labelled import sample, training_labels

#: Labelled documents of each class that are learned from, at most.
PER_CLASS = 20_000
#: Beginnings of words that are tried, in letters.
STEMS = range(4, 9)
#: A term must occur in so many toxic documents at least.
LEAST = 4
#: And either in this share of the toxic sample, or so often that a term equally common in both classes would do so with this chance at most.
SHARE, CHANCE = 0.02, 1e-6
#: And its share there must be so many times that in the clean sample.
RATIO = 20.0
#: Clean documents that make a phrase an exception.
EXCEPTION_LEAST = 3

# Letters of other alphabets and the Latin ones they look like.
_LOOKS = str.maketrans(
    "абвгдеѕзіјклмнорсԁтухьєіӏԛԝ"
    "αβεηικμνορτυχωγ"
    "ıłøđħßæœ",
    "abbrдesзijkлmhopcdtyxbeilqw"
    "abenikmvoptuxwy"
    "ilodhsae",
)
_MARKS = re.compile("[̀-ͯ​-‏⁠﻿­]")
_SIGNS = re.compile(rb"(?<![$@])[$@](?=[A-Za-z0-9])")


def _table() -> bytes:
    """Bytes of folded text: letters in lower case, digits as the letters they stand for, other bytes of letters as they are, the rest as spaces."""
    table = bytearray(b" " * 256)
    for b in range(128, 256):
        table[b] = b
    for b in range(26):
        table[65 + b] = table[97 + b] = 97 + b
    for digit, letter in zip(b"0123456789", b"oizeasgtbg", strict=True):
        table[digit] = letter
    return bytes(table)


_FOLD = _table()
_SIGN = {b"$": b"s", b"@": b"a"}


def fold(text: str) -> str:
    """Words of the folded text with one space around each, as characters of one byte."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().translate(_LOOKS)
    raw = text.encode()
    if b"$" in raw or b"@" in raw:
        raw = _SIGNS.sub(lambda m: _SIGN[m[0]], raw)
    return f" {b' '.join(raw.translate(_FOLD).split()).decode('latin-1')} "


def terms(folded: str) -> set[str]:
    """Candidates for the lexicon: words with a space on both sides, and beginnings of words with one before them."""
    out = set()
    for word in set(folded.split()):
        if len(word) >= 3:
            out.add(f" {word} ")
            out.update(f" {word[:n]}" for n in STEMS if n < len(word))
    return out


@dataclass
class Lexicon:
    """Terms with weights, exceptions, and the coefficients of the score."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}  # built where it is used

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                made.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                made.add_word(phrase, (len(phrase), 0.0))
            if len(made):
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Begin, end and weight of the terms found outside of exceptions; where terms overlap, the longest from the left."""
        automaton = self.automaton()
        if not len(automaton):
            return []
        found = [(end + 1 - size, end + 1, weight) for end, (size, weight) in automaton.iter(folded)]
        spared = [(a, b) for a, b, weight in found if not weight]
        out: list[tuple[int, int, float]] = []
        for a, b, weight in sorted((f for f in found if f[2]), key=lambda f: (f[0], -f[1])):
            if out and a < out[-1][1] - 1 or any(x <= a and b <= y for x, y in spared):  # a space may end one and begin the next
                continue
            out.append((a, b, weight))
        return out

    def features(self, folded: str) -> tuple[float, float, float]:
        total = sum(weight for _, _, weight in self.hits(folded))
        words = max(folded.count(" ") - 1, 1)
        return float(total > 0), float(np.log1p(total)), float(np.log1p(100 * total / words))

    def score(self, text: str) -> float:
        bias, *slopes = self.coefficients
        x = bias + sum(w * f for w, f in zip(slopes, self.features(fold(text)), strict=True))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _counted(texts: DataFrame, items) -> DataFrame:
    """``item``, ``toxic``, ``clean``: documents of each label that hold what ``items(folded)`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(items(fold(text)))
            found = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(found, pa.string()), *(pa.array([seen[y][t] for t in found], pa.int64()) for y in (1, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "toxic", "clean"])

    rows = texts.mapInArrow(run, "item STRING, toxic BIGINT, clean BIGINT")
    return rows.groupBy("item").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _phrases(lexicon: Lexicon):
    """The word of each hit, and the phrases of it with the word before and the word after."""

    def items(folded: str) -> Iterable[str]:
        out = set()
        for a, b, _ in lexicon.hits(folded):
            start, end = folded.rfind(" ", 0, a + 1), folded.find(" ", b - 1)
            before, after = folded.rfind(" ", 0, start) if start > 0 else -1, folded.find(" ", end + 1)
            out.add(folded[start : end + 1])
            if before >= 0:
                out.add(folded[before : end + 1])
            if after >= 0:
                out.add(folded[start : after + 1])
        return out - lexicon.weights.keys()

    return items


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Coefficients, bias first, with a small penalty so that separable data have an answer."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - y) + 0.1 * beta
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta)), slope)
    return tuple(float(b) for b in beta)


def _sure(toxic: int, clean: int) -> Column:
    """Whether the counts of a term in so many documents of each class are no accident, by Chernoff's bound on the binomial tail.

    More documents admit ever rarer terms: about 20 toxic ones and no clean one suffice where the classes are equally large.
    """
    p = toxic / (toxic + clean)
    n = F.col("toxic") + F.col("clean")
    q = F.col("toxic") / n
    rest = F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - q) / (1 - p))).otherwise(0.0) if clean else F.lit(0.0)
    return (q > p) & (F.col("toxic") * F.log(q / p) + rest >= -float(np.log(CHANCE)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Lexicon:
    """The lexicon of the labelled documents outside the held-out fold; all that is collected is bounded by the sample."""
    texts, sizes = sample(docs, training_labels(labels, "toxic", id_col), per_class, id_col, text_col)
    toxic, clean = (min(sizes.get(y, 0), per_class) for y in (1, 0))
    if not toxic:
        return Lexicon({}, coefficients=(-4.0, 0.0, 0.0, 0.0))
    least = LEAST if toxic > LEAST else 1
    enough = (F.col("toxic") >= least) & ((F.col("toxic") >= SHARE * toxic) | _sure(toxic, clean))
    ratio = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / (clean + 1))
    found = _counted(texts, terms).where(enough & (ratio >= min(RATIO, clean))).select("item", ratio.alias("ratio")).collect()
    ratios = {r["item"]: r.ratio for r in found}
    # Of a beginning and longer terms that begin with it the beginning is enough, unless they are much surer.
    weights = {
        t: float(np.log(r)) for t, r in ratios.items()
        if not any(t[:n] in ratios and ratios[t[:n]] >= r / 4 for n in range(STEMS[0] + 1, len(t)))
    }
    lexicon = Lexicon(weights)
    phrases = _counted(texts, _phrases(lexicon)).where((F.col("clean") >= EXCEPTION_LEAST) & (F.col("toxic") / toxic < F.col("clean") / max(clean, 1)))
    lexicon.exceptions = {r["item"] for r in phrases.select("item").collect()}
    lexicon._automaton = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.features(fold(text)) for text in batch.column(0).to_pylist()]
            columns = [pa.array([f[i] for f in x], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=["a", "b", "c", "label"])

    rows = texts.mapInArrow(run, "a DOUBLE, b DOUBLE, c DOUBLE, label INT").toPandas()
    lexicon.coefficients = _logistic(rows[["a", "b", "c"]].to_numpy(), rows["label"].to_numpy())
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows of ``docs`` with the probability of toxicity in ``score_col``, which replaces a column of that name.

    Only the text decides: null and empty texts score as texts without a hit, equal texts score alike, and texts are
    scored whole.  Other columns and repeated rows stay; an empty table stays empty.  No shuffle.
    """

    @F.pandas_udf("double")
    def scored(texts):
        return texts.map(lambda t: lexicon.score(t or "")).astype(float)

    return docs.withColumn(score_col, scored(F.col(text_col).cast("string")))
