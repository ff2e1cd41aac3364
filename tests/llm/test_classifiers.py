"""Toxicity and quality: folding, matching, held-out accuracy, and rows of every kind."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import docs, odd_docs
from tokenloom.llm import QUERIES, quality, toxicity
from tokenloom.llm.registry import table

SF_DIR = "/root/testdata/sf0.1"
LEXICON = toxicity.Lexicon({" idiot": 3.0, " scum ": 2.0, " pathetic": 3.0}, {" idiot proof "}, (-3.0, 1.0, 1.0, 1.0))


def plain_hits(folded, weights, exceptions):
    """Every place of every term, longest first from the left, by search."""
    def places(s):
        out, at = [], folded.find(s)
        while at >= 0:
            out.append((at, at + len(s)))
            at = folded.find(s, at + 1)
        return out

    spared = [p for e in exceptions for p in places(e)]
    found = sorted(((a, b, w) for t, w in weights.items() for a, b in places(t)), key=lambda f: (f[0], -f[1]))
    out = []
    for a, b, w in found:
        if not (out and a < out[-1][1] - 1) and not any(x <= a and b <= y for x, y in spared):
            out.append((a, b, w))
    return out


@pytest.mark.parametrize(
    "text",
    ["You IDIOT!", "you 1d10t", "уou іdiоt", "ｉｄｉｏｔ", "ídïöt", "id​iot", "an idiot-proof box", "$cum", "p@thetic$$$", "scum, idiot. scumble", "", "idiot " * 50],
)
def test_hits_equal_a_plain_search(text):
    folded = toxicity.fold(text)
    assert LEXICON.hits(folded) == plain_hits(folded, LEXICON.weights, LEXICON.exceptions)


def test_folding_and_exceptions():
    for text in ("You IDIOT!", "you 1d10t", "уou іdiоt", "ｉｄｉｏｔ", "ídïöt", "id​iot", "$cum", "p@thetic$$$"):
        assert LEXICON.score(text) > 0.5, text
    for text in ("an idiot-proof box", "scumble", "nidiot", "", "quite a nice day"):
        assert LEXICON.score(text) < 0.5, text
    assert LEXICON.score("idiot") > LEXICON.score("idiot " + "fine words here " * 200)


def test_rare_terms_enter_the_lexicon_where_they_are_sure(spark):
    """A slur in about 1 % of the toxic documents, a word in three of them, and one that is as rare in clean ones."""
    rows = [(i, f"{'zorgle' if i % 75 == 0 else 'idiot'} {'thrice' if i in (1, 2, 3) else 'word'} {'seldom' if i % 90 == 1 else 'x'}") for i in range(3000)]
    rows += [(i, f"word {'seldom' if i % 90 == 1 else 'x'}") for i in range(3000, 6000)]
    labels = spark.createDataFrame([(i, 1, int(i < 3000)) for i, _ in rows], "doc_id BIGINT, quality INT, toxic INT")
    lexicon = toxicity.learn(docs(spark, rows), labels)
    assert lexicon.score("you zorgle there") > 0.5 and lexicon.score("you idiot there") > 0.5
    for text in ("thrice", "seldom", "word"):
        assert lexicon.score(text) < 0.5, text


def accuracy(spark, name, column):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    docs_ = table(spark, SF_DIR, "documents").select("doc_id").toPandas()
    assert sorted(got.doc_id) == sorted(docs_.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    both = got.merge(table(spark, SF_DIR, "labels").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert len(both) > 500
    return both.predicted, both[column]


def test_toxicity_held_out(spark):
    predicted, label = accuracy(spark, "op7_toxicity", "toxic")
    assert (predicted == label).mean() > 0.97 and predicted[label == 0].mean() < 0.01


def test_quality_held_out(spark):
    predicted, label = accuracy(spark, "op8_quality", "quality")
    assert (predicted == label).mean() > 0.98 and predicted[label == 1].mean() > 0.99


def test_votes_equal_a_plain_version():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(90, quality.TERMS))).astype(np.float32)
    labels = (np.arange(90) % 3 > 0).astype(np.int64)
    voters = quality.fit(x, labels, {0: 300, 1: 60})
    got = voters.scores(x[:20])
    for i in range(20):
        v = x[i] @ voters.projection
        cosine = [float(v @ w / np.linalg.norm(v)) for w in voters.vectors]
        near = np.argsort([-c for c in cosine])[: quality.NEIGHBOURS]
        votes = [np.exp((cosine[j] - cosine[near[0]]) / quality.WIDTH) * (10 if labels[j] == 0 else 1) for j in near]
        assert got[i] == pytest.approx(sum(w for w, j in zip(votes, near) if labels[j]) / sum(votes), abs=1e-4)


def test_description_counts_shapes_and_repeats():
    x = quality.describe(pa.array(["Ab1 cd", "", None, "a a a a", "é"]))
    assert (x[0, : quality.SHAPES] > 0).sum() == 4 and not x[1].any() and not x[2].any() and not x[4].any()
    assert x[3, quality.SHAPES] == 1.0 and x[0, quality.SHAPES] == 0.0


LABELS = "doc_id BIGINT, quality INT, toxic INT, text STRING"


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, "x")], [(1, None, None, "x"), (None, 1, 1, "x"), (2, 0, 1, "x"), (2, 1, 0, "x"), (3, 1, 0, "x"), (6, 7, 9, "x")]])
def test_odd_rows_few_labels_and_empty_tables(spark, labels):
    df, rows = odd_docs(spark)
    known = spark.createDataFrame(labels, LABELS)
    for frame in (df, docs(spark, [])):
        lexicon, voters = toxicity.learn(frame, known), quality.learn(frame, known)
        for got in (toxicity.score(frame, lexicon), quality.score(frame, voters)):
            assert got.columns == [*frame.columns, "score"]
            got = got.collect()
            assert len(got) == frame.count()
            assert all(0 <= r.score <= 1 for r in got)
            by_text = {}
            for r in got:
                by_text.setdefault(r.text or "", set()).add(round(r.score, 9))
            assert all(len(s) == 1 for s in by_text.values())
    assert len(rows)


def test_samples_are_bounded_where_one_id_has_a_third_of_all_rows(spark):
    from tokenloom.llm.labelled import sample, training_labels

    rows = [(i, f"text {i}", 1) for i in range(400)] + [(7, f"copy {i % 50}", 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, id INT")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(400)], "doc_id BIGINT, toxic INT, quality INT")
    known = training_labels(labels, "quality")
    texts, sizes = sample(df, known, 10_000)
    assert texts.count() == sum(sizes.values()) == known.count()
    assert sample(df, known, 20)[0].count() <= 40
    voters = quality.learn(df, labels, per_class=20)
    assert len(voters.vectors) <= 40
