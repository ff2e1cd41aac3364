"""Near-duplicates against comparison of all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from tests.llm.fixtures import BASE, docs, odd_docs
from tokenloom.llm import setsketch
from tokenloom.llm.components import components, roots
from tokenloom.llm.registry import table
from tokenloom.llm.words import shingle_sets


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for shingle in s:
            where.setdefault(shingle, []).append(i)
    for a, b in {p for at in where.values() for p in combinations(at, 2)}:
        common = len(sets[a] & sets[b])
        if rows[a][0] is not None and rows[b][0] is not None and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(sets[i]), least.get(root(i)) if doc is not None else None) for i, (doc, _) in enumerate(rows)]


def agrees(df, rows):
    got = setsketch.near_duplicates(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(plain_components(rows), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_documents(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    agrees(df, [(r.doc_id, r.text) for r in df.collect()])


def test_chains_hubs_and_members_of_many_degrees_of_likeness(spark, monkeypatch):
    """A cluster larger than a chunk, whose members link to few others or to none."""
    monkeypatch.setattr(setsketch, "CHUNK", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.choice((0, 1, 2, 3, 4, 6, 9))):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    chain = [f"c{i}" for i in range(60)]
    for i in range(12):  # each links to the next only
        rows.append((2000 + i, " ".join(chain[3 * i : 3 * i + 27 + 20])))
    rows += [(3000 + i, " ".join(rng.choice(base) for _ in range(40))) for i in range(50)]
    agrees(docs(spark, rows), rows)


def test_chunks_are_bounded_by_their_shingles(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "CHUNK_SHINGLES", 300)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    agrees(docs(spark, rows), rows)


def test_odd_rows_copies_and_empty_table(spark):
    df, rows = odd_docs(spark)
    agrees(df, rows)
    many = [(i, BASE if i % 3 == 0 else f"{BASE} {i}") for i in range(300)]
    agrees(docs(spark, many), many)
    assert setsketch.near_duplicates(docs(spark, [])).count() == 0


def test_repeated_rows_that_link_and_texts_that_share_an_id(spark):
    other = " ".join(f"w{i}" for i in range(30))
    rows = [(4, BASE + " again")] * 3 + [(2, BASE)] * 2 + [(9, BASE + " once")]  # (4, ...) links to (2, ...)
    rows += [(7, other), (7, other), (3, other + " more"), (7, BASE + " more"), (7, "a text of its own under the same id"), (8, other + " end")]
    rows += [(50, f"{other} {i % 40}") for i in range(120)]  # one id with many texts, all of which link
    rows += [(60, " ".join(f"v{i}_{k}" for k in range(8))) for i in range(40)]  # and one whose texts do not
    agrees(docs(spark, rows), rows)


def test_shingles_of_long_and_sliced_texts(monkeypatch):
    from tokenloom.llm import words

    monkeypatch.setattr(words, "SLICE", 64)
    texts = ["a b c d e f g", "", "x" * 500 + " y z  q\tr s", "É é A a\x0bB b c", "one two", "a b c d e f g"]
    buffer = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    sets = list(shingle_sets(buffer, offsets))
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    assert np.array_equal(sets[0], sets[-1])
    # A text's words do not depend on its neighbours.
    alone = np.frombuffer(texts[2].encode(), dtype=np.uint8)
    assert np.array_equal(next(shingle_sets(alone, np.array([0, len(alone)]))), sets[2])


@pytest.mark.parametrize("n", range(7))
def test_shingles_of_a_batch_with_few_words(n):
    text = " ".join("abcdef"[:n])
    for texts in ([text], [text, ""], ["", text]):
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        sets = list(shingle_sets(np.frombuffer("".join(texts).encode(), dtype=np.uint8), offsets))
        assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]


def test_a_table_of_three_words(spark):
    rows = [(1, "one two three")]
    agrees(docs(spark, rows).coalesce(1), rows)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.75, 0.95])
def test_estimates(share):
    rng = np.random.default_rng(4)
    near = []
    for _ in range(40):
        n = 400
        both = int(2 * n * share / (1 + share))
        pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        a, b = setsketch.sketch(pool[:n]), setsketch.sketch(pool[n - both :])
        near.append(setsketch.estimate(a[None], b[None], np.array([n]), np.array([n]))[0])
    assert abs(np.mean(near) - share) < 0.03 and np.abs(np.array(near) - share).max() < setsketch.MARGIN
    merged = np.maximum(setsketch.sketch(pool[:n]), setsketch.sketch(pool[n - both :]))
    assert np.array_equal(merged, setsketch.sketch(pool))


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)] + [(5, None), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a INT, b INT"), "a", "b").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in list(parent)}


def test_roots_of_long_chains_and_empty_forests(spark):
    parents = [(i, i - 1) for i in range(1, 50)] + [(100 + i, 100) for i in range(1, 5)]
    got = {r.node: r.component for r in roots(spark.createDataFrame(parents, "c BIGINT, p BIGINT"), "c", "p").collect()}
    assert got == {c: 0 if c < 50 else 100 for c, _ in parents}
    assert roots(spark.createDataFrame([], "c BIGINT, p BIGINT"), "c", "p").count() == 0
