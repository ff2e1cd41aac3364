"""SimHash fingerprints and their components against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import LONG, docs, odd_docs
from tokenloom.llm import QUERIES, simhash
from tokenloom.llm.registry import table

xxhash = pytest.importorskip("xxhash")
SF_DIR = "/root/testdata/sf0.001"


def fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """For each distinct fingerprint the least one that links reach."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    of, names = classes(fps), {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            names[of[f]] = min(i, names.get(of[f], i))
    return sorted(((i, f"{f:016x}", names.get(of[f])) for (i, _), f in zip(rows, fps)), key=str)


def test_odd_texts(spark):
    df, rows = odd_docs(spark)
    got = simhash.near_duplicates(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("words", range(6))
def test_single_texts(spark, words):
    rows = [(3, " ".join("alpha beta Gamma delta Epsilon".split()[:words]))]
    assert sorted(map(tuple, simhash.near_duplicates(docs(spark, rows)).collect())) == brute(rows)


def test_rows_without_ids_name_nothing_and_empty_tables(spark):
    rows = [(None, "a b c d"), (None, None), (None, "a b c d")]
    assert sorted(map(tuple, simhash.near_duplicates(docs(spark, rows)).collect()), key=str) == brute(rows)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_slices_of_long_texts_change_nothing(monkeypatch):
    whole = simhash.fingerprint(LONG)
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(LONG) == whole == fingerprint(LONG)


def test_query_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").collect()]
    assert sorted(map(tuple, QUERIES["op11_simhash"](spark, SF_DIR).collect()), key=str) == brute(rows)


def _planted(rng, n):
    """Random fingerprints, and around some of them others one to four bits away, within a group and across groups."""
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    out = [base]
    for k in (1, 2, 3, 3, 3, 4):
        for f in base[: n // 4]:
            low = rng.integers(0, 4) * 16
            bits = rng.choice(64, k, replace=False) if rng.random() < 0.5 else low + rng.choice(16, k, replace=False)
            out.append(np.array([f ^ np.uint64(sum(1 << int(b) for b in bits))], dtype=np.uint64))
    return np.unique(np.concatenate(out))


def _found(fps):
    keys, members = simhash.variants(fps)
    order = np.argsort(keys, kind="stable")
    a, b = simhash.links(keys[order], members[order])
    assert all((int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(a, b))
    root = {int(f): int(f) for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return {f: find(f) for f in root}, len(a)


@pytest.mark.parametrize("seed", range(4))
def test_links_join_what_all_pairs_join(seed):
    fps = _planted(np.random.default_rng(seed), 120)
    assert _found(fps)[0] == classes(fps.tolist())


def test_every_pair_of_three_bits_is_found():
    rng = np.random.default_rng(9)
    f = int(rng.integers(0, 2**64, dtype=np.uint64))
    for _ in range(300):
        bits = rng.choice(64, 3, replace=False)
        pair = np.array([f, f ^ sum(1 << int(b) for b in bits)], dtype=np.uint64)
        assert len(set(_found(pair)[0].values())) == 1
    for low in range(0, 64, 16):
        pair = np.array([f, f ^ (7 << low)], dtype=np.uint64)
        assert len(set(_found(pair)[0].values())) == 1
    assert len(set(_found(np.array([f, f ^ 15], dtype=np.uint64))[0].values())) == 2


def test_a_crowded_ball_gives_links_in_proportion_to_its_members():
    rng = np.random.default_rng(2)
    f = int(rng.integers(0, 2**64, dtype=np.uint64))
    fps = {f ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 4)), replace=False)) for _ in range(1500)}
    fps = np.array(sorted(fps), dtype=np.uint64)
    found, links = _found(fps)
    assert found == classes(fps.tolist())
    assert links < len(fps) * simhash.GROUPS * simhash.VARIANTS


def test_variants_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 10)
    fps = _planted(np.random.default_rng(11), 60).view(np.int64)
    df = spark.createDataFrame([(int(f),) for f in fps], "fp BIGINT")
    want = classes(fps.view(np.uint64).tolist())
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash._linked(df).collect()]
    assert links and all(want[a] == want[b] for a, b in links)
    spread = {f: f for f in want}
    for _ in range(8):
        for a, b in links:
            spread[a] = spread[b] = min(spread[a], spread[b])
    assert spread == want


def test_whole_query_has_no_hot_result(spark):
    rows = [(i, "the same words in every row") for i in range(300)] + [(i, f"row {i} says {i * i} things about {i + 7}") for i in range(300, 400)]
    got = simhash.near_duplicates(docs(spark, rows))
    assert got.where(F.col("doc_id") < 300).select("component_id").distinct().collect() == [(0,)]
    assert got.count() == 400
