"""The Merkle manifest against a plain tree, block arithmetic, and odd tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import QUERIES, merkle

SCHEMA = "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING, tree INT, place INT, leaf INT, n INT, path STRING"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    """Rows of (doc_id, source, lang, n_chars, text) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "p") for r in rows], SCHEMA)


def tree(leaves):
    """The root and, for each leaf, its siblings level by level as (left, right)."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, a in enumerate(at):
            first = a - a % 3
            run = level[first : first + 3]
            proofs[i].append((run[: a - first], run[a - first + 1 :]))
            at[i] = a // 3
        level = [H("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], proofs


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows):
    def key(r):
        return (r[1] is not None, (r[1] or "").encode()), (r[0] is not None, r[0] or 0), leaf(r)

    rows = sorted(rows, key=key)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in rows if r[1] == s]) for s in sources}
    root, above = tree([trees[s][0] for s in sources])
    out, seen = [], {s: 0 for s in sources}
    for r in rows:
        subroot, proofs = trees[r[1]]
        steps = proofs[seen[r[1]]] + above[sources.index(r[1])]
        seen[r[1]] += 1
        tampered = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        digest = leaf((*r[:4], r[4].replace("\n", ""))) if tampered else leaf(r)
        for left, right in steps:
            digest = H("".join(left) + digest + "".join(right))
        proof = H("".join("".join(left) + "".join(right) for left, right in steps))
        out.append((r[0], leaf(r), subroot, root, proof, digest, digest == root))
    return sorted(out, key=str)


def query(spark, path, df):
    df.write.parquet(f"{path}/documents.parquet")
    got = QUERIES["op12_merkle"](spark, str(path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [4, 9, 10], [81, 2, 27, 28, 1, 1, 1, 5]])
def test_small_trees(spark, tmp_path, sizes):
    rows = [(i, f"s{k}", "en", i, f"a\nb {i}") for k, n in enumerate(sizes) for i in range(1000 * k, 1000 * k + n)]
    assert query(spark, tmp_path, frame(spark, rows)) == brute(rows)


def test_many_blocks_and_a_source_with_a_third_of_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "LEAVES", 9)
    rng = np.random.default_rng(4)
    rows = [(int(i), "hot" if i % 3 == 0 else f"h{i % 41}", None, int(i), "x\ny" * int(i % 3)) for i in rng.permutation(1500)]
    df = frame(spark, rows).repartition(7)
    manifest = merkle.build(df)
    assert len(manifest.tiers) == 3 and len(manifest.top) == 2
    assert manifest.tiers[0].agg(F.max("n")).first()[0] == 9
    assert query(spark, tmp_path, df) == brute(rows)


def test_odd_rows(spark, tmp_path):
    long = "word \n" * 200_000
    rows = [(None, None, None, None, None), (1, None, "", 0, ""), (2, "", "en", -5, "\n"), (3, "ü", "de", 1, "日本\n語"), (4, "z", "en", 1, long)]
    rows += [(7, "s", "en", 1, "same\n")] * 40 + [(7, "s", "en", 1, f"other {i}\n") for i in range(5)] + [(None, "s", "x", 1, "no id\n")]
    assert query(spark, tmp_path, frame(spark, rows).repartition(5)) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, frame(spark, [])) == []


@pytest.mark.parametrize("height", range(9))
def test_addresses_are_those_of_halves_within_halves(height):
    levels = merkle.layout(height)
    assert [len(x) for x in levels] == [3 ** (height - k) for k in range(height + 1)]
    assert sorted(np.concatenate(levels).tolist()) == list(range(sum(map(len, levels))))
    assert levels[height][0] == 0
    if height == 7:  # eight levels: four above, then 81 parts of four levels, each of them 40 nodes in a row
        upper = np.concatenate(levels[4:])
        assert sorted(upper.tolist()) == list(range(40))
        for i in (0, 1, 80):
            part = np.concatenate([levels[k][i * 3 ** (3 - k) : (i + 1) * 3 ** (3 - k)] for k in range(4)])
            assert sorted(part.tolist()) == list(range(40 * (i + 1), 40 * (i + 2)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 26, 27, 28, 500, 2187])
def test_block_roots_and_paths(n):
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
    block = merkle.Block.build(leaves, merkle.levels_over(n))
    root, proofs = tree([d.hex() for d in leaves])
    assert block.root.hex() == root
    read = merkle.Block(bytes(block.nodes), n, block.height)
    for d, path, steps in zip(leaves, read.paths(), proofs, strict=True):
        assert merkle.folded(d, path).hex() == root
        assert [(a.hex(), b.hex()) for a, b in merkle.steps_of(path)] == [("".join(x), "".join(y)) for x, y in steps]


def test_a_change_of_any_column_is_found(spark):
    rows = [(i, "s", "en", 5, f"t{i}") for i in range(30)]
    df = frame(spark, rows)
    for column, other in (("doc_id", F.lit(99)), ("lang", F.lit("de")), ("n_chars", F.lit(6)), ("text", F.lit("u"))):
        changed = df.withColumn(column, F.when(F.col("doc_id") == 12, other).otherwise(F.col(column)))
        claims = changed.select(merkle.leaf_column().alias("claim")).collect()
        manifest = merkle.build(df, F.when(F.col("doc_id") == 12, F.lit([r.claim for r in claims if r.claim][12])).otherwise(merkle.leaf_column()))
        assert [r.doc_id for r in merkle.prove(manifest).where("NOT verified").collect()] == [12]
