"""Encoding, decoding and token files against the libraries."""

import base64
import glob
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import docs, odd_docs
from tokenloom.llm import bpe, token_files
from tokenloom.llm.pieces import PATTERN
from tokenloom.llm.registry import table, vocabulary

RANKS, LIBRARY = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file(LIBRARY)
    made.encode_special_tokens = True
    return made


def test_encoding_equals_the_library_and_decodes(spark, reference_encoding):
    df, rows = odd_docs(spark)
    got = bpe.decode(bpe.encode(df, RANKS), RANKS).collect()
    assert len(got) == len(rows)
    want = sorted((i is None, i, np.array(reference_encoding.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows if i is not None)
    assert sorted((r.doc_id is None, r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got if r.doc_id is not None) == want


def test_encoding_of_all_documents(spark, reference_encoding):
    df = table(spark, SF_DIR, "documents")
    got = {r.doc_id: bytes(r.ids) for r in bpe.encode(df, RANKS).collect()}
    for r in df.collect():
        assert got[r.doc_id] == np.array(reference_encoding.encode_ordinary(r.text), "<u4").tobytes()


def test_memory_of_chunks_may_be_full(monkeypatch):
    from tokenloom.llm import pieces

    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "GROUP", 1)
    memory = pieces.Memory(lambda chunks: [c.encode() for c in chunks])
    texts = ["a b c d e", "a  b", "x" * 100 + " y", "", " lead"]
    assert list(memory.ids(texts)) == [t.encode() for t in texts]


def test_tiny_vocabulary_merges_leftmost_least_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259}
    vocabulary_ = bpe.Vocabulary(ranks)

    def ids(piece):
        return np.frombuffer(vocabulary_.encode_pieces([piece])[0], "<u4").tolist()

    assert ids(b"abc") == [258] and ids(b"aabc") == [97, 258] and ids(b"aaa") == [259, 97] and ids(b"") == []
    assert ids(b"abcd" * 3) == [258, 100] * 3


def test_long_runs_equal_the_library_in_little_time(reference_encoding):
    import time

    rng = np.random.default_rng(5)
    vocabulary_ = bpe.load(RANKS)
    runs = [
        "".join(map(chr, rng.integers(97, 123, 30_000))), "a" * 20_001, "ab" * 7000 + "a", "the" * 5000, "".join(rng.choice(["tion", "in", "re", "q"], 9000)),
        "é中" * 3000, "0" * 5000, "!?" * 4000, "x" * (bpe.LONG + 1),
    ]
    for run in runs:
        got = np.frombuffer(b"".join(vocabulary_.memory.ids([run])), "<u4").tolist()
        assert got == reference_encoding.encode_ordinary(run)
    million = "".join(map(chr, rng.integers(97, 123, 1_000_000)))
    started = time.process_time()
    got = np.frombuffer(b"".join(vocabulary_.memory.ids([million])), "<u4").tolist()
    assert time.process_time() - started < 30  # 9 on a loaded machine
    assert got == reference_encoding.encode_ordinary(million)


@pytest.mark.parametrize("seed", range(6))
def test_long_rows_merge_as_short_ones_do_whatever_the_ranks(seed):
    """Ranks in no order of length: merges make pairs of lower rank all the time."""
    rng = np.random.default_rng(seed)
    tokens = [bytes([b]) for b in range(256)]
    more = sorted({bytes(rng.choice([97, 98, 99], int(rng.integers(2, 6))).tolist()) for _ in range(120)})
    rng.shuffle(more)
    vocabulary_ = bpe.Vocabulary({t: i for i, t in enumerate([*tokens, *more])})
    for n in (2, 3, 50, 400):
        piece = bytes(rng.choice([97, 98, 99], n, p=[0.6, 0.2, 0.2]).tolist())
        assert vocabulary_._merge_long(piece) == vocabulary_._merge([piece])[0]


def test_empty_table(spark, tmp_path):
    df = docs(spark, [])
    assert bpe.decode(bpe.encode(df, RANKS), RANKS).count() == 0
    token_files.write(df, str(tmp_path / "none"), LIBRARY)
    assert token_files.digests(spark, str(tmp_path / "none")).count() == 0


def _expected(library, rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_library(spark, library, tmp_path):
    df, rows = odd_docs(spark)
    path = str(tmp_path / "ids")
    token_files.write(df.repartition(5), path, LIBRARY, end_id=2)
    got = sorted(token_files.digests(spark, path).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == _expected(library, rows)


def test_token_query_takes_added_tokens_out_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    from tokenloom.llm import QUERIES

    end = "<|endoftext|>"
    _, rows = odd_docs(spark)
    rows += list(enumerate([f"a {end} b", end, end * 2, f"{end}a", f"a{end}", f"  {end}\n x {end[:-1]}{end}", "<|ENDOFTEXT|>"], 100))
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(QUERIES["op2_token_orc"](spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == _expected(Tokenizer.from_file(LIBRARY), rows)


@pytest.mark.parametrize("odd", ["lstrip", "rstrip", "single_word", "normalized"])
def test_added_tokens_that_do_not_match_as_they_are_are_refused(tmp_path, odd):
    import json

    made = json.load(open(LIBRARY, encoding="utf-8"))
    made["added_tokens"][0][odd] = True
    (tmp_path / "odd.json").write_text(json.dumps(made), encoding="utf-8")
    with pytest.raises(ValueError, match="endoftext"):
        token_files.LibraryBpe(str(tmp_path / "odd.json"))


def test_token_files_of_all_documents_and_their_pruning(spark, library, tmp_path):
    df = table(spark, SF_DIR, "documents")
    path = str(tmp_path / "ids")
    token_files.write(df, path, LIBRARY, end_id=2)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, token_files.digests(spark, path).collect()), key=lambda r: r[1]) == _expected(library, rows)
    some = token_files.read(spark, path, [3, 77])
    assert {r.doc_id for r in some.collect()} == {3, 77}
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    files = glob.glob(f"{path}/*.orc")
    assert files
    import pyarrow.orc as orc

    assert sum(orc.ORCFile(f).nrows for f in files) == len(rows)
    assert any(b"doc_id" in open(f, "rb").read() for f in files)


def test_query_columns(spark):
    from tokenloom.llm import QUERIES

    got = QUERIES["op1_byte_bpe"](spark, SF_DIR)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    text = table(spark, SF_DIR, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("want"))
    assert got.join(text, "doc_id").where("decoded_sha256 != want").count() == 0
