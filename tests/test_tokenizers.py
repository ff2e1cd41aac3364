import pytest
from pyspark.sql import functions as F

from tokenloom.operators import tokenizers as tk
from tokenloom.operators.decoding import decode, numbered_texts
from tokenloom.operators.layout import tokenize

TEXTS = ["", "a", "﻿z", "éx", "\U0001f600 \U00020000", "中文\n測試", "a\x00b", "<|endoftext|>", " 　 ", "x" * 5000]


def all_tokenizers():
    made = [tk.codepoint(), tk.utf8_bytes()]
    try:
        import public_tokenizers as public
    except ImportError:
        return made
    rank_file = public.path("byte_bpe_multi_50k.tiktoken")
    return [*made, tk.rank_file_bpe(rank_file, public.PATTERN), tk.tokenizer_json(public.path("byte_bpe_50k.json"))]


def encoded(spark, tokenizer, texts=TEXTS):
    docs = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "source_no int, doc_ord bigint, text string")
    return tokenize(docs, tokenizer)


@pytest.mark.parametrize("tokenizer", all_tokenizers(), ids=lambda t: t.name)
def test_round_trip(spark, tokenizer):
    rows = decode(encoded(spark, tokenizer), tokenizer).orderBy("doc_ord").collect()
    assert [r.text for r in rows] == TEXTS


@pytest.mark.parametrize("tokenizer", all_tokenizers(), ids=lambda t: t.name)
def test_ids_fit_the_vocabulary_and_end_reads_as_its_name(spark, tokenizer):
    rows = encoded(spark, tokenizer).collect()
    assert all(0 <= i < tokenizer.vocab_size for r in rows for i in r.tokens)
    assert all(r.n == len(r.tokens) for r in rows)
    end = spark.range(1).select(F.array(F.lit(tokenizer.eos_id)).alias("tokens"))
    assert decode(end, tokenizer).first().text == tk.EOS_TEXT


@pytest.mark.parametrize("tokenizer", [t for t in all_tokenizers() if t.count], ids=lambda t: t.name)
def test_count_is_the_length_of_encode(spark, tokenizer):
    docs = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string")
    text = F.col("text")
    wrong = docs.where(tokenizer.count(text) != F.size(tokenizer.encode(text)))
    assert wrong.count() == 0


def test_ids_are_code_points_and_bytes(spark):
    for tokenizer, ids in ((tk.codepoint(), lambda t: [ord(c) for c in t]), (tk.utf8_bytes(), lambda t: list(t.encode()))):
        rows = encoded(spark, tokenizer).orderBy("doc_ord").collect()
        assert [r.tokens for r in rows] == [ids(t) for t in TEXTS]


def test_codepoint_needs_no_python(spark):
    plan = encoded(spark, tk.codepoint())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_cut_character_decodes_to_a_replacement(spark):
    row = spark.range(1).select(F.array(F.lit(0xE4), F.lit(0xB8)).alias("tokens"))
    assert "�" in decode(row, tk.utf8_bytes()).first().text


def test_rank_file_of_one_byte_pieces(spark, tmp_path):
    import base64

    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"abab"]
    path = tmp_path / "tiny.ranks"
    path.write_bytes(b"\n".join(base64.b64encode(r) + b" %d" % i for i, r in enumerate(ranks)))
    tokenizer = tk.rank_file_bpe(str(path), r"\S+|\s+")
    rows = encoded(spark, tokenizer, ["abab c", "aab"]).orderBy("doc_ord").collect()
    assert [r.tokens for r in rows] == [[257, 32, 99], [97, 256]]
    assert tokenizer.eos_id == 258 and tokenizer.vocab_size == 259


def test_oversized_tables_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(tk, "MAX_RANK_BYTES", 3)
    path = tmp_path / "big"
    path.write_bytes(b"IQ== 0\n")
    with pytest.raises(ValueError, match="not shipped"):
        tk.rank_file_bpe(str(path), ".")


def test_numbered_texts(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b")], "i int, t string")
    assert sorted(r.text for r in numbered_texts(rows, "i", "t").collect()) == ["[1] a", "[2] b"]
