import random
import re

import pytest
from pyspark.sql import functions as F

from tests import model
from tokenloom.operators import layout as lay
from tokenloom.operators import reports
from tokenloom.operators import tokenizers as tk
from tokenloom.operators.shards import build_shards, named, require_both_splits
from tokenloom.plans.corpus import Corpus, read_shards

DOCS = "source_no int, doc_ord bigint, text string"


def some_docs(n=120, seed=5):
    """One source holds a third of the documents; orders have gaps; some texts are empty or long."""
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        source = 3 if rng.random() < 0.33 else rng.choice([1, 2, 7, 11])
        length = rng.choice([0, 1, 5, 40, 900])
        docs.append((source, i * 5000, "".join(rng.choices("ab é中\n\U0001f600", k=length))))
    return docs


def as_dict(shards):
    rows = shards.collect()
    assert all(r.n_tokens == len(r.tokens) for r in rows)
    return {(r.split, r.shard): r.tokens for r in rows}


@pytest.mark.parametrize("size, ratio, eos", [(1000, 0.01, "source"), (97, 0.3, "document"), (10**6, 0.5, "none"), (1, 0.2, "source")])
def test_shards_equal_the_model(spark, size, ratio, eos):
    docs = some_docs(30 if size == 1 else 120)
    if size == 1:
        docs = [(s, o, t[:20]) for s, o, t in docs]
    built = build_shards(spark.createDataFrame(docs, DOCS).repartition(6), tk.codepoint(), size, ratio, eos)
    assert as_dict(built) == model.shards(model.stream(docs, eos), size, ratio)


@pytest.mark.parametrize("eos", ["source", "none"])
@pytest.mark.parametrize("size, ratio", [(1000, 0.01), (64, 0.3), (3000, 0.0), (500, 1.0)])
def test_shards_of_long_documents_and_small_parts_equal_the_model(spark, monkeypatch, size, ratio, eos):
    """Blocks that touch many parts, documents that do, boundaries inside blocks, and whole blocks in a part."""
    from tokenloom.operators import shards as sh

    monkeypatch.setattr(sh, "BLOCKS_PER_PART", 2)
    docs = some_docs(80, seed=9) + [(3, 10**6, "long " * 3000), (7, 10**6 + 1, "中" * 4000), (12, 0, "x" * 5000)]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    for partitions in (1, 3, 16):
        built = build_shards(df, tk.codepoint(), size, ratio, eos, partitions=partitions)
        assert as_dict(built) == model.shards(model.stream(docs, eos), size, ratio)
    want = {k: v for k, v in model.shards(model.stream(docs, eos), size, ratio).items() if k[0] == "val"}
    assert as_dict(build_shards(df, tk.codepoint(), size, ratio, eos, partitions=4, val_only=True)) == want


def test_places_may_be_joined_where_blocks_are_too_many_to_broadcast(spark, monkeypatch):
    from tokenloom.operators import shards as sh

    monkeypatch.setattr(sh, "MAX_BROADCAST_BLOCKS", 1)
    docs = some_docs()
    assert as_dict(build_shards(spark.createDataFrame(docs, DOCS), tk.codepoint(), 700, 0.05)) == model.shards(model.stream(docs), 700, 0.05)


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_shuffle_carries_the_texts(spark):
    df = spark.createDataFrame([(s, i, "some words " * 40) for s in (1, 2, 3) for i in range(200)], DOCS)
    plan = _planned(build_shards(df, tk.codepoint(), 5000, 0.1, partitions=4))
    shuffles = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    # the other one finds the ends of the sources in the thin counted rows
    assert ["part" if "shufflepartitionidpassthrough(" in s else "end" if "hashpartitioning(source_no" in s else s for s in shuffles] == ["part", "end"]
    assert plan.count("Window [") == 1 and plan.count("text#") and "tokens#" not in plan.split("Exchange shufflepartitionidpassthrough(")[1]


def test_the_head_reads_only_sources_below_the_cut(spark, tmp_path):
    df = spark.createDataFrame([(s, i, "some words " * 40) for s in range(1, 30) for i in range(50)], DOCS)
    df.write.parquet(str(tmp_path / "docs"))
    head = build_shards(spark.read.parquet(str(tmp_path / "docs")), tk.codepoint(), 5000, 0.05, partitions=4, val_only=True)
    plan = _planned(head)
    assert "LessThanOrEqual(source_no,2)" in plan
    assert plan.count("Exchange shufflepartitionidpassthrough(") == 1
    assert head.where("split <> 'val'").count() == 0 and head.agg(F.sum("n_tokens")).first()[0] == int((29 * 50 * 440 + 29) * 0.05)


def test_offsets_read_documents_once(spark, monkeypatch):
    calls = []
    plain = tk.codepoint()

    def count(text):
        calls.append(text)
        return plain.count(text)

    counting = tk.Tokenizer(plain.name, plain.vocab_size, plain.eos_id, plain.encode, plain.decode, count)
    docs = some_docs()
    rows = lay.thin_rows(spark.createDataFrame(docs, DOCS), counting)
    offsets = lay.global_offsets(rows)
    assert len(calls) == 1 and "text" not in _planned(offsets.rows)
    spans = sorted((r.g_start, r.g_end) for r in offsets.rows.collect())
    assert spans[0][0] == 0 and spans[-1][1] == offsets.n_tokens == len(model.stream(docs))
    head = offsets.rows_before(1000).collect()
    assert sorted((r.g_start, r.g_end) for r in head) == [s for s in spans if s[0] < 1000]
    assert offsets.rows_before(0).count() == 0


def test_a_tokenizer_that_cannot_count_gives_the_same_layout(spark):
    docs = some_docs()
    plain = tk.codepoint()
    blind = tk.Tokenizer(plain.name, plain.vocab_size, plain.eos_id, plain.encode, plain.decode, None)
    df = spark.createDataFrame(docs, DOCS)
    assert as_dict(build_shards(df, blind, 700, 0.05)) == model.shards(model.stream(docs), 700, 0.05)


def test_an_empty_source_gives_only_its_end(spark):
    docs = [(1, 0, "abc"), (3, 0, "de")]
    sources = spark.createDataFrame([(1,), (2,), (3,), (4,)], "source_no int")
    built = build_shards(spark.createDataFrame(docs, DOCS), tk.codepoint(), 4, 0.25, sources=sources)
    assert as_dict(built) == model.shards(model.stream(docs, sources=[1, 2, 3, 4]), 4, 0.25)


def test_no_documents_give_no_shards(spark):
    none = spark.createDataFrame([], DOCS)
    assert build_shards(none, tk.codepoint(), 10, 0.1).count() == build_shards(none, tk.codepoint(), 10, 0.1, val_only=True).count() == 0


def test_unknown_eos_mode(spark):
    with pytest.raises(ValueError, match="eos"):
        lay.token_rows(spark.createDataFrame([], DOCS), tk.codepoint(), "line")


def test_split_spans_cover_the_stream_once(spark):
    docs = some_docs()
    rows, _ = lay.token_rows(spark.createDataFrame(docs, DOCS), tk.codepoint())
    sums = lay.global_offsets(rows)
    clipped = lay.split_spans(sums.rows, sums.total("n"), 0.1)
    total = len(model.stream(docs))
    for split, size in (("val", int(total * 0.1)), ("train", total - int(total * 0.1))):
        spans = sorted((r.s_start, r.s_end) for r in clipped.where(F.col("split") == split).collect())
        assert spans[0][0] == 0 and spans[-1][1] == size
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    mix = reports.split_mix(clipped).agg(F.sum("n_tokens")).first()[0]
    assert mix == total


def test_chunks_are_the_stream_cut_by_position(spark):
    docs = some_docs()
    chunks = lay.text_chunks(spark.createDataFrame(docs, DOCS), 100).orderBy("source_no", "chunk_no").collect()
    for source in {d[0] for d in docs}:
        whole = "".join(t for s, _, t in sorted(docs) if s == source)
        assert [c.chunk for c in chunks if c.source_no == source] == [whole[i : i + 100] for i in range(0, len(whole), 100)]


def test_incremental_equals_full(spark, tmp_path):
    docs = some_docs()
    df = spark.createDataFrame(docs, DOCS)
    corpus = Corpus(spark, str(tmp_path / "c"), tk.codepoint())
    assert corpus.add(df.where("source_no in (2, 7)"))
    assert corpus.add(df)
    assert corpus.add(df) is None
    assert as_dict(corpus.shards(500, 0.02)) == model.shards(model.stream(docs), 500, 0.02)
    counts = {r.source_no: r.n_tokens for r in corpus.manifest().collect()}
    assert counts == {s: len(model.stream([d for d in docs if d[0] == s])) for s in {d[0] for d in docs}}


def test_a_bpe_corpus_is_tokenized_once_and_equals_the_direct_build(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    bpe = tk.rank_file_bpe(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    df = spark.createDataFrame(some_docs(60), DOCS)
    corpus = Corpus(spark, str(tmp_path / "c"), bpe)
    corpus.add(df.where("source_no = 3"))
    corpus.add(df)
    assert as_dict(corpus.shards(300, 0.1)) == as_dict(build_shards(df, bpe, 300, 0.1))


def test_changed_text_is_noticed_by_content_and_by_force(spark, tmp_path):
    docs = some_docs()
    corpus = Corpus(spark, str(tmp_path / "c"), tk.codepoint())
    corpus.add(spark.createDataFrame(docs, DOCS))
    changed = [(s, o, t + "!" if s == 2 else t) for s, o, t in docs]
    df = spark.createDataFrame(changed, DOCS)
    assert corpus.add(df) is None
    assert corpus.add(df, detect="content")
    expected = model.shards(model.stream(changed), 500, 0.02)
    assert as_dict(corpus.shards(500, 0.02)) == expected
    assert corpus.add(df, detect="content") is None
    again = [(s, o, t[::-1]) for s, o, t in docs]
    corpus.add(spark.createDataFrame(again, DOCS), force=True)
    assert as_dict(corpus.shards(500, 0.02)) == model.shards(model.stream(again), 500, 0.02)


def test_publishing_switches_and_prunes(spark, tmp_path):
    docs = some_docs()
    df = spark.createDataFrame(docs, DOCS)
    corpus = Corpus(spark, str(tmp_path / "c"), tk.codepoint())
    with pytest.raises(FileNotFoundError):
        corpus.current()
    corpus.add(df.where("source_no < 7"))
    first = corpus.publish(500, 0.02)
    old = corpus.current()
    corpus.add(df)
    second = corpus.publish(500, 0.02)
    assert corpus.current_version() == second != first
    assert as_dict(old) == model.shards(model.stream([d for d in docs if d[0] < 7]), 500, 0.02)
    assert as_dict(corpus.current()) == model.shards(model.stream(docs), 500, 0.02)
    plan = corpus.current("val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert corpus.expire() == 0 and as_dict(old)  # a scan begun before may go on
    assert corpus.expire(grace=0) == 1 and corpus.expire(grace=0) == 0
    assert set(k for k, _ in as_dict(corpus.current("val"))) == {"val"}
    with pytest.raises(ValueError):
        read_shards(spark, str(tmp_path), "test")


def test_documents_of_a_run_that_died_stay_invisible(spark, tmp_path):
    docs = some_docs()
    corpus = Corpus(spark, str(tmp_path / "c"), tk.codepoint())
    corpus.add(spark.createDataFrame(docs, DOCS))
    orphan = spark.read.parquet(str(tmp_path / "c" / "cache")).drop("run")
    orphan.write.parquet(str(tmp_path / "c" / "cache" / "run=dead"))
    assert as_dict(corpus.shards(500, 0.02)) == model.shards(model.stream(docs), 500, 0.02)


def test_a_rebuild_shuffles_tokens_once(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"), tk.codepoint())
    corpus.add(spark.createDataFrame(some_docs(), DOCS))
    plan = corpus.shards(500, 0.02)._jdf.queryExecution().executedPlan().toString()
    moving = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line and "max(run_seq" not in line]
    assert [line for line in moving if "shufflepartitionidpassthrough(" in line] and sum("shufflepartitionidpassthrough(" in line for line in moving) == 1
    assert plan.count("Window [") == 1 and "hashpartitioning(split" not in plan


def test_adding_shuffles_no_documents(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"), tk.codepoint())
    rows, tokens = lay.token_rows(spark.createDataFrame(some_docs(), DOCS), tk.codepoint())
    plan = rows.select("doc_ord", tokens)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "max" not in line and "source_no" not in line]
    corpus.add(spark.createDataFrame(some_docs(), DOCS))
    spans = sorted((r.g_start, r.g_end) for r in corpus.offsets().rows.collect())
    assert spans[-1][1] == corpus.offsets().n_tokens == len(model.stream(some_docs()))


def test_writers_at_the_same_time_get_different_numbers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tokenloom.session import claim_number

    folder = str(tmp_path / "claims")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: claim_number(spark, folder, lambda: 4), range(24)))
    assert sorted(got) == list(range(5, 29))

    docs = some_docs()
    root = str(tmp_path / "c")
    texts = [spark.createDataFrame([(s, o, t + str(k)) for s, o, t in docs], DOCS) for k in range(3)]
    with ThreadPoolExecutor(3) as pool:
        runs = list(pool.map(lambda df: Corpus(spark, root, tk.codepoint()).add(df, force=True), texts))
    rows = spark.read.parquet(f"{root}/manifest").select("run", "run_seq").distinct().collect()
    assert {r.run for r in rows} == set(runs) and len({r.run_seq for r in rows}) == 3
    corpus = Corpus(spark, root, tk.codepoint())
    last = runs.index(max(rows, key=lambda r: r.run_seq).run)
    want = model.shards(model.stream([(s, o, t + str(last)) for s, o, t in docs]), 500, 0.02)
    assert as_dict(corpus.shards(500, 0.02)) == want
    assert corpus.vacuum() == 0
    assert corpus.vacuum(grace=0) == 2 and corpus.vacuum(grace=0) == 0
    assert as_dict(corpus.shards(500, 0.02)) == want


def test_vacuum_keeps_runs_in_use_and_runs_under_way(spark, tmp_path):
    docs = some_docs()
    df = spark.createDataFrame(docs, DOCS)
    corpus = Corpus(spark, str(tmp_path / "c"), tk.codepoint())
    corpus.add(df)
    corpus.add(df.where("source_no = 2").withColumn("text", F.lit("new")), force=True)
    (tmp_path / "c" / "cache" / "run=writing").mkdir()
    assert corpus.vacuum(grace=0) == 0  # the first run still holds the other sources
    corpus.add(df, force=True)
    assert corpus.vacuum(grace=0) == 2
    assert (tmp_path / "c" / "cache" / "run=writing").exists()
    assert as_dict(corpus.shards(500, 0.02)) == model.shards(model.stream(docs), 500, 0.02)


def test_too_small_a_corpus_is_refused(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"), tk.codepoint())
    corpus.add(spark.createDataFrame([(1, 0, "abc")], DOCS))
    with pytest.raises(ValueError, match="split empty"):
        corpus.publish(10, 0.01)
    require_both_splits(100, 0.01)


def test_shard_names_and_vocabulary(spark):
    docs = spark.createDataFrame([(1, 0, "ab"), (2, 0, "\U0001f600")], DOCS)
    shards = named(build_shards(docs, tk.codepoint(), 2, 0.4))
    assert sorted(r.shard_name for r in shards.collect()) == ["train_0000.npy", "train_0001.npy", "val_0000.npy"]
    rows, tokens = lay.token_rows(docs, tk.codepoint())
    checked = reports.vocab_check(rows.select("source_no", tokens.alias("tokens")), 151_680).orderBy("source_no").collect()
    assert [(r.n_tokens, r.n_outside, r.max_id) for r in checked] == [(3, 1, model.EOS), (2, 1, model.EOS)]


def test_a_large_input_is_shuffled_into_more_partitions(spark, tmp_path, monkeypatch):
    from tokenloom import session

    docs = some_docs()
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(session, "TARGET_BYTES", 20_000)
    built = build_shards(df, tk.codepoint(), 500, 0.02)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1
    assert as_dict(built) == model.shards(model.stream(docs), 500, 0.02)
    chunks = lay.text_chunks(df, 1000).where("source_no = 3").orderBy("chunk_no").collect()
    assert "".join(c.chunk for c in chunks) == "".join(t for s, _, t in sorted(docs) if s == 3)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from tokenloom import __main__ as cli

    (tmp_path / "in").mkdir()
    lines = {1: ["one", "two"], 10: ["ten"], 2: ["zwei", ""]}
    for n, text in lines.items():
        (tmp_path / "in" / f"input{n}.txt").write_text("".join(t + "\n" for t in text))
    log = tmp_path / "run.log"
    log.write_text("step 1: loss 2.0, grad_norm 0.1, lr 6.00e-04, dt 5.00ms, tok/sec 9.00\nother\n")
    for command in (
        f"build {tmp_path}/in {tmp_path}/root --text --shard-size 8 --val-ratio 0.2",
        f"build {tmp_path}/in {tmp_path}/root --text --shard-size 8 --val-ratio 0.2",
        f"batches {tmp_path}/root {tmp_path}/batches --rows 1 --length 3",
        f"decode {tmp_path}/root {tmp_path}/text",
        f"runlog {log} {tmp_path}/steps",
        f"schedule {tmp_path}/root {tmp_path}/all --rows 1 --length 3 --epochs 1",
        f"save-position {tmp_path}/root 7 1 3",
        f"schedule {tmp_path}/root {tmp_path}/rest --rows 1 --length 3 --epochs 0",
        f"build {tmp_path}/in {tmp_path}/chunked --text --chunk-chars 3 --shard-size 8 --val-ratio 0.2 --eos document",
    ):
        monkeypatch.setattr("sys.argv", ["tokenloom", *command.split()])
        cli.main()
    docs = [(n, i, t + "\n") for n, text in lines.items() for i, t in enumerate(text)]
    expected = model.shards(model.stream(docs), 8, 0.2)
    texts = {(r.split, r.shard): r.text for r in spark.read.parquet(str(tmp_path / "text")).collect()}
    assert texts == {k: "".join("<|endoftext|>" if t == model.EOS else chr(t) for t in v) for k, v in expected.items()}
    batches = spark.read.parquet(str(tmp_path / "batches")).count()
    assert "train: 3 shards" in capsys.readouterr().out
    assert batches == sum((len(v) - 1) // 3 for (split, _), v in expected.items() if split == "train")
    assert spark.read.parquet(str(tmp_path / "steps")).first().loss == 2.0

    lengths = [len(v) for (split, _), v in sorted(expected.items()) if split == "train"]
    whole = [(i, p * 3) for i, n in enumerate(lengths) for p in range((n - 1) // 3)]
    order = [(r.shard, r.data_position) for r in spark.read.parquet(str(tmp_path / "all")).orderBy("global_batch").collect()]
    assert order == whole * 2  # nothing saved: the first pass is whole as well
    rest = [(r.shard, r.data_position) for r in spark.read.parquet(str(tmp_path / "rest")).orderBy("global_batch").collect()]
    assert rest == [at for at in whole if at >= (1, 3)]

    # chunks run over the ends of lines, blank lines among them, and are documents of their own
    texts = {n: "".join(t + "\n" for t in text) for n, text in lines.items()}
    chunks = [(n, i, whole[i : i + 3]) for n, whole in texts.items() for i in range(0, len(whole), 3)]
    shards = Corpus(spark, str(tmp_path / "chunked"), tk.codepoint()).current()
    assert as_dict(shards) == model.shards(model.stream(chunks, "document"), 8, 0.2)


def test_chunks_can_be_what_the_tokenizer_sees(spark):
    public = pytest.importorskip("public_tokenizers")
    bpe = tk.rank_file_bpe(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    docs = [(s, i, f"word {i} of source {s}\n") for s in (1, 2) for i in range(40)]
    df = spark.createDataFrame(docs, DOCS)
    rows = lay.tokenize(lay.chunked_docs(df, 100), bpe).orderBy("source_no", "doc_ord").collect()
    import base64

    import tiktoken

    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    direct = tiktoken.Encoding("direct", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for source in (1, 2):
        whole = "".join(t for s, _, t in docs if s == source)
        expected += [direct.encode_ordinary(whole[i : i + 100]) for i in range(0, len(whole), 100)]
    assert [r.tokens for r in rows] == expected
