import pytest
from pyspark.sql import functions as F

from tests import model
from tokenloom.functions import text as tx
from tokenloom.operators import layout as lay
from tokenloom.operators import tokenizers as tk
from tokenloom.plans.corpus import Corpus
from tokenloom.plans.registered import layout as registered
from tokenloom.schemas import DOCS, TOKEN_CACHE
from tokenloom.streaming import ingest


def rows_of(i):
    return [(i % 3, i * 100 + j, f"　doc {i} {j}\r\n") for j in range(4)]


def cleaned(df):
    return df.withColumn("text", F.concat(tx.unicode_strip(F.col("text")), F.lit("\n")))


def test_stream_equals_batch_and_reads_each_file_once(spark, tmp_path):
    arrived, landing, state = (str(tmp_path / n) for n in ("arrived", "landing", "state"))

    def deliver(i):
        spark.createDataFrame(rows_of(i), DOCS).coalesce(1).write.mode("append").parquet(arrived)

    def run():
        stream = ingest.file_stream(spark, arrived, DOCS, files_per_batch=1)
        ingest.land_tokens(stream, cleaned, tk.codepoint(), landing, state).awaitTermination()

    deliver(0)
    deliver(1)
    run()
    run()
    assert spark.read.parquet(landing).count() == 8
    deliver(2)
    deliver(2)  # the same documents in a second file
    run()
    assert spark.read.parquet(landing).count() == 16
    landed = ingest.landed(spark, landing)
    assert landed.count() == 12

    corpus = Corpus(spark, str(tmp_path / "c"), tk.codepoint())
    corpus.add(landed)
    docs = [(s, o, t.strip() + "\n") for i in range(3) for s, o, t in rows_of(i)]
    got = {(r.split, r.shard): r.tokens for r in corpus.shards(20, 0.2).collect()}
    assert got == model.shards(model.stream(docs), 20, 0.2)


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    landing = str(tmp_path / "landing")
    arrived = str(tmp_path / "arrived")
    spark.createDataFrame(rows_of(0), DOCS).write.parquet(arrived)
    for state in ("s1", "s2"):  # a lost checkpoint replays batch 0
        stream = ingest.file_stream(spark, arrived, DOCS)
        ingest.land_tokens(stream, cleaned, tk.codepoint(), landing, str(tmp_path / state)).awaitTermination()
    assert spark.read.parquet(landing).count() == 4


def land(spark, root, name, rows):
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{root}/arrived-{name}")
    stream = ingest.file_stream(spark, f"{root}/arrived-{name}", DOCS)
    ingest.land_tokens(stream, lambda df: df, tk.codepoint(), f"{root}/landing-{name}", f"{root}/state-{name}").awaitTermination()


def landed_rows(spark, root):
    return sorted((r.source_no, r.doc_ord, "".join(map(chr, r.tokens))) for r in ingest.landed(spark, f"{root}/landing-*/*").collect())


def test_files_landed_twice_count_once_and_move_no_tokens(spark, tmp_path):
    rows = [(i % 3, i, f"text {i}") for i in range(300)]
    land(spark, tmp_path, "a", rows)
    land(spark, tmp_path, "b", list(reversed(rows)))
    assert landed_rows(spark, tmp_path) == sorted(rows)
    plan = ingest.landed(spark, f"{tmp_path}/landing-*/*")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


@pytest.mark.parametrize("bounds", [{}, {"MAX_BROADCAST_MASKS": 0, "MAX_BROADCAST_REPEATS": 0}])
def test_of_landed_copies_the_longest_counts_the_greater_where_they_are_as_long(spark, tmp_path, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(lay, name, value)
    kinds = [("same", "same"), ("short", "a longer one"), ("as long: b", "as long: a"), ("", ""), (None, ""), (None, None), ("once", None)]
    first = [(i % 4, i, kinds[i % 7][0]) for i in range(200)]
    second = [(i % 4, i, kinds[i % 7][1]) for i in range(200) if i % 7 != 6]
    third = [(0, 7 * i, "same") for i in range(0, 28, 4)]  # a third copy of some
    for name, rows in (("a", first), ("b", second), ("c", third), ("d", [(9, 1, "alone")])):
        land(spark, tmp_path, name, rows)
    wanted = {}
    for source, order, text in first + second + third + [(9, 1, "alone")]:
        text = text or ""  # a null text has no tokens
        wanted[source, order] = max(wanted.get((source, order), ""), text, key=lambda t: (len(t), t))
    assert landed_rows(spark, tmp_path) == sorted((*k, t) for k, t in wanted.items())


def test_landed_copies_without_digests_are_compared_by_their_tokens(spark, tmp_path):
    for name, ids in (("a", [1, 2]), ("b", [1, 3])):
        spark.createDataFrame([(0, i, 2, ids) for i in range(3)], TOKEN_CACHE).write.parquet(f"{tmp_path}/landing/batch_id={name}")
    assert sorted((r.doc_ord, r.tokens) for r in ingest.landed(spark, f"{tmp_path}/landing").collect()) == [(i, [1, 3]) for i in range(3)]


def test_changed_content_is_noticed_on_landed_tokens(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"), tk.codepoint())
    docs = {0: rows_of(0), 1: rows_of(1)}
    for attempt in range(2):
        arrived = str(tmp_path / f"arrived-{attempt}")
        spark.createDataFrame(docs[0] + docs[1], DOCS).coalesce(1).write.parquet(arrived)
        landing = str(tmp_path / f"landing-{attempt}")
        ingest.land_tokens(ingest.file_stream(spark, arrived, DOCS), cleaned, tk.codepoint(), landing, str(tmp_path / f"state-{attempt}")).awaitTermination()
        landed = ingest.landed(spark, landing)
        assert corpus.add(landed, detect="content")
        assert corpus.add(landed, detect="content") is None
        docs[1] = [(s, o, t.replace("doc", "new")) for s, o, t in docs[1]]
    runs = {r.source_no: r.run for r in corpus.manifest().collect()}
    assert len(set(runs.values())) == 2  # only the changed source was read again


def streamed(spark, root, corpus, state="state"):
    stream = ingest.file_stream(spark, f"{root}/arrived", DOCS, files_per_batch=1)
    ingest.land_in_corpus(stream, cleaned, corpus, f"{root}/{state}").awaitTermination()


def shards_of(corpus):
    return {(r.split, r.shard): r.tokens for r in corpus.shards(20, 0.2).collect()}


def delivered(spark, root, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(f"{root}/arrived")


@pytest.mark.parametrize("eos", ["source", "document", "none"])
def test_micro_batches_grow_the_sources_of_a_corpus(spark, tmp_path, eos):
    corpus = Corpus(spark, str(tmp_path / "c"), tk.codepoint(), eos)
    corpus.add(cleaned(spark.createDataFrame(rows_of(0), DOCS)))
    rows = rows_of(0)
    for more in (rows_of(3) + rows_of(1), rows_of(4), rows_of(4) + [(2, 7, "x"), (2, 7, "longer"), (2, 5, None)]):
        delivered(spark, tmp_path, more)
        streamed(spark, tmp_path, corpus)
        rows = list(dict.fromkeys(rows + more))
    rows.remove((2, 7, "x"))
    wanted = model.shards(model.stream([(s, o, (t.strip() if t else "") + "\n") for s, o, t in rows if t is not None], eos), 20, 0.2)
    corpus_rows = {(r.source_no, r.doc_ord): r.n for r in corpus.cache().collect()}
    assert (2, 5) in corpus_rows
    got = shards_of(corpus)
    if corpus_rows[2, 5] == 0:  # a null text is a document without tokens
        assert got == wanted
    totals = {r.source_no: r.n_tokens for r in corpus.manifest().collect()}
    assert sum(totals.values()) == sum(len(t) for t in got.values()) == sum(corpus_rows.values())

    runs = corpus._valid().count()
    streamed(spark, tmp_path, corpus)  # nothing has arrived
    streamed(spark, tmp_path, corpus, "lost")  # everything is read again
    assert corpus._valid().count() == runs and shards_of(corpus) == got


def test_a_committed_batch_adds_nothing_and_a_dead_one_is_replaced(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"), tk.codepoint())
    batch = spark.createDataFrame(rows_of(0) + rows_of(1), DOCS)
    assert corpus.add_batch(batch, "s", 0)
    before = shards_of(corpus)
    assert corpus.add_batch(batch, "s", 0) is None  # replayed
    assert corpus.add_batch(batch, "s", 1) is None  # delivered again
    assert shards_of(corpus) == before
    committed = tmp_path / "c" / "manifest" / "stream=s" / "batch=0" / "_SUCCESS"
    committed.unlink()  # as if the attempt had died while it wrote its rows
    for part in committed.parent.glob("*.parquet"):
        part.unlink()
    assert corpus.manifest().count() == 0
    assert corpus.add_batch(batch, "s", 0)
    assert shards_of(corpus) == before
    with pytest.raises(ValueError):
        corpus.add_batch(batch, "a/b", 0)


def test_whole_runs_replace_parts(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"), tk.codepoint())
    docs = spark.createDataFrame(rows_of(0) + rows_of(1), DOCS)
    corpus.add_batch(docs.where("doc_ord % 2 = 0"), "s", 0)
    corpus.add_batch(docs.where("doc_ord % 2 = 1"), "s", 1)
    assert corpus.add(docs) is None and corpus.add(docs, detect="content") is None  # the parts add up to these sources
    grown = shards_of(corpus)
    corpus.add(docs, force=True)
    assert shards_of(corpus) == grown
    assert corpus._valid().count() == 2 and corpus.vacuum(grace=0) == 2
    assert shards_of(corpus) == grown


def test_larger_inputs_are_delivered_in_more_files_not_larger_ones(spark, tmp_path, monkeypatch):
    docs = registered.docs(spark, "/root/testdata/sf0.01")
    whole = registered.estimated_bytes(docs)
    for n, target in ((4, 1 << 40), (10, int(whole * lay.TEXT_GROWTH / 9.5))):
        monkeypatch.setattr(registered, "TARGET_BYTES", target)
        arrived = str(tmp_path / f"arrived-{n}")
        assert registered.deliver(docs, arrived) == n
        sizes = [f.stat().st_size for f in (tmp_path / f"arrived-{n}").glob("*.parquet")]
        assert len(sizes) == n and max(sizes) < 2 * sum(sizes) / n
        assert spark.read.parquet(arrived).exceptAll(docs).isEmpty() and docs.exceptAll(spark.read.parquet(arrived)).isEmpty()
