import gzip
import json
import logging

import pytest
from pyspark.sql import functions as F

from tokenloom.plans.extraction import Extraction
from tokenloom.sources import catalog as cat
from tokenloom.sources import readers, sinks
from tokenloom.__main__ import numbered_text

CATEGORIES = (
    cat.Category("qa_site", "qa/site/", ".jsonl.gz"),
    cat.Category("forum", "forum/", ".parquet", first=2),
    cat.Category("web", "web/", ".parquet"),
    cat.Category("news", "news/", ".parquet"),
)


def gz(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt", encoding="utf-8", newline="") as f:
        f.write("".join(line + "\n" for line in lines))


def parquet(path, columns):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path)


def test_lines_keep_file_order_over_many_splits(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes", None)
    for number, text in ((1, "".join(f"{i}\n" * (i % 3) + f"line {i}\r\n" for i in range(3000))), (2, "a\rb\n\nlast")):
        (tmp_path / f"input{number}.txt").write_bytes(text.encode())
    (tmp_path / "input3.txt.tmp").write_text("no")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        docs = numbered_text(spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() > 5
        rows = docs.orderBy("source_no", "doc_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", old or "128MB")
    expected = [
        (n, line + "\n")
        for n in (1, 2)
        for line in open(tmp_path / f"input{n}.txt", encoding="utf-8").read().removesuffix("\n").split("\n")
    ]
    assert [(r.source_no, r.text) for r in rows] == expected
    assert len({(r.source_no, r.doc_ord) for r in rows}) == len(rows)


def test_a_folder_without_numbered_files_is_an_error(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        cat.numbered_sources(spark, str(tmp_path))


def test_numbers_sort_as_numbers(spark, tmp_path):
    for n in (10, 9, 1):
        (tmp_path / f"input{n}.txt").write_text("x")
    found = cat.numbered_sources(spark, str(tmp_path)).orderBy("source_no").collect()
    assert [(r.source_no, r.name, r.n_bytes) for r in found] == [(n, f"input{n}.txt", 1) for n in (1, 9, 10)]


def record(**fields):
    return json.dumps({{"q": "问", "a": "答"}.get(k, k): v for k, v in fields.items()}, ensure_ascii=False)


def test_qa_records(spark, tmp_path):
    gz(tmp_path / "a.jsonl.gz", [record(q="　q1 ", a="a1\n"), "not json", "", record(q="only"), record(q=None, a="x"), record(q=" ", a="x"), record(q="q2", a="a2", more=1)])
    good, bad = readers.qa_records(spark, str(tmp_path))
    texts = [r.text for r in readers.qa_documents(good).orderBy("row_in_file").collect()]
    assert texts == ["問：q1\n答：a1", "問：q2\n答：a2"]
    assert [r.raw for r in bad.collect()] == ["not json"]


def test_strict_mode_drops_whole_files(spark, tmp_path):
    fine = record(q="q", a="a")
    gz(tmp_path / "good.jsonl.gz", [fine, record(q="missing answer"), record(a="x", n=5)])
    for name, line in {"null": record(q=None, a="a"), "number": record(q=5, a="a"), "broken": "{", "list": "[]", "blank": ""}.items():
        gz(tmp_path / f"{name}.jsonl.gz", [fine, line])
    kept, dropped = readers.strict_qa_records(spark, str(tmp_path))
    assert sorted((r.q, r.a) for r in kept.collect()) == [("", "x"), ("missing answer", ""), ("q", "a")]
    assert sorted(r.path.rsplit("/", 1)[1].split(".")[0] for r in dropped.collect()) == ["blank", "broken", "list", "null", "number"]


def test_forum_filters_reach_the_scan(spark, tmp_path):
    parquet(tmp_path / "f.parquet", {"文本": [" a ", None, "None", "", " ", "b"], "块类型": ["文本"] * 5 + ["其他"], "unused": [1] * 6})
    blocks = readers.forum_blocks(spark, str(tmp_path))
    assert [r.text for r in blocks.orderBy("row_in_file").collect()] == ["a", ""]
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    plan = plan.replace("`", "")
    assert "EqualTo(块类型,文本)" in plan and "Not(EqualTo(文本,None))" in plan and "unused:" not in plan


def test_text_columns_and_nulls(spark, tmp_path):
    parquet(tmp_path / "t.parquet", {"text": ["a", None, ""], "other": ["x"] * 3})
    for nulls, expected in (("drop", ["a", ""]), ("literal", ["a", "None", ""]), ("empty", ["a", "", ""])):
        rows = readers.text_column(spark, str(tmp_path), nulls).orderBy("row_in_file").collect()
        assert [r.text for r in rows] == expected
    assert "other" not in readers.text_column(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        readers.text_column(spark, str(tmp_path), "keep")


def test_one_bad_book_does_not_stop_the_others(spark, tmp_path):
    (tmp_path / "good.txt").write_text("一\n二", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"fine\n\xff\xfe\n")
    good, bad = readers.book_lines(spark, str(tmp_path))
    assert [r.text for r in good.orderBy("row_in_file").collect()] == ["一\n", "二\n"]
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.txt"]


def test_categories(spark):
    paths = [f"forum/{i}.parquet" for i in range(5)] + ["qa/site/a.jsonl.gz", "qa/site/readme.md", "web/x.parquet", "misc/y"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = sorted((r.category, r.path) for r in cat.categorize(files, CATEGORIES).collect())
    assert kept == [
        ("forum", "forum/0.parquet"),
        ("forum", "forum/1.parquet"),
        ("qa_site", "qa/site/a.jsonl.gz"),
        ("web", "web/x.parquet"),
    ]
    assert [c.name for c in cat.choose(CATEGORIES, ["web", "forum"])] == ["web", "forum"]
    assert cat.choose(CATEGORIES) == list(CATEGORIES)
    with pytest.raises(ValueError, match="unknown"):
        cat.choose(CATEGORIES, ["video"])
    assert [r.path for r in cat.slice_of(files, 1, 2).collect()] == ["forum/1.parquet", "forum/2.parquet"]


def test_numbers_go_on_after_the_highest(spark):
    used = spark.createDataFrame([(2,), (9,)], "source_no int")
    files = spark.createDataFrame([(p,) for p in "cab"], "path string")
    got = cat.allot_numbers(files, used).collect()
    assert sorted((r.path, r.source_no) for r in got) == [("a", 10), ("b", 11), ("c", 12)]
    assert cat.next_number(used.where("source_no > 99"), default=3).first().next_source_no == 3


def numbers(made):
    return sorted({r.source_no for r in made.collect()})


@pytest.fixture
def fetched(tmp_path):
    root = tmp_path / "fetched"
    gz(root / "qa/site/2.jsonl.gz", [record(q="q2", a="a\r\n\r\n2")])
    gz(root / "qa/site/1.jsonl.gz", [record(q="q1", a="a1"), "broken"])
    for i in range(3):
        parquet(root / f"forum/{i}.parquet", {"文本": [f"f{i}\n \nx"], "块类型": ["文本"]})
    for i in range(2):
        parquet(root / f"web/{i}.parquet", {"text": [f"w{i}", None]})
    return root


def test_extraction_end_to_end(spark, tmp_path, fetched, caplog):
    job = Extraction(spark, str(tmp_path / "out"))
    with caplog.at_level(logging.WARNING):
        assert numbers(job.run(str(fetched), CATEGORIES)) == [1, 2, 3, 4]
    assert "news: no new file" in caplog.text
    rows = [(r.source_no, r.text) for r in job.docs().orderBy("source_no", "doc_ord").collect()]
    assert rows == [
        (1, "問：q1\n答：a1\n\n"),
        (1, "問：q2\n答：a\n2\n\n"),
        (2, "f0\nx\n\n"),
        (2, "f1\nx\n\n"),
        (3, "w0\n"),
        (4, "w1\n"),
    ]
    assert numbers(job.run(str(fetched), CATEGORIES)) == []
    gz(fetched / "qa/site/3.jsonl.gz", [record(q="q3", a="a3")])
    assert numbers(job.run(str(fetched), CATEGORIES, ["qa_site"])) == [5]
    assert [r.text for r in job.docs().where("source_no = 5").collect()] == ["問：q3\n答：a3\n\n"]


def test_a_slice_of_a_category(spark, tmp_path, fetched):
    job = Extraction(spark, str(tmp_path / "out"))
    assert numbers(job.run(str(fetched), CATEGORIES, ["web"], start=1, count=5, first_number=3)) == [3]
    assert [r.text for r in job.docs().collect()] == ["w1\n"]


def test_orphans_of_a_dead_extraction_are_ignored(spark, tmp_path, fetched):
    job = Extraction(spark, str(tmp_path / "out"))
    job.run(str(fetched), CATEGORIES, ["web"])
    before = job.docs().count()
    dead = spark.createDataFrame([(1, 99, "ghost")], "source_no int, doc_ord bigint, text string")
    sinks.write_documents(dead, str(tmp_path / "out" / "docs" / "run=dead"))
    assert job.docs().count() == before


def test_sinks(spark):
    docs = spark.createDataFrame([(1, "a\r\n\r\nb"), (1, " "), (2, "中")], "source_no int, text string")
    assert [r.text for r in sinks.as_clean_blocks(docs).collect()] == ["a\nb\n\n", "\n\n", "中\n\n"]
    assert sinks.as_clean_blocks(docs, drop_empty=True).count() == 2
    assert [r.text for r in sinks.as_lines(docs).collect()][2] == "中\n"
    report = sinks.size_report(docs.where("source_no = 2")).first()
    assert (report.docs, report.chars, report.bytes, report.mb) == (1, 1, 3, 3 / 1048576)


def test_text_files_give_the_documents_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, i, f"{i}\nx\n") for i in range(50)] + [(2, 0, "y\n\n")], "source_no int, doc_ord bigint, text string")
    sinks.write_source_text(docs, str(tmp_path / "t"))
    lines = readers.documents_by_line(spark, str(tmp_path / "t"))
    files = cat.list_files(spark, str(tmp_path / "t"), "*.txt").select(
        "path", F.regexp_extract("path", "source_no=([0-9]+)", 1).cast("int").alias("source_no"),
        F.regexp_extract("name", "part-([0-9]+)", 1).cast("int").alias("file_ord"),
    )
    rows = readers.place(lines, files).orderBy("source_no", "doc_ord").collect()
    assert "".join(r.text for r in rows if r.source_no == 1) == "".join(f"{i}\nx\n" for i in range(50))
    assert "".join(r.text for r in rows if r.source_no == 2) == "y\n\n"


def test_any_name_of_folders_and_files(spark, tmp_path):
    root = tmp_path / "new files [1]" / "Ünï+x%20"
    for name in ("a b", "c[1]", "d{2},e", "ü?", "p+q", "r%20s", "t*"):
        gz(root / f"qa/site/{name}.jsonl.gz", [record(q=name, a="a")])
    job = Extraction(spark, str(tmp_path / "out"))
    assert numbers(job.run(str(root), CATEGORIES, ["qa_site"])) == [1]
    texts = sorted(r.text for r in job.docs().collect())
    assert texts == sorted(f"問：{n}\n答：a\n\n" for n in ("a b", "c[1]", "d{2},e", "ü?", "p+q", "r%20s", "t*"))
    assert numbers(job.run(str(root), CATEGORIES, ["qa_site"])) == []


def test_line_orders_never_repeat(spark, tmp_path):
    (tmp_path / "blank.txt").write_text("\n" * 4000 + "end")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        lines = readers.text_lines(spark, str(tmp_path / "blank.txt"))
        assert lines.count() == lines.select("row_in_file").distinct().count() == 4001
        assert lines.orderBy(F.col("row_in_file").desc()).first().line == "end"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_orders_of_very_many_files_fit_and_what_does_not_is_an_error(spark):
    rows = spark.createDataFrame([("a", 5, "x"), ("b", (1 << 33) - 1, "y")], "path string, row_in_file bigint, text string")
    many = spark.createDataFrame([("a", 1, 1 << 29), ("b", 1, (1 << 30) - 1)], "path string, source_no int, file_ord bigint")
    placed = readers.place(rows, many).orderBy("doc_ord").collect()
    assert [(r.text, r.doc_ord >> 33) for r in placed] == [("x", 1 << 29), ("y", (1 << 30) - 1)]
    assert placed[1].doc_ord == (1 << 63) - 1
    with pytest.raises(Exception, match="no order left for b"):
        readers.place(rows, many.withColumn("file_ord", F.col("file_ord") * 2)).collect()
    few = many.withColumn("file_ord", F.lit(0))
    with pytest.raises(Exception, match="no order left for"):
        readers.place(rows.withColumn("row_in_file", F.lit(1 << 40)), few).collect()


def cut_short(path, share=2):
    whole = path.read_bytes()
    path.write_bytes(whole[: len(whole) // share])


def test_files_that_cannot_be_read_are_set_aside_by_name(spark, tmp_path, fetched, caplog):
    lines = [record(q=f"q{i}", a=f"a{i * i}") for i in range(3000)]
    for name in ("0 first", "3+[x]", "9"):
        gz(fetched / f"qa/site/{name}.jsonl.gz", lines)
    cut_short(fetched / "qa/site/0 first.jsonl.gz")
    cut_short(fetched / "qa/site/3+[x].jsonl.gz", 3)
    (fetched / "forum/1.parquet").write_bytes(b"no parquet at all")
    job = Extraction(spark, str(tmp_path / "out"))
    with caplog.at_level(logging.WARNING):
        made = job.run(str(fetched), CATEGORIES)
    assert numbers(made) == [1, 2, 3, 4]
    assert sorted((r.category, r.path, r.reason) for r in job.set_aside().collect()) == [
        ("forum", "forum/1.parquet", "unreadable"),
        ("qa_site", "qa/site/0 first.jsonl.gz", "unreadable"),
        ("qa_site", "qa/site/3+[x].jsonl.gz", "unreadable"),
    ]
    assert "0 first.jsonl.gz cannot be read" in caplog.text
    assert not job.manifest().where("path LIKE '%first%' OR path = 'forum/1.parquet'").count()
    texts = [r.text for r in job.docs().where("source_no = 1").orderBy("doc_ord").collect()]
    assert texts[:2] == ["問：q1\n答：a1\n\n", "問：q2\n答：a\n2\n\n"] and len(texts) == 3002
    assert [r.text for r in job.docs().where("source_no = 2").collect()] == ["f0\nx\n\n"]

    gz(fetched / "qa/site/0 first.jsonl.gz", lines[:2])  # fetched again, whole this time
    (fetched / "qa/site/3+[x].jsonl.gz").unlink()
    made = job.run(str(fetched), CATEGORIES, ["qa_site"])
    assert [(r.path, r.source_no) for r in made.collect()] == [("qa/site/0 first.jsonl.gz", 5)]
    assert job.docs().where("source_no = 5").count() == 2


def test_other_failures_are_raised(spark, tmp_path, fetched, monkeypatch):
    def failing(*_, **__):
        raise RuntimeError("disk full")

    monkeypatch.setattr(sinks, "write_documents", failing)
    job = Extraction(spark, str(tmp_path / "out"))
    with pytest.raises(RuntimeError, match="disk full"):
        job.run(str(fetched), CATEGORIES)
    assert job.manifest().count() == 0 and job.set_aside().count() == 0


def test_strict_extraction_drops_files_and_nulls_may_be_literal(spark, tmp_path, fetched):
    job = Extraction(spark, str(tmp_path / "out"))
    assert numbers(job.run(str(fetched), CATEGORIES, ["qa_site", "web"], strict=True, nulls="literal")) == [1, 2, 3]
    assert [(r.path, r.reason) for r in job.set_aside().collect()] == [("qa/site/1.jsonl.gz", "invalid records")]
    rows = [(r.source_no, r.text) for r in job.docs().orderBy("source_no", "doc_ord").collect()]
    assert rows == [(1, "問：q2\n答：a\n2\n\n"), (2, "w0\n"), (2, "None\n"), (3, "w1\n"), (3, "None\n")]


def test_the_scan_is_bounded_by_paths_and_time_and_names_no_file(spark, tmp_path, fetched, monkeypatch):
    import os

    from pyspark.sql import SparkSession

    job = Extraction(spark, str(tmp_path / "out"))
    job.run(str(fetched), CATEGORIES, ["qa_site"])
    for name in "12":
        cut_short(fetched / f"qa/site/{name}.jsonl.gz")
        os.utime(fetched / f"qa/site/{name}.jsonl.gz", (1e9, 1e9))
    gz(fetched / "qa/site/0.jsonl.gz", [record(q="q0", a="a0")])
    made = []
    create = SparkSession.createDataFrame
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, data, *a, **k: made.extend(data) or create(self, data, *a, **k))
    assert numbers(job.run(str(fetched), CATEGORIES, ["qa_site"])) == [2]
    assert made == [] and job.set_aside().count() == 0  # the files of the first run are not opened, nor are paths sent out


def test_books_keep_their_order_and_a_blank_line_between(spark, tmp_path):
    root = tmp_path / "fetched"
    root.mkdir()
    for name, text in {"2": "b1\nb2\n", "1": "a1\n\na2"}.items():
        (root / f"{name}.txt").write_text(text)
    (root / "3.txt").write_bytes(b"\xff\xfe\n")
    job = Extraction(spark, str(tmp_path / "out"))
    assert numbers(job.run(str(root), [cat.Category("books", "", ".txt")])) == [1]
    rows = job.docs().orderBy("source_no", "doc_ord").collect()
    assert "".join(r.text for r in rows) == "a1\n\na2\n\nb1\nb2\n\n"
