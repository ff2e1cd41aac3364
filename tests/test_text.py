import random
import re
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import names as nm
from tokenloom.functions import text as tx

PIECES = [*tx.WHITESPACE, "\r\n", "a", "b c", "é", "中文", "\U0001f600", "​", "x　y", "\n\n", " \t\n", "*~+%/"]


def samples(n=400):
    rng = random.Random(7)
    return ["", " ", "　", *("".join(rng.choices(PIECES, k=rng.randint(1, 12))) for _ in range(n))]


def apply(spark, function, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def clean(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return "\n".join(line for line in text.split("\n") if line.strip())


@pytest.mark.parametrize(
    "function, expected",
    [
        (tx.unicode_strip, str.strip),
        (tx.normalize_newlines, lambda t: re.sub("\r\n?", "\n", t)),
        (tx.drop_blank_lines, lambda t: "\n".join(x for x in t.split("\n") if x.strip())),
        (tx.clean_block, clean),
        (tx.percent_encode, lambda t: quote(t, safe="")),
    ],
)
def test_equals_python(spark, function, expected):
    texts = samples()
    assert apply(spark, function, texts) == [expected(t) for t in texts]


def test_whitespace_is_what_python_calls_space():
    assert sorted(tx.WHITESPACE) == [c for c in map(chr, range(0x110000)) if c.isspace()]


def test_missing_values(spark):
    assert apply(spark, tx.empty_if_missing, [None, "a"]) == ["", "a"]
    assert apply(spark, tx.null_as_literal, [None, "a"]) == ["None", "a"]


def test_titles(spark):
    rows = [("t ", " b"), (None, " b "), ("", "b"), ("  ", "b")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, b string")
    got = [r.v for r in df.select("i", tx.title_and_body(F.col("t"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == ["t\nb", "b", "b", "\nb"]


def test_forum_filter_comes_before_stripping(spark):
    rows = [("a", "文本"), (None, "文本"), ("", "文本"), ("None", "文本"), (" ", "文本"), ("a", "其他"), ("a", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, k string")
    kept = df.where(tx.is_forum_text(F.col("t"), F.col("k"))).orderBy("i").collect()
    assert [r.i for r in kept] == [0, 4]


def test_names(spark):
    df = spark.createDataFrame([("a/b/" + "x" * 60, 12345), ("plain", 7)], "p string, n bigint")
    row, plain = df.select(
        nm.base_name(F.col("p"), 50).alias("base"),
        nm.flat_path(F.col("p")).alias("flat"),
        nm.shard_name(F.lit("train"), F.col("n")).alias("name"),
        nm.padded_size(F.col("n")).alias("padded"),
        nm.ceil_div(F.col("n"), 7).alias("up"),
    ).collect()
    assert (row.base, row.name, row.padded, row.up) == ("x" * 50, "train_12345.npy", 12416, 1764)
    assert (plain.flat, plain.name, plain.up) == ("plain", "train_0007.npy", 1)
    sizes = spark.range(1).select(nm.padded_size(151_643).alias("v"), nm.rate(F.lit(1), F.lit(0)).alias("r")).first()
    assert sizes.v == 151_680 and sizes.r is None


def test_numbers_in_names(spark):
    names = ["input1.txt", "input20.txt", "input3.txt.tmp", "xinput4.txt", "input.txt", "input99999999999.txt"]
    assert apply(spark, lambda c: nm.number_in(c, nm.SOURCE_FILE_PATTERN), names) == [1, 20, None, None, None, None]
