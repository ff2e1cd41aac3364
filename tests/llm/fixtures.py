"""Small tables with the cases that every operator must bear."""

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, id BIGINT, n BIGINT, size INT, row INT, label INT"

LONG = "lorem ipsum dolor sit amet " * 8000

BASE = "The quick brown fox jumps over the lazy dog and runs far away from the old farm house before night falls over the hills"

ODD = [
    None,
    "",
    " ",
    "\n\t ",
    "a",
    "one two three",
    " 'tis don't  we'll\n \n x\t  y\x1c\x1dz 　   a\x85 b  ",
    "a" * 700,
    "日本語テキスト " * 20,
    "½²Ⅷ٣ 一二三 <|endoftext|>",
    "😀😀 👩‍👩‍👧 \x1f !\x1f a",
    LONG,
    BASE,
    BASE,
    BASE + " again",
    BASE.upper(),
]


def docs(spark, rows):
    """A table of (doc_id, text) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 5, 6, 7, 8, 9) for i, t in rows], SCHEMA)


def odd_docs(spark):
    """All odd texts, a row without an id, and a row that comes twice."""
    rows = list(enumerate(ODD)) + [(None, BASE), (4, "a"), (4, "a")]
    return docs(spark, rows), rows
