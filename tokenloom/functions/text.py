"""Text cleaning and document composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode calls white space, as text-stripping in Python sees them.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The question/answer template and the separators after a document.
QUESTION_PREFIX = "問："
ANSWER_PREFIX = "\n答："
LINE_SEPARATOR = "\n"
BLOCK_SEPARATOR = "\n\n"
NULL_LITERAL = "None"


def unicode_strip(c: Column) -> Column:
    """Strip every Unicode white-space character from both ends (``trim`` alone knows U+0020 only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def empty_if_missing(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def null_as_literal(c: Column) -> Column:
    return F.coalesce(c, F.lit(NULL_LITERAL))


def normalize_newlines(c: Column) -> Column:
    """CR LF and lone CR become LF."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def drop_blank_lines(c: Column) -> Column:
    """Keep the lines that hold something besides white space; kept lines stay as they are."""
    lines = F.filter(F.split(c, "\n", -1), lambda line: unicode_strip(line) != "")
    return F.array_join(lines, "\n")


def clean_block(c: Column) -> Column:
    return drop_blank_lines(normalize_newlines(c))


def compose_qa(question: Column, answer: Column) -> Column:
    """The Q/A document of two already stripped strings."""
    return F.concat(F.lit(QUESTION_PREFIX), question, F.lit(ANSWER_PREFIX), answer)


def qa_is_complete(question: Column, answer: Column) -> Column:
    return (question != "") & (answer != "")


def title_and_body(title: Column, body: Column) -> Column:
    """Title line over the body; an empty or missing title leaves the body alone.

    A title of white space counts as present and leaves an empty first line.
    """
    stripped = unicode_strip(body)
    return F.when(
        title.isNotNull() & (title != ""), F.concat(unicode_strip(title), F.lit("\n"), stripped)
    ).otherwise(stripped)


def is_forum_text(text: Column, block_type: Column, wanted: str = "文本") -> Column:
    """Non-empty text of the wanted block type, tested before any stripping."""
    return text.isNotNull() & (text != "") & (text != NULL_LITERAL) & (block_type == wanted)


def percent_encode(c: Column) -> Column:
    """RFC 3986 percent-encoding with no character exempt but the unreserved ones."""
    form = F.url_encode(c)
    for java_form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(java_form), F.lit(plain))
    return form
