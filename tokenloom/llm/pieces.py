"""Cutting texts into the pieces that byte-level BPE encodes one by one, with a bounded memory of earlier pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Chunks remembered by a worker unless it says otherwise; more are encoded anew.  Memory, never results, depends on it.
REMEMBERED = 800_000
#: Chunks longer than this are not remembered.
LONGEST = 64
#: Characters held as chunks at a time.
GROUP = 4 << 20

# White space of the pattern: Python's \s also holds \x1c to \x1f, which the pattern takes for symbols.
_RUN = re.compile("[^\\S\x1c-\x1f]*[\\S\x1c-\x1f]+|[^\\S\x1c-\x1f]+")
_WIDE_GAP = re.compile("[^\\S\x1c-\x1f] ")
_GAPS = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")


@lru_cache(maxsize=1)
def pattern():
    import regex

    return regex.compile(PATTERN)


def chunks(text: str) -> list[str]:
    """Cut a text where white space follows something else; the first chunk as it is, the others with what precedes them.

    No match of the pattern crosses such a place, nor does a match depend on what lies beyond it, so
    chunks can be matched one by one.  Where every gap is one space, splitting at spaces finds the same
    places faster; chunks then lack that space, which ``Memory`` puts back.
    """
    return _RUN.findall(text)


def plain(text: str) -> bool:
    """Whether no white space precedes a space, so that the text may be split at spaces."""
    if text.isascii():
        return not any(gap in text for gap in _GAPS)
    return "  " not in text and not _WIDE_GAP.search(text)


class Memory:
    """Encoded chunks, kept for later batches.  ``encode`` turns distinct chunks into bytes of ids."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], remembered: int | None = None):
        self._encode, self._remembered = encode, REMEMBERED if remembered is None else remembered
        self._spaced: dict[str, bytes] = {}
        self._whole: dict[str, bytes] = {}

    def _learn(self, known: dict[str, bytes], wanted: set[str], lead: str) -> list[str]:
        """Encode what is wanted and not known; returns the chunks too long to keep."""
        if len(known) > self._remembered:
            known.clear()
        new = list(wanted.difference(known))
        known.update(zip(new, self._encode([lead + c for c in new] if lead else new), strict=True))
        return [c for c in new if len(c) > LONGEST]

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian numbers in bytes."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        cut, spaced, whole = [], set(), set()
        for text in texts:
            if plain(text):
                first, *rest = text.split(" ")
                spaced.update(rest)
                whole.add(first)
            else:
                first, rest = None, chunks(text)
                whole.update(rest)
            cut.append((first, rest))
        long_spaced, long_whole = self._learn(self._spaced, spaced, " "), self._learn(self._whole, whole, "")
        for first, rest in cut:
            if first is None:
                yield b"".join(map(self._whole.__getitem__, rest))
            else:
                yield self._whole[first] + b"".join(map(self._spaced.__getitem__, rest))
        for known, long in ((self._spaced, long_spaced), (self._whole, long_whole)):
            for c in long:
                del known[c]
