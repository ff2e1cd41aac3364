"""Token ids as ORC files in document order.

Stripes hold the ids with integer run-length encoding; row indexes and Bloom filters on the document id let a reader
skip row groups and stripes, and every stripe can be read by a task of its own.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.pieces import GROUP, LONGEST, chunks, pattern, plain
from tokenloom.llm.registry import written
from tokenloom.session import row_partitions

#: Rows of equal ids are ordered by ``tie``, their place in the input.
SCHEMA = "doc_id BIGINT, tie BIGINT, ids ARRAY<INT>"

#: Chunks of each kind and pieces remembered by a worker; more are encoded anew.  Results do not depend on it.
CHUNKS, PIECES = 800_000, 400_000

#: New chunks that are cut into pieces as one text.
JOINT = 1000

#: Size of a shuffled text against its size in the compressed input.
GROWTH = 2.5

_PACK = [struct.Struct(f"<{n}i").pack for n in range(LONGEST)]

_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "compression": "snappy",
}


class _Known(dict):
    """Encoded chunks.  A chunk that is missing is encoded when it is asked for, and remembered unless it is long."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self._encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self._encode(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def bound(self, most: int) -> None:
        if len(self) > most:
            self.clear()


class LibraryBpe:
    """Texts encoded by the model of a tokenizers file, each distinct chunk and piece once while it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        cutter = tokenizer.pre_tokenizer
        if tokenizer.normalizer is not None or not isinstance(cutter, pre_tokenizers.ByteLevel) or cutter.add_prefix_space or not cutter.use_regex:
            raise ValueError(f"{path} is no plain byte-level tokenizer")
        self._tokenize = tokenizer.model.tokenize
        # A byte is written as the character of its number if that is printable, else as one of those from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self._letters = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}
        self._space = chr(self._letters[32])
        self._pieces = _Known(self._piece)
        self._spaced = _Known(self._after_space)
        self._whole = _Known(self._chunk)
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        if odd := [t["content"] for t in added if any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))]:
            raise ValueError(f"{path} has added tokens that do not match as they are: {odd}")
        self._added = {t["content"]: np.array([t["id"]], dtype="<i4").tobytes() for t in added}
        # Where several begin at one place the longest counts.
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")").split

    def ids(self, texts: list[str], split_added: bool) -> Iterator[bytes]:
        """The ids of each text; with ``split_added`` the file's added tokens are taken out of the texts first."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._group(group, split_added)
                group, size = [], 0
        yield from self._group(group, split_added)

    def _group(self, texts: list[str], split_added: bool) -> Iterator[bytes]:
        for known, most in ((self._spaced, CHUNKS), (self._whole, CHUNKS), (self._pieces, PIECES)):
            known.bound(most)
        marked = [split_added and any(a in t for a in self._added) for t in texts]
        easy = [not m and len(t) < GROUP and plain(t) for t, m in zip(texts, marked)]
        found = iter(self._at_spaces([t for t, e in zip(texts, easy) if e]))
        for text, m, e in zip(texts, marked, easy):
            if e:
                yield next(found)
            elif m:
                first, *rest = self._cut(text)  # texts and added tokens in turn
                yield b"".join([self._text(first), *(x for a, t in zip(rest[::2], rest[1::2]) for x in (self._added[a], self._text(t)))])
            else:
                yield self._text(text)

    def _text(self, text: str) -> bytes:
        return b"".join(map(self._whole.__getitem__, chunks(text)))

    def _at_spaces(self, texts: list[str]) -> list[bytes]:
        """Texts that may be split at spaces: each distinct chunk is looked up once for all its places."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = lists.offsets.to_numpy()
        distinct = lists.values.dictionary_encode()
        which = distinct.indices.to_numpy().copy()
        firsts = lists.values.take(pa.array(offsets[:-1])).to_pylist()
        which[offsets[:-1]] = np.arange(len(firsts)) + len(distinct.dictionary)  # no space precedes them
        used = np.zeros(len(distinct.dictionary), dtype=bool)
        used[which[which < len(used)]] = True
        spaced = self._looked_up(distinct.dictionary.to_numpy(zero_copy_only=False).tolist(), used)
        encoded = pa.array([*spaced, *map(self._whole.__getitem__, firsts)], pa.large_binary())
        joined = encoded.take(pa.array(which))  # all ids of all texts, in their order
        _, ends, data = joined.buffers()
        cuts = np.frombuffer(ends, dtype=np.int64)[offsets].tolist()
        held = memoryview(data) if data is not None else b""
        return [bytes(held[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _looked_up(self, found: list[str], used: np.ndarray) -> list[bytes]:
        """The ids of the chunks in use, each after a space; new ones are encoded together."""
        known = self._spaced
        out = [known.get(c) if u else b"" for c, u in zip(found, used.tolist())]
        joint = []
        for i, ids in enumerate(out):
            if ids is None:
                chunk = found[i]
                if chunk.isalpha() and chunk.isascii():  # one piece, whose bytes stand for themselves
                    out[i] = ids = self._ids(self._space + chunk)
                    if len(chunk) <= LONGEST:
                        known[chunk] = ids
                elif len(chunk) <= LONGEST and chunk and chunk.strip() == chunk:
                    joint.append(i)
                else:
                    out[i] = known[chunk]
        for at in range(0, len(joint), JOINT):
            places = joint[at : at + JOINT]
            # A space between two characters that are none begins a match wherever it stands, and nothing else begins with one.
            parts: list[list[bytes]] = []
            for piece in pattern().findall("".join([" " + found[i] for i in places])):
                if piece[0] == " ":
                    ids = known.get(piece[1:])
                    if ids is None:
                        ids = known[piece[1:]] = self._piece(piece)
                    parts.append([ids])
                else:
                    parts[-1].append(self._pieces[piece])
            for i, part in zip(places, parts, strict=True):
                out[i] = known[found[i]] = part[0] if len(part) == 1 else b"".join(part)
        return out

    def _after_space(self, chunk: str) -> bytes:
        """A chunk without the space that precedes it."""
        return self._chunk(" " + chunk)

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for piece in pattern().findall(chunk):
            if piece[0] == " " and (word := piece[1:]).isalpha():  # remembered with the chunks that are such a word
                ids = self._spaced.get(word)
                if ids is None:
                    ids = self._piece(piece)
                    if len(word) <= LONGEST:
                        self._spaced[word] = ids
                out.append(ids)
            else:
                out.append(self._pieces[piece])
        return out[0] if len(out) == 1 else b"".join(out)

    def _piece(self, piece: str) -> bytes:
        return self._ids(piece.encode().decode("latin-1").translate(self._letters))

    def _ids(self, letters: str) -> bytes:
        ids = [t.id for t in self._tokenize(letters)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}i", *ids)


@lru_cache(maxsize=2)
def load(path: str) -> LibraryBpe:
    """Once for each worker."""
    return LibraryBpe(path)


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", split_added: bool = False
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write them to ``path`` in ascending order of their ids.

    Null and empty texts give the end id alone; null ids come first; rows of equal ids keep the order of the input, and
    repeated rows are all written.  With ``split_added`` the file's added tokens in a text become their ids, as the library does
    unless told otherwise; without it they are ordinary text (the library's ``encode_special_tokens``).  An empty table gives readable files without rows.  Texts are shuffled once, by ranges of the id.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = [F.col("doc_id").asc_nulls_first(), "tie"]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("tie"), text.alias("text"))
    ranges = row_partitions(docs, GROWTH)
    rows = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    end = np.array([end_id], dtype="<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = load(tokenizer)
        for batch in batches:
            encoded = [ids + end for ids in library.ids(batch.column(2).to_pylist(), split_added)]
            ends = np.concatenate([[0], np.cumsum([len(ids) // 4 for ids in encoded])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["doc_id", "tie", "ids"])

    rows.mapInArrow(run, SCHEMA).write.options(**_OPTIONS).orc(path)


def read(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The written rows; with ``doc_ids`` row groups whose statistics or Bloom filters rule them out are not read."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files, for each document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).view(np.uint8)
            ends = (ids.offsets.to_numpy() * 4).tolist()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:])]
            sizes = np.diff(ends) // 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                names=["file", "doc_id", "tie", "n_tokens", "ids_crc32"],
            )

    rows = read(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "tie", "ids")
    thin = written(rows.mapInArrow(run, "file STRING, doc_id BIGINT, tie BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"), "token-digests")
    # A range of ids is one file, or several where the writer split it; files are few beside their rows.
    files = thin.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min(F.struct(F.col("doc_id"), F.col("tie"))).alias("first"))
    before = Window.orderBy(F.col("first.doc_id").asc_nulls_first(), "first.tie").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    return thin.join(files, "file").select(
        "doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32"
    )
