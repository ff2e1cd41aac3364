"""Tokenizers as column expressions.

``codepoint`` stays inside Catalyst.  ``bytes`` and the BPE tokenizers are Arrow UDFs: one call
per batch, never one per row.  The worker functions are closures over plain bytes, so a
cluster needs nothing of this package on its workers.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: how the end-of-text token reads when decoded.
EOS_TEXT = "<|endoftext|>"

_IDS = T.ArrayType(T.IntegerType())
_TEXT = T.StringType()

#: The tables of one tokenizer travel to every worker; this bounds them.
MAX_RANK_BYTES = 64 << 20


@dataclass(frozen=True)
class Tokenizer:
    """``encode``: text → array<int>; ``decode``: array<int> → text.

    ``count`` gives the number of tokens without building them, where that is possible; the
    layout of a corpus then needs no tokenizing pass.
    """

    name: str
    vocab_size: int
    eos_id: int
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    count: Callable[[Column], Column] | None = None


def _empty_tokens() -> Column:
    return F.array().cast(_IDS)


def codepoint() -> Tokenizer:
    """Token id = Unicode code point; end-of-text is the first id past them."""
    eos = 0x110000

    def encode(text: Column) -> Column:
        # split('') of an empty string yields one empty element, hence the guard
        points = F.transform(F.split(text, ""), lambda ch: F.ascii(ch))
        return F.when(F.length(text) > 0, points).otherwise(_empty_tokens())

    def decode(tokens: Column) -> Column:
        eos_hex = EOS_TEXT.encode("utf-32-be").hex()
        digits = F.transform(tokens, lambda t: F.when(t == eos, F.lit(eos_hex)).otherwise(F.lpad(F.hex(t), 8, "0")))
        # the decoder swallows one byte-order mark; give it one so that a mark in the text survives
        marked = F.concat(F.lit("0000feff"), F.array_join(digits, ""))
        return F.decode(F.unhex(marked), "UTF-32")

    def count(text: Column) -> Column:
        return F.coalesce(F.length(text), F.lit(0)).cast("bigint")

    return Tokenizer("codepoint", eos + 1, eos, encode, decode, count)


def utf8_bytes() -> Tokenizer:
    """Token id = UTF-8 byte."""
    eos = 256

    @F.arrow_udf(_IDS)
    def byte_ids(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # the Arrow buffer of a batch already is the concatenated token stream
        data = pc.fill_null(texts, "").cast(pa.binary())
        lengths = np.asarray(pc.binary_length(data), dtype=np.int64)
        offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
        np.cumsum(lengths, out=offsets[1:])
        stream = np.frombuffer(b"".join(data.to_pylist()), dtype=np.uint8).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(stream))

    def decode(tokens: Column) -> Column:
        eos_hex = EOS_TEXT.encode().hex()
        digits = F.transform(tokens, lambda t: F.when(t == eos, F.lit(eos_hex)).otherwise(F.lpad(F.hex(t), 2, "0")))
        return F.make_valid_utf8(F.unhex(F.array_join(digits, "")).cast("string"))

    def count(text: Column) -> Column:
        return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")

    return Tokenizer("bytes", eos + 1, eos, byte_ids, decode, count)


def _bounded(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_BYTES + 1)
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError(f"{path}: tokenizer tables over {MAX_RANK_BYTES} bytes are not shipped to workers")
    return raw


def rank_file_bpe(path: str, pattern: str, eos_id: int | None = None, name: str = "bpe") -> Tokenizer:
    """Byte-level BPE from a local rank file (``base64 rank`` per line) and its split pattern."""
    raw = _bounded(path)
    n_ranks = sum(1 for line in raw.splitlines() if line.strip())
    eos = n_ranks if eos_id is None else eos_id

    def build():
        import base64

        import tiktoken

        pairs = (line.split() for line in raw.splitlines() if line.strip())
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in pairs}
        return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={EOS_TEXT: eos})

    @F.arrow_udf(_IDS)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = build()
        for texts in batches:
            ids = encoding.encode_ordinary_batch([t or "" for t in texts.to_pylist()], num_threads=1)
            yield pa.array(ids, type=pa.list_(pa.int32()))

    @F.arrow_udf(_TEXT)
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow as pa

        encoding = build()
        for rows in batches:
            yield pa.array([None if ids is None else encoding.decode(ids) for ids in rows.to_pylist()], type=pa.string())

    return Tokenizer(name, max(eos + 1, n_ranks), eos, encode, decode)


def tokenizer_json(path: str, eos_token: str = EOS_TEXT, name: str = "tokenizer-json") -> Tokenizer:
    """A finished tokenizer in the common ``tokenizer.json`` form, from a local file."""
    from tokenizers import Tokenizer as JsonTokenizer

    raw = _bounded(path).decode("utf-8")
    probe = JsonTokenizer.from_str(raw)
    eos = probe.token_to_id(eos_token)
    if eos is None:
        raise ValueError(f"{path} has no token {eos_token!r}")

    @F.arrow_udf(_IDS)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow as pa
        from tokenizers import Tokenizer as Loaded

        loaded = Loaded.from_str(raw)
        for texts in batches:
            rows = loaded.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            yield pa.array([row.ids for row in rows], type=pa.list_(pa.int32()))

    @F.arrow_udf(_TEXT)
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow as pa
        from tokenizers import Tokenizer as Loaded

        loaded = Loaded.from_str(raw)
        for rows in batches:
            texts = [None if ids is None else loaded.decode(ids, skip_special_tokens=False) for ids in rows.to_pylist()]
            yield pa.array(texts, type=pa.string())

    return Tokenizer(name, probe.get_vocab_size(with_added_tokens=True), eos, encode, decode)
