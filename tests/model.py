"""The corpus in plain Python lists, for small inputs: what the Spark jobs must equal."""

import math

EOS = 0x110000


def stream(docs, eos="source", sources=()):
    """Global token stream of ``(source_no, doc_ord, text)``."""
    by_source = {s: [] for s in sources}
    for source, order, text in docs:
        by_source.setdefault(source, []).append((order, text))
    tokens = []
    for source in sorted(by_source):
        for _, text in sorted(by_source[source]):
            tokens += [ord(c) for c in text]
            if eos == "document":
                tokens.append(EOS)
        if eos == "source":
            tokens.append(EOS)
    return tokens


def shards(tokens, size, ratio):
    cut = int(len(tokens) * ratio)
    out = {}
    for split, part in (("val", tokens[:cut]), ("train", tokens[cut:])):
        for i in range(math.ceil(len(part) / size)):
            out[split, i] = part[i * size : (i + 1) * size]
    return out


def read_order(lengths, width, shard=0, position=0, reads=100):
    """Positions a reader visits, one batch after the other, passing over shards too short for any."""
    if all(n < width + 1 for n in lengths):
        return []
    visited = []
    while len(visited) < reads:
        if position + width + 1 <= lengths[shard]:
            visited.append((shard, position))
            position += width
        else:
            shard, position = (shard + 1) % len(lengths), 0
    return visited
