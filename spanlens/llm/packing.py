"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the longest sequence fill whole sequences first.  What is left is packed window by window, the
longest pieces first: a piece goes into the open sequence with the least room that holds it.  Where none does, a
sequence is opened whose cost for each token that the rest of the window can fill is least, over all permitted lengths
at once: ``cost`` counts a sequence's tokens, attention that grows with the square of its length, and a fixed part.
In the end each sequence shrinks to the shortest permitted length that holds its contents.

A window is ``WINDOW`` consecutive pieces of a partition: nothing is shuffled, memory is bounded, and no document is
dropped or cut except those longer than the longest sequence.  Sequences are numbered by partition and place, so a repeated
task gives the same ones.

Defined cases: null and empty texts are one piece, the end token alone; documents with a null or repeated id are packed
each on its own; an empty table gives an empty result; other columns are left alone.
"""

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, parts, remembered, whole
from .pieces import Vocabulary, model_path, pre_tokens

SIZES = (1024, 2048, 4096, 8192)
WINDOW = 1 << 15
#: Tokens that a sequence costs beyond its own, and the length at which attention costs as much as the rest.
FIXED_TOKENS, ATTENTION_LENGTH = 256, 32768
CACHE, CACHE_CHARS = 150_000, 64
_known: dict[str, dict[str, int]] = remembered()


def cost(size: int) -> float:
    return FIXED_TOKENS + size * (1 + size / ATTENTION_LENGTH)


def token_lengths(texts: list[str], path: str) -> list[int]:
    """Tokens of each text.  The pieces of a pre-token are counted once for each batch, and short ones remembered."""
    known = _known.setdefault(path, {})
    split = [pre_tokens(t) for t in texts]
    new = list({w for s in split for w in s}.difference(known))
    fresh = {w: len(ids) for w, ids in zip(new, Vocabulary.at(path).encode(new))}
    get = (lambda w: fresh[w] if w in fresh else known[w]) if fresh else known.__getitem__
    out = [sum(map(get, s)) for s in split]
    room = CACHE - len(known)
    if room > 0:
        known.update((w, fresh[w]) for w in new[:room] if len(w) <= CACHE_CHARS)
    return out


def pack(lengths: list[int], sizes=SIZES, price: Callable[[int], float] = cost) -> tuple[list, list, list]:
    """For each piece (none longer than the longest size) its sequence and its place in it, and the sequences' sizes."""
    sizes = sorted(sizes)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left = sum(lengths)
    room: list[tuple[int, int]] = []  # (space, sequence), in order
    filled: list[int] = []
    opened: list[int] = []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            space, b = room.pop(at)
        else:
            b = len(filled)
            space = min((s for s in sizes if s >= n), key=lambda s: (price(s) / min(s, left), s))
            filled.append(0)
            opened.append(space)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        left -= n
        if space > n:
            insort(room, (space - n, b))
    return bins, offsets, [next(s for s in sizes if s >= max(f, 1)) for f in filled]


_OUT = "piece long, start long, n_tokens long, bin_id string, bin_size long, bin_offset long"


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
                   sizes=SIZES, window: int = WINDOW, end_tokens: int = 1) -> DataFrame:
    """One row for each piece of a document: its tokens from ``start`` on, the sequence it is in and where."""
    path, longest = model or model_path(), max(sizes)
    source = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    names = ["id", *[x.split()[0] for x in _OUT.split(", ")]]

    def step(batches):
        part = TaskContext.get().partitionId()
        ids, pieces, number = [], [], 0

        def close(kind):
            nonlocal ids, pieces, number
            n, start = np.array([p[1] for p in pieces]), np.array([p[2] for p in pieces])
            bins, offsets, final = pack(n.tolist(), sizes)
            out = pa.record_batch(
                [pa.array(ids, kind), pa.array([p[0] for p in pieces], pa.int64()), pa.array(start, pa.int64()),
                 pa.array(n, pa.int64()), pa.array([f"{part}-{number}-{b}" for b in bins]),
                 pa.array([final[b] for b in bins], pa.int64()), pa.array(offsets, pa.int64())], names)
            ids, pieces, number = [], [], number + 1
            return out

        for batch in parts(batches):
            kind = batch.column(0).type
            for doc, n in zip(batch.column(0).to_pylist(), token_lengths(batch.column(1).to_pylist(), path)):
                total = n + end_tokens
                for k, start in enumerate(range(0, total, longest) if total else [0]):
                    ids.append(doc)
                    pieces.append((k, min(longest, total - start), start))
                    if len(pieces) >= window:
                        yield close(kind)
        if pieces:
            yield close(kind)

    kind = source.schema["id"].dataType.simpleString()
    return map_arrow(source, step, f"id {kind}, {_OUT}").withColumnRenamed("id", id_col)
