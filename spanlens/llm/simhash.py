"""SimHash fingerprints and every link between them within a radius, by covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of r + 1 bits.  For each of the 2^(r+1) - 1 non-zero vectors v there is one
table, whose mask keeps the bits whose vector has an odd product with v.  At most r differing bits span at most r
dimensions, so some v is orthogonal to them all: in its table none of those bits is kept and the two fingerprints
collide.  A mask keeps about half of the bits, so unrelated fingerprints seldom meet.

Equal fingerprints are one node.  In a bucket of up to ``bucket`` different fingerprints each is compared with those not
yet reached, and only a spanning forest of the links leaves the task.  Larger buckets take an exact way without
comparisons: two fingerprints differ in at most 2h bits if and only if some value differs from each of them in at most h
bits, so all values within h of each fingerprint (over the bits that the mask leaves free) are the meeting points,
each shared by a bounded number of fingerprints.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; null ids come after all
others; an empty table gives an empty result; rows that repeat an id and a text are copies.
"""

from itertools import combinations
from math import gcd

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .common import map_arrow, names_apart, whole
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Different fingerprints up to which a bucket is compared directly; larger ones meet at midpoints.
BUCKET = 2048
_CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The bits set in over half of the XXH64 values of a text's word shingles, A-Z in lower case."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = (ends - [len(w) + 1 for w in words]), ends - 1
    last = ends[min(shingle, len(words)) - 1:].tolist()
    first = starts[:len(last)].tolist()
    votes, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), _CHUNK):
        hashes = np.array([digest(line[s:e], SEED) for s, e in zip(first[at:at + _CHUNK], last[at:at + _CHUNK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(first), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; ``fp`` is the fingerprint as a signed long."""
    source = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))

    def step(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return map_arrow(source, step, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks, as signed longs.

    The bits take their vectors in steps prime to the number of vectors: each is used as often as any other, and where
    there are more vectors than bits, those used lie far apart.
    """
    span = (1 << (radius + 1)) - 1
    step = next(s for s in range(round(span * 0.618), 2 * span) if gcd(s, span) == 1)
    vectors = [1 + i * step % span for i in range(bits)]
    found = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, span + 1)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in found]


def _forest(found: np.ndarray, radius: int):
    """Links that join the fingerprints of one bucket as all of its links would: (a, b), at most one for each."""
    rest, a, b = found, [], []
    while rest.size:
        wave, rest = [rest[0]], rest[1:]
        while wave and rest.size:
            near = np.bitwise_count(rest ^ wave[-1]) <= radius
            at = wave.pop()
            if near.any():
                new = rest[near]
                a.append(np.full(new.size, at, np.uint64))
                b.append(new)
                wave.extend(new)
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (found[:0], found[:0])


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links inside the buckets (place, key), whose fingerprints reach a task together and in order."""

    def step(batches):
        open_key, held = None, []

        def close():
            found = np.concatenate(held) if held else np.zeros(0, np.uint64)
            return _forest(found, radius) if found.size > 1 else (found[:0], found[:0])

        for batch in batches:
            place, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (key[1:] != key[:-1])) + 1
            out = []
            for start, end in zip([0, *cuts], [*cuts, len(fp)]):
                if start == end:
                    continue
                if (place[start], key[start]) != open_key:
                    out.append(close())
                    open_key, held = (place[start], key[start]), []
                held.append(fp[start:end].view(np.uint64))
            if out:
                a, b = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])
        a, b = close()
        yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = rows.repartition("place", "key").sortWithinPartitions("place", "key")
    return map_arrow(dealt.select("place", "key", "fp"), step, "a long, b long")


def _midpoint_links(rows: DataFrame, radius: int, covering: list[int]) -> DataFrame:
    """Links inside crowded buckets.  For an odd radius one end may be one bit nearer, so both are tried."""
    near, far = radius // 2, radius - radius // 2
    free = [[i for i in range(BITS) if not m >> i & 1] for m in covering]

    def flips(places, most):
        sets = [c for n in range(most + 1) for c in combinations(places, n)]
        return np.array([sum(1 << i for i in c) for c in sets], np.uint64)

    def step(batches):
        known = {}
        for batch in batches:
            place, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for at, x in zip(place.tolist(), fp):
                if at not in known:
                    wide = flips(free[at], far)
                    known[at] = wide, np.bitwise_count(wide) <= near
                wide, close = known[at]
                yield pa.record_batch(
                    [pa.array(np.full(wide.size, at, np.int32)), pa.array((x ^ wide).view(np.int64)),
                     pa.array(np.full(wide.size, x, np.uint64).view(np.int64)), pa.array(close)],
                    ["place", "z", "fp", "close"],
                )

    points = map_arrow(rows.select("place", "fp"), step, "place int, z long, fp long, close boolean")
    # Of the fingerprints at a meeting point, all are tied to the least of those that are close to it.
    least = points.filter("close").groupBy("place", "z").agg(F.min("fp").alias("b"))
    return points.join(least, ["place", "z"]).filter(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the different fingerprints ``fp`` of ``nodes`` that connect all those within ``radius``.

    Every link is a true one, and two fingerprints within the radius are always connected.
    """
    covering = masks(radius)
    tables = F.array(*[
        F.struct(F.lit(i).cast("int").alias("place"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(covering)
    ])
    rows = nodes.select("fp", F.explode(tables).alias("t")).select("t.place", "t.key", "fp")
    crowded = stored(
        rows.groupBy("place", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).drop("n"),
        "crowded-buckets",
    )
    if crowded.isEmpty():
        return _bucket_links(rows, radius)
    return _bucket_links(rows.join(crowded, ["place", "key"], "left_anti"), radius).unionByName(
        _midpoint_links(rows.join(crowded, ["place", "key"]), radius, covering)
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of ``df``: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id
    that chains of links within ``radius`` reach, its own included."""
    found = stored(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = stored(found.groupBy("fp").agg(F.min("id").alias("first")), "fingerprint-nodes")
    label = components(links(nodes, radius, bucket)).select(F.col("node").alias("fp"), F.col("component").alias("top"))
    placed = nodes.join(label, "fp", "left").withColumn("top", F.coalesce("top", "fp"))
    tops = placed.groupBy("top").agg(F.min("first").alias("component_id"))
    answer = stored(placed.join(tops, "top").select("fp", "component_id"), "fingerprint-components")
    return found.join(answer, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each component the row with the smallest id.

    Rows whose id repeats that smallest id are told apart by nothing, and one of them stays; rows without an id
    go where their component has one, and otherwise one of them stays.
    """
    key, top, rank, print_ = names_apart(df, "key", "top", "rank", "fp")
    placed = stored(near_duplicates(df, id_col, text_col, **settings), "near-duplicates").select(
        F.col(id_col).alias(key), F.col("component_id").alias(top), F.col("fingerprint").alias(print_)
    )
    # Ids are unique in a table of documents.  Where they are, what goes is a set of ids; the rest is a rare case.
    odd = placed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())
    odd = stored(odd.select(key), "repeated-ids")
    gone = placed.filter(F.col(key) != F.col(top)).select(key).distinct()
    if odd.isEmpty():
        return df.join(gone.withColumnRenamed(key, id_col), id_col, "left_anti").select(*df.columns)
    return _one_each(df, id_col, text_col, settings, (key, top, rank, print_))


def _one_each(df, id_col, text_col, settings, names):
    """The same for tables in which ids repeat or are missing: the rows are told apart by a stored row number."""
    key, top, rank, _ = names
    rows = stored(df.withColumn(key, F.monotonically_increasing_id()), "numbered-rows")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(key).alias("row"))
    ordered = rows.select(order.alias("order"), F.col(text_col))
    placed = near_duplicates(ordered, "order", text_col, **settings)
    stay = placed.filter(F.col("order") == F.col("component_id")).select(F.col("order.row").alias(key))
    return rows.join(stay, key, "left_semi").select(*df.columns)
