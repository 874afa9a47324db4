"""Near copies by the Jaccard similarity of their word shingles, found by long SimHash fingerprints and checked exactly.

1. A text is the set of its shingles of ``SHINGLE`` words (XXH64 values, A-Z in lower case); equal sets are one node.  Each
   value is spread to ``BITS + CHECK`` bits, and a bit of the fingerprint is 1 if set in over half of the values.  Two sets of
   similarity 0.8 differ in a bit with a probability of at most 0.152.
2. ``TABLES`` tables keep ``KEPT`` of the first ``BITS`` bits each; every bit is kept by equally many.  Nodes that agree in all
   kept bits of a table meet, and are candidates if at most ``RADIUS`` of the other ``CHECK`` bits differ.  A pair of similarity
   0.8 agrees in no table with probability 1.4e-5 and differs in more bits with 1.3e-5, and less above.  Only links that
   hold a bucket's candidates together leave its task where there are many.  The first ``FIRST`` tables tie most of a crowd;
   in the others a bucket gives links only between nodes that those have not tied, so a crowd makes few links a node and
   not one for each table.
3. Candidates that hang together are a group.  In a group of up to ``BLOCK`` nodes all sets are compared whole, but those
   that links tie together already.  A larger group is first held against its most central node; if that doesn't tie all
   of it, the rest is dealt to blocks that meet each other and the blocks of what is tied.  The components are those of all
   pairs in a group that are at least ``similarity`` alike.

Sets are made a second time for candidates only, since for all documents they would be larger than the texts; those of
groups that one task compares are made there.

Defined cases: null and empty texts are equal, empty sets; texts of fewer words are one shingle; null ids come after all
others; an empty table gives an empty result; rows that repeat an id and a text are copies.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .common import keyed, map_arrow, may_hold, parts, whole
from .components import components
from .minhash import SEED, SHINGLE, SIMILARITY, _sets, _shingles, _true_links, shingle_set, without_members

BITS, CHECK, RADIUS = 1024, 128, 36
TABLES, KEPT = 192, 16
#: Tables whose links are followed before the others are looked at.
FIRST = 16
#: Nodes, and shingles of all of them, that a task compares with each other.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Rows of a bucket up to which its pairs are compared without a forest; rows that a task holds at once.
_SMALL, _HELD = 64, 1 << 16
#: Comparisons of two fingerprints that a bucket's forest makes at once.
_AT_ONCE = 1 << 18
_CHUNK = 255


def fingerprint(held: np.ndarray, bits: int = BITS + CHECK) -> np.ndarray:
    """The bits (0 or 1) set in over half of the values that a set's hashes are spread to."""
    rng = np.random.default_rng(SEED)
    plus, factor = rng.integers(0, 1 << 64, (2, bits // 64), np.uint64)
    factor |= np.uint64(1)
    votes = np.zeros(bits, np.int64)
    for at in range(0, len(held), _CHUNK):
        spread = (held[at:at + _CHUNK, None] ^ plus) * factor
        spread ^= spread >> np.uint64(32)
        spread *= np.uint64(0x9E3779B97F4A7C15)
        spread ^= spread >> np.uint64(29)
        of = np.unpackbits(spread.view(np.uint8).reshape(len(spread), -1), axis=1, bitorder="little")
        votes += np.add.reduce(of, axis=0, dtype=np.uint8)
    return (2 * votes > len(held)).astype(np.uint8)


def tables(bits: int = BITS, count: int = TABLES, kept: int = KEPT) -> np.ndarray:
    """The bits that each table keeps: ``count`` rows of ``kept``, cut from shuffled lists of all bits."""
    rng = np.random.default_rng(SEED)
    each = bits // kept
    return np.concatenate([rng.permutation(bits)[:each * kept].reshape(each, kept) for _ in range(-(-count // each))])[:count]


def _sketches(source: DataFrame, shingle: int) -> DataFrame:
    """(id, set_hash, size, bits, fp) of (id, text): ``bits`` for the tables, ``fp`` for the distance."""

    def step(batches):
        for batch in parts(batches):
            digests, sizes, bits, prints = [], [], [], []
            for text in batch.column(1).to_pylist():
                held = shingle_set(text, shingle)
                found = np.packbits(fingerprint(held), bitorder="little").tobytes()
                digests.append(xxhash.xxh3_128_digest(held.tobytes()))
                sizes.append(len(held))
                bits.append(found[:BITS // 8])
                prints.append(found[BITS // 8:])
            yield pa.record_batch(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()),
                 pa.array(prints, pa.binary())], ["id", "set_hash", "size", "bits", "fp"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return map_arrow(source, step, f"id {kind}, set_hash binary, size long, bits binary, fp binary")


def _table_rows(nodes: DataFrame, start: int, end: int) -> DataFrame:
    """(key, x, y, top): each node's fingerprint in its bucket of each of the tables from ``start`` to ``end``; ``nodes`` has
    bits, fp and top."""

    def step(batches):
        places = tables()[start:end]
        base = (np.arange(start, start + len(places), dtype=np.int32) << KEPT)[None, :]
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(at, 256)
                n = batch.num_rows
                bits = np.unpackbits(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(n, -1), axis=1,
                                     bitorder="little")
                keys = np.packbits(bits[:, places], axis=2).view(">u2")[:, :, 0].astype(np.int32) + base
                fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(n, 2)
                once = [fp[:, 0], fp[:, 1], batch.column(2).to_numpy()]
                yield pa.record_batch([pa.array(keys.ravel()), *[pa.array(np.repeat(x, len(places))) for x in once]],
                                      ["key", "x", "y", "top"])

    return map_arrow(nodes.select("bits", "fp", "top"), step, "key int, x long, y long, top long")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Of signed numbers it counts the bits of their absolute values.
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _forest(found: np.ndarray, radius: int, top: np.ndarray) -> list[tuple]:
    """Pairs that hold the fingerprints of one bucket together as all pairs within ``radius`` would, with what has the same
    ``top`` (if not 0) tied already."""
    rest, at = np.unique(found, axis=0, return_index=True)
    sub, out = np.where(top[at] == 0, -1 - np.arange(len(at)), top[at]), []
    while len(rest):
        new = sub == sub[0]
        wave, rest, sub = [rest[new]], rest[~new], sub[~new]
        while wave and len(rest):
            now, step = wave.pop(), max(1, _AT_ONCE // len(rest))
            if len(now) > step:
                wave.append(now[step:])
                now = now[:step]
            close = _apart(now[:, None], rest[None]) <= radius
            near = np.flatnonzero(close.any(axis=0))
            if near.size:
                # One link ties all that has the same top.
                tops, one = np.unique(sub[near], return_index=True)
                near = near[one]
                out.append((now[close[:, near].argmax(axis=0)], rest[near]))
                new = np.isin(sub, tops)
                wave.append(rest[new])
                rest, sub = rest[~new], sub[~new]
    return out


def _bucket_pairs(key: np.ndarray, fp: np.ndarray, radius: int, top: np.ndarray | None = None) -> list[tuple]:
    """Pairs that hold the candidates of whole buckets together; ``key`` is in order, and in a key ``top``."""
    top = np.zeros(len(key), np.int64) if top is None else top
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    bucket, out = np.repeat(np.arange(len(starts)), sizes), []
    small = (sizes <= _SMALL)[bucket]
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for off in range(1, _SMALL):
        at = np.flatnonzero((key[off:] == key[:-off]) & small[off:])
        if not at.size:
            break
        at = at[(top[at] != top[at + off]) | (top[at] == 0)]
        far = _apart(fp[at], fp[at + off])
        at = at[(far > 0) & (far <= radius)]
        first.append(at)
        second.append(at + off)
    first, second = np.concatenate(first), np.concatenate(second)
    # Where the pairs are more than what they tie, a forest says the same.
    apart = np.concatenate([[True], (key[1:] != key[:-1]) | (top[1:] != top[:-1]) | (top[1:] == 0)])
    subs = np.bincount(bucket[apart], minlength=len(starts))
    dense = np.bincount(bucket[first], minlength=len(starts)) > subs
    sparse = ~dense[bucket[first]]
    out.append((fp[first[sparse]], fp[second[sparse]]))
    for at in np.flatnonzero(dense | (sizes > _SMALL) & (subs > 1)):
        of = slice(starts[at], starts[at] + sizes[at])
        out.extend(_forest(fp[of], radius, top[of]))
    return out


def _met(nodes: DataFrame, radius: int, start: int, end: int) -> DataFrame:
    """(a, b): pairs of the fingerprints of ``nodes`` (bits, fp, top) that, with what has the same ``top`` (if not 0), hold
    together what all pairs would that meet in the tables from ``start`` to ``end`` within ``radius``."""

    def step(batches):
        held, rows = [], 0

        def told(last):
            nonlocal held, rows
            key, fp, top = (np.concatenate([x[i] for x in held]) for i in range(3))
            # The last bucket may go on in the next batch.
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            # A bucket that fills the buffer alone waits until it has grown by as much again.
            held, rows = ([(key[cut:], fp[cut:], top[cut:])], 0) if cut < len(key) else ([], 0)
            out = _bucket_pairs(key[:cut], fp[:cut], radius, top[:cut]) if cut else []
            a, b = (np.concatenate([np.zeros((0, 2), np.int64), *[x[i] for x in out]]) for i in (0, 1))
            a, b = ([row.tobytes() for row in x] for x in (a, b))
            return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                key, x, y, top = (batch.column(i).to_numpy() for i in range(4))
                held.append((key, np.stack([x, y], axis=1), top))
                rows += batch.num_rows
                if rows >= _HELD:
                    yield told(False)
        if held:
            yield told(True)

    dealt = _table_rows(nodes, start, end).repartition("key").sortWithinPartitions("key", "top")
    return map_arrow(dealt, step, "a binary, b binary")


def candidates(nodes: DataFrame, radius: int = RADIUS, first: int = FIRST) -> DataFrame:
    """(a, b): pairs of fingerprints that hold together what all pairs that meet within ``radius`` would."""
    nodes = nodes.filter("size > 0").select("bits", "fp")
    loose = nodes.withColumn("top", F.lit(0).cast("long"))
    if not first:
        return _met(loose, radius, 0, TABLES)
    early = stored(components(stored(_met(loose, radius, 0, first), "first-candidates")), "first-components")
    numbers = stored(early.filter("node = component").select("component", (F.monotonically_increasing_id() + 1).alias("top")), "numbers")
    tied = stored(early.join(numbers, "component").select(F.col("node").alias("fp"), "top"), "tied")
    late = _met(nodes.join(tied, "fp", "left").select("bits", "fp", F.coalesce("top", F.lit(0)).alias("top")), radius, first, TABLES)
    # What the first tables tie goes on as stars.
    return late.unionByName(early.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))


def _set_forest(subs: list, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Places of sets that are alike; with what has the same ``subs`` they hold together as all such pairs would."""
    _, sub = np.unique(np.array(subs, dtype=object).astype(str), return_inverse=True)
    size, rest, out = np.array([len(x) for x in sets]), np.ones(len(sets), bool), []
    while rest.any():
        new = sub == sub[rest.argmax()]
        wave, rest = list(np.flatnonzero(new)), rest & ~new
        while wave and rest.any():
            at = wave.pop()
            fits = np.minimum(size, size[at]) >= similarity * np.maximum(size, size[at]) - 1e-9
            other = np.flatnonzero(rest & fits)
            if not other.size:
                continue
            every = np.concatenate([sets[i] for i in other])
            place = np.minimum(np.searchsorted(sets[at], every), size[at] - 1)
            starts = np.concatenate([[0], np.cumsum(size[other])[:-1]])
            common = np.add.reduceat((sets[at][place] == every).astype(np.int64), starts)
            for i in other[common >= similarity * (size[other] + size[at] - common) - 1e-9]:
                if rest[i]:
                    new = rest & (sub == sub[i])
                    out.append((at, i))
                    wave.extend(np.flatnonzero(new))
                    rest &= ~new
    return out


def _dealt_links(dealt: DataFrame, whole_sets: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b) of (loose, i, j, node, sub): links that hold the sets dealt to one (loose, i, j) together.

    ``whole_sets`` has node and either held, its set, or text, of which the set is made where it is compared: as texts the
    sets are half as large in a shuffle."""
    column = whole_sets.columns[1]

    def step(batches):
        as_set = (lambda x: shingle_set(x, shingle)) if column == "text" else (lambda x: np.frombuffer(x, np.uint64))
        now, held = None, []

        def told():
            nonlocal held
            rows, held = held, []
            pairs = _set_forest([x[1] for x in rows], [x[2] for x in rows], similarity)
            return [rows[x][0] for x, _ in pairs], [rows[y][0] for _, y in pairs]

        for batch in parts(batches):
            a, b = [], []
            for loose, i, j, node, sub, given in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                if (loose, i, j) != now:
                    x, y = told()
                    a, b, now = a + x, b + y, (loose, i, j)
                held.append((node, sub, as_set(given)))
            yield pa.record_batch([pa.array(a, batch.schema.field(3).type), pa.array(b, batch.schema.field(3).type)], ["a", "b"])
            kind = batch.schema.field(3).type
        if held:
            a, b = told()
            yield pa.record_batch([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    rows = dealt.join(whole_sets, "node").repartition("loose", "i", "j").sortWithinPartitions("loose", "i", "j")
    kind = dealt.schema["node"].dataType.simpleString()
    return map_arrow(rows.select("loose", "i", "j", "node", "sub", column), step, f"a {kind}, b {kind}")


def _blocks(n, shingles, block: int):
    return F.greatest(F.ceil(n / block), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _crowd(members: DataFrame, sets: DataFrame, similarity: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Links of the nodes of large groups with the most central one, and the others dealt to blocks that all meet."""
    shingles = _shingles(members.select("node"), sets)
    # What many near copies come from is alike to more of them than they are to each other: its shingles are the most common.
    weights = shingles.groupBy("node").agg((F.sum("n") / F.first("size")).alias("weight"))
    centre = stored(members.join(weights, "node").groupBy("loose").agg(F.max(F.struct("weight", "node")).alias("m"))
                    .select("loose", F.col("m.node").alias("centre")), "centres")
    pairs = members.join(centre, "loose").filter(F.col("node") != F.col("centre"))
    found = stored(_true_links(pairs.select(F.col("node").alias("b"), F.col("centre").alias("a")), sets, similarity), "true-links")
    # These links are stars: what is tied to a centre has it as its label.
    tied = found.select(F.col("b").alias("node"), F.lit(True).alias("tied"))
    now = members.join(centre, "loose").join(tied, "node", "left").select(
        "loose", "node", "size", (F.col("tied").isNotNull() | (F.col("node") == F.col("centre"))).alias("hub"), "centre")
    now = stored(now.withColumn("sub", F.when(F.col("hub"), F.col("centre")).otherwise(F.col("node"))), "crowded-nodes")
    of = lambda hub, x: F.sum(F.when(F.col("hub") == hub, F.lit(x) if x == 1 else F.col(x)).otherwise(0))
    parts = now.groupBy("loose").agg(
        F.sum(F.when(~F.col("hub"), 1).otherwise(0)).alias("left"),
        _blocks(of(False, 1), of(False, "size"), block).alias("rest"), _blocks(of(True, 1), of(True, "size"), block).alias("hubs"),
    ).filter("left > 0")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("hub"), F.col("hubs")).otherwise(F.col("rest"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    meets = F.when(F.col("hub"), F.transform(upto(F.col("rest")), lambda x: F.struct(x.alias("i"), (F.col("rest") + F.col("own")).alias("j")))
                   ).otherwise(F.concat(
                       F.transform(upto(F.col("rest")), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"))),
                       F.transform(upto(F.col("hubs")), lambda y: F.struct(F.col("own").alias("i"), (F.col("rest") + y).alias("j")))))
    dealt = now.join(parts, "loose").withColumn("own", own).select("loose", "node", "sub", F.explode(meets).alias("at"))
    return found, dealt.select("loose", "at.i", "at.j", "node", "sub")


def links(nodes: DataFrame, source: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS,
          block: int = BLOCK) -> DataFrame:
    """(node, component) of the nodes (node, size, bits, fp) that are linked to another; ``source`` has their id and text."""
    loose = components(stored(candidates(nodes, radius), "candidates")).select(F.col("node").alias("fp"), "component")
    placed = nodes.filter("size > 0").select("node", "size", "fp").join(loose, "fp", "left").select(
        "node", "size", F.coalesce("component", "fp").alias("loose"))
    groups = placed.groupBy("loose").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).filter("n > 1")
    members = stored(placed.join(groups, "loose"), "candidate-groups")
    large = (F.col("n") > block) | (F.col("shingles") > BLOCK_SHINGLES) & (F.col("n") > 2)
    dealt = stored(members.filter(~large).select("loose", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", F.col("node").alias("sub")),
                   "small-groups")
    # A few texts more than wanted do no harm.
    texts = source.filter(may_hold(dealt.select(F.col("node").alias("id")), "id")).select(F.col("id").alias("node"), "text")
    true = _dealt_links(dealt, texts, similarity, shingle)
    found, crowd = None, stored(members.filter(large).select("loose", "node", "size"), "large-groups")
    if not crowd.isEmpty():
        sets = stored(_sets(source.filter(may_hold(crowd.select(F.col("node").alias("id")), "id")), shingle), "shingle-sets")
        found, more = _crowd(crowd, sets, similarity, block)
        true = true.unionByName(_dealt_links(more, sets, similarity, shingle))
    return components(true if found is None else true.unionByName(found)).select("node", "component")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each component the row with the smallest id.

    Rows without an id go where their component has one, and otherwise one of them stays.
    """
    df, key = keyed(df, id_col)
    source = df.select(F.col(key).alias("id"), whole(text_col).alias("text"))
    sketches = stored(_sketches(source, shingle), "sketches")
    nodes = stored(sketches.groupBy("set_hash").agg(
        F.min("id").alias("node"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("fp").alias("fp"),
        F.count(F.lit(1)).alias("n")), "nodes")
    return without_members(df, id_col, key, sketches, nodes, links(nodes, source, shingle, similarity, radius, block))
