"""Near copies by the Jaccard similarity of their word shingles, found by MinHash and checked exactly.

1. A text is the set of its shingles of ``SHINGLE`` words (XXH64 values, A-Z in lower case); equal sets are one node.
2. ``BANDS`` keys, each of ``ROWS`` minima under random linear maps, put nodes into buckets.  A pair of similarity s has
   no bucket in common with probability (1 - s^ROWS)^BANDS: 5e-5 at 0.8 and less above.
3. Nodes that share a bucket are candidates, and a link is a candidate whose sets, compared whole, are at least
   ``similarity`` alike.  In every bucket all nodes are first held against one of them, twice with another one; what
   this ties together needs no more comparisons.
4. In buckets that still hold different components, pairs are compared where at most ``DIRECT`` nodes are left.  The
   nodes of larger ones are held against the most central node of their bucket, and then meet by their rarest shingles instead:
   sets that are alike enough have one of the first (1 - similarity) * size + 1 in common, and texts of one template, each
   with much of its own, don't meet.  At last the pairs that still meet are compared, so the components are those of all
   true links between candidates, whichever way a bucket takes.

Sets are made a second time for candidates only, since for all documents they would be larger than the texts.  A pair
whose sizes alone rule the similarity out is not compared.

Defined cases: null and empty texts are equal, empty sets; texts of fewer words are one shingle; null ids come after all
others; an empty table gives an empty result; rows that repeat an id and a text are copies.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .common import keyed, map_arrow, may_hold, parts, whole, without
from .components import components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 25, 5
#: Times that a bucket's nodes are held against one of them before its pairs are compared.
STARS = 2
#: Nodes of a bucket that are still compared in pairs, so pairs are at most half as many times the nodes.
DIRECT = 8
_CHUNK = 1 << 12


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted, distinct hashes of a text's word shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    last = ends[min(shingle, len(words)) - 1:].tolist()
    first = (ends - size)[:len(last)].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[s:e], SEED) for s, e in zip(first, last)], np.uint64))


def _maps(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    factor, plus = rng.integers(0, 1 << 64, (2, bands * rows), np.uint64)
    return factor | np.uint64(1), plus


def band_keys(held: np.ndarray, maps, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A set's key in each band."""
    factor, plus = maps
    least = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(held), _CHUNK):
        mapped = factor[:, None] * held[None, at:at + _CHUNK] + plus[:, None]
        least = np.minimum(least, mapped.min(axis=1))
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _sketches(source: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, set_hash, size, keys) of (id, text)."""

    def step(batches):
        maps = _maps(bands, rows)
        for batch in batches:
            digests, sizes, keys = [], [], []
            for text in batch.column(1).to_pylist():
                held = shingle_set(text, shingle)
                digests.append(xxhash.xxh3_128_digest(held.tobytes()))
                sizes.append(len(held))
                keys.append(band_keys(held, maps, bands, rows).view(np.int64) if len(held) else [])
            yield pa.record_batch(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], ["id", "set_hash", "size", "keys"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return map_arrow(source, step, f"id {kind}, set_hash binary, size long, keys array<long>")


def _sets(source: DataFrame, shingle: int) -> DataFrame:
    def step(batches):
        for batch in parts(batches):
            held = [shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(held, pa.binary())], ["node", "held"])

    return map_arrow(source, step, f"node {source.schema['id'].dataType.simpleString()}, held binary")


def _true_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least ``similarity`` alike."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("held").alias("of_b")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("held").alias("of_a")), "a").select("a", "b", "of_a", "of_b")

    def step(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(both, step, f"a {kind}, b {kind}")


def _shingles(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, node, size, n): the shingles of each node, and how many of the nodes have one; stored."""

    def step(batches):
        for batch in batches:
            held = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in held], np.int64)
            yield pa.record_batch([
                batch.column(0).take(pa.array(np.repeat(np.arange(len(held)), sizes))), pa.array(np.repeat(sizes, sizes)),
                pa.array(np.concatenate([np.zeros(0, np.int64), *held]))], ["node", "size", "key"])

    held = sets.join(nodes, "node", "left_semi").select("node", "held")
    rows = stored(map_arrow(held, step, f"node {sets.schema['node'].dataType.simpleString()}, size long, key long"), "shingles")
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return stored(rows.join(often, "key"), "counted-shingles")


def _rare_shingles(shingles: DataFrame, similarity: float) -> DataFrame:
    """(key, node, size): of each node's shingles those that a set ``similarity`` alike cannot do without.

    With shingles in one order for all, the rarest first, two such sets have one of their first (1 - similarity) * size + 1
    in common.  One that a single node has takes a place in this order, but has nothing to meet."""
    sort = F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("n", "key"))))
    listed = shingles.groupBy("node").agg(F.first("size").alias("size"), sort.alias("sorted"))
    alone = F.col("size") - F.size("sorted")
    wanted = (F.floor((1 - similarity) * F.col("size") + 1e-9) + 1 - alone).cast("int")
    return listed.select(
        "node", "size", F.explode(F.slice("sorted", F.lit(1), F.greatest(wanted, F.lit(0)))).alias("s")).select(
        F.col("s.key").alias("key"), "node", "size")


def _open(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of buckets that still hold more than one component, with their component as ``top``."""
    now = rows.join(label, "node", "left").withColumn("top", F.coalesce("component", "node")).drop("component")
    several = now.groupBy("key").agg(F.min("top").alias("x"), F.max("top").alias("y")).filter("x < y").select("key")
    return stored(now.join(several, "key"), "open-buckets")


def links(nodes: DataFrame, source: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY,
          stars: int = STARS, direct: int = DIRECT) -> DataFrame:
    """(node, component) of the nodes (node, size, keys) that are linked to another; ``source`` has their id and text."""
    rows = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    rows = stored(rows.join(shared, "key").select("key", "node", "size"), "shared-buckets")
    wanted = rows.select(F.col("node").alias("id")).distinct()
    # A few texts more than wanted do no harm.
    sets = stored(_sets(source.filter(may_hold(wanted, "id")), shingle), "shingle-sets")
    near = F.least("size", "other_size") >= similarity * F.greatest("size", "other_size") - 1e-9
    kind = source.schema["id"].dataType.simpleString()
    label, found = source.sparkSession.createDataFrame([], f"node {kind}, component {kind}"), None

    def compare(now: DataFrame, turn: int | None, weights: DataFrame | None = None) -> None:
        """Hold the nodes of each bucket against the one of the largest weight or, without ``weights``, against one that
        ``turn`` decides, or against each other."""
        nonlocal label, found
        if turn is not None:
            now = now if weights is None else now.join(weights, "node")
            first = F.xxhash64("node", F.lit(turn)) if weights is None else -F.col("weight")
            mark = F.struct(first.alias("h"), "node", "size", "top")
            other = now.groupBy("key").agg(F.min(mark).alias("m")).select(
                "key", F.col("m.node").alias("other"), F.col("m.size").alias("other_size"), F.col("m.top").alias("other_top"))
            apart = F.col("top") != F.col("other_top")
        else:
            other = now.select("key", F.col("node").alias("other"), F.col("size").alias("other_size"),
                               F.col("top").alias("other_top"))
            apart = F.col("top") < F.col("other_top")
        pairs = now.join(other, "key").filter(apart & near)
        pairs = pairs.select(F.greatest("node", "other").alias("b"), F.least("node", "other").alias("a")).distinct()
        more = stored(_true_links(pairs, sets, similarity), "true-links")
        if not more.isEmpty():
            found = more if found is None else found.unionByName(more)
            label = stored(components(found).select("node", "component"), "near-components")

    for turn in range(stars):
        compare(_open(rows, label), turn)
    left = _open(rows, label)
    crowd = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > direct).select("key")
    crowd = stored(crowd, "crowded-buckets")
    compare(left.join(crowd, "key", "left_anti"), None)
    if not crowd.isEmpty():
        held = stored(left.join(crowd, "key", "left_semi").select("key", "node", "size"), "crowded-rows")
        shingles = _shingles(held.select("node").distinct(), sets)
        # The node whose shingles are the most common: what many near copies come from is alike to more of them than they
        # are to each other.
        weights = stored(shingles.groupBy("node").agg((F.sum("n") / F.first("size")).alias("weight")), "weights")
        compare(_open(held, label), 0, weights)
        rare = stored(_rare_shingles(shingles, similarity), "rare-shingles")
        compare(_open(rare, label), 0, weights)
        compare(_open(rare, label), None)
    return label


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                     stars: int = STARS, direct: int = DIRECT) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each component the row with the smallest id.

    Rows without an id go where their component has one, and otherwise one of them stays.
    """
    df, key = keyed(df, id_col)
    source = df.select(F.col(key).alias("id"), whole(text_col).alias("text"))
    sketches = stored(_sketches(source, shingle, bands, rows), "sketches")
    nodes = stored(sketches.groupBy("set_hash").agg(
        F.min("id").alias("node"), F.first("size").alias("size"), F.first("keys").alias("keys"),
        F.count(F.lit(1)).alias("n")), "nodes")
    return without_members(df, id_col, key, sketches, nodes, links(nodes, source, shingle, similarity, stars, direct))


def without_members(df: DataFrame, id_col: str, key: str, sketches: DataFrame, nodes: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of ``df`` that stay, told apart by ``key``: of each component the one with the smallest id.

    ``sketches`` has id and set_hash of every row, ``nodes`` set_hash, node and its ``n`` rows, ``label`` node and component.
    """
    names = df.select(F.col(key).alias("id"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("of"),
                                                       F.col(key).alias("key")).alias("order"))
    placed = nodes.join(label, "node", "left").filter("n > 1 OR component IS NOT NULL").select(
        "set_hash", F.coalesce("component", "node").alias("top"))
    members = stored(sketches.select("id", "set_hash").join(placed, "set_hash").join(names, "id")
                     .select("id", "top", "order"), "members")
    stay = members.groupBy("top").agg(F.min("order").alias("first"))
    gone = members.join(stay, "top").filter(F.col("order") != F.col("first")).select(F.col("id").alias(key))
    return without(df, stored(gone, "near-copies"), sketches.select(F.col("id").alias(key)), key).select(
        *[c for c in df.columns if c != key or key == id_col])
