"""The best documents for each query by a lexical score, without scoring all of them.

Index: documents are put into blocks of at most ``BLOCK_DOCS`` texts, in the order of their ids.  A block has one posting
list for each of its terms (positions in the block and occurrences) and one row with its ids and lengths.  The index holds
no weights, so counts of the whole corpus can follow from it: ``score`` needs the number of documents N, all terms L and
each term's documents df.

Search: queries are taken in blocks, too, and a task has the postings of one document block for the terms of one query
block.  Over each posting list's impacts (what its documents gain by the term) lies a sparse table of range maxima.  For
each query the search holds intervals of documents, the one with the largest bound first; a bound is the sum of the
terms' largest impacts in the interval.  The first interval is split at the document of its largest impact, which is scored
exactly, and both rests get bounds of their own.  It ends when no interval can beat the ``k`` best.  All queries of a block
take their steps together, so a step is a few array operations.  The best of all blocks are ranked last.

Defined cases: null and empty texts, and those without a term, are in no ranking; equal scores rank by id, null ids last;
rows that repeat an id are ranked each; rows that repeat a query's id are one query with the terms of all, null ids
included; queries without terms and empty tables give no rows; other columns are left alone; a text longer than
``BLOCK_BYTES`` makes a block with what was read before it.
"""

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .common import map_arrow, whole

TOP = 10
BLOCK_DOCS, BLOCK_BYTES, QUERY_BLOCK = 4096, 16 << 20, 256
# What a term is made of, as a pattern and as a table of bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM_BYTE = bytes(
    c + 32 if chr(c) in UPPER else c if c >= 128 or chr(c).isdigit() or chr(c) in LOWER else 32 for c in range(256)
)


def terms_of(text) -> Column:
    """The terms of a text, with repeats."""
    return F.regexp_extract_all(F.translate(whole(text), UPPER, LOWER), F.lit(TERM), F.lit(0))


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """For each word of ``texts`` its text's number and the word."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = data[offsets[0]:offsets[-1]].to_pybytes().translate(_TERM_BYTE) if data else b""
    spaced = pa.Array.from_buffers(pa.large_string(), len(texts), [
        None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data)])
    lists = pc.ascii_split_whitespace(spaced)
    words = lists.flatten()
    at = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    real = pc.not_equal(words, "")
    return at[real.to_numpy(zero_copy_only=False)], words.filter(real).dictionary_encode()


def _block(number: int, ids: pa.Array, texts: pa.Array):
    """The rows of one block: a posting list for each term, and the ids and lengths."""
    order = pc.sort_indices(ids, null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    count = len(ids)
    at, words = _words(texts)
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, tfs = np.unique(codes * count + at, return_counts=True)
    code, doc = np.divmod(pairs, count)
    sizes = np.bincount(at, minlength=count)
    cuts = np.concatenate([np.flatnonzero(np.diff(code, prepend=-1)), [len(code)]]).astype(np.int32)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.astype(np.int32)))
    n = len(cuts) - 1
    if n:
        yield pa.record_batch([
            pa.array(np.full(n, number)), words.dictionary.take(pa.array(code[cuts[:-1]])).cast(pa.string()),
            pa.array(np.diff(cuts).astype(np.int64)), pa.nulls(n, pa.int64()), lists(doc), lists(tfs),
            pa.nulls(n, pa.list_(ids.type)), pa.nulls(n, pa.list_(pa.int64())),
        ], _NAMES)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), values)
    yield pa.record_batch([
        pa.array([number]), pa.nulls(1, pa.string()), pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]),
        pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), one(ids), one(pa.array(sizes)),
    ], _NAMES)


_NAMES = ["block", "term", "n", "total", "docs", "tfs", "ids", "sizes"]


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``df``, stored: (block, term, n, docs, tfs) for each posting list, and a row without a term for each
    block with its ``ids``, their ``sizes`` in terms, how many have any (``n``) and all their terms (``total``)."""
    source = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))

    def step(batches):
        number, held, docs, size = TaskContext.get().partitionId() << 32, [], 0, 0
        flush = lambda: _block(number, *[
            pa.concat_arrays([b.column(i) if i == 0 else b.column(i).cast(pa.large_string()) for b in held]) for i in (0, 1)])
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS // 8):
                part = batch.slice(at, BLOCK_DOCS // 8)
                if docs and (docs + part.num_rows > BLOCK_DOCS or size > BLOCK_BYTES):
                    yield from flush()
                    number, held, docs, size = number + 1, [], 0, 0
                held.append(part)
                docs += part.num_rows
                size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
        if docs:
            yield from flush()

    kind = source.schema["id"].dataType.simpleString()
    rows = map_arrow(source, step, "block long, term string, n long, total long, docs array<int>, tfs array<int>, "
                                   f"ids array<{kind}>, sizes array<long>")
    return stored(rows, "lexical-index")


class _Maxima:
    """Sparse table of range maxima over posting lists that lie one behind the other; a range never leaves its list."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values, self.levels = values, [np.arange(len(values), dtype=np.int32)]
        half = 1
        while 2 * half <= longest:
            below = self.levels[-1]
            left, right = below[:len(below) - half], below[half:]
            self.levels.append(np.where(values[left] >= values[right], left, right))
            half *= 2
        self.starts = np.cumsum([0, *[len(x) for x in self.levels]])
        self.flat = np.concatenate(self.levels) if len(values) else np.zeros(0, np.int32)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each range [a, b) the place of its largest value, and that value; 0 where it is empty."""
        some = b > a
        length = np.where(some, b - a, 1)
        level = np.frexp(length.astype(np.float64))[1] - 1
        first = np.minimum(a, len(self.values) - 1)
        last = np.where(some, b - (1 << level), first)
        level = np.where(some, level, 0)
        x, y = self.flat[self.starts[level] + first], self.flat[self.starts[level] + last]
        best = np.where(self.values[x] >= self.values[y], x, y)
        return best, np.where(some, self.values[best], 0)


def search_block(docs: np.ndarray, impacts: np.ndarray, cuts: np.ndarray, queries: list[np.ndarray], k: int) -> list[list]:
    """For each query (numbers of lists) its ``k`` best documents as (score, document), scores above 0 only.

    List t has the documents ``docs[cuts[t]:cuts[t + 1]]``, ascending, and what each gains."""
    span = int(docs.max(initial=-1)) + 1
    key = np.repeat(np.arange(len(cuts) - 1, dtype=np.int64) * span, np.diff(cuts)) + docs
    maxima = _Maxima(impacts, int(np.diff(cuts).max(initial=1)))
    heaps, found, serial = [[] for _ in queries], [[] for _ in queries], 0

    def push(who, lists, a, b, low):
        """Bounds of the intervals of queries ``who``, whose ranges in ``lists`` follow one another."""
        nonlocal serial
        sizes = np.array([len(queries[q]) for q in who])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        place, value = maxima(a, b)
        bounds = np.add.reduceat(value, begins[:-1])
        # The list whose range has the largest impact, and with it the document to split at.
        at = np.maximum.reduceat(value << 20 | np.arange(len(value)) - np.repeat(begins[:-1], sizes), begins[:-1])
        split = docs[place[(at & ((1 << 20) - 1)) + begins[:-1]]].tolist()
        for q, bound, doc, x, y, first in zip(who, bounds.tolist(), split, begins.tolist(), begins[1:].tolist(), low):
            if bound > 0:
                serial += 1
                heapq.heappush(heaps[q], (-bound, first, serial, doc, lists[x:y], a[x:y], b[x:y]))

    live = [q for q, terms in enumerate(queries) if len(terms)]
    if live:
        lists = np.concatenate([queries[q] for q in live])
        push(live, lists, cuts[lists], cuts[lists + 1], [0] * len(live))
    while True:
        taken = []
        for q in live:
            if not heaps[q]:
                continue
            bound, first = -heaps[q][0][0], heaps[q][0][1]
            # An interval whose bound only equals the last one's score may still hold an earlier document.
            if len(found[q]) == k and (bound, -first) < found[q][0]:
                continue
            taken.append((q, heapq.heappop(heaps[q])))
        if not taken:
            return [[(s, -d) for s, d in sorted(f, reverse=True)] for f in found]
        live = [q for q, _ in taken]
        sizes = [len(x[4]) for _, x in taken]
        lists, a, b = (np.concatenate([x[i] for _, x in taken]) for i in (4, 5, 6))
        at = [x[3] for _, x in taken]
        wanted = np.repeat(at, sizes)
        p = np.searchsorted(key, lists * span + wanted)
        here = (p < b) & (docs[np.minimum(p, len(docs) - 1)] == wanted)
        gains = np.where(here, impacts[np.minimum(p, len(docs) - 1)], 0)
        scores = np.add.reduceat(gains, np.concatenate([[0], np.cumsum(sizes)[:-1]])).tolist()
        for q, doc, score in zip(live, at, scores):
            if score > 0:
                (heapq.heappush if len(found[q]) < k else heapq.heappushpop)(found[q], (score, -doc))
        push(live, lists, a, p, [x[1] for _, x in taken])
        push(live, lists, p + here, b, [doc + 1 for doc in at])


def _searcher(docs_in_all: int, terms_in_all: int, k: int):
    """The search of one block of documents for one block of queries, given as one table."""

    def step(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        heads = table.filter(pc.is_valid(table["ids"]))
        rows = table.filter(pc.is_valid(table["docs"]))
        out = lambda *c: pa.table(list(c), ["item_id", "doc_id", "score"])
        kinds = table.schema.field("items").type.value_type, table.schema.field("ids").type.value_type
        if not rows.num_rows:
            return out(pa.nulls(0, kinds[0]), pa.nulls(0, kinds[1]), pa.nulls(0, pa.int64()))
        flat = lambda t, c: t[c].combine_chunks().flatten()
        size = flat(heads, "sizes").to_numpy()
        docs, tfs = flat(rows, "docs").to_numpy().astype(np.int64), flat(rows, "tfs").to_numpy().astype(np.int64)
        lengths = pc.list_value_length(rows["docs"]).to_numpy()
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        m = 10 + (90 * size * docs_in_all) // terms_in_all
        impacts = np.repeat(rows["w"].to_numpy(), lengths) * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[docs]))
        items = flat(rows, "items").dictionary_encode(null_encoding="encode")
        numbers = items.indices.to_numpy()
        term = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows["items"]).to_numpy())
        order = np.argsort(numbers, kind="stable")
        queries = np.split(term[order], np.cumsum(np.bincount(numbers))[:-1])
        best = search_block(docs, impacts, cuts, queries, k)
        of = np.repeat(np.arange(len(best)), [len(b) for b in best])
        places = [d for b in best for _, d in b]
        return out(items.dictionary.take(pa.array(of, pa.int64())),
                   flat(heads, "ids").take(pa.array(places, pa.int64())), pa.array([s for b in best for s, _ in b], pa.int64()))

    return step


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = TOP,
           query_block: int = QUERY_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of a stored ``index`` for each item."""
    asked = items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(terms_of(text_col))).alias("term"))
    counted = index.filter("term IS NULL").agg(F.sum("n"), F.sum("total")).first()
    docs_in_all, terms_in_all = int(counted[0] or 0), int(counted[1] or 0)
    blocks = -(-asked.select("item").distinct().count() // query_block) or 1
    by_term = asked.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("queries"), "term").agg(
        F.array_sort(F.collect_set(F.struct(F.col("item").alias("of")))).getField("of").alias("items"))
    postings = index.filter("term IS NOT NULL")
    df = postings.select("term", "n").join(by_term.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(docs_in_all) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = stored(by_term.join(df, "term").select("queries", "term", "items", weight.alias("w")), "query-terms")
    met = postings.select("block", "term", "docs", "tfs").join(weighed, "term").select("block", "queries", "w", "items", "docs", "tfs")
    # Every block of documents is searched for every block of queries.
    heads = index.filter("term IS NULL").select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("queries"), "ids", "sizes")
    kinds = [items.schema[item_col].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()]
    best = met.unionByName(heads, allowMissingColumns=True).groupBy("block", "queries").applyInArrow(
        _searcher(docs_in_all, terms_in_all, k), f"item_id {kinds[0]}, doc_id {kinds[1]}, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
