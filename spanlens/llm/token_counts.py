"""Tokens of every document without the ids: pieces are counted once for each distinct pre-token.

1. A first pass keeps the most frequent pre-tokens of each task, which add up to one list of at most ``HEAD``; their
   piece counts are broadcast (at most HEAD words of HEAD_CHARS characters).  Which pre-tokens are on that list changes
   the cost only.
2. The second pass turns each chunk of documents into pre-token frequencies.  Frequent pre-tokens are joined with the
   broadcast counts there.  The others leave as one row for each chunk and hash bucket: the distinct pre-tokens and,
   for each, the documents it is in and how often.
3. A bucket's rows meet in one task.  It counts the pieces of each distinct pre-token once and joins them with the
   frequencies; sums for each document are all that is shuffled after it.

Memory is bounded by a chunk's text (a batch of BATCH_BYTES, or one longer document) on one side and by ``RUN`` rows of
a bucket on the other.  A pre-token has one bucket, which keeps its count; one of more than ``COUNTED`` distinct pre-tokens
starts anew there, which changes the cost only.

Defined cases: null and empty texts have no bytes and no tokens; documents with a null or repeated id get a row each;
an empty table gives an empty result.
"""

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, whole
from .pieces import Vocabulary, model_path, pre_tokens

HEAD, HEAD_CHARS = 1 << 16, 64
#: Frequent pre-tokens that one task reports; its counters hold eight times as many at most.
TASK_HEAD = 1 << 14
#: Rows of a bucket held at once, and distinct pre-tokens of it whose counts are kept from run to run (about 100 MB).
RUN, COUNTED = 64, 500_000
LIMIT = 4096


def _frequent(texts: DataFrame, head: int) -> DataFrame:
    """(word, n) of the pre-tokens that are frequent in some task, at most ``head``."""

    def step(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            words = [w for t in batch.column(1).to_pylist() for w in pre_tokens(t) if len(w) <= HEAD_CHARS]
            codes, names = pd.factorize(np.array(words, object))
            for w, n in zip(names.tolist(), np.bincount(codes, minlength=len(names)).tolist()):
                seen[w] = seen.get(w, 0) + n
            if len(seen) > 8 * TASK_HEAD:
                seen = dict(heapq.nlargest(4 * TASK_HEAD, seen.items(), key=lambda x: x[1]))
        top = heapq.nlargest(TASK_HEAD, seen.items(), key=lambda x: x[1])
        yield pa.record_batch([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                              ["word", "n"])

    counts = map_arrow(texts, step, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(head)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width; its first byte says which."""
    width = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([width.itemsize]) + values.astype(width).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


_ROWS = [("bucket", "int", pa.int32()), ("key", "long", pa.int64()), ("n_bytes", "long", pa.int64()),
         ("head", "long", pa.int64()), ("words", "string", pa.string()), ("sizes", "binary", pa.binary()),
         ("in_docs", "binary", pa.binary()), ("docs", "binary", pa.binary()), ("times", "binary", pa.binary())]
_NAMES = [n for n, _, _ in _ROWS] + ["id"]


def _frequencies(texts: DataFrame, known, buckets: int) -> DataFrame:
    """Rows of documents (``head`` set) and rows of pre-tokens (``words`` set); ``key`` is a document's row number, or
    the first one of the chunk that the numbers in ``docs`` count from."""

    def step(batches):
        head = known.value
        for batch in batches:
            keys, held = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            if not held:
                continue
            split = [pre_tokens(t) for t in held]
            doc = np.repeat(np.arange(len(held)), [len(s) for s in split])
            codes, names = pd.factorize(np.array([w for s in split for w in s], object))
            cost = np.fromiter((head.get(w, -1) for w in names), np.int64, len(names))
            per = cost[codes] if len(codes) else np.zeros(0, np.int64)
            sums = np.bincount(doc, np.maximum(per, 0), len(held)).astype(np.int64)
            n = len(held)
            yield pa.record_batch(
                [pa.array((keys % buckets).astype(np.int32)), pa.array(keys),
                 pa.array([len(t.encode()) for t in held], pa.int64()), pa.array(sums),
                 *[pa.nulls(n, kind) for _, _, kind in _ROWS[4:]], batch.column(2)], _NAMES)
            rare = per < 0
            pair, times = np.unique(codes[rare] * n + doc[rare], return_counts=True)
            code, place = pair // n, pair % n
            place_of = pd.util.hash_array(names) % np.uint64(buckets) if len(names) else np.zeros(0, np.uint64)
            at = place_of[code]
            order = np.argsort(at, kind="stable")
            at, code, place, times = at[order], code[order], place[order], times[order]
            edges = np.flatnonzero(np.diff(at, prepend=at[:1] + 1)) if len(at) else np.zeros(0, np.int64)
            rows = []
            for a, b in zip(edges, [*edges[1:], len(at)]):
                c = code[a:b]
                first = np.flatnonzero(np.diff(c, prepend=c[0] - 1))
                own = names[c[first]].tolist()
                rows.append((int(at[a]), int(keys[0]), None, None, "".join(own),
                             _packed(np.array([len(w) for w in own])),
                             _packed(np.diff(first, append=b - a)), _packed(place[a:b]), _packed(times[a:b])))
            if rows:
                columns = [pa.array(c, kind) for c, (_, _, kind) in zip(zip(*rows), _ROWS)]
                yield pa.record_batch([*columns, pa.nulls(len(rows), batch.column(2).type)], _NAMES)

    kind = texts.schema["id"].dataType.simpleString()
    return map_arrow(texts, step, ", ".join(f"{n} {t}" for n, t, _ in _ROWS) + f", id {kind}")


def _sums(rows: DataFrame, path: str) -> DataFrame:
    """(key, n_bytes, n, id): parts of the documents' sums."""
    out = ["key", "n_bytes", "n", "id"]

    def joined(run, id_type, costs):
        words = []
        for r in run:
            at = 0
            for size in _unpacked(r["sizes"]).tolist():
                words.append(r["words"][at:at + size])
                at += size
        codes, names = pd.factorize(np.array(words, object))
        new = [w for w in names if w not in costs]
        costs.update(zip(new, map(len, Vocabulary.at(path).encode(new))))
        cost = np.array([costs[w] for w in names], np.int64)[codes]
        keys, sums, begin = [], [], 0
        for r in run:
            in_docs, docs, times = (_unpacked(r[k]) for k in ("in_docs", "docs", "times"))
            part = np.bincount(docs, np.repeat(cost[begin:begin + len(in_docs)], in_docs) * times).astype(np.int64)
            begin += len(in_docs)
            hit = np.flatnonzero(part)
            keys.append(hit + r["key"])
            sums.append(part[hit])
        keys, sums = np.concatenate(keys), np.concatenate(sums)
        return pa.record_batch(
            [pa.array(keys), pa.nulls(len(keys), pa.int64()), pa.array(sums), pa.nulls(len(keys), id_type)], out)

    def step(batches):
        run, bucket, costs = [], None, {}
        for batch in batches:
            whole_docs = batch.filter(pc.is_valid(batch.column(3)))
            if whole_docs.num_rows:
                yield pa.record_batch([whole_docs.column(i) for i in (1, 2, 3, 9)], out)
            for r in batch.filter(pc.is_valid(batch.column(4))).to_pylist():
                if run and (r["bucket"] != bucket or len(run) >= RUN):
                    yield joined(run, batch.column(9).type, costs)
                    run = []
                if r["bucket"] != bucket or len(costs) > COUNTED:
                    costs.clear()
                bucket = r["bucket"]
                run.append(r)
        if run:
            yield joined(run, batch.column(9).type, costs)

    return map_arrow(rows.repartition("bucket").sortWithinPartitions("bucket", "key"), step,
                     f"key long, n_bytes long, n long, id {rows.schema['id'].dataType.simpleString()}")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
                 head: int = HEAD, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``df``: its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""
    spark, path = df.sparkSession, model or model_path()
    texts = df.select(F.monotonically_increasing_id().alias("key"), whole(text_col).alias("text"),
                      F.col(id_col).alias("id"))

    def counted(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            cost = [len(ids) for ids in Vocabulary.at(path).encode(names)]
            yield pa.record_batch([batch.column(0), pa.array(cost, pa.int64())], ["word", "cost"])

    frequent = map_arrow(_frequent(texts, head).select("word"), counted, "word string, cost long")
    known = spark.sparkContext.broadcast(dict(map(tuple, frequent.collect())))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = (
        _sums(_frequencies(texts, known, buckets), path)
        .groupBy("key").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    )
    return sums.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
