"""Sweeps along one sorted timeline: latest facts before points, and the newest span over each point.

Rows are dealt once, by range or by cell, and sorted where they land; a sweep then passes over each partition's rows in
batches and remembers little: the last fact, or the spans that are still open.
"""

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

_KIND, _TIE, _PART = "_kind", "_tie", "_part"
_FACT, _POINT, _EDGE, _HEAD = 0, 1, 2, 4


def _changes(columns: list[pa.Array], n: int) -> np.ndarray:
    """Where a row's key is not that of the row before."""
    new = np.zeros(n, bool)
    for c in columns:
        codes = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _filler(keys: list[str], facts: dict[str, str], edge: int, head: int):
    """Fill ``facts`` (column -> filled column) from the last fact of the same key, along the rows' order.

    Each partition adds a copy of its first row, of kind ``head``: what it may lack, and one of its last row, of kind
    ``edge``: what it hands on."""

    def marked(row, kind):
        return pa.record_batch([pa.array([kind], pa.int32()) if name == _KIND else row.column(i)
                                for i, name in enumerate(row.schema.names)], row.schema)

    def step(batches):
        last, part = None, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if last is None else pa.concat_batches([last, batch])
            n = table.num_rows
            column = {name: table.column(i) for i, name in enumerate(table.schema.names)}
            kind = column[_KIND].to_numpy(zero_copy_only=False)
            at = np.arange(n)
            # The row handed on stands for the fact that it was filled from, if any.
            known = kind == _FACT
            if last is not None:
                filled = next(iter(facts.values()))
                known[0] = column[filled][0].is_valid
            begin = np.maximum.accumulate(np.where(_changes([column[k] for k in keys], n), at, 0))
            source = np.maximum.accumulate(np.where(known, at, -1))
            source = pa.array(np.where(source >= begin, source, 0), pa.int64(), mask=source < begin)
            for name, filled in facts.items():
                own = column[name]
                if last is not None:
                    own = pa.concat_arrays([column[filled].slice(0, 1), own.slice(1)])
                column[filled] = own.take(source)
            column[_PART] = pa.array(np.full(n, part), pa.int32())
            out = pa.record_batch(list(column.values()), table.schema)
            if last is None:
                yield marked(out.slice(0, 1), head)
            last = out.slice(n - 1, 1)
            yield out.slice(n - batch.num_rows)
        if last is not None:
            yield marked(last, edge)

    return step


def nearest_facts(points: DataFrame, facts: DataFrame, by, ts: str, keep, tie: str, first_of_ties: bool = False,
                  forward: bool = False) -> DataFrame:
    """``points`` with the columns ``keep`` and ``ts`` of the last fact at or before each (``before_*``) and, with
    ``forward``, of the first one past it (``after_*``); null where there is none.

    Both sides form one timeline, dealt by range of (``by``, ``ts``) and sorted once, so a key with most of the rows is
    shared by many tasks.  What a partition's first key lacks comes from the partitions next to it through one row each.
    Of facts at one time the one with the largest ``tie`` counts, or the smallest.
    """
    by = list(by)
    columns = [ts, *keep]
    kinds = {c: facts.schema[c].dataType.simpleString() for c in columns}
    sides = ("before", "after") if forward else ("before",)
    own = F.struct(*[F.col(c) for c in points.columns]).alias("_own")
    empty = lambda names: [F.lit(None).cast(k).alias(n) for n, k in names]
    filled = [(f"{s}_{c}", kinds[c]) for s in sides for c in columns]
    parts = [F.lit(None).cast("int").alias(_PART)]
    at_points = points.select(*by, ts, F.lit(_POINT).alias(_KIND), F.lit(None).cast("long").alias(_TIE), own,
                              *empty([(f"_f_{c}", kinds[c]) for c in columns]), *empty(filled), *parts)
    at_facts = facts.select(*by, ts, F.lit(_FACT).alias(_KIND), F.col(tie).cast("long").alias(_TIE),
                            F.lit(None).cast(at_points.schema["_own"].dataType).alias("_own"),
                            *[F.col(c).alias(f"_f_{c}") for c in columns], *empty(filled), *parts)
    line = at_facts.unionByName(at_points).repartitionByRange(*by, ts)
    for side in sides:
        along = (lambda c: F.col(c).desc()) if side == "after" else F.col
        ties = F.col(_TIE).desc() if first_of_ties else F.col(_TIE).asc()
        line = line.sortWithinPartitions(*[along(c) for c in by], along(ts), along(_KIND), ties)
        line = line.mapInArrow(_filler(by, {f"_f_{c}": f"{side}_{c}" for c in columns}, _EDGE + sides.index(side),
                                       _HEAD + sides.index(side)), line.schema)
    swept = stored(line.filter(F.col(_KIND) != _FACT).drop(*[f"_f_{c}" for c in columns], _TIE), "swept")
    out = swept.filter(F.col(_KIND) == _POINT)
    for k, side in enumerate(sides):
        names = [f"{side}_{c}" for c in columns]
        step = 1 if side == "before" else -1
        # One row for each partition: what its first key has from the last one before it that holds a fact of this key.
        order = Window.partitionBy(*by).orderBy(F.col(_PART) * step, F.col(_KIND).desc())
        ends = swept.filter(F.col(_KIND).isin(_EDGE + k, _HEAD + k))
        known = lambda c: F.when(F.col(_KIND) == _EDGE + k, F.col(c))
        handed = ends.select(*by, _PART, _KIND, *[F.last(known(c), True).over(order).alias(f"_h_{c}") for c in names])
        handed = handed.filter(F.col(_KIND) == _HEAD + k).drop(_KIND)
        out = out.join(F.broadcast(handed), [*by, _PART], "left")
        lacks = F.col(f"{side}_{ts}").isNull()
        out = out.withColumns({c: F.when(lacks, F.col(f"_h_{c}")).otherwise(F.col(c)) for c in names}).drop(
            *[f"_h_{c}" for c in names])
    return out.select(*[F.col(f"_own.{c}").alias(c) for c in points.columns], *[n for n, _ in filled])


def newest_covering(rows: DataFrame, cells: list[str], keep: list[str], kinds: str) -> DataFrame:
    """(capture_id, probe_id, order, keep...) of the span on top at each probe of a cell, if any.

    ``rows`` has spans (``probe_id`` null, ``low``, ``high``, ``o1``, ``o2``, ``keep``) and probes (``low`` their time).  A cell is
    swept along ``low`` with a heap of its open spans, the newest on top; one that has ended when it comes to the top is
    dropped for good, so a probe costs no more than the spans that began since the last one, and makes one row."""

    def step(batches):
        cell, heap = None, []
        for batch in batches:
            read = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            out = []
            for key, capture, probe, low, high, o1, o2, *kept in zip(
                    zip(*[read[c] for c in cells]), *[read[c] for c in ("capture_id", "probe_id", "low", "high", "o1", "o2")],
                    *[read[c] for c in keep]):
                if key != cell:
                    cell, heap = key, []
                if probe is None:
                    heapq.heappush(heap, (-o1, -o2, high, kept))
                    continue
                while heap and heap[0][2] < low:
                    heapq.heappop(heap)
                if heap:
                    out.append((capture, probe, -heap[0][0], -heap[0][1], *heap[0][3]))
            if out:
                types = [batch.schema.field(c).type for c in ("capture_id", "probe_id", "o1", "o2", *keep)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                      ["capture_id", "probe_id", "o1", "o2", *keep])

    dealt = rows.repartition(*cells).sortWithinPartitions(*cells, "low", F.col("probe_id").isNotNull())
    return dealt.mapInArrow(step, kinds)
