"""Time-range questions about one capture set: windows, tails and their bounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import int_div
from ..functions.predicates import overlaps, start_in
from ..schema import CAPTURE, DETAIL_SLACK_NS, SEQ
from .matching import interval_join
from .sequence import sortedness
from .slabs import slice_by_arrival
from .sweep import nearest_facts

RENDER_COLUMNS = (CAPTURE, SEQ, "start", "dur", "gid")


def render_only(df: DataFrame) -> DataFrame:
    """The numeric columns a timeline is drawn from; the texts are looked up later by ``detail_nearest``."""
    return df.select(*RENDER_COLUMNS)


def interval_window(df: DataFrame, t0, t1, cap: int | None = None, keep: str | None = None,
                    order: DataFrame | None = None, columns=RENDER_COLUMNS, **slabs) -> DataFrame:
    """Rows that overlap ``[t0, t1]``, flagged ``capped``: all of them, by one filter that the scan takes over.

    A caller who wants at most ``cap`` rows of each capture also says which to ``keep``: the ``middle`` of the range,
    the ``first`` arrivals, or ``by_order`` the middle of captures in start order and the first arrivals of any
    other.  ``order`` is a stored result of ``sortedness``; without it ``by_order`` takes a pass over all rows.
    """
    hits = df.filter(overlaps(t0, t1)).select(*columns)
    if cap is None:
        return hits.withColumn("capped", F.lit(False))
    facts = None
    if keep == "by_order":
        facts = (sortedness(df, **slabs) if order is None else order).select(CAPTURE, F.col("sorted").alias("_middle"))
    elif keep not in ("middle", "first"):
        raise ValueError("with a cap, keep is one of 'middle', 'first' and 'by_order'")
    middle = F.col("_middle") if keep == "by_order" else F.lit(keep == "middle")
    skipped = lambda n: F.when(middle & (n > cap), int_div(n - cap, 2)).otherwise(0)
    kept = slice_by_arrival(hits, skipped, lambda n: skipped(n) + cap, facts=facts, **slabs)
    return kept.select(*columns, (F.col("total") > cap).alias("capped"))


def tail_follow(df: DataFrame, after, before, cap: int | None = None, after_seq: int = -1, **slabs) -> DataFrame:
    """New rows: ``after < start < before`` and arrived after ``after_seq``, with ``capped``.

    With a ``cap`` the oldest arrivals come first, and the next page goes on from the last of them (``tail_frontier``):
    pages of a capture in any order yield each row once.
    """
    hits = df.filter(start_in(after, before) & (F.col(SEQ) > after_seq)).select(*RENDER_COLUMNS)
    if cap is None:
        return hits.withColumn("capped", F.lit(False))
    kept = slice_by_arrival(hits, lambda n: F.lit(0), lambda n: F.lit(cap), **slabs)
    return kept.select(*RENDER_COLUMNS, (F.col("total") > cap).alias("capped"))


def tail_frontier(page: DataFrame) -> DataFrame:
    """Where the next page of each capture starts: the last arrival seen, the largest start, and whether more waits."""
    return page.groupBy(CAPTURE).agg(
        F.max(SEQ).alias("after_seq"), F.max("start").alias("max_start"), F.bool_or("capped").alias("more"),
    )


def tail_or_window(df: DataFrame, frontier: DataFrame, t0, t1) -> DataFrame:
    """What has arrived since ``frontier`` for each capture, or its whole window where new rows start at or before
    the largest start already seen.  ``whole`` tells which; a capture without a frontier gets its window."""
    rows = df.filter(overlaps(t0, t1)).select(*RENDER_COLUMNS).join(
        frontier.select(CAPTURE, F.col("after_seq").alias("_seq"), F.col("max_start").alias("_start")), CAPTURE, "left")
    new = F.col(SEQ) > F.coalesce("_seq", F.lit(-1))
    broken = rows.groupBy(CAPTURE).agg(
        (F.bool_or(F.col("_seq").isNull())
         | F.coalesce(F.bool_or(new & (F.col("start") <= F.col("_start"))), F.lit(False))).alias("whole"))
    return rows.join(broken, CAPTURE).filter(F.col("whole") | new).select(*RENDER_COLUMNS, "whole")


def gc_window(gc: DataFrame, t0, t1) -> DataFrame:
    """Collector pauses that overlap ``[t0, t1]``; both bounds reach the scan where ``end`` is stored."""
    stop = F.col("end") if "end" in gc.columns else F.col("start") + F.col("dur")
    return gc.filter(overlaps(t0, t1, end=stop))


def gc_tail(gc: DataFrame, after, before) -> DataFrame:
    """Collector pauses past their own frontier."""
    return gc.filter(start_in(after, before))


def window_bounds(rows: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """Count and time bounds of a window's rows.  ``max_start`` and ``max_seq`` are the frontier of the next tail.

    ``captures`` lists the captures asked for, so that one with an empty window has a row of zeros.
    """
    stop = F.col("start") + F.col("dur")
    none = F.lit(0)
    found = rows.groupBy(CAPTURE).agg(
        F.count(F.lit(1)).alias("visible"),
        F.greatest(F.min("start"), none).alias("min_start"),
        F.greatest(F.max("start"), none).alias("max_start"),
        F.greatest(F.max(stop), none).alias("max_end"),
        F.max(SEQ).alias("max_seq"),
    )
    if captures is None:
        return found
    zeros = ["visible", "min_start", "max_start", "max_end"]
    return captures.select(CAPTURE).distinct().join(found, CAPTURE, "left").fillna(0, zeros).fillna(-1, ["max_seq"])


def detail_at(df: DataFrame, gid: int, start_ns: int, dur_ns: int) -> DataFrame:
    """Texts of the one row of a track that starts nearest ``start_ns``; a filter the scan can push down."""
    slack = max(dur_ns, DETAIL_SLACK_NS)
    near = df.filter(
        (F.col("gid") == gid) & F.col("start").between(start_ns - slack, start_ns + slack)
    )
    gap = F.struct(F.abs(F.col("start") - start_ns).alias("gap"), F.col(SEQ).alias("seq"))
    pick = lambda c: F.coalesce(F.min_by(c, gap), F.lit("")).alias(c)
    return near.agg(*[pick(c) for c in ("func", "task", "stack")])


def samples_range(samples: DataFrame, t0: int, t1: int) -> DataFrame:
    """Samples in ``[t0, t1]`` and one more on each side, so that held values reach both edges.

    The range is a pushed-down filter.  One aggregate over two number columns finds the arrivals of the outer rows, and
    they are fetched by filters of their own.
    """
    at = F.struct("start", SEQ)
    edges = samples.groupBy(CAPTURE).agg(
        F.max(F.when(F.col("start") < t0, at)).alias("left"), F.min(F.when(F.col("start") > t1, at)).alias("right"),
    )
    outer = edges.select(CAPTURE, F.explode(F.array("left", "right")).alias("at")).filter("at is not null").select(
        CAPTURE, F.col(f"at.{SEQ}").alias(SEQ), F.col("at.start").alias("start"))
    beyond = samples.filter((F.col("start") < t0) | (F.col("start") > t1))
    return samples.filter(F.col("start").between(t0, t1)).unionByName(
        beyond.join(outer, [CAPTURE, SEQ, "start"], "left_semi").select(*samples.columns))


def samples_ranges(samples: DataFrame, ranges: DataFrame) -> DataFrame:
    """``samples_range`` for a table of ranges (``probe_id``, ``t0``, ``t1``) of at least no length: of each its samples and one
    more on either side.

    The outer samples are those before and after a point at either edge, found in one sweep; the inner ones are an interval
    join of points.  A sample that starts at an edge is inside."""
    times = F.explode(F.array(F.struct((F.col("t0") - 1).alias("t"), F.lit("left").alias("_edge")),
                              F.struct(F.col("t1").alias("t"), F.lit("right").alias("_edge"))))
    asked = ranges.select(CAPTURE, "probe_id", times.alias("_at")).select(CAPTURE, "probe_id", "_at.t", "_at._edge")
    facts = samples.select(CAPTURE, F.col("start").alias("t"), SEQ)
    # Of samples at one time the last is before an edge and the first is after it.
    left = nearest_facts(asked.filter("_edge = 'left'"), facts, [CAPTURE], "t", [SEQ], SEQ).select(
        CAPTURE, "probe_id", F.col(f"before_{SEQ}").alias(SEQ))
    right = nearest_facts(asked.filter("_edge = 'right'"), facts, [CAPTURE], "t", [SEQ], SEQ, True, True).select(
        CAPTURE, "probe_id", F.col(f"after_{SEQ}").alias(SEQ))
    # As spans of two units around the doubled time, samples on an edge overlap it.
    points = samples.select(CAPTURE, SEQ, F.lit(0).cast("long").alias("gid"), (F.col("start") * 2 - 1).alias("start"),
                            F.lit(2).cast("long").alias("dur"))
    inner = interval_join(ranges.select(CAPTURE, "probe_id", (F.col("t0") * 2).alias("t0"), (F.col("t1") * 2).alias("t1")), points)
    found = inner.select(CAPTURE, "probe_id", SEQ).unionByName(left).unionByName(right).filter(F.col(SEQ).isNotNull())
    return found.join(samples, [CAPTURE, SEQ]).select("probe_id", *samples.columns)
