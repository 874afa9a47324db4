"""Grouped and whole-capture aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import overlaps
from ..schema import BLOCKED_NS, CAPTURE, I64_MAX, LONG_NS, REPORT_TOP, SEQ
from .slabs import exact_quantiles, top_n

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _by_track(rows: DataFrame, **sums) -> DataFrame:
    """One row for each track: first-arrival ``name`` and ``is_hub``, ``first_seq`` and the ``sums``.

    ``sums`` are (partial aggregate, its combiner) pairs.  The rows are first reduced for each (track, name,
    hub flag) by hash aggregation, since picking a text along an order would have to sort them; the few
    results are then combined for each track.
    """
    fine = rows.groupBy(CAPTURE, "gid", "name", "is_hub").agg(
        F.min(SEQ).alias("first_seq"), *[part.alias(c) for c, (part, _) in sums.items()]
    )
    return fine.groupBy(CAPTURE, "gid").agg(
        F.min_by("name", "first_seq").alias("name"), F.min_by("is_hub", "first_seq").alias("is_hub"),
        F.min("first_seq").alias("first_seq"), *[combine(c).alias(c) for c, (_, combine) in sums.items()]
    )


def track_runs(rows: DataFrame) -> DataFrame:
    """Run time of each track, with the name and hub flag of its first row by arrival."""
    return _by_track(rows, run=(F.sum("dur"), F.sum)).drop("first_seq")


def track_max(rows: DataFrame) -> DataFrame:
    """Longest row and row count of each track."""
    return rows.groupBy(CAPTURE, "gid").agg(
        F.max("dur").alias("max_dur"), F.count(F.lit(1)).alias("executions")
    )


def duration_stats(df: DataFrame, t0=0, t1=I64_MAX, approximate: bool = False) -> DataFrame:
    """p50, p95 and p99 of the non-hub durations that overlap ``[t0, t1]``, linearly interpolated.

    A capture without such rows gets 0.  ``approximate`` trades exactness for one pass.
    """
    rows = df.filter(~F.col("is_hub") & overlaps(t0, t1))
    if approximate:
        p = F.percentile_approx("dur", list(QUANTILES.values()), 10_000)
        found = rows.groupBy(CAPTURE).agg(p.alias("_p")).select(
            CAPTURE, *[F.col("_p")[i].cast("double").alias(q) for i, q in enumerate(QUANTILES)]
        )
    else:
        found = exact_quantiles(rows, "dur", QUANTILES)
    captures = df.select(CAPTURE).distinct()
    return captures.join(found, CAPTURE, "left").fillna(0.0, list(QUANTILES))


def slow_band_counts(df: DataFrame, tier: str = "all", long_ns=LONG_NS, blocked_ns=BLOCKED_NS) -> DataFrame:
    """Non-hub rows in the long and in the blocked band, and ``total`` of the asked tier, in one pass."""
    app = ~F.col("is_hub")
    long_band = F.count_if(app & (F.col("dur") >= long_ns) & (F.col("dur") < blocked_ns))
    blocked = F.count_if(app & (F.col("dur") >= blocked_ns))
    total = {"all": F.col("long_total") + F.col("blocked_total"), "long": F.col("long_total"),
             "blocked": F.col("blocked_total")}[tier]
    return df.groupBy(CAPTURE).agg(
        long_band.alias("long_total"), blocked.alias("blocked_total")
    ).withColumn("total", total)


def track_rollup(df: DataFrame, long_ns=LONG_NS, blocked_ns=BLOCKED_NS) -> DataFrame:
    """One row for each track with every number the summary and the top list need."""
    app = ~F.col("is_hub")
    return _by_track(
        df,
        run=(F.sum("dur"), F.sum), executions=(F.count(F.lit(1)), F.sum), max_dur=(F.max("dur"), F.max),
        hub_run=(F.sum(F.when(~app, F.col("dur")).otherwise(0)), F.sum),
        app_run=(F.sum(F.when(app, F.col("dur")).otherwise(0)), F.sum),
        long_count=(F.count_if(app & (F.col("dur") >= long_ns)), F.sum),
        blocked_count=(F.count_if(app & (F.col("dur") >= blocked_ns)), F.sum),
        last_end=(F.max(F.col("start") + F.col("dur")), F.max),
        first_start=(F.min_by("start", SEQ), lambda c: F.min_by(c, "first_seq")),
    )


def summary_scalars(df: DataFrame, long_ns=LONG_NS, blocked_ns=BLOCKED_NS, rollup=None) -> DataFrame:
    """Distinct tracks, hub and application run time, and rows at or over each threshold.

    Counting tracks in the per-track rollup needs no separate distinct pass.
    """
    rollup = track_rollup(df, long_ns, blocked_ns) if rollup is None else rollup
    return rollup.groupBy(CAPTURE).agg(
        F.count(F.lit(1)).alias("tracks"), F.sum("hub_run").alias("hub_run"),
        F.sum("app_run").alias("app_run"), F.sum("long_count").alias("long_count"),
        F.sum("blocked_count").alias("blocked_count"),
    )


def top_tracks(df: DataFrame, n: int = REPORT_TOP, rollup=None) -> DataFrame:
    """The ``n`` tracks with the most run time, hub included; the first-seen track wins a tie."""
    rollup = track_rollup(df) if rollup is None else rollup
    order = [F.col("run").desc(), F.col("first_seq")]
    return top_n(rollup, order, n, spread="gid").select(
        CAPTURE, "rank", "gid", "name", "is_hub", "run", "executions"
    )


def hot_functions(df: DataFrame, n: int = REPORT_TOP) -> DataFrame:
    """The ``n`` functions with the most non-hub run time; an empty label stays a group of its own."""
    per_func = df.filter(~F.col("is_hub")).groupBy(CAPTURE, "func").agg(
        F.sum("dur").alias("total"), F.count(F.lit(1)).alias("executions"), F.max("dur").alias("longest")
    )
    return top_n(per_func, [F.col("total").desc(), F.col("func")], n, spread="func").select(
        CAPTURE, "rank", "func", "total", "executions", "longest"
    )


def gc_totals(gc: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """Number and length of all pauses; zeros for a capture that ``captures`` lists and that has none."""
    found = gc.groupBy(CAPTURE).agg(F.count(F.lit(1)).alias("pauses"), F.sum("dur").alias("total"))
    if captures is None:
        return found
    return captures.select(CAPTURE).distinct().join(found, CAPTURE, "left").fillna(0, ["pauses", "total"])


def gc_by_generation(gc: DataFrame) -> DataFrame:
    return gc.groupBy(CAPTURE, "generation").agg(
        F.count(F.lit(1)).alias("pauses"), F.sum("dur").alias("total")
    )


def capture_counters(df: DataFrame) -> DataFrame:
    """Rows, bytes of text and numbers, latest end and first observed start of each capture."""
    texts = sum((F.octet_length(c) for c in ("name", "func", "task", "stack")), F.lit(0))
    return df.groupBy(CAPTURE).agg(
        F.count(F.lit(1)).alias("total"), F.sum(texts + 24).cast("long").alias("bytes"),
        F.max(F.col("start") + F.col("dur")).alias("span"), F.min_by("start", SEQ).alias("origin"),
    )


def event_rate(counters: DataFrame) -> DataFrame:
    """Rows for each second of the capture's span; 0 for a span of 0."""
    rate = F.when(F.col("span") > 0, F.col("total") / (F.col("span") / 1e9)).otherwise(0.0)
    return counters.select(CAPTURE, "total", "span", rate.alias("per_second"))


def _last_end(df):
    """End of the last row by arrival in each capture: "now" for the recent-window questions."""
    return df.groupBy(CAPTURE).agg(F.max_by(F.col("start") + F.col("dur"), SEQ).alias("_now"))


def _recent(df, window_ns):
    """Time each row spends inside ``[now - window, now]``.

    Only rows that end late enough can count.  The earliest "now" of all captures, a scalar subquery, bounds
    the scan by a plain comparison on ``end``.
    """
    now = _last_end(df)
    floor = now.agg(F.min("_now")).scalar() - window_ns
    late = df.filter(F.col("end") >= floor).join(now, CAPTURE)
    start_at = F.col("_now") - window_ns
    part = F.least(F.col("end"), F.col("_now")) - F.greatest(F.col("start"), start_at)
    return late.filter(F.col("end") >= start_at).withColumn("_part", part)


def cpu_busy(df: DataFrame, window_ns: int = 1_000_000_000) -> DataFrame:
    """Share of the last ``window_ns`` spent in non-hub rows, between 0 and 1."""
    used = _recent(df, window_ns).filter(~F.col("is_hub")).groupBy(CAPTURE).agg(F.sum("_part").alias("_used"))
    share = F.coalesce(F.col("_used"), F.lit(0)) / float(window_ns)
    return _last_end(df).join(used, CAPTURE, "left").select(
        CAPTURE, F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)).alias("busy")
    )


def recent_activity(df: DataFrame, window_ns: int | None) -> DataFrame:
    """Run time of each track in the last ``window_ns``, or in the whole capture."""
    if window_ns is None:
        return df.groupBy(CAPTURE, "gid").agg(F.sum("dur").alias("activity"))
    part = _recent(df, window_ns).groupBy(CAPTURE, "gid").agg(F.sum("_part").alias("activity"))
    tracks = df.select(CAPTURE, "gid").distinct()
    return tracks.join(part, [CAPTURE, "gid"], "left").fillna(0, ["activity"])
