"""Sorted, limited and ranked results."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import duration_band, slow_level, tier_filter, track_name_fallback
from ..schema import (
    BLOCKED_NS, CAPTURE, LONG_NS, OVERFLOW_LABEL, SEQ,
)
from ..storage import stored
from .aggregates import recent_activity, track_rollup
from .slabs import Running, running, slice_by_arrival, top_n


def slowlog(df: DataFrame, limit: int, tier="all", sort="start", long_ns=LONG_NS,
            blocked_ns=BLOCKED_NS) -> DataFrame:
    """The first ``limit`` slow non-hub rows of a tier, longest (``dur``) or newest (``start``) first; ties by arrival.

    The tier is selected before the limit, so one band never hides the other.
    """
    rows = df.filter(tier_filter(tier, long_ns, blocked_ns)).select(
        CAPTURE, SEQ, "start", "dur", "gid", "name", "func"
    )
    best = top_n(rows, [F.col(sort).desc(), F.col(SEQ)], limit)
    return best.withColumn("level", slow_level("dur", blocked_ns))


def global_rank(df: DataFrame, order: dict, ident: str, by=(CAPTURE,), name: str = "row") -> DataFrame:
    """0-based rank along the columns ``order`` (name -> ascending?), ``ident`` breaking ties.

    The rows are dealt in ranges of the whole order, ``ident`` included, and stored, so rows alike in all but
    ``ident`` are many ranges, too.  Ranks inside a range and the sizes of the ranges before it add up.
    """
    by = list(by)
    along = [*[F.col(c).asc() if up else F.col(c).desc() for c, up in order.items()], F.col(ident).asc()]
    ranges = stored(
        df.repartitionByRange(*by, *along).withColumn("_range", F.spark_partition_id()), "rank-ranges")
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        *by, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_range").orderBy(*along)
    ranked = ranges.withColumn("_i", F.row_number().over(inside)).join(sizes, [*by, "_range"])
    return ranked.withColumn(name, F.col("_before") + F.col("_i") - 1).drop("_before", "_i", "_range")


def track_rank_keys(name):
    """STRUCT<kind, number> of a track name: hub, numbered worker, bare worker, anything else."""
    n = F.col(name) if isinstance(name, str) else name
    low = F.lower(n)
    number = lambda pattern: F.coalesce(
        F.regexp_extract(low, pattern, 1).try_cast("long"), F.lit(0)
    )
    return F.struct(
        F.when(low.startswith("hub"), 0).when(F.regexp_like(low, F.lit(r"^greenlet-\d")), 1)
        .when(low == "greenlet", 2).otherwise(3).alias("kind"),
        F.when(low.startswith("hub"), number(r"^hub[^-]*-\s*(\d+)"))
        .otherwise(number(r"^greenlet-(\d+)")).alias("number"),
    )


def track_order(df: DataFrame, mode: str = "activity") -> DataFrame:
    """Display row of each track: hubs on top, then by activity (``activity`` or ``recent1/10/60``, in
    seconds) or not (``ident``), then by the rank of the name, then by name.

    The tracks are ranked range by range (``global_rank``), so no task sorts every track of a capture.
    """
    seconds = {"activity": None, "recent1": 1, "recent10": 10, "recent60": 60, "ident": None}[mode]
    tracks = track_rollup(df).select(
        CAPTURE, "gid", track_name_fallback("name", "gid").alias("name"), "is_hub", F.col("run").alias("activity")
    )
    if seconds is not None:
        tracks = tracks.drop("activity").join(recent_activity(df, seconds * 1_000_000_000), [CAPTURE, "gid"])
    keys = track_rank_keys("name")
    out = tracks.withColumns({
        "_hub": F.when(F.col("is_hub"), 0).otherwise(1),
        "_act": F.when(F.col("is_hub") | F.lit(mode == "ident"), 0).otherwise(F.col("activity")),
        "_kind": keys["kind"], "_num": keys["number"],
    })
    ranked = global_rank(out, {"_hub": True, "_act": False, "_kind": True, "_num": True, "name": True}, "gid")
    return ranked.select(CAPTURE, "row", "gid", "name", "is_hub", "activity")


def stable_track_order(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """Keep the rows of ``placed`` (capture, gid, row) and append unseen tracks below, first seen first."""
    seen = rows.groupBy(CAPTURE, "gid").agg(F.min(SEQ).alias(SEQ))
    fresh = seen.join(placed, [CAPTURE, "gid"], "left_anti")
    height = placed.groupBy(CAPTURE).agg((F.max("row") + 1).alias("_height"))
    nth = running(fresh, [CAPTURE], [SEQ], [Running("_nth", F.lit(1), "sum")])
    below = nth.join(height, CAPTURE, "left").select(
        CAPTURE, "gid", (F.coalesce("_height", F.lit(0)) + F.col("_nth")).cast("long").alias("row")
    )
    return placed.select(CAPTURE, "gid", F.col("row").cast("long").alias("row")).unionByName(below)


def fold_overflow(df: DataFrame, limit: int) -> DataFrame:
    """Run time of each track, tracks first seen after the first ``limit`` folded into one.

    Tracks are counted along their first arrival, so telling which ones are kept sorts none of them together.
    """
    tracks = track_rollup(df)
    first = tracks.select(CAPTURE, "gid", F.col("first_seq").alias(SEQ))
    kept = slice_by_arrival(first, lambda n: F.lit(0), lambda n: F.lit(limit)).select(
        CAPTURE, "gid", F.lit(True).alias("_kept")
    )
    fits = F.coalesce("_kept", F.lit(False))
    return (
        tracks.join(kept, [CAPTURE, "gid"], "left")
        .groupBy(
            CAPTURE, F.when(fits, F.col("gid")).alias("gid"),
            F.when(fits, track_name_fallback("name", "gid")).otherwise(OVERFLOW_LABEL).alias("name"),
            (fits & F.col("is_hub")).alias("is_hub"),
        )
        .agg(F.sum("run").alias("run"), F.max("max_dur").alias("max_dur"),
             F.sum("executions").alias("executions"), F.count(F.lit(1)).alias("tracks"))
    )


def page_tracks(order: DataFrame, df: DataFrame, first: int, last: int, long_ns=LONG_NS,
                blocked_ns=BLOCKED_NS) -> DataFrame:
    """The tracks on display rows ``first .. last`` with run time and the band of their longest row."""
    page = order.filter(F.col("row").between(first, last)).select(CAPTURE, "row", "gid", "name", "is_hub")
    load = df.groupBy(CAPTURE, "gid").agg(F.sum("dur").alias("run"), F.max("dur").alias("max_dur"))
    return page.join(load, [CAPTURE, "gid"]).withColumn(
        "band", duration_band("max_dur", "is_hub", long_ns, blocked_ns)
    )


def retention_cap(df: DataFrame, keep: int, **slabs) -> DataFrame:
    """The newest ``keep`` arrivals of each capture, with ``evicted`` telling whether older ones went."""
    kept = slice_by_arrival(df, lambda n: F.greatest(n - keep, F.lit(0)), lambda n: n, **slabs)
    return kept.withColumn("evicted", F.col("total") > keep).drop("total")


def retention_horizon(kept: DataFrame) -> DataFrame:
    """Earliest start still held by each capped capture; 0 where nothing was evicted."""
    return kept.groupBy(CAPTURE).agg(
        F.when(F.bool_or("evicted"), F.min("start")).otherwise(0).alias("retained_from"),
        F.count(F.lit(1)).alias("held"),
    )
