"""Time series on fixed bins or pixel columns."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arith import floor_div, int_div
from ..schema import CAPTURE, LAG_FULL_SCALE_MIN, SEQ, STALL_INTERVAL_NS
from .slabs import Running, running

BIN_SLAB = 1 << 16


def _runs_to_bins(changes: DataFrame, last) -> DataFrame:
    """One row for each bin of the runs ``bin .. last``, made in two steps so no array outgrows a slab."""
    tops = F.sequence(floor_div("bin", BIN_SLAB), floor_div("_last", BIN_SLAB))
    inner = F.sequence(
        F.greatest(F.col("bin"), F.col("_top") * BIN_SLAB),
        F.least(F.col("_last"), F.col("_top") * BIN_SLAB + (BIN_SLAB - 1)),
    )
    return (
        changes.withColumn("_last", last).withColumn("_top", F.explode(tops))
        .withColumn("_bin", F.explode(inner)).withColumn("_first", F.col("_bin") == F.col("bin"))
    )


def busy_bins(df: DataFrame, bin_ns: int, origin: int = 0) -> DataFrame:
    """Non-hub run time in each bin of ``bin_ns`` by exact overlap; bins without run time are left out.

    A row adds to its first and last bin and marks where its fully covered bins begin and end, so a row makes
    at most four contributions however long it is.  A running sum of the marks gives the rows that cover each
    bin whole.
    """
    start = F.greatest(F.col("start") - origin, F.lit(0)).alias("_a")
    end = (F.col("start") + F.col("dur") - origin).alias("_b")
    spans = df.filter(~F.col("is_hub")).select(CAPTURE, start, end).filter(F.col("_b") > F.col("_a"))
    first, last = int_div("_a", bin_ns), int_div("_b", bin_ns)
    entry = lambda b, part, mark: F.struct(
        b.alias("bin"), part.alias("part"), F.lit(mark).cast("long").alias("mark")
    )
    zero = F.lit(0).cast("long")
    parts = F.when(first == last, F.array(entry(first, F.col("_b") - F.col("_a"), 0))).otherwise(
        F.array(
            entry(first, (first + 1) * bin_ns - F.col("_a"), 0), entry(last, F.col("_b") - last * bin_ns, 0),
            entry(first + 1, zero, 1), entry(last, zero, -1),
        )
    )
    changes = (
        spans.select(CAPTURE, F.explode(parts).alias("e")).groupBy(CAPTURE, F.col("e.bin").alias("bin"))
        .agg(F.sum("e.part").alias("part"), F.sum("e.mark").alias("mark"))
    )
    counted = running(changes, [CAPTURE], ["bin"], [
        Running("_whole", F.col("mark"), "sum", True), Running("_next", F.col("bin"), "next"),
    ], floor_div("bin", BIN_SLAB))
    run_end = F.when(F.col("_whole") > 0, F.coalesce(F.col("_next") - 1, F.col("bin"))).otherwise(F.col("bin"))
    busy = F.col("_whole") * bin_ns + F.when(F.col("_first"), F.col("part")).otherwise(0)
    return _runs_to_bins(counted, run_end).select(
        CAPTURE, F.col("_bin").alias("bin"), busy.alias("busy_ns")
    ).filter(F.col("busy_ns") > 0)


def _columns(captures: DataFrame, n: int) -> DataFrame:
    """Columns 0 .. n-1 for every capture, made in two steps so that no array outgrows a slab."""
    if n < 1:
        raise ValueError(f"a series has one column at least, not {n}")
    number = lambda x: F.lit(x).cast("long")
    tops = captures.select(CAPTURE).distinct().withColumn(
        "_top", F.explode(F.sequence(number(0), number((n - 1) // BIN_SLAB))))
    inside = F.sequence(F.col("_top") * BIN_SLAB, F.least(F.col("_top") * BIN_SLAB + (BIN_SLAB - 1), number(n - 1)))
    return tops.select(CAPTURE, F.explode(inside).alias("x"))


def utilization_series(bins: DataFrame, bin_ns: int, t0: int, px_ns: int, n: int,
                       captures: DataFrame | None = None) -> DataFrame:
    """Busy share of ``n`` columns of ``px_ns`` from ``t0``: bins spread over the columns they overlap.

    A share is at most 1; a column without run time is 0, and so are all of a capture that ``captures`` lists and
    no bin belongs to.
    """
    grid = _columns(bins if captures is None else captures, n)
    low, high = F.col("bin") * bin_ns, (F.col("bin") + 1) * bin_ns
    seen = bins.filter((low < t0 + n * px_ns) & (high > t0))
    from_x = F.greatest(floor_div(low - t0, px_ns), F.lit(0))
    to_x = F.least(floor_div(high - t0 - 1, px_ns), F.lit(n - 1))
    spread = seen.withColumn("x", F.explode(F.sequence(from_x, to_x)))
    left = F.col("x") * px_ns + t0
    shared = F.least(high, left + px_ns) - F.greatest(low, left)
    busy = spread.groupBy(CAPTURE, "x").agg(
        F.sum(F.col("busy_ns") * (shared / float(bin_ns))).alias("_busy")
    )
    share = F.least(F.coalesce(F.col("_busy"), F.lit(0.0)) / float(px_ns), F.lit(1.0))
    return grid.join(busy, [CAPTURE, "x"], "left").select(CAPTURE, "x", share.alias("busy"))


def smooth_series(series: DataFrame, n: int, bin_ns: int, px_ns: int, value: str = "busy") -> DataFrame:
    """Centred moving mean over about 2% of the ``n`` columns; as is where a bin is a column or wider."""
    if bin_ns >= px_ns:
        return series
    w = max(1, int(n / 100 + 0.5))
    # A column also goes to the slabs whose means it is part of, so that each slab has its own window.
    homes = F.sequence(floor_div(F.col("x") - w, BIN_SLAB), floor_div(F.col("x") + w, BIN_SLAB))
    around = Window.partitionBy(CAPTURE, "_slab").orderBy("x").rowsBetween(-w, w)
    spread = series.withColumn("_slab", F.explode(homes)).withColumn(value, F.avg(value).over(around))
    return spread.filter(F.col("_slab") == floor_div("x", BIN_SLAB)).select(*series.columns)


def hold_on_grid(samples: DataFrame, value: str, t0: int, px_ns: int, n: int,
                 captures: DataFrame | None = None) -> DataFrame:
    """The latest sample value at the left edge of each of ``n`` columns; 0 before the first, and in a capture that
    ``captures`` lists and no sample belongs to.

    Samples are reduced to the last one of each column first; the carry runs over the columns slab by slab.
    """
    grid = _columns(samples if captures is None else captures, n)
    # A sample shows from the first column whose left edge is not before it.
    x = F.greatest(-floor_div(-(F.col("start") - t0), px_ns), F.lit(0))
    last = samples.filter(F.col("start") <= t0 + (n - 1) * px_ns).groupBy(CAPTURE, x.alias("x")).agg(
        F.max_by(value, F.struct("start", SEQ)).alias("_v")
    )
    held = running(grid.join(last, [CAPTURE, "x"], "left"), [CAPTURE], ["x"], [
        Running("_held", F.col("_v"), "last", True),
    ], floor_div("x", BIN_SLAB))
    return held.select(CAPTURE, "x", F.coalesce("_held", F.lit(0.0)).alias(value))


def utilization_with_tail(series, samples, spans, t0: int, px_ns: int, n: int) -> DataFrame:
    """Columns past the end of the rows take the held CPU sample (ms/s over 1000, between 0 and 1).

    A capture of the series without rows ends at 0, so all its later columns are held."""
    edge = spans.groupBy(CAPTURE).agg(F.max(F.col("start") + F.col("dur")).alias("_edge"))
    share = F.greatest(F.least(F.col("cpu_ms_s") / 1000.0, F.lit(1.0)), F.lit(0.0))
    held = hold_on_grid(samples, "cpu_ms_s", t0, px_ns, n).select(CAPTURE, "x", share.alias("_held"))
    out = series.join(edge, CAPTURE, "left").join(held, [CAPTURE, "x"], "left")
    past = (F.col("x") * px_ns + t0 > F.coalesce("_edge", F.lit(0))) & F.col("_held").isNotNull()
    return out.select(CAPTURE, "x", F.when(past, F.col("_held")).otherwise(F.col("busy")).alias("busy"))


def lag_series(samples: DataFrame, t0: int, px_ns: int, n: int, captures: DataFrame | None = None) -> DataFrame:
    """Held lag of each column, the highest in view and the full scale of the band."""
    held = hold_on_grid(samples, "lag_ms_s", t0, px_ns, n, captures)
    peaks = held.groupBy(CAPTURE).agg(F.max("lag_ms_s").alias("peak"))
    return held.join(peaks, CAPTURE).withColumn(
        "full_scale", F.greatest(F.col("peak"), F.lit(LAG_FULL_SCALE_MIN))
    )


def stall_intervals(arrivals: DataFrame, interval_ns: int = STALL_INTERVAL_NS, live=True) -> DataFrame:
    """Throughput of each interval, the empty ones included, and where the stream stalls and resumes.

    ``arrivals`` has ``t`` (arrival time, ns) and ``bytes``.  An interval is stalled when rows came before it
    but none in it.
    """
    live = F.lit(live) if isinstance(live, bool) else live
    seen = arrivals.groupBy(CAPTURE, floor_div("t", interval_ns).alias("bin")).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("bytes").alias("_bytes")
    )
    known = running(seen, [CAPTURE], ["bin"], [
        Running("_so_far", F.col("_rows"), "sum", True), Running("_was", F.col("bin"), "last"),
        Running("_next", F.col("bin"), "next"),
    ], floor_div("bin", BIN_SLAB))
    # A row stands for its own interval and for the empty ones up to the next row's.
    dense = _runs_to_bins(known, F.coalesce(F.col("_next") - 1, F.col("bin")))
    rows = F.when(F.col("_first"), F.col("_rows")).otherwise(0)
    size = F.when(F.col("_first"), F.col("_bytes")).otherwise(0)
    seconds = interval_ns / 1e9
    stalled = live & ~F.col("_first")
    begins = F.when(F.col("_bin") == F.col("bin") + 1, "stalled")
    resumes = F.when(F.col("_first") & (F.col("bin") > F.col("_was") + 1), "resumed")
    return dense.select(
        CAPTURE, F.col("_bin").alias("interval"), rows.alias("new_rows"),
        F.round(rows / seconds).cast("long").alias("rows_per_s"),
        F.round(size / seconds / 1024).cast("long").alias("kib_per_s"),
        F.col("_so_far").alias("total"), stalled.alias("stalled"),
        F.when(live, F.coalesce(begins, resumes)).alias("transition"),
    )
