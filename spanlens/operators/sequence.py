"""Computations along arrival order: folding switches, pairing, deltas, rates and order checks."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_hub
from ..schema import CAPTURE, DELTA_MAX, SEQ
from .slabs import SLAB, SLAB_ROWS, Running, arrival_slab, running


def fold_switches(switches: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Run intervals from switch events: on each thread a switch closes the interval the one before opened.

    Track, start, name, function and task come from the opening switch, the stack from the closing one.  The
    last, still open interval of a thread is not emitted.
    """
    lane = [CAPTURE, "thread"]
    columns = [*lane, SEQ, "ts", "target", "label", "func", "task", "stack"]
    inside = Window.partitionBy(*lane, SLAB).orderBy(SEQ)
    folded = switches.select(*columns, arrival_slab(rows=slab_rows).alias(SLAB)).withColumns({
        "_ts": F.lead("ts").over(inside), "_stack": F.lead("stack").over(inside),
        "_head": F.lag(SEQ).over(inside).isNull(),
    })
    # A slab's last switch is closed by the next slab's first one: those few rows are folded once more.
    edges = folded.filter(F.col("_head") | F.col("_ts").isNull())
    between = Window.partitionBy(*lane).orderBy(SEQ)
    bridged = edges.withColumns({
        "_open": F.col("_ts").isNull(), "_ts": F.lead("ts").over(between),
        "_stack": F.lead("stack").over(between),
    }).filter(F.col("_open") & F.col("_ts").isNotNull())
    keep = [*columns, "_ts", "_stack"]
    closed = folded.filter(F.col("_ts").isNotNull()).select(*keep).unionByName(bridged.select(*keep))
    dur = F.greatest(F.col("_ts") - F.col("ts"), F.lit(0))
    return closed.select(
        CAPTURE, SEQ, "thread", F.col("target").alias("gid"), F.col("ts").alias("start"), dur.alias("dur"),
        (F.col("ts") + dur).alias("end"), F.col("label").alias("name"), "func", "task",
        F.col("_stack").alias("stack"), is_hub("label").alias("is_hub"),
    )


def drop_zero_tail(spans: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Drop a thread's last interval where it has no length."""
    rest = running(
        spans, [CAPTURE, "thread"], [SEQ], [Running("_later", F.col(SEQ), "next")],
        arrival_slab(rows=slab_rows),
    )
    return rest.filter(F.col("_later").isNotNull() | (F.col("dur") > 0)).select(*spans.columns)


def pair_gc(phases: DataFrame, origin: int = 0, queue_limit: int | None = None,
            slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Collector pauses from start and stop marks.

    A stop closes the latest start before it (also one already used) and is ignored without one.  Rows with
    phase ``drain`` empty the producer's queue: with ``queue_limit`` only the latest that many pauses before
    each drain are kept, as a bounded queue would.
    """
    stop = F.col("phase") == "stop"
    specs = [Running("_open", F.when(F.col("phase") == "start", F.col("t")), "last")]
    out = running(phases, [CAPTURE], [SEQ], specs, arrival_slab(rows=slab_rows))
    paired = stop & F.col("_open").isNotNull()
    if queue_limit is not None:
        one = F.when(paired, 1).otherwise(0)
        counted = running(out.withColumn("_one", one), [CAPTURE], [SEQ], [
            Running("_nth", F.col("_one"), "sum", True), Running("_rest", F.col("_one"), "sum_after"),
        ], arrival_slab(rows=slab_rows))
        at_drain = F.when(F.col("phase") == "drain", F.col("_nth"))
        out = running(counted, [CAPTURE], [SEQ], [Running("_full", at_drain, "next")],
                      arrival_slab(rows=slab_rows))
        later = F.coalesce(F.col("_full") - F.col("_nth"), F.col("_rest"))
        paired = paired & (later < queue_limit)
    return out.filter(paired).select(
        CAPTURE, SEQ, F.greatest(F.col("_open") - origin, F.lit(0)).alias("start"),
        (F.col("t") - F.col("_open")).alias("dur"),
        F.coalesce("generation", F.lit(-1)).cast("long").alias("generation"),
        F.coalesce("collected", F.lit(0)).cast("long").alias("collected"),
    )


def sortedness(df: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """For each capture: ``sorted`` is false once a row starts before the latest end among earlier rows."""
    spans = df.select(CAPTURE, SEQ, "start", (F.col("start") + F.col("dur")).alias("_end"))
    seen = running(spans, [CAPTURE], [SEQ], [Running("_high", F.col("_end"), "max")],
                   arrival_slab(rows=slab_rows))
    breaks = F.coalesce(F.col("start") < F.greatest(F.col("_high"), F.lit(0)), F.col("start") < 0)
    return seen.groupBy(CAPTURE).agg(
        (F.count_if(breaks) == 0).alias("sorted"), F.count_if(breaks).alias("out_of_order"),
        F.min(F.when(breaks, F.col(SEQ))).alias("first_break"),
    )


def counter_rates(counters: DataFrame, by=(CAPTURE, "gid"), slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Cumulative CPU counters as milliseconds per wall second; 0 for the first reading of each key."""
    was = [Running(f"_was_{c}", F.col(c), "last") for c in ("start", "on_cpu_ns", "runq_ns")]
    out = running(counters, by, [SEQ], was, arrival_slab(rows=slab_rows))
    seconds = F.greatest((F.col("start") - F.col("_was_start")) / 1e9, F.lit(1e-3))

    def rate(c):
        grown = F.greatest(F.col(c) - F.col(f"_was_{c}"), F.lit(0)) / 1e6
        return F.coalesce(grown / seconds, F.lit(0.0))

    return out.select(
        *counters.columns, rate("runq_ns").alias("lag_ms_s"), rate("on_cpu_ns").alias("cpu_ms_s")
    )


def delta_encode(rows: DataFrame, by=(CAPTURE, "thread"), ts: str = "ts", slab_rows: int = SLAB_ROWS):
    """24-bit time deltas: ``delta`` to the row before, or a reset with ``base`` where it does not fit."""
    out = running(rows, by, [SEQ], [Running("_was", F.col(ts), "last")], arrival_slab(rows=slab_rows))
    step = F.col(ts) - F.coalesce("_was", F.lit(0))
    fits = (step >= 0) & (step <= DELTA_MAX)
    return out.select(
        *by, SEQ, (~fits).alias("is_reset"), F.when(~fits, F.col(ts)).alias("base"),
        F.when(fits, step).otherwise(0).alias("delta"),
    )


def delta_decode(rows: DataFrame, by=(CAPTURE, "thread"), slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Times back from deltas: the latest base plus the deltas since.

    A reset row's base less the running sum at that row is a constant until the next reset, so one running
    sum and one carried constant replace a sum in each reset group.
    """
    summed = running(rows, by, [SEQ], [Running("_sum", F.col("delta"), "sum", True)],
                     arrival_slab(rows=slab_rows))
    shift = F.when(F.col("is_reset"), F.col("base") - F.col("_sum"))
    out = running(summed, by, [SEQ], [Running("_shift", shift, "last", True)], arrival_slab(rows=slab_rows))
    return out.select(*by, SEQ, (F.coalesce("_shift", F.lit(0)) + F.col("_sum")).alias("ts"))
