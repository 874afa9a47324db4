"""The registered queries: every operator applied to timeline tables derived from ``events``."""

import time

from pyspark.sql import functions as F

from .. import schema
from ..functions import formats as fmt
from ..functions import predicates as pred
from ..functions import procfs, stacks
from ..functions.arith import int_div
from ..operators import aggregates as agg
from ..operators import dictionary as dic
from ..operators import matching as mat
from ..operators import ranges as rng
from ..operators import ranking as rank
from ..operators import sequence as sq
from ..operators import series as ser
from ..operators import sketches as sk
from ..schema import CAPTURE, SEQ
from ..sources import captures as cap
from ..sources import slab_store as store
from ..streaming import live, stall
from . import event_views as v
from . import report as rep

DAY = 86_400_000_000_000
HOUR = 3_600_000_000_000
SECOND = 1_000_000_000
T0, T1 = 5 * DAY, 12 * DAY
COLUMNS = 720
PX = HOUR
NOW_MS = v.EPOCH_MS + 31 * 86_400_000

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__.removesuffix("_")] = fn
    return fn


KEY = (CAPTURE, SEQ)


# Sources and sinks -------------------------------------------------------------------------------------------

@query
def read_capture(spark, d):
    return _stored_capture(spark, d)["executions"].select(
        *KEY, "gid", "start", "dur", "name", "func", "task", "stack", "is_hub"
    )


def _stored_capture(spark, d):
    path = cap.scratch(spark, "capture")
    cap.write_capture({
        "executions": v.executions(spark, d), "gc": v.gc_events(spark, d), "samples": v.sys_samples(spark, d),
        "switches": v.switches(spark, d), "meta": meta_view(spark, d),
    }, path)
    return cap.read_capture(spark, path)


@query
def read_capture_tables(spark, d):
    """Every stored table read back: its rows and one number column of each."""
    numbers = {"executions": "end", "gc": "end", "samples": "start", "switches": "ts", "meta": "epoch_ms"}
    out = None
    for name, df in _stored_capture(spark, d).items():
        one = df.groupBy(CAPTURE).agg(
            F.count(F.lit(1)).alias("rows"), F.min(SEQ).alias("first_seq"), F.max(numbers[name]).alias("largest"),
        ).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def meta_view(spark, d):
    e = v._base(spark, d)
    return e.select(
        *KEY, F.when(F.col("k") % 2 == 1, F.col("k") + v.EPOCH_MS).otherwise(0).alias("epoch_ms"),
        F.col("gid").alias("tid"), (-F.col("k")).alias("pid"),
        F.concat(F.lit('{"runtime":"'), F.col("event_type"), F.lit('","python":"3.'), F.col("k").cast("string"),
                 F.lit('"}')).alias("pyinfo"),
    )


@query
def read_meta(spark, d):
    return cap.read_meta(meta_view(spark, d)).select(
        CAPTURE, "epoch_ms", "tid", "pid", F.col("pyinfo")["runtime"].alias("runtime"),
        F.col("pyinfo")["python"].alias("python"),
    )


def _report(spark, d):
    return rep.analyze_report(v.executions(spark, d), v.gc_events(spark, d), meta_view(spark, d))


@query
def report_json(spark, d):
    j = rep.report_json(_report(spark, d))
    at = lambda path, kind: F.get_json_object("json", path).cast(kind)
    return j.select(
        CAPTURE, at("$.totalExecutions", "long").alias("total"), at("$.spanNs", "long").alias("span_ns"),
        at("$.epochMs", "long").alias("epoch_ms"), at("$.p95Ns", "long").alias("p95_ns"),
        at("$.longCount", "long").alias("long_count"), at("$.gcTotalNs", "long").alias("gc_total_ns"),
        at("$.gcByGen[0].totalNs", "long").alias("gen0_ns"), at("$.slowest[2].dur", "long").alias("third_dur"),
        at("$.topGreenlets[0].name", "string").alias("top_track"),
        at("$.topFuncs[0].func", "string").alias("top_func"),
    )


@query
def report_of_all_captures(spark, d):
    """The whole JSON of each capture; in one of them nothing ran."""
    e = v.executions(spark, d).filter(F.col(CAPTURE) != "cap-c")
    return rep.report_json(rep.analyze_report(e, v.gc_events(spark, d), meta_view(spark, d)))


@query
def report_text(spark, d):
    return rep.report_text(_report(spark, d))


@query
def render_columns(spark, d):
    return dic.render_columns(rng.interval_window(v.executions(spark, d), T0, T1), T0)


@query
def validate_render_columns(spark, d):
    rows = rng.interval_window(v.executions(spark, d), T0, T1)
    tracks = dic.track_positions(rows).groupBy(CAPTURE).agg(F.count(F.lit(1)).alias("_t"))
    n = rows.groupBy(CAPTURE).agg(F.count(F.lit(1)).alias("_n"))
    short = lambda c, capture: F.col(c) - F.when(F.col(CAPTURE) == capture, 1).otherwise(0)
    headers = n.join(tracks, CAPTURE).select(
        CAPTURE, short("_n", "cap-c").alias("n"), short("_t", "cap-b").alias("n_tracks")
    )
    return dic.validate_render_columns(dic.render_columns(rows, T0), headers)


# Predicates --------------------------------------------------------------------------------------------------

@query
def is_hub(spark, d):
    e = v.executions(spark, d)
    return e.select(
        *KEY, pred.is_hub("name").alias("plain"), pred.is_hub(F.upper("name")).alias("upper_case"),
        pred.is_hub(F.substring("name", 1, 2)).alias("too_short"),
    )


@query
def overlaps(spark, d):
    return v.executions_dense(spark, d).filter(pred.overlaps(T0, T1)).select(*KEY, "start", "dur")


@query
def start_in(spark, d):
    return v.executions(spark, d).filter(pred.start_in(T0, T1)).select(*KEY, "start")


@query
def tier_filter(spark, d):
    return v.executions(spark, d).select(
        *KEY, *[pred.tier_filter(t).alias(f"in_{t}") for t in ("all", "long", "blocked")]
    )


@query
def slow_level(spark, d):
    return v.executions(spark, d).select(
        *KEY, pred.slow_level().alias("log_level"), pred.timeline_level().alias("level")
    )


@query
def duration_band(spark, d):
    return v.executions(spark, d).select(*KEY, pred.duration_band().alias("band"))


@query
def heat_score(spark, d):
    return v.executions(spark, d).select(*KEY, F.round(pred.heat_score(), 6).alias("heat"))


@query
def track_label(spark, d):
    b = v._base(spark, d)
    return b.select(
        *KEY, pred.track_label(F.initcap("event_type"), F.when(F.col("k") % 7 > 0, F.col("k"))).alias("label")
    )


@query
def track_name_fallback(spark, d):
    e = v.executions(spark, d)
    blank = F.when(F.col("gid") % 3 == 0, "").otherwise(F.col("name"))
    return e.select(*KEY, pred.track_name_fallback(blank, F.col("gid") * 1_000_003).alias("name"))


@query
def correlation_id(spark, d):
    b = v._base(spark, d)
    k, s = F.col("k"), F.col("event_type")
    return b.select(*KEY, pred.correlation_id(
        F.when(k % 2 == 0, F.concat(s, F.lit("\n"), k.cast("string"))), F.when(k % 3 == 0, k),
        F.when(k % 5 == 0, s),
    ).alias("task"))


@query
def stack_gate(spark, d):
    e = v.executions(spark, d)
    return e.select(*KEY, *[pred.stack_gate(m, "func").alias(f"stack_{m}") for m in ("off", "slow", "all")])


@query
def missing_stack_reason(spark, d):
    e = v.executions(spark, d)
    mode = F.element_at(F.array(F.lit("off"), F.lit("slow"), F.lit("all")), (F.col("gid") % 3 + 1).cast("int"))
    return e.select(*KEY, pred.missing_stack_reason(mode, "stack").alias("reason"))


@query
def evicted_flag(spark, d):
    e = v.executions(spark, d)
    kept = rank.retention_horizon(rank.retention_cap(e.select(*KEY, "start"), 2000))
    return kept.join(agg.capture_counters(e), CAPTURE).select(
        CAPTURE, "retained_from", "origin", pred.evicted_flag("retained_from", "origin").alias("evicted")
    )


@query
def drop_zero_tail(spark, d):
    e = v.executions(spark, d)
    zero = F.when(F.col("gid") % 2 == 0, 0).otherwise(F.col("dur"))
    return sq.drop_zero_tail(e.select(*KEY, "thread", zero.alias("dur")))


@query
def render_only(spark, d):
    return rng.render_only(v.executions(spark, d))


# Joins and lookups -------------------------------------------------------------------------------------------

@query
def interval_window(spark, d):
    whole = rng.interval_window(v.executions(spark, d), T0, T1).withColumn("case", F.lit("whole"))
    middle = rng.interval_window(v.executions(spark, d), T0, T1, 101, "by_order").withColumn("case", F.lit("capped"))
    first = rng.interval_window(v.executions_dense(spark, d), T0, T1, 101, "by_order")
    return whole.unionByName(middle).unionByName(first.withColumn("case", F.lit("dense")))


#: Arrivals of a slab in the stored captures of these queries.
STORE_SLAB = 1024


def _slab_store(spark, df):
    """``df`` as a store, written in two appends."""
    path = cap.scratch(spark, "slab-store")
    middle = df.agg(F.percentile_approx(SEQ, 0.5)).first()[0]
    for part in (df.filter(F.col(SEQ) <= middle), df.filter(F.col(SEQ) > middle)):
        store.append_store(part, path, STORE_SLAB)
    return path, store.read_rows(spark, path), store.read_index(spark, path)


@query
def stored_window(spark, d):
    """Capped windows of a capture in order and of one with overlaps, by way of the slab index."""
    out = None
    for case, df in (("capped", v.executions(spark, d)), ("dense", v.executions_dense(spark, d))):
        _, rows, index = _slab_store(spark, df)
        one = store.stored_window(rows, index, T0, T1, 101).withColumn("case", F.lit(case))
        out = one if out is None else out.unionByName(one)
    return out


@query
def stored_tail(spark, d):
    _, rows, index = _slab_store(spark, v.executions(spark, d))
    return store.stored_tail(rows, index, T0, T1, 50).withColumn("case", F.lit("capped")).unionByName(
        store.stored_tail(rows, index, T0, T1, 50, 5000).withColumn("case", F.lit("next")))


@query
def stored_retention(spark, d):
    """Retention from the index, before folders are deleted and after."""
    path, rows, index = _slab_store(spark, v.executions(spark, d))
    before = store.stored_retention(rows, index, 1500).withColumn("case", F.lit("before"))
    before = cap.stored(before, "horizon")
    store.evict(spark, path, 1500)
    after = store.stored_retention(store.read_rows(spark, path), store.read_index(spark, path), 1500)
    return before.unionByName(after.withColumn("case", F.lit("after")))


@query
def stored_recent_activity(spark, d):
    """The last ten hours of each capture, one of which ended a year before the others."""
    e = v.executions_dense(spark, d)
    old = F.when(F.col(CAPTURE) == "cap-c", 365 * DAY).otherwise(0)
    shifted = e.withColumns({"start": F.col("start") - old, "end": F.col("end") - old})
    _, rows, index = _slab_store(spark, shifted)
    recent = store.stored_recent(rows, index, 10 * HOUR)
    return agg.recent_activity(recent, 10 * HOUR).filter("activity > 0")


@query
def interval_join(spark, d):
    return mat.interval_join(v.viewports(spark, d), v.executions_dense(spark, d)).select(
        CAPTURE, "probe_id", SEQ, "start", "dur"
    )


@query
def interval_join_capped(spark, d):
    """At most 20 spans of each viewport: the middle ones where a capture is in order, and the first where it is not."""
    few = mat.interval_join_capped(v.viewports(spark, d), v.executions(spark, d), 20, slab_rows=256)
    many = mat.interval_join_capped(v.viewports(spark, d), v.executions_dense(spark, d), 20, slab_rows=256)
    both = few.withColumn("case", F.lit("plain")).unionByName(many.withColumn("case", F.lit("dense")))
    return both.select(CAPTURE, "probe_id", SEQ, "start", "dur", "capped", "case")


@query
def samples_ranges(spark, d):
    """The samples of every viewport and one more on either side."""
    return rng.samples_ranges(v.sys_samples(spark, d), v.viewports(spark, d))


@query
def gc_window(spark, d):
    return rng.gc_window(v.gc_events(spark, d), T0, T1)


@query
def gc_tail(spark, d):
    return rng.gc_tail(v.gc_events(spark, d), T0, T1)


@query
def tail_follow(spark, d):
    e = v.executions(spark, d)
    return rng.tail_follow(e, T0, T1).withColumn("case", F.lit("whole")).unionByName(
        rng.tail_follow(e, T0, T1, cap=50).withColumn("case", F.lit("capped"))
    ).unionByName(rng.tail_follow(e, T0, T1, cap=50, after_seq=5000).withColumn("case", F.lit("next")))


@query
def tail_or_window(spark, d):
    """The first half of the arrivals has been seen."""
    e = v.executions(spark, d)
    seen = rng.tail_frontier(rng.tail_follow(e.filter(F.col(SEQ) < 5000), T0, T1)).filter(F.col(CAPTURE) != "cap-c")
    return rng.tail_or_window(e, seen, T0, T1)


@query
def detail_nearest(spark, d):
    return mat.detail_nearest(v.probes(spark, d), v.executions(spark, d)).select(
        CAPTURE, "probe_id", "hit_seq", "func", "task", "stack"
    )


@query
def samples_range(spark, d):
    return rng.samples_range(v.sys_samples(spark, d), T0, T1)


@query
def hold_asof(spark, d):
    return mat.hold_asof(
        v.probes(spark, d).select(CAPTURE, "probe_id", "t"), v.sys_samples(spark, d), ["lag_ms_s", "cpu_ms_s"]
    )


@query
def stab_lookup(spark, d):
    p = v.probes(spark, d).select(CAPTURE, "probe_id", "gid", "t")
    return mat.stab_lookup(p, v.executions_dense(spark, d), 60 * SECOND)


@query
def gc_stab(spark, d):
    p = v.probes(spark, d).select(CAPTURE, "probe_id", "t")
    return mat.gc_stab(p, v.gc_events(spark, d), 100 * SECOND)


@query
def intern_dictionary(spark, d):
    e = v.executions(spark, d)
    whole = dic.intern_dictionary(e, "func").withColumn("case", F.lit("func"))
    return whole.unionByName(dic.intern_dictionary(e, "task").withColumn("case", F.lit("task")))


@query
def resolve_dictionary(spark, d):
    e = v.executions(spark, d)
    pool = dic.intern_dictionary(e, "func")
    coded = dic.encode(e.select(*KEY, "func"), "func", pool)
    return dic.resolve_dictionary(coded.select(*KEY, "value_id"), pool)


# Aggregations ------------------------------------------------------------------------------------------------

@query
def track_runs(spark, d):
    e = v.executions(spark, d)
    return agg.track_runs(rng.interval_window(e, T0, T1, columns=(*rng.RENDER_COLUMNS, "name", "is_hub")))


@query
def track_max(spark, d):
    return agg.track_max(v.executions(spark, d))


@query
def window_bounds(spark, d):
    e = v.executions_dense(spark, d)
    near = rng.window_bounds(rng.interval_window(e, T0, T1), e).withColumn("case", F.lit("window"))
    return near.unionByName(
        rng.window_bounds(rng.interval_window(e, 400 * DAY, 401 * DAY), e).withColumn("case", F.lit("empty")))


@query
def duration_stats(spark, d):
    e = v.executions(spark, d)
    both = agg.duration_stats(e).withColumn("case", F.lit("whole")).unionByName(
        agg.duration_stats(e, T0, T0 + DAY).withColumn("case", F.lit("day"))
    ).unionByName(agg.duration_stats(e, 400 * DAY, 401 * DAY).withColumn("case", F.lit("empty")))
    return both.select(CAPTURE, "case", *[F.round(q, 6).alias(q) for q in agg.QUANTILES])


@query
def sketched_stats(spark, d):
    """Quantiles and distinct tracks of a range of days from a table of hourly sketches, and whether they are close enough:
    ranks within 2 %, distinct counts within 5 %."""
    e = v.executions(spark, d)
    table = cap.stored(sk.sketch_table(e, HOUR), "sketches")
    got = sk.sketched_stats(sk.merge_sketches(table, T0 // HOUR, T1 // HOUR - 1), agg.QUANTILES)
    app = e.filter(~F.col("is_hub") & (F.col("start") >= T0) & (F.col("start") < T1))
    below = lambda q, at: F.count_if(F.col("dur") < F.col(q) if at else F.col("dur") <= F.col(q)) / F.count(F.lit(1))
    close = [((below(q, True) <= p + 0.02) & (below(q, False) >= p - 0.02)).alias(f"{q}_close") for q, p in agg.QUANTILES.items()]
    near = F.abs(F.first("tracks") - F.count_distinct("gid")) <= 0.05 * F.count_distinct("gid") + 1
    return app.join(got, CAPTURE).groupBy(CAPTURE).agg(F.first("rows").alias("rows"), *close, near.alias("tracks_close"))


@query
def slow_band_counts(spark, d):
    e = v.executions(spark, d)
    out = None
    for tier in ("all", "long", "blocked"):
        one = agg.slow_band_counts(e, tier).withColumn("tier", F.lit(tier))
        out = one if out is None else out.unionByName(one)
    return out


@query
def summary_scalars(spark, d):
    return agg.summary_scalars(v.executions(spark, d))


@query
def top_tracks(spark, d):
    return agg.top_tracks(v.executions(spark, d))


@query
def hot_functions(spark, d):
    return agg.hot_functions(v.executions(spark, d))


@query
def gc_totals(spark, d):
    gc = v.gc_events(spark, d)
    some = agg.gc_totals(gc.filter(F.col(CAPTURE) == "cap-a"), v.executions(spark, d)).withColumn("case", F.lit("some"))
    return some.unionByName(agg.gc_totals(gc).withColumn("case", F.lit("all")))


@query
def gc_by_generation(spark, d):
    return agg.gc_by_generation(v.gc_events(spark, d))


@query
def capture_counters(spark, d):
    return agg.capture_counters(v.executions(spark, d))


@query
def event_rate(spark, d):
    r = agg.event_rate(agg.capture_counters(v.executions(spark, d)))
    return r.withColumn("per_second", F.round("per_second", 9))


@query
def cpu_busy(spark, d):
    return agg.cpu_busy(v.executions_dense(spark, d), 6 * HOUR).select(CAPTURE, F.round("busy", 6).alias("busy"))


@query
def recent_activity(spark, d):
    e = v.executions_dense(spark, d)
    out = agg.recent_activity(e, None).withColumn("case", F.lit("whole"))
    for hours in (1, 10, 60):
        out = out.unionByName(agg.recent_activity(e, hours * HOUR).withColumn("case", F.lit(f"{hours}h")))
    return out


@query
def analyze_report(spark, d):
    r = _report(spark, d)
    return r.select(
        CAPTURE, "pid", "epochMs", "totalExecutions", "spanNs", "greenlets", "hubRunNs", "nonHubRunNs", "p50Ns",
        "p95Ns", "p99Ns", "longCount", "blockedCount", "gcCount", "gcTotalNs", "longMs", "blockedMs",
        F.array_join(F.transform("gcByGen", lambda g: F.concat_ws(":", g["gen"], g["count"], g["totalNs"])), ",")
        .alias("gens"),
        F.array_join(F.transform("slowest", lambda s: F.concat_ws(
            ":", s["start"], s["dur"], s["level"], s["gid"], s["name"], s["func"])), ",")
        .alias("slowest"),
        F.array_join(F.transform("topGreenlets", lambda t: F.concat_ws(
            ":", t["gid"], t["name"], t["runNs"], t["executions"])), ",")
        .alias("tracks"),
        F.array_join(F.transform("topFuncs", lambda t: F.concat_ws(
            "=", t["func"], t["totalNs"], t["count"], t["maxNs"])), ",")
        .alias("funcs"),
    )


# Sequences and series ----------------------------------------------------------------------------------------

@query
def fold_switches(spark, d):
    return sq.fold_switches(v.switches(spark, d)).drop("end")


@query
def pair_gc(spark, d):
    return sq.pair_gc(v.gc_phases(spark, d))


@query
def sortedness(spark, d):
    return sq.sortedness(v.executions(spark, d)).withColumn("case", F.lit("plain")).unionByName(
        sq.sortedness(v.executions_dense(spark, d)).withColumn("case", F.lit("dense"))
    )


@query
def counter_rates(spark, d):
    return sq.counter_rates(v.proc_counters(spark, d)).select(
        *KEY, F.round("lag_ms_s", 6).alias("lag_ms_s"), F.round("cpu_ms_s", 6).alias("cpu_ms_s")
    )


@query
def delta_encode(spark, d):
    return sq.delta_encode(v.switches_fast(spark, d))


@query
def delta_decode(spark, d):
    return sq.delta_decode(sq.delta_encode(v.switches_fast(spark, d)))


@query
def busy_bins(spark, d):
    return ser.busy_bins(v.executions_dense(spark, d), HOUR)


def _utilization(spark, d):
    bins = ser.busy_bins(v.executions_dense(spark, d), HOUR // 4)
    return ser.utilization_series(bins, HOUR // 4, DAY, PX, COLUMNS)


def _hub_only(df):
    """One capture more, in which nothing but the hub runs."""
    hub = df.filter("is_hub AND capture_id = 'cap-a'").withColumn(CAPTURE, F.lit("cap-hub"))
    return df.unionByName(hub)


@query
def utilization_series(spark, d):
    e = _hub_only(v.executions_dense(spark, d))
    bins = ser.busy_bins(e, HOUR // 4)
    return ser.utilization_series(bins, HOUR // 4, DAY, PX, COLUMNS, e).select(
        CAPTURE, "x", F.round("busy", 6).alias("busy"))


@query
def smooth_series(spark, d):
    s = ser.smooth_series(_utilization(spark, d), COLUMNS, HOUR // 4, PX)
    return s.select(CAPTURE, "x", F.round("busy", 6).alias("busy"))


@query
def utilization_with_tail(spark, d):
    e = v.executions_dense(spark, d)
    s = ser.utilization_with_tail(_utilization(spark, d), v.sys_samples(spark, d), e, DAY, PX, COLUMNS)
    return s.select(CAPTURE, "x", F.round("busy", 6).alias("busy"))


@query
def utilization_without_rows(spark, d):
    """One of the captures has samples and no intervals: all of its columns are held."""
    e = v.executions_dense(spark, d).filter(F.col(CAPTURE) != "cap-c")
    bins, samples = ser.busy_bins(e, HOUR // 4), v.sys_samples(spark, d)
    series = ser.utilization_series(bins, HOUR // 4, DAY, PX, COLUMNS, samples)
    s = ser.utilization_with_tail(series, samples, e, DAY, PX, COLUMNS)
    return s.select(CAPTURE, "x", F.round("busy", 6).alias("busy"))


@query
def lag_series(spark, d):
    few = v.sys_samples(spark, d).filter(F.col(CAPTURE) != "cap-c")
    return ser.lag_series(few, DAY, PX, COLUMNS, v.executions(spark, d))


@query
def stall_intervals(spark, d):
    e = v.executions(spark, d)
    arrivals = e.select(CAPTURE, F.col("end").alias("t"), F.octet_length("func").alias("bytes"))
    return ser.stall_intervals(arrivals, HOUR // 4)


@query
def arrival_lag(spark, d):
    c = agg.capture_counters(v.executions(spark, d))
    epoch = F.when(F.col(CAPTURE) != "cap-c", v.EPOCH_MS)
    lag = pred.arrival_lag(F.lit(NOW_MS), epoch, "span", F.lit(True), F.lit(False))
    return c.select(CAPTURE, F.round(lag, 6).alias("lag_ms"), pred.arrival_lag_tier(lag).alias("tier"))


@query
def health_status(spark, d):
    e = v.executions(spark, d)
    c = agg.capture_counters(e)
    return rep.health_status(c, True, F.col("span") < 30 * DAY - HOUR // 12)


# Ranking -----------------------------------------------------------------------------------------------------

@query
def slowlog(spark, d):
    e = v.executions(spark, d)
    out = None
    for tier, sort, limit in (("all", "dur", 500), ("all", "start", 500), ("long", "start", 100),
                              ("blocked", "dur", 100)):
        one = rank.slowlog(e, limit, tier, sort).withColumn("case", F.lit(f"{tier}-{sort}"))
        out = one if out is None else out.unionByName(one)
    return out


def _order(spark, d, mode="activity"):
    return rank.track_order(v.executions(spark, d), mode)


@query
def track_order(spark, d):
    out = None
    for mode in ("activity", "ident"):
        one = _order(spark, d, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out.drop("activity")


@query
def recent_track_order(spark, d):
    """The display order by recent run time, with days as milliseconds so that the windows hold rows."""
    e = v.executions_dense(spark, d)
    ms = lambda c: F.floor(F.col(c) / 86_400).cast("long").alias(c)
    fast = e.select(*[ms(c) if c in ("start", "dur") else F.col(c) for c in e.columns if c != "end"])
    fast = fast.withColumn("end", F.col("start") + F.col("dur"))
    out = None
    for mode in ("recent1", "recent10", "recent60"):
        one = rank.track_order(fast, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query
def stable_track_order(spark, d):
    e = v.executions(spark, d)
    placed = rank.track_order(e.filter(F.col("start") < T0 // 5)).select(CAPTURE, "gid", "row")
    return rank.stable_track_order(placed, e)


@query
def fold_overflow(spark, d):
    return rank.fold_overflow(v.executions(spark, d), 25)


@query
def page_tracks(spark, d):
    return rank.page_tracks(_order(spark, d), v.executions(spark, d), 2, 29)


@query
def retention_cap(spark, d):
    return rank.retention_cap(rng.render_only(v.executions(spark, d)), 2000)


@query
def cap_frames(spark, d):
    e = v.executions(spark, d)
    return e.select(*KEY, stacks.join_stack(stacks.cap_frames(stacks.split_stack("stack"), 2)).alias("stack"))


@query
def append_batches(spark, d):
    parts = v.batch_parts(v.executions(spark, d).select(*KEY, "gid", "start", "dur", "name"))
    return cap.append_batches(*parts)


# Scalars -----------------------------------------------------------------------------------------------------

@query
def split_stack(spark, d):
    frames = stacks.split_stack("stack")
    return v.executions(spark, d).select(
        *KEY, F.size(frames).alias("frames"), F.coalesce(F.get(frames, F.lit(0)), F.lit("")).alias("leaf"),
        F.coalesce(F.get(frames, F.lit(2)), F.lit("")).alias("root"),
    )


@query
def join_stack(spark, d):
    frames = stacks.split_stack("stack")
    back = stacks.join_stack(F.reverse(frames))
    return v.executions(spark, d).select(*KEY, stacks.join_stack(frames).alias("same"), back.alias("root_first"))


@query
def parse_frame(spark, d):
    e = v.executions(spark, d)
    one = F.explode(F.array(
        "func", F.substring_index("stack", stacks.STACK_SEPARATOR, 1), F.lit("/usr/lib/gevent/hub.py:a:b:7"),
        F.concat(F.lit("/srv/greenlets/"), F.col("task"), F.lit(":run")), F.col("name"),
    )).alias("frame")
    return e.select(*KEY, one).withColumn("p", stacks.parse_frame("frame")).select(*KEY, "frame", "p.*")


@query
def parse_frames(spark, d):
    """Every frame of every stack."""
    frames = stacks.parse_frames(stacks.split_stack("stack"))
    return v.executions(spark, d).select(*KEY, F.posexplode(frames).alias("at", "p")).select(*KEY, "at", "p.*")


@query
def leaf_function(spark, d):
    frames = F.concat(F.array(F.lit("<string>:m:1"), F.lit("/usr/lib/gevent/hub.py:switch:1")),
                      stacks.split_stack("stack"))
    return v.executions(spark, d).select(*KEY, stacks.leaf_function(frames).alias("leaf"))


@query
def clean_stack(spark, d):
    frames = F.concat(F.array(F.lit("<string>:m:1"), F.lit("/opt/tracer.py:hook:9")), stacks.split_stack("stack"))
    clean = stacks.clean_stack(frames, "/tracer.py")
    return v.executions(spark, d).select(*KEY, stacks.join_stack(clean).alias("stack"))


@query
def short_stack(spark, d):
    s = stacks.short_stack("stack", "func", 1)
    return v.executions(spark, d).select(
        *KEY, stacks.join_stack(s["frames"]).alias("shown"), s["hidden"].alias("hidden")
    )


@query
def explode_stacks(spark, d):
    e = v.executions(spark, d).select(*KEY, F.posexplode(stacks.shown_frames("stack", "func")).alias("pos", "frame"))
    return e.withColumn("leaf", F.col("pos") == 0)


@query
def fmt_ns(spark, d):
    e = v.executions(spark, d)
    return e.select(*KEY, fmt.fmt_ns("dur").alias("dur"), fmt.fmt_ns(int_div("dur", 1000)).alias("small"),
                    fmt.fmt_ns("start").alias("start"))


@query
def format_time(spark, d):
    e = v.executions(spark, d)
    return e.select(
        *KEY, fmt.format_time(F.col("dur") / 1e6).alias("dur"), fmt.format_time(F.col("start") / 1e6).alias("start"),
        fmt.format_time(-F.col("dur") / 1e9).alias("negative"), fmt.format_time(F.col("dur") / 1e12).alias("tiny"),
    )


@query
def format_time_precise(spark, d):
    e = v.executions(spark, d)
    return e.select(*KEY, fmt.format_time_precise(F.col("dur") / 1e6).alias("dur"),
                    fmt.format_time_precise(F.col("dur") / 1e9).alias("small"))


@query
def human_bytes(spark, d):
    return v.executions(spark, d).select(
        *KEY, fmt.human_bytes("dur").alias("size"), fmt.human_bytes("start").alias("large"),
        fmt.human_bytes(F.col("gid")).alias("small"),
    )


@query
def format_bytes(spark, d):
    return v.executions(spark, d).select(
        *KEY, fmt.format_bytes("dur").alias("size"), fmt.format_bytes("start").alias("large"),
        fmt.format_bytes(F.col("gid")).alias("small"),
    )


@query
def format_rate(spark, d):
    b = v._base(spark, d)
    return b.select(*KEY, fmt.format_rate(F.col("value")).alias("rate"),
                    fmt.format_rate(F.col("value") * 1000.0).alias("high"))


@query
def pct(spark, d):
    e = v.executions(spark, d)
    return e.select(*KEY, fmt.pct("dur", F.col("gid") * 1_000_000).alias("share"))


@query
def axis_clock(spark, d):
    e = v.executions(spark, d)
    t = F.col("start") / 1e6
    epoch = F.when(F.col("gid") % 4 > 0, F.lit(v.EPOCH_MS).cast("long"))
    return e.select(*KEY, fmt.axis_clock(t, epoch).alias("utc"),
                    fmt.axis_clock(t, epoch, "local", "Asia/Tokyo").alias("tokyo"))


@query
def nice_step(spark, d):
    return v._base(spark, d).select(*KEY, F.round(fmt.nice_step(F.col("value") + 0.0137), 9).alias("step"))


@query
def axis_ticks(spark, d):
    c = agg.capture_counters(v.executions(spark, d))
    views = c.select(
        CAPTURE, (F.col("origin") / 1e6).alias("t0_ms"), (F.lit(1000.0) / (F.col("span") / 1e6)).alias("px_per_ms"),
        F.lit(v.EPOCH_MS + 12_345).alias("epoch_ms"),
    )
    both = rep.axis_ticks(views).withColumn("mode", F.lit("relative")).unionByName(
        rep.axis_ticks(views, clock=True).withColumn("mode", F.lit("clock"))
    )
    return both.select(CAPTURE, "mode", "kind", "step", F.round("t_ms", 3).alias("t_ms"))


@query
def cpu_tier(spark, d):
    b = v._base(spark, d)
    return b.select(*KEY, pred.cpu_tier(F.least(F.lit(1000), F.col("k") * 10) / 1000).alias("tier"))


@query
def lag_tier(spark, d):
    return v._base(spark, d).select(*KEY, pred.lag_tier("value").alias("tier"))


@query
def parse_proc_status(spark, d):
    b = v._base(spark, d)
    k = F.col("k").cast("string")
    text = F.concat(
        F.lit("Name:\t"), F.col("event_type"), F.lit("\nState:\tS (sleeping)\nVmPeak:\t  "),
        (F.col("k") * 1024).cast("string"), F.lit(" kB\nVmRSS:\t"), F.when(F.col("k") % 4 == 0, "x").otherwise(k),
        F.lit(" kB\nThreads:\t"), k, F.lit("\nvoluntary_ctxt_switches:\t"), F.col("gid").cast("string"),
        F.when(F.col("k") % 2 == 0, "\nnonvoluntary_ctxt_switches:\tmany\n").otherwise("\n"),
    )
    return b.select(*KEY, procfs.parse_proc_status(text).alias("p")).select(*KEY, "p.*")


@query
def parse_schedstat(spark, d):
    b = v._base(spark, d)
    text = F.concat_ws(" ", F.col("start").cast("string"),
                       F.when(F.col("k") % 3 == 0, "none").otherwise(F.col("k").cast("string")), F.lit("17\n"))
    p = procfs.parse_schedstat(text)
    return b.select(*KEY, p["on_cpu_ns"].alias("on_cpu_ns"), p["runq_ns"].alias("runq_ns"))


@query
def parse_cpu_stat(spark, d):
    b = v._base(spark, d)
    text = F.concat(F.lit("usage_usec 9\nnr_periods "), F.col("k").cast("string"), F.lit("\nnr_throttled "),
                    F.when(F.col("k") % 5 == 0, "?").otherwise(F.col("gid").cast("string")),
                    F.when(F.col("k") % 2 == 0, "\nthrottled_usec 123\n").otherwise("\n"))
    return b.select(*KEY, procfs.parse_cpu_stat(text).alias("p")).select(*KEY, "p.*")


@query
def parse_psi(spark, d):
    b = v._base(spark, d)
    text = F.concat(F.lit("some avg10="), F.format_string("%.2f", F.col("k") / 4.0),
                    F.lit(" avg60=1.00 avg300=0.50 total=77\nfull avg10=9.00 avg60=0.00\n"))
    blank = F.when(F.col("k") % 6 == 0, "full avg10=9.00\n").otherwise(text)
    return b.select(*KEY, procfs.parse_psi(blank).alias("avg10"))


@query
def parse_cpu_max(spark, d):
    b = v._base(spark, d)
    text = F.when(F.col("k") % 4 == 0, "max 100000").when(
        F.col("k") % 4 == 1, F.concat((F.col("k") * 1000).cast("string"), F.lit(" 50000"))
    ).otherwise((F.col("k") * 1000).cast("string"))
    return b.select(*KEY, procfs.parse_cpu_max(text).alias("cores"))


# Streaming ---------------------------------------------------------------------------------------------------

ONCE = {"availableNow": True}


def _arriving(spark, df, start, parts: int = 2):
    """Append ``df`` to a new folder in ``parts`` steps of arrival, running the stream to its end after each."""
    path, out = cap.scratch(spark, "arrivals"), cap.scratch(spark, "out")
    first, last = df.agg(F.min(SEQ), F.max(SEQ)).first()
    width = (last - first) // parts + 1
    for i in range(parts):
        low = first + i * width
        df.filter((F.col(SEQ) >= low) & (F.col(SEQ) < low + width)).write.mode("append").parquet(path)
        start(path, out).awaitTermination()
    return out


@query
def stream_switches(spark, d):
    out = _arriving(spark, v.switches(spark, d), lambda path, out: live.parquet_append_sink(
        live.stream_switches(spark, path), f"{out}/rows", f"{out}/offsets", ONCE))
    return spark.read.schema(schema.SWITCHES).parquet(f"{out}/rows")


def _rows(df):
    return df.select(*KEY, "gid", "start", "dur", "name", "func", "task", "stack", "is_hub")


@query
def parquet_append_sink(spark, d):
    out = _arriving(spark, v.executions(spark, d).drop("thread"), lambda path, out: live.parquet_append_sink(
        live.stream_executions(spark, path), f"{out}/rows", f"{out}/offsets", ONCE))
    return _rows(spark.read.schema(schema.EXECUTIONS).parquet(f"{out}/rows"))


@query
def micro_batch_flush(spark, d):
    out = _arriving(spark, v.executions(spark, d).drop("thread"), lambda path, out: live.parquet_append_sink(
        live.stream_executions(spark, path, max_files=1), f"{out}/rows", f"{out}/offsets", ONCE))
    return _rows(spark.read.schema(schema.EXECUTIONS).parquet(f"{out}/rows"))


@query
def stream_tail(spark, d):
    out = _arriving(spark, v.executions(spark, d).drop("thread"), lambda path, out: live.stream_tail(
        spark, path, f"{out}/rows", f"{out}/offsets", T0, ONCE))
    return _rows(spark.read.schema(schema.EXECUTIONS).parquet(f"{out}/rows"))


@query
def stream_retention(spark, d):
    out = _arriving(spark, v.executions(spark, d).drop("thread"), lambda path, out: live.parquet_append_sink(
        live.stream_executions(spark, path), f"{out}/rows", f"{out}/offsets", ONCE))
    stored = spark.read.schema(schema.EXECUTIONS).parquet(f"{out}/rows")
    return rank.retention_horizon(rank.retention_cap(stored, 1500))


@query
def fold_switches_stream(spark, d):
    out = _arriving(spark, v.switches(spark, d), lambda path, out: live.fold_switches_stream(
        live.stream_switches(spark, path), out, f"{out}/offsets", ONCE))
    return spark.read.parquet(f"{out}/rows").drop("end", live.BATCH)


@query
def live_aggregates(spark, d):
    out = _arriving(spark, v.executions(spark, d).drop("thread"), lambda path, out: live.live_aggregates(
        live.stream_executions(spark, path), out, f"{out}/offsets", ONCE))
    return live.latest(spark, f"{out}/head").drop("changed")


@query
def live_head(spark, d):
    """The second arrival brings rows of one capture only."""
    e = v.executions(spark, d).drop("thread")
    path, out = cap.scratch(spark, "arrivals"), cap.scratch(spark, "out")
    for part in (e.filter(F.col(CAPTURE) != "cap-b"), e.filter(F.col(CAPTURE) == "cap-b")):
        part.write.mode("append").parquet(path)
        live.live_aggregates(live.stream_executions(spark, path), out, f"{out}/offsets", ONCE).awaitTermination()
    return live.live_head(live.latest(spark, f"{out}/head"), rank.retention_horizon(rank.retention_cap(e, 1500)))


@query
def late_rows(spark, d):
    out = _arriving(spark, v.executions_dense(spark, d).drop("thread"), lambda path, out: live.mark_late_stream(
        live.stream_executions(spark, path), out, f"{out}/offsets", ONCE))
    return spark.read.parquet(f"{out}/rows").select(*KEY, "start", "dur", "late")


def _out_of_order(spark, d):
    """The last third of one capture's arrivals starts three days early."""
    e = v.executions(spark, d).drop("thread", "end")
    first, last = e.agg(F.min(SEQ), F.max(SEQ)).first()
    early = (F.col(CAPTURE) == "cap-b") & (F.col(SEQ) >= first + 2 * ((last - first) // 3 + 1))
    return e.withColumn("start", F.col("start") - F.when(early, 3 * DAY).otherwise(0))


@query
def stream_follow(spark, d):
    """What each of three batches sends to a follower: new rows, or a window anew."""
    out = _arriving(spark, _out_of_order(spark, d), lambda path, out: live.follow_stream(
        live.stream_executions(spark, path), out, f"{out}/offsets", T0, 28 * DAY, ONCE), parts=3)
    return spark.read.parquet(f"{out}/rows").select(*KEY, "start", "dur", "gid", "whole", F.col(live.BATCH).cast("long").alias("batch"))


@query
def follower_view(spark, d):
    """What the follower has drawn in the end."""
    out = _arriving(spark, _out_of_order(spark, d), lambda path, out: live.follow_stream(
        live.stream_executions(spark, path), out, f"{out}/offsets", T0, 28 * DAY, ONCE), parts=3)
    return live.follower_view(spark, out)


@query
def interval_counts(spark, d):
    """Hourly counts under a watermark of a day: rows of closed intervals are dropped and counted as such."""
    out = _arriving(spark, _out_of_order(spark, d), lambda path, out: live.count_intervals_stream(
        live.stream_executions(spark, path), out, f"{out}/offsets", DAY, HOUR, ONCE), parts=3)
    return live.interval_counts(spark, out, DAY, HOUR)


@query
def intern_stream(spark, d):
    """The dictionary after three batches."""
    out = _arriving(spark, v.executions(spark, d).drop("thread"), lambda path, out: live.intern_stream(
        live.stream_executions(spark, path), "func", out, f"{out}/offsets", ONCE), parts=3)
    return live.dictionary_of(spark, out)


@query
def stall_monitor(spark, d):
    """Every row arrives at once, so each capture is seen to stall after one interval."""
    path, out = cap.scratch(spark, "arrivals"), cap.scratch(spark, "out")
    arrivals = v.executions(spark, d).select(CAPTURE, F.octet_length("func").alias("bytes"))
    arrivals.write.parquet(path)
    # A session of its own, for the state store and few state partitions.
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", stall.ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    rows = own.readStream.schema(arrivals.schema).parquet(path)
    live_query = (
        stall.stall_monitor(rows, 1000).writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/offsets").outputMode("append")
        .trigger(processingTime="500 milliseconds").start()
    )
    captures, deadline = arrivals.select(CAPTURE).distinct().count(), time.monotonic() + 300
    try:
        while not live_query.awaitTermination(2):
            if time.monotonic() > deadline:
                raise TimeoutError("no stall was seen in 300 s")
            # One batch takes all files, so a capture's first stalled row comes after its last arrival.
            progress = live_query.lastProgress
            if progress is not None and progress.batchId > 0:
                seen = spark.read.schema(stall._OUT).parquet(f"{out}/rows").filter("stalled")
                if seen.select(CAPTURE).distinct().count() == captures:
                    break
    finally:
        live_query.stop()
    return spark.read.schema(stall._OUT).parquet(f"{out}/rows").groupBy(CAPTURE).agg(
        F.max("total").alias("total"), F.sum("new_rows").alias("new_rows"), F.bool_or("stalled").alias("stalled"),
        F.count_if(F.col("transition") == "stalled").alias("stalls"),
    )
