"""Small literal cases with hand-checked results."""

import pytest
from pyspark.sql import functions as F

from spanlens.functions import formats as fmt
from spanlens.functions import predicates as pred
from spanlens.functions import stacks
from spanlens.operators import aggregates as agg
from spanlens.operators import dictionary as dic
from spanlens.operators import matching as mat
from spanlens.operators import ranges as rng
from spanlens.operators import ranking as rank
from spanlens.operators import sequence as sq
from spanlens.operators import series as ser
from spanlens.plans import report as rep

MS = 1_000_000


def spans(spark, rows):
    """Rows ``(gid, start ms, dur ms[, name])`` by arrival."""
    data = [
        ("c", i, r[0], int(r[1] * MS), int(r[2] * MS), int((r[1] + r[2]) * MS),
         r[3] if len(r) > 3 else f"Greenlet-{r[0]}", f"app.py:work_{r[0]}:1", "", "")
        for i, r in enumerate(rows)
    ]
    df = spark.createDataFrame(data, "capture_id string, seq long, gid long, start long, dur long, end long, "
                                     "name string, func string, task string, stack string")
    return df.withColumn("is_hub", pred.is_hub("name"))


def pauses(spark, rows):
    return spark.createDataFrame([("c", i, int(s * MS), int(d * MS), g, 0) for i, (s, d, g) in enumerate(rows)],
                                 "capture_id string, seq long, start long, dur long, generation long, collected long")


def gids(df):
    return sorted(r.gid for r in df.collect())


def test_counters(spark):
    r = agg.capture_counters(spans(spark, [(1, 5, 10), (2, 20, 5)])).first()
    assert (r.total, r.origin, r.span) == (2, 5 * MS, 25 * MS)


@pytest.mark.parametrize("rows, t0, t1, want", [
    ([(2, 10, 5), (1, 0, 100)], 12, 14, [1, 2]),
    ([(1, 0, 5), (2, 3, 100)], 4, 4.5, [1, 2]),
    ([(1, 0, 10), (3, 18, 5), (2, 50, 10)], 20, 40, [3]),
])
def test_window(spark, rows, t0, t1, want):
    out = rng.interval_window(spans(spark, rows), int(t0 * MS), int(t1 * MS))
    assert gids(out) == want and not any(r.capped for r in out.collect())


def test_window_cap_keeps_the_middle(spark):
    rows = [(i, i * 10, 5) for i in range(5)]
    out = rng.interval_window(spans(spark, rows), 0, 100 * MS, 2, "by_order").collect()
    assert sorted(r.gid for r in out) == [1, 2] and all(r.capped for r in out)
    messy = rng.interval_window(spans(spark, rows[::-1]), 0, 100 * MS, 2, "by_order")
    assert gids(messy) == [3, 4]
    assert gids(rng.interval_window(spans(spark, rows), 0, 100 * MS, 2, "first")) == [0, 1]
    with pytest.raises(ValueError, match="keep"):
        rng.interval_window(spans(spark, rows), 0, 100 * MS, 2)


@pytest.mark.parametrize("cap", [1, 2, 3, 10])
def test_pages_of_an_unsorted_capture_lose_nothing(spark, cap):
    df, seen, last = spans(spark, [(1, 100, 1), (2, 500, 1), (3, 200, 1), (4, 300, 1), (5, 50, 1)]), [], -1
    for _ in range(6):
        page = rng.tail_follow(df, 0, 1000 * MS, cap, last)
        seen += gids(page)
        edge = rng.tail_frontier(page).first()
        if not edge.more:
            break
        last = edge.after_seq
    assert sorted(seen) == [1, 2, 3, 4, 5]


def test_a_broken_order_brings_the_whole_window(spark):
    df = spans(spark, [(1, 100, 1), (2, 500, 1), (3, 200, 1)])
    front = rng.tail_frontier(rng.tail_follow(df.filter("seq < 2"), 0, 1000 * MS))
    assert gids(rng.tail_or_window(df, front, 0, 1000 * MS)) == [1, 2, 3]
    more = spans(spark, [(1, 100, 1), (2, 500, 1), (3, 600, 1)])
    assert gids(rng.tail_or_window(more, front, 0, 1000 * MS)) == [3]


def test_open_ended_bounds(spark):
    assert gids(rng.interval_window(spans(spark, [(1, 0, 5)]), 0, (1 << 64) - 1)) == [1]


def test_tail(spark):
    out = rng.tail_follow(spans(spark, [(1, 0, 100), (2, 10, 5), (3, 30, 5), (4, 45, 5)]), 10 * MS, 100 * MS)
    assert gids(out) == [3, 4]
    assert rng.window_bounds(out).first().max_start == 45 * MS
    gc = rng.gc_tail(pauses(spark, [(5, 1, 0), (60, 1, 2)]), 5 * MS, 100 * MS).collect()
    assert [r.generation for r in gc] == [2]


def test_gc_window(spark):
    got = rng.gc_window(pauses(spark, [(5, 1, 2), (500, 1, 0)]), 0, 50 * MS).collect()
    assert [r.generation for r in got] == [2]


def test_slowlog(spark):
    df = spans(spark, [(1, 0, 5), (2, 10, 25), (3, 50, 80), (9, 200, 90, "Hub")])
    n = agg.slow_band_counts(df).first()
    assert (n.total, n.long_total, n.blocked_total) == (2, 1, 1)
    first = rank.slowlog(df, 500, "all", "dur").orderBy("rank").first()
    assert (first.gid, first.level) == (3, 2)
    assert gids(rank.slowlog(df, 500, "blocked")) == [3]
    only = rank.slowlog(df, 500, "long").collect()
    assert [(r.gid, r.level) for r in only] == [(2, 1)]


def test_percentiles_leave_the_hub_out(spark):
    df = spans(spark, [(1, i * 20, 10) for i in range(100)] + [(9, 5000, 100_000, "Hub")])
    r = agg.duration_stats(df).first()
    assert (r.p50, r.p95, r.p99) == (10 * MS,) * 3
    rough = agg.duration_stats(df, approximate=True).first()
    assert rough.p99 == 10 * MS
    empty = agg.duration_stats(spans(spark, [(9, 0, 5, "Hub")])).first()
    assert (empty.p50, empty.p99) == (0.0, 0.0)


def test_summary_and_report(spark):
    df = spans(spark, [(1, 0, 25), (2, 30, 80), (1, 200, 1), (9, 0, 500, "Hub")])
    gc = pauses(spark, [(1, 2, 0), (5, 3, 2)])
    s = agg.summary_scalars(df).first()
    assert (s.tracks, s.hub_run, s.app_run, s.long_count, s.blocked_count) == (3, 500 * MS, 106 * MS, 2, 1)
    assert agg.top_tracks(df).orderBy("rank").first().gid == 9
    f = agg.hot_functions(df).orderBy("rank").first()
    assert (f.func, f.total) == ("app.py:work_2:1", 80 * MS)
    t = agg.gc_totals(gc).first()
    assert (t.pauses, t.total) == (2, 5 * MS)
    r = rep.analyze_report(df, gc)
    row = r.first()
    assert [g.gen for g in row.gcByGen] == [0, 2] and row.gcByGen[0].totalNs == 2 * MS
    assert (row.greenlets, row.spanNs, row.p50Ns) == (3, 500 * MS, 25 * MS)
    lines = [x.line for x in rep.report_text(r).orderBy("line_no").collect()]
    assert lines[1:3] == ["  process ?, stored in 0 B, starts at ?", "  4 intervals of 3 tracks in 500.0ms"]
    assert "  tracks: 106.0ms, 21.2% of the capture; hubs: 500.0ms" in lines
    assert "  1. 80.0ms !! app.py:work_2:1 in Greenlet-2" in lines
    assert "  generation 0: 1, 2.0ms" in lines
    assert "  1. Hub* #9: 500.0ms in 1" in lines
    assert "  1. app.py:work_2:1: 80.0ms in 1, at most 80.0ms" in lines


def test_report_without_pauses(spark):
    row = rep.analyze_report(spans(spark, [(9, 0, 5, "Hub")]), pauses(spark, [])).first()
    assert (row.gcCount, row.gcByGen, row.slowest, row.topFuncs, row.p99Ns) == (0, [], [], [], 0)


def test_fold_takes_stack_from_the_closing_switch(spark):
    rows = [("c", 0, 1, 100, 7, "Greenlet-7", "f", "t", ""), ("c", 1, 2, 110, 8, "Hub", "g", "", "x"),
            ("c", 2, 1, 150, 9, "Greenlet-9", "h", "", "s7"), ("c", 3, 1, 140, 7, "Greenlet-7", "f", "", "s9")]
    df = spark.createDataFrame(rows, "capture_id string, seq long, thread long, ts long, target long, "
                                     "label string, func string, task string, stack string")
    got = [(r.gid, r.start, r.dur, r.func, r.task, r.stack) for r in sq.fold_switches(df).orderBy("seq").collect()]
    assert got == [(7, 100, 50, "f", "t", "s7"), (9, 150, 0, "h", "", "s9")]


def test_delta_reset(spark):
    rows = [("c", 0, 1, 100), ("c", 1, 1, 100 + 2**25), ("c", 2, 1, 5), ("c", 3, 1, 6)]
    coded = sq.delta_encode(spark.createDataFrame(rows, "capture_id string, seq long, thread long, ts long"))
    assert [r.is_reset for r in coded.orderBy("seq").collect()] == [False, True, True, False]
    assert [r.ts for r in sq.delta_decode(coded).orderBy("seq").collect()] == [r[3] for r in rows]


def test_detail(spark):
    df = spans(spark, [(1, 10, 1), (1, 14, 1), (2, 12, 1)])
    asked = spark.createDataFrame(
        [("c", 1, 1, 12 * MS, 0), ("c", 2, 1, 17 * MS, 0), ("c", 3, 3, 12 * MS, 0), ("c", 4, 1, 20 * MS, 9 * MS)],
        "capture_id string, probe_id long, gid long, t long, dur long")
    got = {r.probe_id: r.hit_seq for r in mat.detail_nearest(asked, df).collect()}
    assert got == {1: 0, 2: None, 3: None, 4: 1}
    assert rng.detail_at(df, 1, 12 * MS, 0).first().func == "app.py:work_1:1"
    assert rng.detail_at(df, 5, 12 * MS, 0).first().func == ""


def test_samples_keep_one_on_each_side(spark):
    rows = [("c", i, t, float(i), 0.0) for i, t in enumerate([10, 20, 20, 30, 40, 50])]
    s = spark.createDataFrame(rows, "capture_id string, seq long, start long, lag_ms_s double, cpu_ms_s double")
    at = lambda a, b: sorted(r.seq for r in rng.samples_range(s, a, b).collect())
    assert at(25, 35) == [2, 3, 4]
    assert at(60, 70) == [5]
    assert at(0, 5) == [0]
    assert at(20, 50) == [0, 1, 2, 3, 4, 5]


def test_dictionary(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(["b", "", "a", "b"])],
                               "capture_id string, seq long, v string")
    pool = dic.intern_dictionary(df, "v")
    assert {r.value: r.id for r in pool.collect()} == {"": 0, "b": 1, "a": 2}
    many = spark.range(50).select(F.lit("c").alias("capture_id"), F.col("id").alias("seq"),
                                  F.concat(F.lit("s"), F.col("id")).alias("v"))
    small = dic.intern_dictionary(many, "v")
    back = dic.resolve_dictionary(dic.encode(many, "v", small).select("capture_id", "seq", "value_id"), small)
    assert [r.value for r in back.orderBy("seq").collect()] == [f"s{i}" for i in range(50)]
    odd = spark.createDataFrame([("c", 1, 77)], "capture_id string, seq long, value_id int")
    assert dic.undefined_ids(odd, small).count() == 1
    with pytest.raises(Exception, match="no text has the id 77"):
        dic.resolve_dictionary(odd, small).collect()


def test_render_columns(spark):
    rows = rng.render_only(spans(spark, [(1, 0, 10), (2, 5, 3)]))
    out = dic.render_columns(rows, 0).orderBy("seq").collect()
    assert [(r.start_ms, r.dur_ms, r.track_idx) for r in out] == [(0.0, 10.0, 0), (5.0, 3.0, 1)]
    head = spark.createDataFrame([("c", 2, 1)], "capture_id string, n long, n_tracks long")
    bad = dic.validate_render_columns(dic.render_columns(rows, 0), head).first()
    assert bad.problem == "track place 1 with 1 tracks"


def texts(spark, fn, values):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "i int, x double")
    return [r.t for r in df.orderBy("i").select(fn(F.col("x")).alias("t")).collect()]


def test_formats(spark):
    assert texts(spark, fmt.format_time, [0.0005, 0.05, 0.5, 5, 50, 1500, -5]) == [
        "500 ns", "50.0 µs", "500 µs", "5.00 ms", "50.0 ms", "1.50 s", "-5.00 ms"]
    assert texts(spark, fmt.format_time_precise, [0.001234, 1.234567, 1, 1500]) == [
        "1.234 µs", "1.234567 ms", "1 ms", "1.5 s"]
    as_long = lambda f: lambda c: f(c.cast("long"))
    sizes = [512, 1024, 1536, 20 << 20, 3 << 30]
    assert texts(spark, as_long(fmt.format_bytes), sizes) == ["512 B", "1.0 KB", "1.5 KB", "20 MB", "3.0 GB"]
    assert texts(spark, fmt.format_rate, [5, 42, 1500, 12000]) == ["5.0/s", "42/s", "1.5k/s", "12.0k/s"]
    assert texts(spark, as_long(fmt.fmt_ns), [7, 5_600, 3_400_000, 1_250_000_000]) == ["7ns", "5.6µs", "3.4ms", "1.25s"]
    assert texts(spark, as_long(fmt.human_bytes), [5, 2048, 5 << 40]) == ["5 B", "2.0 KB", "5120.0 GB"]


def test_stacks(spark):
    frames = ["<string>:x:1", "/opt/hook.py:cb:3", "/usr/lib/gevent/hub.py:switch:9", "/srv/a.py:C.run:12"]
    df = spark.createDataFrame([(frames, [])], "f array<string>, none array<string>")
    r = df.select(
        stacks.leaf_function("f", "/hook.py").alias("leaf"), stacks.leaf_function("none").alias("empty"),
        stacks.clean_stack("f", "/hook.py").alias("clean"), stacks.parse_frame(F.lit("/srv/a.py:C:run:12")).alias("p"),
    ).first()
    assert (r.leaf, r.empty, r.clean) == ("a.py:C.run:12", "", frames[2:])
    assert tuple(r.p) == ("/srv/a.py", "a.py", "C:run", "12", False)


def test_deep_stacks_are_kept_whole(spark):
    frames = [f"/usr/lib/gevent/hub.py:f{i}:1" for i in range(40)] + ["/srv/a.py:run:1"]
    df = spark.createDataFrame([(frames,)], "f array<string>")
    r = df.select(stacks.leaf_function("f").alias("leaf"), stacks.clean_stack("f").alias("clean")).first()
    assert r.leaf == "a.py:run:1" and r.clean == frames


def test_series_of_any_width(spark):
    bins = spark.createDataFrame([("c", 0, 5)], "capture_id string, bin long, busy_ns long")
    wide = ser.utilization_series(bins, 10, 0, 1, 200_000)
    assert wide.count() == 200_000 and wide.filter("busy > 0").count() == 10
    rows = spark.range(300).selectExpr("'c' AS capture_id", "id AS x", "CAST(id AS DOUBLE) AS busy")
    old, ser.BIN_SLAB = ser.BIN_SLAB, 16
    try:
        got = {r.x: r.busy for r in ser.smooth_series(rows, 1000, 1, 2).collect()}
    finally:
        ser.BIN_SLAB = old
    near = lambda x: [i for i in range(x - 10, x + 11) if 0 <= i < 300]
    assert got == {x: pytest.approx(sum(near(x)) / len(near(x))) for x in range(300)}


def test_stall_transitions(spark):
    t = [0, 1, 4, 26, 27, 31]
    df = spark.createDataFrame([("c", x * 10**9, 1024 * 5) for x in t], "capture_id string, t long, bytes long")
    out = ser.stall_intervals(df).orderBy("interval").collect()
    assert [(r.interval, r.new_rows, r.stalled, r.transition) for r in out] == [
        (0, 3, False, None), (1, 0, True, "stalled"), (2, 0, True, None), (3, 0, True, None), (4, 0, True, None),
        (5, 2, False, "resumed"), (6, 1, False, None)]
    assert out[0].rows_per_s == 1 and out[0].kib_per_s == 3


def test_track_order_ranks_names(spark):
    names = ["Greenlet-10", "worker", "greenlet", "Hub-2", "Greenlet-9", "hub"]
    df = spans(spark, [(i, i, 1, n) for i, n in enumerate(names)])
    got = [r.name for r in rank.track_order(df, "ident").orderBy("row").collect()]
    assert got == ["hub", "Hub-2", "Greenlet-9", "Greenlet-10", "greenlet", "worker"]


def test_overflow_tracks_share_one_row(spark):
    out = rank.fold_overflow(spans(spark, [(i, i, 1) for i in range(6)]), 4).collect()
    other = [r for r in out if r.gid is None]
    assert len(out) == 5 and (other[0].name, other[0].executions, other[0].tracks) == ("…(other greenlets)", 2, 2)
