"""The slab forms with slabs of a few rows, so that values are carried across many of them."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from spanlens.operators import matching as mat
from spanlens.operators import ranges as rng
from spanlens.operators import ranking as rank
from spanlens.operators import sequence as sq
from spanlens.operators import series as ser
from spanlens.operators import slabs
from spanlens.plans import catalog as c
from spanlens.plans import event_views as v
from tests import compare

SF = "/root/testdata/sf0.001"
SMALL = {"slab_rows": 7}


def check(df, name, where=None):
    con = compare.connect(SF)
    cur = con.execute(entry.oracle_sql()[name])
    names, want = [x[0] for x in cur.description], cur.fetchall()
    if where:
        want = [r for r in want if where(dict(zip(names, r)))]
    keep = [i for i, n in enumerate(names) if n in df.columns]
    got = compare.canonical([tuple(r) for r in df.select(*[names[i] for i in keep]).collect()],
                            [names[i] for i in keep])
    assert got == compare.canonical([[r[i] for i in keep] for r in want], [names[i] for i in keep])
    assert got


def test_fold_switches(spark):
    check(sq.fold_switches(v.switches(spark, SF), **SMALL).drop("end"), "fold_switches")


def test_pair_gc(spark):
    check(sq.pair_gc(v.gc_phases(spark, SF), **SMALL), "pair_gc")


def test_sortedness(spark):
    for case, view in (("plain", v.executions), ("dense", v.executions_dense)):
        check(sq.sortedness(view(spark, SF), **SMALL), "sortedness", lambda r: r["case"] == case)


def test_rates_and_deltas(spark):
    rates = sq.counter_rates(v.proc_counters(spark, SF), **SMALL)
    check(rates.withColumns({x: F.round(x, 6) for x in ("lag_ms_s", "cpu_ms_s")}), "counter_rates")
    coded = sq.delta_encode(v.switches_fast(spark, SF), **SMALL)
    check(coded, "delta_encode")
    check(sq.delta_decode(coded, **SMALL), "delta_decode")


def test_drop_zero_tail(spark):
    e = v.executions(spark, SF)
    zero = F.when(F.col("gid") % 2 == 0, 0).otherwise(F.col("dur"))
    check(sq.drop_zero_tail(e.select(*c.KEY, "thread", zero.alias("dur")), **SMALL), "drop_zero_tail")


def test_windows(spark):
    e, d = v.executions(spark, SF), v.executions_dense(spark, SF)
    for case, rows, cap in (("whole", e, 2_000_000), ("capped", e, 101), ("dense", d, 101)):
        out = rng.interval_window(rows, c.T0, c.T1, cap, "by_order", **SMALL)
        check(out, "interval_window", lambda r: r["case"] == case)
    check(rng.tail_follow(e, c.T0, c.T1, 50, **SMALL), "tail_follow", lambda r: r["case"] == "capped")
    check(rank.retention_cap(rng.render_only(e), 2000, **SMALL), "retention_cap")
    for keep in (1, 6, 7, 8, 50):
        kept = rank.retention_cap(rng.render_only(e), keep, **SMALL)
        assert {r["count"] for r in kept.groupBy("capture_id").count().collect()} == {keep}


@pytest.mark.parametrize("slab", [1, 4, 1 << 16])
def test_bins(spark, monkeypatch, slab):
    monkeypatch.setattr(ser, "BIN_SLAB", slab)
    check(ser.busy_bins(v.executions_dense(spark, SF), c.HOUR), "busy_bins")
    e = v.executions(spark, SF)
    arrivals = e.select("capture_id", F.col("end").alias("t"), F.octet_length("func").alias("bytes"))
    check(ser.stall_intervals(arrivals, c.HOUR // 4), "stall_intervals")


def test_bins_sum_to_run_time_for_long_spans(spark):
    spans = spark.createDataFrame(
        [("a", 1, 5, 1_000_003), ("a", 2, -50, 77), ("a", 3, 250_000, 10), ("b", 4, 0, 64)],
        "capture_id string, seq long, start long, dur long",
    ).withColumn("is_hub", F.lit(False))
    bins = ser.busy_bins(spans, 16)
    total = {r[0]: r[1] for r in bins.groupBy("capture_id").agg(F.sum("busy_ns")).collect()}
    assert total == {"a": 1_000_003 + 27 + 10, "b": 64}
    assert bins.filter("capture_id = 'a'").count() == 1_000_008 // 16 + 1


def test_one_pair_once_for_any_sizes(spark):
    import random

    random.seed(3)
    size = lambda: 2 ** random.randint(0, 44) + random.randint(0, 9)
    spans = [(random.choice("ab"), i, i % 5, random.randint(0, 2**45), size()) for i in range(400)]
    asked = [(random.choice("ab"), i, random.randint(0, 2**45)) for i in range(150)]
    asked = [(k, i, t, t + size() - 1) for k, i, t in asked]
    s = spark.createDataFrame(spans, "capture_id string, seq long, gid long, start long, dur long")
    p = spark.createDataFrame(asked, "capture_id string, probe_id long, t0 long, t1 long")
    got = [(r.probe_id, r.seq) for r in mat.interval_join(p, s).collect()]
    want = [(i, q) for k, i, t0, t1 in asked for k2, q, _, st, du in spans if k == k2 and st < t1 and st + du > t0]
    assert sorted(got) == sorted(want) and want


def test_quantiles_match_sorting(spark):
    import random

    random.seed(5)
    groups = {"a": [7], "b": [random.randint(0, 2**random.randint(1, 60)) for _ in range(997)],
              "c": [5] * 600 + [9] * 401, "d": list(range(1, 1001))}
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "capture_id string, dur long")
    q = {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in slabs.exact_quantiles(df, "dur", q).collect():
        xs = sorted(groups[r.capture_id])
        for name, p in q.items():
            at = (len(xs) - 1) * p
            lo, hi = int(at), -int(-at // 1)
            assert r[name] == pytest.approx(xs[lo] + (xs[hi] - xs[lo]) * (at - lo), rel=1e-12)


def test_top_n_equals_plain_ranking(spark):
    e = v.executions(spark, SF)
    got = slabs.top_n(e, [F.col("dur").desc(), F.col("seq")], 9, salts=5)
    want = sorted(((r.capture_id, -r.dur, r.seq) for r in e.collect()))
    seen, top = {}, []
    for k, d, s in want:
        seen[k] = seen.get(k, 0) + 1
        if seen[k] <= 9:
            top.append((k, s, seen[k]))
    assert sorted((r.capture_id, r.seq, r["rank"]) for r in got.collect()) == sorted(top)


def test_queue_limit_of_pauses(spark):
    marks = [("start", 10), ("stop", 11), ("start", 20), ("stop", 22), ("start", 30), ("stop", 33), ("drain", 40),
             ("start", 50), ("stop", 55), ("stop", 56), ("start", 60), ("stop", 61)]
    rows = [("a", i, p, t, None, None) for i, (p, t) in enumerate(marks)]
    df = spark.createDataFrame(
        rows, "capture_id string, seq long, phase string, t long, generation long, collected long")
    for slab in (1, 3, 100):
        kept = sq.pair_gc(df, origin=5, queue_limit=2, slab_rows=slab).orderBy("seq").collect()
        assert [(r.start, r.dur) for r in kept] == [(15, 2), (25, 3), (45, 6), (55, 1)]
        assert {(r.generation, r.collected) for r in kept} == {(-1, 0)}
