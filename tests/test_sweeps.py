"""Sweeps, the slab store, sketches and the batch-wise streams, on small inputs with awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from spanlens.operators import aggregates as agg
from spanlens.operators import matching as mat
from spanlens.operators import ranges as rng
from spanlens.operators import ranking as rank
from spanlens.operators import series as ser
from spanlens.operators import sketches as sk
from spanlens.operators.sweep import nearest_facts
from spanlens.plans import event_views as v
from spanlens.plans import report as rep
from spanlens.sources import slab_store as store
from spanlens.streaming import live
from tests.test_cases import MS, pauses, spans
from tests.test_plans import plan

SF = "/root/testdata/sf0.001"
ONCE = {"availableNow": True}


@pytest.fixture
def partitions(spark):
    """Many partitions, which adaptive execution leaves alone."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
                                          "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for key, value in zip(old, ("13", "false", "3")):
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def rows_of(rng_, keys, n, span):
    return [(rng_.choice(keys), rng_.randrange(span)) for _ in range(n)]


@pytest.mark.parametrize("keys, span", [(["a"], 400), (["a", "b", None], 40), (list("abcdefghij"), 1000), (["a"], 3)])
def test_nearest_facts(spark, partitions, keys, span):
    """One key over all partitions, many small ones, very many ties, keys without facts and facts without points."""
    r = random.Random(span)
    facts = [(k, t, i, float(i)) for i, (k, t) in enumerate(rows_of(r, keys[1:] or keys, 150, span))]
    points = [(k, t, i) for i, (k, t) in enumerate(rows_of(r, keys[:-1] or keys, 200, span))]
    fact_df = spark.createDataFrame(facts, "k string, t long, seq long, v double")
    point_df = spark.createDataFrame(points, "k string, t long, id long")
    for smallest in (False, True):
        got = nearest_facts(point_df, fact_df, ["k"], "t", ["seq", "v"], "seq", smallest, forward=True).collect()
        assert len(got) == len(points)
        for row in got:
            own = [f for f in facts if f[0] == row.k]
            pick = min if smallest else max
            before = [f for f in own if f[1] <= row.t]
            after = [f for f in own if f[1] > row.t]
            b = pick((f for f in before if f[1] == max(x[1] for x in before)), key=lambda f: f[2], default=None)
            a = pick((f for f in after if f[1] == min(x[1] for x in after)), key=lambda f: f[2], default=None)
            assert (row.before_t, row.before_seq, row.before_v) == (b[1:] if b else (None,) * 3), (row, b)
            if smallest:  # the nearest later fact: with ties, the one of the same rule
                assert (row.after_t, row.after_seq, row.after_v) == (a[1:] if a else (None,) * 3), (row, a)
            else:
                assert row.after_t == (a[1] if a else None)


def test_nearest_facts_of_nothing(spark):
    fact_df = spark.createDataFrame([], "k string, t long, seq long, v double")
    point_df = spark.createDataFrame([("a", 1, 1)], "k string, t long, id long")
    row, = nearest_facts(point_df, fact_df, ["k"], "t", ["v"], "seq").collect()
    assert (row.before_t, row.before_v, row.id) == (None, None, 1)
    assert nearest_facts(point_df.limit(0), fact_df, ["k"], "t", ["v"], "seq").count() == 0


def test_held_values_take_one_scan_of_what_was_swept(spark):
    p = v.probes(spark, SF).select("capture_id", "probe_id", "t")
    text = plan(mat.hold_asof(p, v.sys_samples(spark, SF), ["lag_ms_s"]))
    assert text.count("Scan parquet") <= 2 and text.count(" Exchange") <= 3


def test_covering_spans_nested_deep(spark, partitions):
    """A thousand spans over every probe: a probe makes a row for each size class at most."""
    deep = spans(spark, [(1, k, 4000 - 2 * k) for k in range(1000)])
    asked = [("c", i, 1, (1000 + 2 * i) * MS) for i in range(500)]
    probes = spark.createDataFrame(asked, "capture_id string, probe_id long, gid long, t long")
    got = {r.probe_id: r.hit_seq for r in mat.stab_lookup(probes, deep, 0).collect()}
    for i in range(500):
        t = 1000 + 2 * i
        assert got[i] == max(k for k in range(1000) if k <= t <= 4000 - k)


@pytest.mark.parametrize("salts", [1, 3])
def test_covering_spans_by_brute_force(spark, partitions, salts):
    r = random.Random(3)
    rows = [(r.choice([1, 2]), r.randrange(300), r.choice([0, 1, 5, 50, 200])) for _ in range(200)]
    asked = [("c", i, r.choice([1, 2, 3]), r.randrange(-20, 600) * MS) for i in range(150)]
    probes = spark.createDataFrame(asked, "capture_id string, probe_id long, gid long, t long")
    got = {x.probe_id: x.hit_seq for x in mat.stab_lookup(probes, spans(spark, rows), 2 * MS, salts).collect()}
    held = pauses(spark, [(s, d, g) for g, s, d in rows])
    got_gc = {x.probe_id: x.hit_seq for x in mat.gc_stab(probes, held, 2 * MS, salts).collect()}
    for _, i, gid, t in asked:
        over = [(s, k) for k, (g, s, d) in enumerate(rows) if g == gid and s * MS <= t <= (s + max(d, 2)) * MS]
        assert got[i] == (max(over)[1] if over else None)
        over = [k for k, (_, s, d) in enumerate(rows) if (s - 4) * MS <= t <= (s + max(d, 4) + 4) * MS]
        assert got_gc[i] == max(over, default=None)


def in_store(spark, path, rows, slab=10, cut=45):
    df = spans(spark, rows)
    for part in (df.filter(F.col("seq") < cut), df.filter(F.col("seq") >= cut)):
        store.append_store(part, str(path), slab)
    return df, store.read_rows(spark, str(path)), store.read_index(spark, str(path))


def spoil(path, slabs):
    """Overwrite the files of some slabs, so that reading one fails."""
    for k in slabs:
        for f in (path / "rows" / "capture_id=c" / f"slab={k}").glob("*.parquet"):
            f.write_bytes(b"not a table")
        for f in (path / "rows" / "capture_id=c" / f"slab={k}").glob(".*.crc"):
            f.write_bytes(b"")


def same(a, b):
    assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("ordered", [True, False])
def test_window_reads_its_slabs_alone(spark, tmp_path, ordered):
    rows = [(1, 10 * k, 9 if ordered or k % 7 else 40) for k in range(100)]
    df, stored_rows, index = in_store(spark, tmp_path, rows)
    want = rng.interval_window(df, 200 * MS, 800 * MS, 12, "by_order").collect()
    assert index.count() == 10 and store.stored_sortedness(index).first().sorted is ordered
    # The middle 12 of 60 rows lie in slabs 4 and 5, the first 12 in 1, 2 and 3; slab 8 is on the window's edge.
    needed = {4, 5, 1, 2, 7, 8, 8} if ordered else {1, 2, 3, 8, 7}
    spoil(tmp_path, set(range(10)) - needed)
    got = store.stored_window(stored_rows, index, 200 * MS, 800 * MS, 12)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_tail_and_retention_read_their_slabs_alone(spark, tmp_path):
    df, stored_rows, index = in_store(spark, tmp_path, [(1, 10 * k, 5) for k in range(100)])
    tail = rng.tail_follow(df, 300 * MS, 2000 * MS, 15, 34).collect()
    horizon = rank.retention_horizon(rank.retention_cap(df, 37)).collect()
    spoil(tmp_path, {0, 1, 2, 7, 8, 9})
    got = store.stored_tail(stored_rows, index, 300 * MS, 2000 * MS, 15, 34)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tail))
    assert [tuple(r) for r in store.stored_retention(stored_rows, index, 37).collect()] == [tuple(r) for r in horizon]


def test_eviction_deletes_folders_and_reads_no_row(spark, tmp_path):
    df, _, index = in_store(spark, tmp_path, [(1, 10 * k, 5) for k in range(100)])
    spoil(tmp_path, range(6))
    assert store.evict(spark, str(tmp_path), 37) == 6 and store.evict(spark, str(tmp_path), 37) == 0
    left = sorted(p.name for p in (tmp_path / "rows" / "capture_id=c").iterdir())
    assert left == [f"slab={k}" for k in range(6, 10)]
    rows, index = store.read_rows(spark, str(tmp_path)), store.read_index(spark, str(tmp_path))
    kept = rank.retention_cap(df, 37)
    assert [tuple(r) for r in store.stored_retention(rows, index, 37).collect()] == [
        tuple(r) for r in rank.retention_horizon(kept).collect()]
    assert rows.count() == 40
    late = df.filter(F.col("seq") >= 60)
    same(store.stored_window(rows, index, 0, 10_000 * MS, 8, "first"), rng.interval_window(late, 0, 10_000 * MS, 8, "first"))


def test_recent_rows_of_captures_a_year_apart(spark, tmp_path):
    """Each capture's last slab is read, however long ago it ended."""
    df, _, _ = in_store(spark, tmp_path, [(k % 3, 10 * k, 5) for k in range(100)])
    year = 365 * 24 * 3600 * 1000 * MS
    old = df.withColumns({"capture_id": F.lit("old"), "start": F.col("start") - year, "end": F.col("end") - year})
    store.append_store(old, str(tmp_path), 10)
    spoil(tmp_path, range(9))
    rows, index = store.read_rows(spark, str(tmp_path)), store.read_index(spark, str(tmp_path))
    recent = store.stored_recent(rows, index, 60 * MS)
    want = agg.recent_activity(df.unionByName(old), 60 * MS).filter("activity > 0")
    same(agg.recent_activity(recent, 60 * MS).filter("activity > 0"), want)
    same(agg.cpu_busy(recent, 60 * MS), agg.cpu_busy(df.unionByName(old), 60 * MS))


def test_report_lists_every_generation_or_the_rest(spark):
    rows, held = spans(spark, [(1, 0, 25)]), pauses(spark, [(k, 1 + k % 5, k) for k in range(50)])
    row = rep.analyze_report(rows, held).first()
    assert [g.gen for g in row.gcByGen] == list(range(50)) and sum(g["count"] for g in row.gcByGen) == row.gcCount
    row = rep.analyze_report(rows, held, generations=4).first()
    assert [g.gen for g in row.gcByGen] == [4, 9, 14, 19, None] and row.gcByGen[-1]["count"] == 46
    assert sum(g.totalNs for g in row.gcByGen) == row.gcTotalNs
    assert "  generation others: 46, 130.0ms" in [x.line for x in rep.report_text(rep.analyze_report(rows, held, generations=4)).collect()]


def test_report_of_a_capture_in_which_nothing_ran(spark):
    r = rep.analyze_report(spans(spark, []), pauses(spark, [(1, 2, 0)]))
    assert (r.first().totalExecutions, r.first().gcCount, r.first().slowest) == (0, 1, [])
    assert [x.line for x in rep.report_text(r).orderBy("line_no").collect()][-1] == "  nothing ran"


def test_columns_of_a_capture_without_rows_are_held(spark):
    samples = spark.createDataFrame([("c", 0, 5, 0.0, 500.0)], "capture_id string, seq long, start long, lag_ms_s double, cpu_ms_s double")
    series = ser.utilization_series(ser.busy_bins(spans(spark, []), 10), 10, 0, 10, 3, samples)
    got = ser.utilization_with_tail(series, samples, spans(spark, []), 0, 10, 3).orderBy("x").collect()
    assert [r.busy for r in got] == [0.0, 0.5, 0.5]


def test_sketches_merge(spark):
    df = spans(spark, [(k % 40, k, (k * 7) % 1000 + 1) for k in range(2000)] + [(99, 1, 10**6, "Hub")])
    table = sk.sketch_table(df, 100 * MS)
    assert table.count() == 20
    got = sk.sketched_stats(sk.merge_sketches(table, 5, 14), {"p50": 0.5, "p99": 0.99}).first()
    assert got.rows == 1000 and abs(got.tracks - 40) <= 2
    assert abs(got.p50 / MS - 500) <= 20 and abs(got.p99 / MS - 990) <= 20
    assert sk.merge_sketches(table, 500).count() == 0


def test_follower_replays_a_batch(spark, tmp_path):
    """A batch that runs twice sends the same, and a broken order sends the window once more."""
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    parts = [[(1, 10, 5), (1, 20, 5)], [(1, 30, 5)], [(1, 5, 5), (1, 40, 5)], [(1, 50, 5)]]
    seq = 0
    for part in parts:
        df = spans(spark, part).withColumn("seq", F.col("seq") + seq)
        seq += len(part)
        df.write.mode("append").parquet(src)
        live.follow_stream(live.stream_executions(spark, src), out, ck, 0, 1000 * MS, ONCE).awaitTermination()
    sent = spark.read.parquet(f"{out}/rows").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("whole").alias("whole")).orderBy("batch_id").collect()
    assert [(r.n, r.whole) for r in sent] == [(2, True), (1, False), (5, True), (1, False)]
    assert sorted(r.start // MS for r in live.follower_view(spark, out).collect()) == [5, 10, 20, 30, 40, 50]


def test_interval_counts_report_what_they_drop(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for part in ([(1, 1, 1), (1, 95, 1)], [(1, 2, 1), (1, 91, 1), (1, 120, 1)]):
        spans(spark, part).write.mode("append").parquet(src)
        live.count_intervals_stream(live.stream_executions(spark, src), out, ck, 20 * MS, 10 * MS, ONCE).awaitTermination()
    got = {r.interval: (r.new_rows, r.dropped, r.closed) for r in live.interval_counts(spark, out, 20 * MS, 10 * MS).collect()}
    assert got == {0: (1, 1, True), 9: (2, 0, True), 12: (1, 0, False)}


@pytest.mark.parametrize("keep, slab", [("first", 1), ("middle", 8), ("by_order", 64)])
def test_capped_ranges_by_brute_force(spark, keep, slab):
    """Ranges of no length, spans of no length, spans on both edges, and captures in order or not."""
    r = random.Random(slab)
    rows = [(1, r.randrange(100), r.choice([0, 0, 1, 10, 60])) for _ in range(150)]
    asked = [("c", i, t * MS, (t + r.choice([0, 0, 1, 30, 200])) * MS) for i, t in enumerate(r.choices(range(-5, 120), k=60))]
    probes = spark.createDataFrame(asked + [("c", 99, 5, 4)], "capture_id string, probe_id long, t0 long, t1 long")
    got = {}
    for x in mat.interval_join_capped(probes, spans(spark, rows), 6, keep, slab_rows=slab).collect():
        got.setdefault(x.probe_id, []).append((x.seq, x.capped))
    for _, i, t0, t1 in asked:
        hits = [k for k, (_, s, d) in enumerate(rows) if s * MS < t1 and (s + d) * MS > t0]
        low = (len(hits) - 6) // 2 if keep == "middle" and len(hits) > 6 else 0
        assert sorted(got.get(i, [])) == [(k, len(hits) > 6) for k in hits[low:low + 6]]
    assert 99 not in got


def test_samples_of_ranges(spark):
    r = random.Random(2)
    times = sorted(r.choices(range(0, 60), k=40))
    samples = spark.createDataFrame([("c", i, t, 0.0, 1.0) for i, t in enumerate(times)],
                                    "capture_id string, seq long, start long, lag_ms_s double, cpu_ms_s double")
    asked = [("c", i, t, t + r.choice([0, 1, 10, 80])) for i, t in enumerate(r.choices(range(-10, 80), k=40))]
    ranges = spark.createDataFrame(asked, "capture_id string, probe_id long, t0 long, t1 long")
    got = {}
    for x in rng.samples_ranges(samples, ranges).collect():
        got.setdefault(x.probe_id, []).append(x.seq)
    for _, i, t0, t1 in asked:
        want = sorted(x.seq for x in rng.samples_range(samples, t0, t1).collect()) if i < 3 else None
        left = [k for k, t in enumerate(times) if t < t0][-1:]
        right = [k for k, t in enumerate(times) if t > t1][:1]
        inner = [k for k, t in enumerate(times) if t0 <= t <= t1]
        assert sorted(got.get(i, [])) == sorted(left + inner + right) and want in (None, sorted(got.get(i, [])))
