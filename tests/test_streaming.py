"""Streams: replayed batches, equality with batch results, the timer-driven stall monitor."""

import time

from pyspark.sql import functions as F

from spanlens.operators import sequence as sq
from spanlens.plans import event_views as v
from spanlens.schema import EXECUTIONS, SWITCHES
from spanlens.streaming import live, stall

SF = "/root/testdata/sf0.001"
ONCE = {"availableNow": True}


def test_fold_equals_batch_over_many_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = v.switches(spark, SF)
    for i in range(4):
        rows.filter((F.col("seq") >= 250 * i) & (F.col("seq") < 250 * (i + 1))).coalesce(1).write.mode(
            "append").parquet(src)
    live.fold_switches_stream(
        live.stream_switches(spark, src, max_files=1), out, str(tmp_path / "ck"), ONCE, slab_rows=50
    ).awaitTermination()
    got = spark.read.parquet(f"{out}/rows")
    assert got.select(live.BATCH).distinct().count() == 4
    want = sq.fold_switches(rows)
    assert got.count() == want.count()
    assert got.drop(live.BATCH).exceptAll(want).count() == 0


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = v.switches(spark, SF)
    out = str(tmp_path / "out")

    class Replaying:
        """Calls the batch function twice for each batch, as after a failure before its commit."""

        def __init__(self, stream):
            self.stream = stream

        @property
        def writeStream(self):
            outer = self.stream.writeStream

            class Writer:
                def foreachBatch(self, work):
                    def twice(df, n):
                        work(df, n)
                        work(df, n)
                    return outer.foreachBatch(twice)
            return Writer()

    src = str(tmp_path / "in")
    for part in (rows.filter("seq < 500"), rows.filter("seq >= 500")):
        part.write.mode("append").parquet(src)
        live.fold_switches_stream(
            Replaying(live.stream_switches(spark, src)), out, str(tmp_path / "ck"), ONCE).awaitTermination()
    got = spark.read.parquet(f"{out}/rows").drop(live.BATCH)
    want = sq.fold_switches(rows)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_counters_mark_what_changed(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = v.executions(spark, SF).select(*EXECUTIONS.fieldNames())
    for part in (rows, rows.filter("capture_id = 'cap-b'")):
        part.write.mode("append").parquet(src)
        live.live_aggregates(live.stream_executions(spark, src), out, str(tmp_path / "ck"), ONCE).awaitTermination()
    head = {r.capture_id: (r.total, r.changed) for r in live.latest(spark, f"{out}/head").collect()}
    n = {r.capture_id: r["count"] for r in rows.groupBy("capture_id").count().collect()}
    assert head == {"cap-a": (n["cap-a"], False), "cap-b": (2 * n["cap-b"], True), "cap-c": (n["cap-c"], False)}


def test_late_rows_are_kept(spark, tmp_path):
    schema = "capture_id string, seq long, start long, dur long"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("c", 0, 0, 10), ("c", 1, 5, 1)], [("c", 2, 9, 1), ("c", 3, 10, 5), ("d", 0, 1, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        live.mark_late_stream(live._stream(spark, src, spark.createDataFrame([], schema).schema, None), out,
                              str(tmp_path / "ck"), ONCE).awaitTermination()
    got = {(r.capture_id, r.seq): r.late for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == {("c", 0): False, ("c", 1): True, ("c", 2): True, ("c", 3): False, ("d", 0): False}


def test_interval_counts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    v.executions(spark, SF).select(*EXECUTIONS.fieldNames()).write.parquet(src)
    counts = live.interval_counts(live.stream_executions(spark, src), 3600, late="1 hour")
    q = (counts.select("capture_id", F.col("window.start").alias("at"), "new_rows").writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append")
         .trigger(**ONCE).start())
    q.awaitTermination()
    closed = spark.read.parquet(out)
    assert 0 < closed.agg(F.sum("new_rows")).first()[0] <= 1000


def test_stall_monitor_fires_without_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("c", 2048)] * 6, "capture_id string, bytes long")
    rows.coalesce(1).write.parquet(src)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stall.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        stream = spark.readStream.schema(rows.schema).parquet(src)
        got = []

        def keep(df, _):
            got.extend(df.collect())

        q = (stall.stall_monitor(stream, 1000).writeStream.outputMode("append").foreachBatch(keep)
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start())
        until = time.time() + 60
        while time.time() < until and not any(r.stalled for r in got):
            time.sleep(0.5)
        rows.limit(2).coalesce(1).write.mode("append").parquet(src)
        while time.time() < until and not any(r.transition == "resumed" for r in got):
            time.sleep(0.5)
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    first = got[0]
    assert (first.total, first.new_rows, first.rows_per_s, first.kib_per_s) == (6, 6, 6, 12)
    assert not first.stalled
    marks = [r.transition for r in got if r.transition]
    assert marks[:2] == ["stalled", "resumed"]
    assert [r for r in got if r.transition == "resumed"][0].new_rows == 2


def test_switch_schema_matches_the_view(spark):
    assert set(v.switches(spark, SF).columns) == set(SWITCHES.fieldNames())


def test_state_versions_expire_and_folders_have_owners(spark, tmp_path):
    import pytest

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = v.executions(spark, SF).drop("thread")
    for i in range(4):
        rows.filter(F.col("seq") % 4 == i).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: live.stream_executions(spark, src, max_files=1)
    live.live_aggregates(stream(), out, str(tmp_path / "ck"), ONCE).awaitTermination()
    kept = sorted(p.name for p in (tmp_path / "out" / "head").iterdir() if p.name.startswith(live.BATCH))
    assert kept == [f"{live.BATCH}=2", f"{live.BATCH}=3"]
    assert live.latest(spark, f"{out}/head").agg(F.sum("total")).first()[0] == rows.count()
    with pytest.raises(Exception, match="belongs to query"):
        live.live_aggregates(stream(), out, str(tmp_path / "other"), ONCE).awaitTermination()
