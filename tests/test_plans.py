"""What the plans must and must not hold."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from spanlens.functions import predicates as pred
from spanlens.operators import ranges as rng
from spanlens.plans import catalog as c
from spanlens.sources import captures as cap

SF = "/root/testdata/sf0.001"
STREAMS = {"stream_switches", "parquet_append_sink", "micro_batch_flush", "stream_tail", "stream_retention",
           "fold_switches_stream", "live_aggregates", "live_head", "late_rows", "read_capture", "read_capture_tables",
           "stall_monitor"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def outside_subqueries(text):
    """The plan's lines without those below a subquery node."""
    kept, skip = [], None
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        if skip is not None and depth > skip:
            continue
        skip = depth if line.lstrip(" :+-*").startswith("Subquery") else None
        if skip is None:
            kept.append(line)
    return kept


@pytest.mark.parametrize("name", sorted(set(c.QUERIES) - STREAMS))
def test_no_nested_loops_and_no_single_task(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    # One-row aggregates of partial results live in scalar subqueries; nothing else may meet in one task.
    assert not [x for x in outside_subqueries(text) if "SinglePartition" in x]


def test_range_reaches_the_scan(spark, tmp_path):
    e = c.v.executions(spark, SF)
    cap.write_capture({"executions": e}, str(tmp_path))
    stored = cap.read_capture(spark, str(tmp_path))["executions"]
    text = plan(rng.render_only(stored.filter(pred.overlaps(5, 9))))
    assert "LessThan(start,9)" in text and "GreaterThan(end,5)" in text
    one = plan(stored.filter("capture_id = 'cap-b'").select("dur"))
    assert "PartitionFilters: [isnotnull(capture_id" in one and "ReadSchema: struct<dur:bigint>" in one


def test_a_window_is_one_scan(spark, tmp_path):
    cap.write_capture({"executions": c.v.executions(spark, SF), "gc": c.v.gc_events(spark, SF)}, str(tmp_path))
    stored = cap.read_capture(spark, str(tmp_path))
    text = plan(rng.interval_window(stored["executions"], c.T0, c.T1))
    assert text.count("Scan parquet") == 1 and "Exchange" not in text
    text = plan(rng.gc_window(stored["gc"], 5, 9))
    assert "LessThan(start,9)" in text and "GreaterThan(end,5)" in text


def test_window_reads_no_texts(spark, tmp_path):
    cap.write_capture({"executions": c.v.executions(spark, SF)}, str(tmp_path))
    stored = cap.read_capture(spark, str(tmp_path))["executions"]
    text = plan(rng.interval_window(stored, c.T0, c.T1))
    read = [x.split("ReadSchema: ")[1] for x in text.splitlines() if "ReadSchema" in x]
    assert read and not [x for x in read if "string" in x]


def test_rollup_hashes_on_the_fact_side(spark):
    from spanlens.operators.aggregates import track_rollup

    text = plan(track_rollup(c.v.executions(spark, SF)))
    below = text.split("Exchange")[-1]
    assert "HashAggregate" in below and "SortAggregate" not in below


def test_frames_never_end_at_the_last_row(spark):
    for name in ("pair_gc", "busy_bins", "drop_zero_tail", "detail_nearest"):
        assert "unboundedfollowing" not in plan(c.QUERIES[name](spark, SF)).lower()


def test_scratch_follows_the_session(spark):
    class Session:
        conf = {"spark.checkpoint.dir": "hdfs://shared/work/"}
        sparkContext = spark.sparkContext

    assert cap.scratch(Session, "x").startswith("hdfs://shared/work/x-")
    class Far:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cap.scratch(Far, "x")
    Session.conf = {}
    own = cap.scratch(Session, "x").rsplit("/", 1)[0]
    assert cap.scratch(Session, "y").startswith(own)


def test_results_do_not_depend_on_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        r = c.v.executions(spark, SF).agg(F.min("start"), F.max("start")).first()
        clock = c.QUERIES["axis_clock"](spark, SF).orderBy("seq").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert tuple(r) == tuple(c.v.executions(spark, SF).agg(F.min("start"), F.max("start")).first())
    assert clock == c.QUERIES["axis_clock"](spark, SF).orderBy("seq").first()
