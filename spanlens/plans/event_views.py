"""Timeline tables derived from an ``events`` table, the input of the registered queries.

One application's users become tracks, its lanes threads, and three captures of unequal size hold them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arith import int_div
from ..functions.predicates import is_hub
from ..operators.slabs import Running, running
from ..schema import CAPTURE

# Fixed value: 2024-01-01T00:00:00Z in ns, the time origin of every derived capture.
ORIGIN_NS = 1704067200000000000
EPOCH_MS = ORIGIN_NS // 1_000_000


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # A TIMESTAMP_NTZ minus another keeps the wall-clock value whatever the session zone is.
    since = F.col("ts").cast("timestamp_ntz") - F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    micros = (F.extract(F.lit("DAY"), since).cast("long") * 86_400_000_000
              + F.extract(F.lit("HOUR"), since).cast("long") * 3_600_000_000
              + F.extract(F.lit("MINUTE"), since).cast("long") * 60_000_000
              + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long"))
    thread = F.pmod(F.col("user_id"), F.lit(8))
    return events.select(
        F.when(thread < 5, "cap-a").when(thread < 7, "cap-b").otherwise("cap-c").alias(CAPTURE),
        F.col("event_id").alias("seq"), thread.alias("thread"), F.col("user_id").alias("gid"),
        (micros * 1000).alias("start"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def executions(spark, sf_dir, ns_per_unit: int = 1_000_000) -> DataFrame:
    """Run intervals; ``value`` counts milliseconds (or ``ns_per_unit``)."""
    b = _base(spark, sf_dir)
    k = F.col("k").cast("string")
    name = F.concat(F.when(F.col("gid") % 10 == 0, "Hub-").otherwise("Greenlet-"), F.col("gid").cast("string"))
    leaf = F.concat(F.lit("app.py:"), F.col("event_type"), F.lit(":"), k)
    stack = F.concat(
        F.lit("/srv/app/"), leaf,
        F.lit(" <- /usr/lib/gevent/hub.py:switch:1 <- /srv/app/main.py:main:2"),
    )
    dur = F.round(F.col("value") * ns_per_unit).cast("long")
    return b.select(
        CAPTURE, "seq", "thread", "gid", "start", dur.alias("dur"), (F.col("start") + dur).alias("end"),
        name.alias("name"), leaf.alias("func"),
        F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("req-"), k)).alias("task"),
        F.when((F.col("value") >= 20) & ~is_hub(name), stack).otherwise("").alias("stack"),
        is_hub(name).alias("is_hub"),
    )


def executions_dense(spark, sf_dir) -> DataFrame:
    """The same rows with ``value`` read as minutes, so that most of them overlap."""
    return executions(spark, sf_dir, 60_000_000_000)


def gc_events(spark, sf_dir) -> DataFrame:
    b = _base(spark, sf_dir).filter(F.col("event_type") == "error")
    return b.select(
        CAPTURE, "seq", "start", F.round(F.col("value") * 100_000).cast("long").alias("dur"),
        (F.col("gid") % 3).alias("generation"), F.col("k").alias("collected"),
    )


def sys_samples(spark, sf_dir) -> DataFrame:
    b = _base(spark, sf_dir).filter(F.col("event_type") == "view")
    return b.select(
        CAPTURE, "seq", "start", F.col("value").alias("lag_ms_s"),
        F.least(F.lit(1000), F.col("k") * 10).cast("double").alias("cpu_ms_s"),
    )


def proc_counters(spark, sf_dir) -> DataFrame:
    """Ever-growing on-CPU and run-queue counters, one pair for each track."""
    b = _base(spark, sf_dir).select(
        CAPTURE, "seq", "gid", "start", F.round(F.col("value") * 1_000_000).cast("long").alias("on"),
        (F.col("k") * 1_000_000).alias("wait"),
    )
    return running(b, [CAPTURE, "gid"], ["seq"], [
        Running("on_cpu_ns", F.col("on"), "sum", True), Running("runq_ns", F.col("wait"), "sum", True),
    ]).drop("on", "wait")


def switches(spark, sf_dir, divisor: int = 1) -> DataFrame:
    """Switch events; ``divisor`` compresses their clock."""
    e = executions(spark, sf_dir)
    return e.select(
        CAPTURE, "seq", "thread", int_div("start", divisor).alias("ts"), F.col("gid").alias("target"),
        F.col("name").alias("label"), "func", "task", "stack",
    )


def switches_fast(spark, sf_dir) -> DataFrame:
    return switches(spark, sf_dir, 100_000)


def gc_phases(spark, sf_dir) -> DataFrame:
    """Collector start and stop marks: clicks start one, errors stop one."""
    b = _base(spark, sf_dir).filter(F.col("event_type").isin("click", "error"))
    return b.select(
        CAPTURE, "seq", F.when(F.col("event_type") == "click", "start").otherwise("stop").alias("phase"),
        F.col("start").alias("t"), F.when(F.col("k") % 4 > 0, F.col("gid") % 3).alias("generation"),
        F.when(F.col("k") % 5 > 0, F.col("k")).alias("collected"),
    )


def probes(spark, sf_dir) -> DataFrame:
    """Point questions (one for each purchase): a track and a time near, but rarely on, a row's start."""
    b = _base(spark, sf_dir).filter(F.col("event_type") == "purchase")
    return b.select(
        CAPTURE, F.col("seq").alias("probe_id"), "gid",
        (F.col("start") + (F.col("k") - 50) * 1_000_000_000).alias("t"),
        (F.round(F.col("value") * 1_000_000_000)).cast("long").alias("dur"),
    )


def viewports(spark, sf_dir) -> DataFrame:
    """Range questions (one for each signup) from seconds to hours wide."""
    b = _base(spark, sf_dir).filter(F.col("event_type") == "signup")
    return b.select(
        CAPTURE, F.col("seq").alias("probe_id"), F.col("start").alias("t0"),
        (F.col("start") + (F.col("k") + 1) * 10_000_000_000).alias("t1"),
    )


def batch_parts(df: DataFrame, parts: int = 3) -> list[DataFrame]:
    """The table as ``parts`` batches by arrival."""
    return [df.filter(F.pmod(F.col("seq"), F.lit(parts)) == i) for i in range(parts)]
