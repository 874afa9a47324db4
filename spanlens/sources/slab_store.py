"""Stored captures cut into slabs of arrivals, with a small index that answers where rows are.

Rows lie in one folder for each (capture, slab); the index has one row for each slab and append: rows, the smallest and
largest arrival, start and end, and whether the rows are in order among themselves.  What needs the order of a whole capture,
its row count or its last end is answered from the index alone; windows, tails and retention pick slabs from it and
read no others: their keys reach the scan of the partitioned table as a scalar subquery, so Spark lists and opens only
those folders.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.arith import int_div
from ..functions.predicates import overlaps, start_in
from ..operators.ranges import RENDER_COLUMNS
from ..operators.slabs import arrival_slab, prune
from ..schema import CAPTURE, SEQ

#: Arrivals of a slab: about 100 MB of rows, so a folder is worth opening and a capture has few of them.
STORE_ROWS = 1 << 22
SLAB = "slab"
INDEX = (
    "capture_id string, slab long, rows long, min_seq long, max_seq long, min_start long, max_start long, min_end long, "
    "max_end long, last_end long, ordered boolean"
)


def append_store(df: DataFrame, path: str, rows: int = STORE_ROWS) -> None:
    """Add newer arrivals to a store.  Rows are sorted by arrival inside their slab; ``df`` is read twice, for them and for
    their index."""
    df = df if "end" in df.columns else df.withColumn("end", F.col("start") + F.col("dur"))
    known = [c for c in schema.EXECUTIONS.fieldNames() if c in df.columns]
    cut = df.select(*known, arrival_slab(rows=rows).alias(SLAB)).repartition(CAPTURE, SLAB).sortWithinPartitions(
        CAPTURE, SLAB, SEQ)
    cut.write.mode("append").partitionBy(CAPTURE, SLAB).parquet(f"{path}/rows")
    earlier = Window.partitionBy(CAPTURE, SLAB).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, -1)
    facts = cut.withColumn("_high", F.max("end").over(earlier)).groupBy(CAPTURE, SLAB).agg(
        F.count(F.lit(1)).alias("rows"), F.min(SEQ).alias("min_seq"), F.max(SEQ).alias("max_seq"),
        F.min("start").alias("min_start"), F.max("start").alias("max_start"), F.min("end").alias("min_end"),
        F.max("end").alias("max_end"), F.max_by("end", SEQ).alias("last_end"), F.bool_and(F.coalesce(F.col("start") >= F.col("_high"), F.lit(True))).alias("ordered"))
    facts.coalesce(1).write.mode("append").parquet(f"{path}/index")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.EXECUTIONS if f.name != CAPTURE)
    return spark.read.schema(f"{kinds}, {CAPTURE} string, {SLAB} long").parquet(f"{path}/rows")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each slab, with ``before`` and ``total`` (rows before it and in all), ``max_end_before``, ``in_order`` (no
    row of it starts before the end of an earlier arrival) and ``held`` (its rows were not evicted)."""
    parts = spark.read.schema(INDEX).parquet(f"{path}/index")
    earlier = Window.partitionBy(CAPTURE).orderBy("min_seq").rowsBetween(Window.unboundedPreceding, -1)
    high = F.max("max_end").over(earlier)
    ok = F.col("ordered") & F.coalesce(F.col("min_start") >= high, F.lit(True))
    slabs = parts.withColumns({"_high": high, "_ok": ok}).groupBy(CAPTURE, SLAB).agg(
        F.sum("rows").alias("rows"), *[F.min(c).alias(c) for c in ("min_seq", "min_start", "min_end")],
        *[F.max(c).alias(c) for c in ("max_seq", "max_start", "max_end")], F.min("_high").alias("max_end_before"),
        F.max_by("last_end", "max_seq").alias("last_end"),
        F.bool_and("_ok").alias("in_order"))
    along = Window.partitionBy(CAPTURE).orderBy(SLAB).rowsBetween(Window.unboundedPreceding, -1)
    held = F.lit(True)
    if _exists(spark, f"{path}/evicted"):
        gone = spark.read.schema(f"{CAPTURE} string, {SLAB} long").parquet(f"{path}/evicted").distinct()
        slabs = slabs.join(gone.withColumn("_gone", F.lit(True)), [CAPTURE, SLAB], "left")
        held = F.col("_gone").isNull()
    slabs = slabs.withColumn("held", held).drop("_gone")
    return slabs.withColumns({
        "before": F.coalesce(F.sum("rows").over(along), F.lit(0)), "total": F.sum("rows").over(Window.partitionBy(CAPTURE)),
    })


def stored_sortedness(index: DataFrame) -> DataFrame:
    """Whether each capture's arrivals are in start order without overlap, from the index alone."""
    return index.groupBy(CAPTURE).agg(F.bool_and("in_order").alias("sorted"))


def stored_bounds(index: DataFrame) -> DataFrame:
    """Rows, origin side and last end of each capture, from the index alone."""
    return index.groupBy(CAPTURE).agg(
        F.sum("rows").alias("total"), F.min("min_start").alias("min_start"), F.max("max_start").alias("max_start"),
        F.max("max_end").alias("span"), F.max("max_seq").alias("max_seq"))


def _of(rows: DataFrame, slabs: DataFrame) -> DataFrame:
    """The rows of some slabs; no other folder is read."""
    return prune(rows, slabs, [CAPTURE, SLAB]).join(slabs, [CAPTURE, SLAB])


def _sliced(rows: DataFrame, index: DataFrame, may: Column, full: Column, hit: Column, lower, upper, facts=None) -> DataFrame:
    """Rows for which ``hit`` holds and whose rank among those of their capture is in [``lower``(n), ``upper``(n)).

    Slabs for which ``full`` holds are counted from the index, others that ``may`` have hits by reading them."""
    met = index.filter(may & F.col("held")).select(CAPTURE, SLAB, F.when(full, F.col("rows")).alias("_all"))
    some = _of(rows.filter(hit), met.filter("_all IS NULL").select(CAPTURE, SLAB)).groupBy(CAPTURE, SLAB).agg(
        F.count(F.lit(1)).alias("_some"))
    along = Window.partitionBy(CAPTURE).orderBy(SLAB).rowsBetween(Window.unboundedPreceding, -1)
    counts = met.join(some, [CAPTURE, SLAB], "left").withColumn("_n", F.coalesce("_all", "_some", F.lit(0))).withColumns({
        "_before": F.coalesce(F.sum("_n").over(along), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy(CAPTURE))})
    if facts is not None:
        counts = counts.join(facts, CAPTURE)
    chosen = counts.withColumns({"_lo": lower(F.col("total")), "_hi": upper(F.col("total"))}).filter(
        (F.col("_before") < F.col("_hi")) & (F.col("_before") + F.col("_n") > F.col("_lo"))).select(
        CAPTURE, SLAB, "_before", "total", "_lo", "_hi")
    place = F.row_number().over(Window.partitionBy(CAPTURE, SLAB).orderBy(SEQ))
    return _of(rows.filter(hit), chosen).withColumn("_rank", F.col("_before") + place - 1).filter(
        (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).select(
        *[c for c in rows.columns if c != SLAB], "total")


def stored_window(rows: DataFrame, index: DataFrame, t0: int, t1: int, cap: int, keep: str = "by_order",
                  columns=RENDER_COLUMNS) -> DataFrame:
    """``interval_window`` with a cap over a store: at most ``cap`` rows of each capture, the middle of one in start order and
    the first arrivals of any other (or as ``keep`` says)."""
    if keep not in ("by_order", "middle", "first"):
        raise ValueError("keep is one of 'middle', 'first' and 'by_order'")
    facts = stored_sortedness(index).select(CAPTURE, F.col("sorted").alias("_middle")) if keep == "by_order" else None
    middle = F.col("_middle") if facts is not None else F.lit(keep == "middle")
    skipped = lambda n: F.when(middle & (n > cap), int_div(n - cap, 2)).otherwise(0)
    may = (F.col("min_start") < t1) & (F.col("max_end") > t0)
    full = (F.col("max_start") < t1) & (F.col("min_end") > t0)
    kept = _sliced(rows, index, may, full, overlaps(t0, t1), skipped, lambda n: skipped(n) + cap, facts)
    return kept.select(*columns, (F.col("total") > cap).alias("capped"))


def stored_tail(rows: DataFrame, index: DataFrame, after: int, before: int, cap: int, after_seq: int = -1) -> DataFrame:
    """``tail_follow`` with a cap over a store: the oldest arrivals past the frontier first."""
    may = (F.col("max_start") > after) & (F.col("min_start") < before) & (F.col("max_seq") > after_seq)
    full = (F.col("min_start") > after) & (F.col("max_start") < before) & (F.col("min_seq") > after_seq)
    hit = start_in(after, before) & (F.col(SEQ) > after_seq)
    kept = _sliced(rows, index, may, full, hit, lambda n: F.lit(0), lambda n: F.lit(cap))
    return kept.select(*RENDER_COLUMNS, (F.col("total") > cap).alias("capped"))


def stored_recent(rows: DataFrame, index: DataFrame, window_ns: int) -> DataFrame:
    """The rows that can count in the last ``window_ns`` of their own capture, whenever it ended: slabs whose rows have all
    ended before are not read.  ``cpu_busy`` and ``recent_activity`` take them in place of all rows."""
    last = Window.partitionBy(CAPTURE)
    newest, now = F.max("max_seq").over(last), F.max_by("last_end", "max_seq").over(last)
    near = index.filter("held").withColumns({"_newest": newest, "_now": now}).filter(
        (F.col("max_end") >= F.col("_now") - window_ns) | (F.col("max_seq") == F.col("_newest")))
    return _of(rows, near.select(CAPTURE, SLAB)).drop(SLAB)


def _evictable(keep: int) -> Column:
    return F.col("total") - F.col("before") - F.col("rows") >= keep


def stored_retention(rows: DataFrame, index: DataFrame, keep: int) -> DataFrame:
    """``retained_from`` and ``held`` of each capture under a cap of ``keep`` arrivals: the index knows the slabs that stay whole,
    and the one that is cut is read alone."""
    cut = (F.col("total") - F.col("before") > keep) & ~_evictable(keep)
    edges = index.filter(cut).select(CAPTURE, SLAB, (F.col("total") - keep - F.col("before")).alias("_gone"))
    place = F.row_number().over(Window.partitionBy(CAPTURE, SLAB).orderBy(SEQ))
    within = _of(rows.select(CAPTURE, SLAB, SEQ, "start"), edges).withColumn("_at", place).filter("_at > _gone").groupBy(
        CAPTURE).agg(F.min("start").alias("_edge"))
    whole = index.groupBy(CAPTURE).agg(
        F.min(F.when(F.col("total") - F.col("before") <= keep, F.col("min_start"))).alias("_whole"), F.max("total").alias("total"))
    return whole.join(within, CAPTURE, "left").select(
        CAPTURE, F.when(F.col("total") > keep, F.least("_whole", "_edge")).otherwise(0).alias("retained_from"),
        F.least("total", F.lit(keep).cast("long")).alias("held"))


def evict(spark: SparkSession, path: str, keep: int) -> int:
    """Delete the folders of slabs of which no row is among the newest ``keep`` arrivals; no row is read.

    They are marked first, so that no reader of the index looks for them; it still counts them among all arrivals.  Returns
    how many folders went.  Repeating it does no harm."""
    chosen = read_index(spark, path).filter(F.col("held") & _evictable(keep)).select(CAPTURE, SLAB)
    old = [tuple(r) for r in chosen.toLocalIterator()]
    if old:
        spark.createDataFrame(old, f"{CAPTURE} string, {SLAB} long").coalesce(1).write.mode("append").parquet(f"{path}/evicted")
    for capture, slab in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/{CAPTURE}={capture}/{SLAB}={slab}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(old)
