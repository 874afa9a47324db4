"""Structured Streaming forms: folding, appending, following, running counters and order checks.

State that outlives a micro-batch (open intervals, counters, highest ends) is one small row for each thread or
capture.  It is kept as a table version for each batch id below the query's folder: a replayed batch reads the
version before it and overwrites its own, so results are exactly once, and a busy thread's rows are still
folded by many tasks.  The last two versions are kept.  A folder belongs to the query that made it: a new checkpoint over
an old folder is refused.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arith import floor_div
from ..functions.predicates import is_hub, overlaps
from ..operators.ranges import RENDER_COLUMNS
from ..operators.sequence import fold_switches
from ..operators.slabs import Running, running
from ..schema import BLOCKED_NS, CAPTURE, EXECUTIONS, LONG_NS, SEQ, STALL_INTERVAL_NS, SWITCHES
from ..sources.captures import append_batches

FLUSH_TRIGGER = {"processingTime": "10 seconds"}
# Fixed value: a live reader gets a batch after about 2,048 events.
LIVE_BATCH_EVENTS = 2048
BATCH = "batch_id"


def stream_switches(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Switch events arriving as files below ``path``."""
    return _stream(spark, path, SWITCHES, max_files)


def stream_executions(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    return _stream(spark, path, EXECUTIONS, max_files)


def _stream(spark, path, schema, max_files):
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def kafka_switches(spark: SparkSession, servers: str, topic: str, per_trigger: int = LIVE_BATCH_EVENTS * 1000):
    """Switch events as JSON values of a topic (needs Spark's Kafka package); offsets bound each batch."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("maxOffsetsPerTrigger", per_trigger).load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), SWITCHES).alias("s")).select("s.*")


def parquet_append_sink(stream: DataFrame, path: str, checkpoint: str, trigger=None):
    """Append what is new since the last flush.  A committed file is never written again."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy(CAPTURE).outputMode("append").trigger(**(trigger or FLUSH_TRIGGER)).start()
    )


def stream_tail(spark: SparkSession, path: str, sink: str, checkpoint: str, after: int | None = None,
                trigger=None):
    """Follow a table: each row past the frontier reaches this follower once.

    The frontier over time is the checkpoint's arrival offset and not a start time, so a row that arrives late
    with an early start is not skipped.
    """
    rows = stream_executions(spark, path)
    if after is not None:
        rows = rows.filter(F.col("start") > after)
    return parquet_append_sink(rows, sink, checkpoint, trigger)


def _state(spark, path, batch_id, schema):
    """State version left by the batch before ``batch_id``."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{BATCH}={batch_id - 1}")


def _folder(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _save(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a state version and drop the one before the last."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
    files, old = _folder(df.sparkSession, f"{path}/{BATCH}={batch_id - 2}")
    files.delete(old, True)


def _claim(spark: SparkSession, out: str) -> None:
    """Bind ``out`` to the running query, or raise where another one has written there."""
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    files, at = _folder(spark, f"{out}/query")
    if not files.exists(at):
        spark.createDataFrame([(query,)], "id string").write.parquet(f"{out}/query")
    elif (owner := spark.read.schema("id string").parquet(f"{out}/query").first().id) != query:
        raise ValueError(f"{out} belongs to query {owner}; use its checkpoint or another folder")


def _per_batch(stream, work, out, checkpoint, trigger):
    """Run ``work`` on each batch, which is read once however often it is used."""
    def step(batch: DataFrame, batch_id: int) -> None:
        _claim(batch.sparkSession, out)
        batch.persist()
        try:
            work(batch, batch_id)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or FLUSH_TRIGGER)).start()
    )


def fold_switches_stream(stream: DataFrame, out: str, checkpoint: str, trigger=None, **slabs):
    """``fold_switches`` over a stream: each interval is written once, in the batch that closes it.

    Rows go to ``out/rows``; the open switch of each thread is the state.
    """
    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = _state(spark, f"{out}/open", batch_id, SWITCHES)
        rows = held.unionByName(batch.select(*SWITCHES.fieldNames()))
        closed = fold_switches(rows, **slabs)
        closed.write.mode("overwrite").parquet(f"{out}/rows/{BATCH}={batch_id}")
        last = rows.groupBy(CAPTURE, "thread").agg(F.max(SEQ).alias(SEQ))
        still_open = rows.join(last, [CAPTURE, "thread", SEQ], "left_semi").select(*SWITCHES.fieldNames())
        _save(still_open, f"{out}/open", batch_id)

    return _per_batch(stream, work, out, checkpoint, trigger)


_COUNTERS = (
    "capture_id string, total long, bytes long, span long, long_count long, blocked_count long, changed boolean"
)


def live_aggregates(stream: DataFrame, out: str, checkpoint: str, trigger=None, long_ns=LONG_NS,
                    blocked_ns=BLOCKED_NS):
    """Running counters of each capture.  Version n of ``out/head`` holds them after batch n, with ``changed``
    marking the captures this batch moved."""
    def work(batch: DataFrame, batch_id: int) -> None:
        app = ~is_hub("name")
        texts = sum((F.octet_length(c) for c in ("name", "func", "task", "stack")), F.lit(24))
        new = batch.groupBy(CAPTURE).agg(
            F.count(F.lit(1)).alias("total"), F.sum(texts).alias("bytes"),
            F.max(F.col("start") + F.col("dur")).alias("span"),
            F.count_if(app & (F.col("dur") >= long_ns)).alias("long_count"),
            F.count_if(app & (F.col("dur") >= blocked_ns)).alias("blocked_count"),
        ).withColumn("changed", F.lit(True))
        held = _state(batch.sparkSession, f"{out}/head", batch_id, _COUNTERS).withColumn("changed", F.lit(False))
        both = held.unionByName(new).groupBy(CAPTURE).agg(
            *[F.sum(c).cast("long").alias(c) for c in ("total", "bytes")], F.max("span").alias("span"),
            *[F.sum(c).cast("long").alias(c) for c in ("long_count", "blocked_count")],
            F.bool_or("changed").alias("changed"),
        )
        _save(both, f"{out}/head", batch_id)

    return _per_batch(stream, work, out, checkpoint, trigger)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a state table, of the two that are kept."""
    files, at = _folder(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at)]
    newest = max(int(n.split("=")[1]) for n in names if n.startswith(f"{BATCH}="))
    return spark.read.parquet(f"{path}/{BATCH}={newest}")


def live_head(counters: DataFrame, horizon: DataFrame | None = None) -> DataFrame:
    """What a live reader shows of each capture: its counters, ``stalled`` where the last batch brought nothing, and
    ``retained_from``, the earliest start still stored (0 where nothing was evicted)."""
    out = counters.withColumn("stalled", ~F.col("changed")).drop("changed")
    if horizon is None:
        return out.withColumn("retained_from", F.lit(0).cast("long"))
    return out.join(horizon.select(CAPTURE, "retained_from"), CAPTURE, "left").fillna(0, ["retained_from"])


def mark_late_stream(stream: DataFrame, out: str, checkpoint: str, trigger=None, **slabs):
    """Keep every row and flag ``late`` those that start before the latest end among earlier arrivals.

    No watermark: nothing is dropped.  Rows go to ``out/rows``, each capture's highest end is the state.
    """
    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "capture_id string, high long"
        held = _state(spark, f"{out}/high", batch_id, schema)
        end = F.col("start") + F.col("dur")
        seen = running(batch, [CAPTURE], [SEQ], [Running("_high", end, "max")], **slabs)
        known = seen.join(held, CAPTURE, "left")
        high = F.greatest(F.col("_high"), F.col("high"), F.lit(0))
        known.select(*batch.columns, (F.col("start") < high).alias("late")).write.mode("overwrite").parquet(
            f"{out}/rows/{BATCH}={batch_id}"
        )
        tops = batch.groupBy(CAPTURE).agg(F.max(end).alias("high")).unionByName(held)
        _save(tops.groupBy(CAPTURE).agg(F.max("high").alias("high")), f"{out}/high", batch_id)

    return _per_batch(stream, work, out, checkpoint, trigger)


_FRONT = "capture_id string, after_seq long, max_start long, reset long"


def follow_stream(stream: DataFrame, out: str, checkpoint: str, t0: int, t1: int, trigger=None):
    """Follow a window of every capture: new rows, or the whole window anew where order breaks.

    A follower that draws rows in start order can't insert one before those it has drawn.  So where a batch starts at or
    before the largest start already sent, its capture is sent whole, with ``whole`` set, and what was sent before is void;
    a capture's first rows are whole, too.  The state is one row for each capture: last arrival, largest start, and the
    batch it was last sent whole in.  What was sent since then (``follower_view``) is the capture's window, so nothing
    but it is read again."""
    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = _state(spark, f"{out}/front", batch_id, _FRONT)
        new = batch.filter(overlaps(t0, t1, end=F.col("start") + F.col("dur"))).select(*RENDER_COLUMNS)
        seen = new.groupBy(CAPTURE).agg(
            F.max(SEQ).alias("_seq"), F.max("start").alias("_start"), F.min("start").alias("_first"))
        broken = F.col("after_seq").isNull() | (F.col("_first") <= F.col("max_start"))
        both = seen.join(held, CAPTURE, "left").withColumn("whole", broken)
        sent = new.join(both.select(CAPTURE, "whole"), CAPTURE)
        if batch_id:
            anew = both.filter(F.col("whole") & F.col("reset").isNotNull()).select(CAPTURE)
            before = _sent_since(spark, out, held.join(anew, CAPTURE, "left_semi"), batch_id)
            sent = sent.unionByName(before.withColumn("whole", F.lit(True)))
        sent.write.mode("overwrite").parquet(f"{out}/rows/{BATCH}={batch_id}")
        moved = both.select(CAPTURE, F.greatest("after_seq", "_seq").alias("after_seq"),
                            F.greatest("max_start", "_start").alias("max_start"),
                            F.when(F.col("whole"), batch_id).otherwise(F.col("reset")).cast("long").alias("reset"))
        _save(held.join(moved, CAPTURE, "left_anti").unionByName(moved), f"{out}/front", batch_id)

    return _per_batch(stream, work, out, checkpoint, trigger)


def _sent_since(spark, out, front, before):
    """Rows of the captures of ``front`` that were sent from their last whole batch on, and before batch ``before``."""
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").filter(F.col(BATCH) < before)
    return rows.join(front.select(CAPTURE, "reset"), CAPTURE).filter(F.col(BATCH) >= F.col("reset")).select(*RENDER_COLUMNS)


def follower_view(spark: SparkSession, out: str) -> DataFrame:
    """What a follower has drawn now: each capture's window."""
    return _sent_since(spark, out, latest(spark, f"{out}/front"), 1 << 62)


def count_intervals_stream(stream: DataFrame, out: str, checkpoint: str, late_ns: int | None = None,
                           width_ns: int = STALL_INTERVAL_NS, trigger=None):
    """Rows of each tumbling interval of start time, under a watermark that the caller gives, or none.

    A capture's watermark is its largest start in earlier batches less ``late_ns``.  Rows of an interval that ends at or before
    it are not counted but reported as dropped; without ``late_ns`` every row counts.  Each batch writes its own part
    of the counts, so state is one number for each capture."""
    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = _state(spark, f"{out}/high", batch_id, "capture_id string, high long")
        interval = floor_div("start", width_ns)
        rows = batch.select(CAPTURE, "start", interval.alias("interval")).join(held, CAPTURE, "left")
        dropped = F.lit(False) if late_ns is None else F.coalesce(
            (F.col("interval") + 1) * width_ns <= F.col("high") - late_ns, F.lit(False))
        rows.groupBy(CAPTURE, "interval").agg(
            F.count_if(~dropped).alias("new_rows"), F.count_if(dropped).alias("dropped"),
        ).write.mode("overwrite").parquet(f"{out}/counts/{BATCH}={batch_id}")
        tops = batch.groupBy(CAPTURE).agg(F.max("start").alias("high")).unionByName(held)
        _save(tops.groupBy(CAPTURE).agg(F.max("high").alias("high")), f"{out}/high", batch_id)

    return _per_batch(stream, work, out, checkpoint, trigger)


def interval_counts(source: SparkSession | DataFrame, out: str | int = 5, late_ns: int | None = None,
                    width_ns: int = STALL_INTERVAL_NS, late: str | None = None) -> DataFrame:
    """Rows counted and dropped in each interval so far below ``out``, and whether the watermark has closed it.

    Given a stream of intervals instead of a session it returns the rows of each tumbling window of ``out`` seconds of start
    time, as a stream; only a given watermark ``late`` ever drops one."""
    if isinstance(source, DataFrame):
        at = source.withColumn("at", F.timestamp_micros(floor_div("start", 1000)))
        at = at if late is None else at.withWatermark("at", late)
        return at.groupBy(CAPTURE, F.window("at", f"{out} seconds")).agg(F.count(F.lit(1)).alias("new_rows"))
    spark = source
    parts = spark.read.parquet(f"{out}/counts").groupBy(CAPTURE, "interval").agg(
        F.sum("new_rows").alias("new_rows"), F.sum("dropped").alias("dropped"))
    closed = F.lit(False) if late_ns is None else (F.col("interval") + 1) * width_ns <= F.col("high") - late_ns
    return parts.join(latest(spark, f"{out}/high"), CAPTURE).select(CAPTURE, "interval", "new_rows", "dropped", closed.alias("closed"))


_POOL = "capture_id string, id long, value string"


def intern_stream(stream: DataFrame, value: str, out: str, checkpoint: str, trigger=None, **slabs):
    """A dictionary that grows batch by batch: ids never change, and new texts get the next ones in order of first sight.

    Each batch appends its new texts to the pool; the state is the largest id of each capture."""
    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tops = _state(spark, f"{out}/top", batch_id, "capture_id string, top long")
        seen = batch.select(CAPTURE, SEQ, F.col(value).alias("value")).filter(F.col("value") != "").groupBy(
            CAPTURE, "value").agg(F.min(SEQ).alias(SEQ))
        if batch_id:
            seen = seen.join(interned(spark, out, batch_id), [CAPTURE, "value"], "left_anti")
        counted = running(seen, [CAPTURE], [SEQ], [Running("_n", F.lit(1), "sum", inclusive=True)], **slabs)
        new = counted.join(tops, CAPTURE, "left").select(
            CAPTURE, (F.coalesce("top", F.lit(0)) + F.col("_n")).cast("long").alias("id"), "value")
        new.write.mode("overwrite").parquet(f"{out}/pool/{BATCH}={batch_id}")
        added = spark.read.schema(_POOL).parquet(f"{out}/pool/{BATCH}={batch_id}").groupBy(CAPTURE).agg(F.max("id").alias("top"))
        every = batch.select(CAPTURE).distinct().withColumn("top", F.lit(0).cast("long"))
        _save(append_batches(added, tops, every).groupBy(CAPTURE).agg(F.max("top").alias("top")), f"{out}/top", batch_id)

    return _per_batch(stream, work, out, checkpoint, trigger)


def interned(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The pool of all batches, or of those before one, without the empty text."""
    pool = spark.read.schema(f"{_POOL}, {BATCH} long").parquet(f"{out}/pool")
    return (pool if before is None else pool.filter(F.col(BATCH) < before)).drop(BATCH)


def dictionary_of(spark: SparkSession, out: str) -> DataFrame:
    """The dictionary as ``intern_dictionary`` gives it: with id 0 for the empty text of every capture seen."""
    empty = latest(spark, f"{out}/top").select(CAPTURE, F.lit(0).cast("long").alias("id"), F.lit("").alias("value"))
    return interned(spark, out).unionByName(empty)
