"""Stored captures: Parquet tables partitioned by capture, and their metadata."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..schema import CAPTURE, SEQ
from ..storage import scratch, stored  # noqa: F401

TABLES = {
    "executions": schema.EXECUTIONS, "gc": schema.GC_EVENTS, "samples": schema.SYS_SAMPLES,
    "switches": schema.SWITCHES, "meta": schema.SESSION_META,
}


def write_capture(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """Append tables to a capture set.

    Tasks take ranges of (capture, start): a large capture is written by many of them, small ones share one,
    and a file covers a narrow span of time, so that a range question skips most files.
    """
    for name, df in tables.items():
        known = TABLES[name].fieldNames()
        if "end" in known and "end" not in df.columns:  # stored, so that both bounds of a range reach the scan
            df = df.withColumn("end", F.col("start") + F.col("dur"))
        out = df.select(*[c for c in known if c in df.columns])
        if "start" in out.columns:
            out = out.repartitionByRange(CAPTURE, "start").sortWithinPartitions(CAPTURE, "start")
        out.write.mode(mode).partitionBy(CAPTURE).parquet(f"{path}/{name}")


def read_capture(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a stored capture set, whole and without a cap; one absent on disk is left out."""
    found = {}
    for name, kind in TABLES.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            found[name] = spark.read.schema(kind).parquet(f"{path}/{name}")
    return found


def read_meta(meta: DataFrame) -> DataFrame:
    """The latest session facts of each capture; an epoch of 0 means unknown, the JSON becomes a map."""
    last = meta.groupBy(CAPTURE).agg(
        F.max_by("epoch_ms", F.when(F.col("epoch_ms") > 0, F.col(SEQ))).alias("epoch_ms"),
        *[F.max_by(c, SEQ).alias(c) for c in ("tid", "pid", "pyinfo")],
    )
    return last.withColumn("pyinfo", F.from_json("pyinfo", "map<string,string>"))


def append_batches(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Batches of one schema below each other; nothing is de-duplicated."""
    out = first
    for df in more:
        out = out.unionByName(df)
    return out
