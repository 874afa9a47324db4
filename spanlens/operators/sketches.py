"""Quantiles and distinct counts of any time range from small mergeable sketches.

A table of sketches has one row for each capture and time bucket: how many rows start in it, a KLL sketch of their run times
and an HLL sketch of their tracks.  It is made once, new buckets are appended, and a range merges the rows it
covers instead of reading the intervals again.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import floor_div
from ..schema import CAPTURE

#: Size of the sketches: ranks are off by about 0.7 %, distinct counts by about 1.6 %, at 4 to 8 KB a bucket.
KLL_K, HLL_BITS = 400, 12
BUCKET = "bucket"


def sketch_table(df: DataFrame, bucket_ns: int, k: int = KLL_K, bits: int = HLL_BITS) -> DataFrame:
    """(capture_id, bucket, rows, durations, tracks) of all non-hub rows, by the bucket they start in.

    Sketches are aggregated before they are shuffled, so a crowded bucket costs one sketch for each task."""
    app = df.filter(~F.col("is_hub"))
    return app.groupBy(CAPTURE, floor_div("start", bucket_ns).alias(BUCKET)).agg(
        F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_bigint("dur", F.lit(k)).alias("durations"),
        F.hll_sketch_agg("gid", F.lit(bits)).alias("tracks"),
    )


def merge_sketches(table: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """One row for each capture from the buckets ``first`` to ``last``; the sketches can be merged further."""
    if first is not None:
        table = table.filter(F.col(BUCKET) >= first)
    if last is not None:
        table = table.filter(F.col(BUCKET) <= last)
    return table.groupBy(CAPTURE).agg(
        F.sum("rows").alias("rows"), F.kll_merge_agg_bigint("durations").alias("durations"),
        F.hll_union_agg("tracks").alias("tracks"),
    )


def sketched_stats(merged: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Rows, approximate distinct tracks and approximate quantiles of run time of merged sketches."""
    return merged.select(
        CAPTURE, "rows", F.hll_sketch_estimate("tracks").alias("tracks"),
        *[F.kll_sketch_get_quantile_bigint("durations", F.lit(float(p))).alias(name) for name, p in quantiles.items()],
    )
