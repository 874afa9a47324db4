"""Dictionaries of texts: dense ids in order of first sight, and back."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import col
from ..schema import CAPTURE, SEQ
from .slabs import Running, running


def intern_dictionary(df: DataFrame, value) -> DataFrame:
    """``(id, value)`` of each capture's distinct texts in order of first sight, 0 being the empty one.

    Values are reduced to one row each first; their places are counted slab by slab along their first arrival.
    """
    seen = df.select(CAPTURE, SEQ, col(value).alias("value")).filter(F.col("value") != "").groupBy(
        CAPTURE, "value").agg(F.min(SEQ).alias(SEQ))
    ranked = running(seen, [CAPTURE], [SEQ], [Running("id", F.lit(1), "sum", inclusive=True)])
    empty = df.select(CAPTURE).distinct().select(CAPTURE, F.lit(0).cast("long").alias("id"), F.lit("").alias("value"))
    return ranked.select(CAPTURE, "id", "value").unionByName(empty)


def encode(df: DataFrame, value: str, dictionary: DataFrame, name: str = "value_id") -> DataFrame:
    """``df`` with the id of ``value``; the empty text and one that the dictionary lacks get 0."""
    ids = dictionary.select(CAPTURE, F.col("value").alias(value), F.col("id").alias(name))
    return df.join(ids, [CAPTURE, value], "left").fillna(0, [name])


def resolve_dictionary(ids: DataFrame, dictionary: DataFrame, name: str = "value_id") -> DataFrame:
    """``ids`` with the text of ``name``; an id that is not defined is an error where it is read."""
    texts = dictionary.select(CAPTURE, F.col("id").alias(name), "value")
    unknown = F.raise_error(F.concat(F.lit("no text has the id "), F.col(name).cast("string")))
    out = ids.join(texts, [CAPTURE, name], "left")
    return out.withColumn("value", F.when(F.col("value").isNotNull(), F.col("value")).otherwise(unknown))


def undefined_ids(ids: DataFrame, dictionary: DataFrame, name: str = "value_id") -> DataFrame:
    """The rows whose id the dictionary does not define."""
    return ids.join(dictionary.select(CAPTURE, F.col("id").alias(name)), [CAPTURE, name], "left_anti")


def track_positions(rows: DataFrame) -> DataFrame:
    """0-based place of each track of a window, by first arrival, counted slab by slab."""
    first = rows.groupBy(CAPTURE, "gid").agg(F.min(SEQ).alias(SEQ))
    return running(first, [CAPTURE], [SEQ], [Running("track_idx", F.lit(1), "sum")]).select(CAPTURE, "gid", "track_idx")


def render_columns(rows: DataFrame, t0: int, tracks: DataFrame | None = None) -> DataFrame:
    """Float32 start and length in ms relative to ``t0`` and the track's place; an unknown track is 0."""
    tracks = track_positions(rows) if tracks is None else tracks
    # The ns are rounded to float32 first.  Spark would merge that cast with the one to DOUBLE; nanvl keeps it.
    rounded = lambda c: F.nanvl(c.cast("float"), F.lit(0.0).cast("float"))
    ms = lambda c: (rounded(c) / 1e6).cast("float")
    return rows.join(tracks, [CAPTURE, "gid"], "left").select(
        CAPTURE, SEQ, ms(F.col("start") - t0).alias("start_ms"), ms(F.col("dur")).alias("dur_ms"),
        F.coalesce("track_idx", F.lit(0)).alias("track_idx"),
    )


def validate_render_columns(rendered: DataFrame, headers: DataFrame) -> DataFrame:
    """Check each capture's rows against its header (``n`` rows, ``n_tracks`` tracks).

    ``problem`` is NULL for a good window, else what the first bad place is.
    """
    stats = rendered.groupBy(CAPTURE).agg(
        F.count(F.lit(1)).alias("rows"), F.min_by("track_idx", SEQ).alias("_any"),
        F.max("track_idx").alias("max_idx"),
    )
    bad_index = rendered.join(headers, CAPTURE).filter(
        (F.col("track_idx") >= F.col("n_tracks")) | (F.col("track_idx") < 0)
    ).groupBy(CAPTURE).agg(F.min_by("track_idx", SEQ).alias("_idx"), F.count(F.lit(1)).alias("bad_rows"))
    out = headers.join(stats, CAPTURE, "left").join(bad_index, CAPTURE, "left").fillna(0, ["rows", "bad_rows"])
    problem = F.when(F.col("rows") != F.col("n"), F.concat(
        F.lit("header says "), F.col("n").cast("string"), F.lit(" rows, found "), F.col("rows").cast("string")
    )).when(F.col("bad_rows") > 0, F.concat(
        F.lit("track place "), F.col("_idx").cast("string"), F.lit(" with "), F.col("n_tracks").cast("string"),
        F.lit(" tracks"),
    ))
    return out.select(CAPTURE, "n", "n_tracks", "rows", "bad_rows", problem.alias("problem"))
