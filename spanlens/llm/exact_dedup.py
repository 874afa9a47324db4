"""Exact duplicates by digest, with frequent digests handled apart.

A Misra-Gries pass names every digest that may hold ``support`` of all rows, at most ``1 / support`` of them.  Their
exact sizes and smallest ids are counted (which verifies them) and broadcast, so copies of a frequent text are
answered or removed where they are read.  All other digests are shuffled as usual; none of them can hold more than
``support`` of the rows.

Defined cases: a null text is an empty one; null ids come after all others and ``keep_id`` is null only where a group
has no other id; of rows that repeat the smallest id as well as the text, exactly one stays; an empty table gives an
empty result; other columns of the input are left alone, whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .common import SPACE, keyed, whole, without

#: Share of all rows from which a digest counts as frequent; the broadcast has at most 1 / SUPPORT rows.
SUPPORT = 0.001


def normal_text(text: str) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(whole(text), f"{SPACE}+", " ")


def text_digest(text: str) -> Column:
    """SHA-256 of the normalised text in UTF-8, as text: Spark's counters compare binary values by reference."""
    return F.sha2(normal_text(text), 256)


def _digest_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, digest) of every row, stored: the texts are read once."""
    return stored(
        df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                  text_digest(text_col).alias("digest")),
        "digests",
    )


def _frequent(digests: DataFrame, support: float) -> DataFrame:
    """(digest, first, n) of the digests that the Misra-Gries counters hold, each counted exactly.

    ``first`` is the (id, row) that stays.  At most ``1 / support`` rows.
    """
    held = digests.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    return stored(
        digests.join(F.broadcast(held), "digest").groupBy("digest")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")),
        "frequent-digests",
    )


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row for each row of ``df``: its id, ``keep_id`` (the smallest id with an equal text), ``group_size``,
    ``kept`` and ``text_sha256``."""
    digests = _digest_table(df, id_col, text_col)
    frequent = F.broadcast(_frequent(digests, support))
    heavy = digests.join(frequent, "digest").select(
        "id", "digest", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
    )
    group = Window.partitionBy("digest")
    rest = digests.join(frequent, "digest", "left_anti").select(
        "id", "digest", F.min("id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("id").asc_nulls_last(), "row")) == 1).alias("kept"),
    )
    return heavy.unionByName(rest).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept",
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    support: float = SUPPORT) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Which rows go is decided on ids and digests alone; texts are parted by these ids where they are read, and few are
    shuffled.
    """
    df, key = keyed(df, id_col)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("of"), F.col(key).alias("key"))
    digests = stored(df.select(F.col(key).alias("row"), F.col(id_col).alias("id"), order.alias("order"),
                               text_digest(text_col).alias("digest")), "digests")
    frequent = _frequent(digests, support)
    heavy = digests.join(F.broadcast(frequent), "digest").filter(F.col("row") != F.col("first.row"))
    rest = digests.join(F.broadcast(frequent), "digest", "left_anti")
    # The first of each group of two or more is aggregated before the shuffle and joined back.
    first = rest.groupBy("digest").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    light = rest.join(first, "digest").filter(F.col("order") != F.col("first"))
    gone = stored(heavy.select(F.col("row").alias(key)).unionByName(light.select(F.col("row").alias(key))), "copies")
    return without(df, gone, digests.select(F.col("row").alias(key)), key).select(*[c for c in df.columns if c != key or key == id_col])
