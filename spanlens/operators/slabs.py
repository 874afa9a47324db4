"""Ordered computations that stay parallel when one key holds most of the rows.

A window over ``capture_id`` alone sorts a whole capture in one task.  Here a capture is first cut into slabs
of bounded size along its order.  Each slab is windowed on its own, each slab is also reduced to one summary
row, and the small summary table carries values from slab to slab.  Both sides are partitioned by
(key, slab), so the large side is shuffled once.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arith import floor_div, int_div, shift_left, shift_right
from ..schema import CAPTURE, SEQ

SLAB_ROWS = 1 << 18
SLAB = "_slab"


def arrival_slab(seq=SEQ, rows: int = SLAB_ROWS) -> Column:
    """Slab number of an arrival number.  ``seq`` is unique in a capture, so a slab has at most ``rows``."""
    return floor_div(seq, rows)


@dataclass(frozen=True)
class Running:
    """One running value.

    ``how``: ``sum``, ``max`` or ``last`` of the rows before, ``next`` for the first non-NULL value after,
    ``sum_after`` for the sum of the rows after.
    ``inclusive`` counts the row itself.
    """

    name: str
    value: Column
    how: str
    inclusive: bool = False


def running(df: DataFrame, by, order, specs, slab: Column | None = None) -> DataFrame:
    """Add the running values ``specs`` along ``order`` inside each ``by`` group, slab by slab.

    ``order`` is unique in a group, and its first column orders the non-NULL values alone.  Values are plain
    numbers, so the slab summaries are hash aggregates.  What looks ahead runs over the reversed order: a
    frame that ends at the last row would cost the square of a slab's size.
    """
    by, order = list(by), list(order)
    slab = arrival_slab(order[0]) if slab is None else slab
    values = {s.name: f"_v_{s.name}" for s in specs}
    base = df.withColumns({SLAB: slab, **{values[s.name]: s.value for s in specs}})
    ahead = ("next", "sum_after")

    def summary(s):
        v = F.col(values[s.name])
        at = F.when(v.isNotNull(), F.col(order[0]))
        reduced = {"max": F.max, "last": lambda c: F.max_by(c, at), "next": lambda c: F.min_by(c, at)}
        return reduced.get(s.how, F.sum)(v).alias(f"_s_{s.name}")

    def seen(s, keys, columns, edge):
        """The frame of the rows already passed: before this one, or after it when looking ahead."""
        along = [F.col(c).desc() if s.how in ahead else F.col(c).asc() for c in columns]
        return Window.partitionBy(*keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, -edge)

    def over(s, column, frame):
        kinds = {"max": F.max, "last": lambda c: F.last(c, True), "next": lambda c: F.last(c, True)}
        return kinds.get(s.how, F.sum)(F.col(column)).over(frame)

    carries = (
        base.groupBy(*by, SLAB).agg(*[summary(s) for s in specs])
        .select(*by, SLAB, *[
            over(s, f"_s_{s.name}", seen(s, by, [SLAB], 1)).alias(f"_c_{s.name}") for s in specs
        ])
    )

    def combine(s):
        here = over(s, values[s.name], seen(s, [*by, SLAB], order, 0 if s.inclusive else 1))
        carried = F.col(f"_c_{s.name}")
        if s.how in ("sum", "sum_after"):
            return F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))
        return F.greatest(here, carried) if s.how == "max" else F.coalesce(here, carried)

    out = base.join(carries, [*by, SLAB], "left")
    return out.select(*df.columns, *[combine(s).alias(s.name) for s in specs])


#: Bits of the array that ``prune`` marks wanted keys in; with more keys than half of them it drops little.
PRUNE_BITS = 1 << 18


def prune(rows: DataFrame, wanted: DataFrame, keys, bits: int = PRUNE_BITS) -> DataFrame:
    """Drop rows whose ``keys`` are surely not in ``wanted``, before a join with it shuffles them.

    The wanted keys set bits by their hash in a fixed 32 KB array, which reaches the scan as a scalar
    subquery.  Other keys may share a bit, so the join still decides.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    bit = shift_left(F.lit(1).cast("long"), F.pmod(F.col("_place"), F.lit(64)))
    words = wanted.select(place.alias("_place")).groupBy(int_div("_place", 64).alias("_w")).agg(
        F.bit_or(bit).alias("_bits")
    )
    dense = words.agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("_m")).select(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.lit(bits // 64 - 1).cast("long")),
            lambda w: F.coalesce(F.element_at("_m", w), F.lit(0).cast("long")),
        )
    )
    word = F.element_at(dense.scalar(), int_div(place, 64).cast("int") + 1)
    return rows.filter(F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1)


def slice_by_arrival(df: DataFrame, lower, upper, facts: DataFrame | None = None,
                     slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Rows whose 0-based arrival rank in their capture is in ``[lower(n), upper(n))``, n = rows in all.

    Adds ``total`` (n).  ``facts`` has one row for each capture whose columns the two bounds may use.  Only
    slabs that meet the range are read again and ranked, so a cap over a huge capture neither sorts it nor
    moves it to one task.
    """
    base = df.withColumn(SLAB, arrival_slab(rows=slab_rows))
    earlier = Window.partitionBy(CAPTURE).orderBy(SLAB).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        base.groupBy(CAPTURE, SLAB).agg(F.count(F.lit(1)).alias("_n"))
        .select(
            CAPTURE, SLAB, "_n",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy(CAPTURE)).alias("total"),
        )
    )
    if facts is not None:
        counts = counts.join(facts, CAPTURE)
    met = (
        counts.withColumns({"_lo": lower(F.col("total")), "_hi": upper(F.col("total"))})
        .filter((F.col("_before") < F.col("_hi")) & (F.col("_before") + F.col("_n") > F.col("_lo")))
        .select(CAPTURE, SLAB, "_before", "total", "_lo", "_hi")
    )
    place = F.row_number().over(Window.partitionBy(CAPTURE, SLAB).orderBy(SEQ))
    return (
        prune(base, met, [CAPTURE, SLAB]).join(met, [CAPTURE, SLAB])
        .withColumn("_rank", F.col("_before") + place - 1)
        .filter((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
        .select(*df.columns, "total")
    )


def top_n(df: DataFrame, order, n: int, by=(CAPTURE,), spread: str | None = SEQ, salts: int = 64):
    """The first ``n`` rows of each group along ``order``, with their 1-based ``rank``.

    Ranks first inside ``salts`` sub-groups, where Spark keeps at most n rows per map task, and then among the
    survivors, so one group's rows never meet in one task.
    """
    by = list(by)
    if spread is not None:
        salt = F.pmod(F.xxhash64(spread), F.lit(salts))
        first = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(first))
            .filter(F.col("_r") <= n).drop("_salt", "_r")
        )
    final = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= n)


def exact_quantiles(df: DataFrame, value: str, probabilities: dict, by=(CAPTURE,)) -> DataFrame:
    """Exact linearly interpolated quantiles of a non-negative LONG, one row per group.

    ``percentile`` keeps every distinct value of a group in one task.  Here a logarithmic histogram (at most
    65,536 cells a group) finds the cells that hold the wanted ranks, and only those cells are counted value
    by value, in slabs of 65,536 values: a cell at a minute spans 40 million.
    """
    by = list(by)
    cell = F.floor(F.log2(F.col(value).cast("double") + 1.0) * 1024).cast("int").alias("_cell")
    base = df.select(*by, F.col(value).alias("_value"), cell)
    along = Window.partitionBy(*by).orderBy("_cell")
    cells = (
        base.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *by, "_cell", "_n",
            (F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
            F.sum("_n").over(Window.partitionBy(*by)).alias("_total"),
        )
    )
    wants = F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            ((F.col("_total") - 1) * F.lit(p)).alias("at"),
        )
        for name, p in probabilities.items()
    ])
    wanted = (
        cells.select(*by, "_cell", "_n", "_before", F.explode(wants).alias("_w"))
        .select(
            *by, "_cell", "_before", F.col("_w.name").alias("_q"),
            F.col("_w.at").alias("_at"), F.floor("_w.at").alias("_lo"), F.ceil("_w.at").alias("_hi"), "_n",
        )
        .filter((F.col("_lo") < F.col("_before") + F.col("_n")) & (F.col("_hi") >= F.col("_before")))
        .drop("_n")
    )
    picked = wanted.select(*by, "_cell", "_before").distinct()
    counted = (
        prune(base, picked, [*by, "_cell"]).join(picked, [*by, "_cell"]).groupBy(*by, "_cell", "_before", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    values = (
        running(counted, [*by, "_cell"], ["_value"], [Running("_upto", F.col("_n"), "sum", True)],
                shift_right("_value", 16))
        .withColumn("_last", F.col("_before") - 1 + F.col("_upto"))
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
        .drop("_before", "_upto")
    )
    holds = lambda rank: (F.col(rank) >= F.col("_first")) & (F.col(rank) <= F.col("_last"))
    ends = (
        values.join(wanted.drop("_before"), [*by, "_cell"]).groupBy(*by, "_q", "_at", "_lo")
        .agg(F.max(F.when(holds("_lo"), F.col("_value"))).alias("_a"),
             F.max(F.when(holds("_hi"), F.col("_value"))).alias("_b"))
        .withColumn("_value", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_lo")))
    )
    return ends.groupBy(*by).agg(*[
        F.max(F.when(F.col("_q") == name, F.col("_value"))).cast("double").alias(name) for name in probabilities
    ])
