"""What the operators on texts share."""

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arith import int_div, shift_left
from ..storage import stored

#: ASCII white space, between words: space and \t \n \v \f \r, as a regular expression.
SPACE = r"[\x20\x09-\x0D]"
BATCH_ROWS, BATCH_BYTES, PART_ROWS = 2000, 8 << 20, 400
#: What modules remember in a Python worker, and the module whose step ran last in it.
_remembered: list[dict] = []
_last = [""]


def whole(text) -> Column:
    """The text as it is; a null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def remembered() -> dict:
    """A dictionary that a worker keeps from task to task, until a step of another module runs in it."""
    _remembered.append({})
    return _remembered[-1]


def forget(module: str) -> None:
    """What modules remembered goes, unless the last step in this process was of the same ``module``."""
    if _last[0] != module:
        _last[0] = module
        for held in _remembered:
            held.clear()


def hand_back() -> None:
    """Memory that is free in this process goes back to the machine, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def frugal(step: Callable, module: str) -> Callable:
    """``step`` for workers that live on: they forget what other modules remembered before it, and hand free memory back after.

    An executor keeps its workers, often more than it has cores, and waiting ones count against its memory in later stages.
    """

    def told(batches):
        forget(module)
        yield from step(batches)
        hand_back()

    return told


def map_arrow(df: DataFrame, step: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` in batches small enough for very long texts.

    The batch limits belong to the session; larger ones are lowered, smaller ones of the caller stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = str(conf.get(name))
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df.mapInArrow(frugal(step, step.__module__), schema)


def parts(batches, rows: int = PART_ROWS):
    """Batches a few hundred texts long, for what holds their words and tokens several times over."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def names_apart(df: DataFrame, *wanted: str) -> list[str]:
    """Helper column names that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of the arrays that rows are parted by before a join; with more keys than half of them they spare little.
PART_BITS = 1 << 23


def may_hold(wanted: DataFrame, key: str, bits: int = PART_BITS) -> Column:
    """A condition on rows with a column ``key``: true where ``wanted`` has it, and rarely where it doesn't.

    The keys of ``wanted`` set bits by their hash in an array of fixed size (1 MB), which reaches the scan as a scalar
    subquery, so rows are told apart where they are read.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    word, bit = int_div(place, 64), F.pmod(place, F.lit(64))
    marks = wanted.select(word.alias("word"), shift_left(F.lit(1).cast("long"), bit).alias("bit"))
    held = marks.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = wanted.sparkSession.range(bits // 64).select(F.col("id").alias("word")).join(held, "word", "left")
    # Rows of this aggregate are as many as the array has words, whatever the tables hold.
    dense = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all"))
    array = dense.select(F.transform("all", lambda w: w["bits"])).scalar()
    return F.getbit(F.get(array, word.cast("int")), bit.cast("int")) == 1


def without(df: DataFrame, gone: DataFrame, ids: DataFrame, key: str, bits: int = PART_BITS) -> DataFrame:
    """``df.join(gone, key, "left_anti")`` without a shuffle of most rows.  ``ids`` has the ``key`` of every row of ``df``.

    Rows whose bit is not set among those of ``gone`` stay.  Of the others those that stay set bits, too, and only rows with
    both bits are joined.
    """
    chosen = may_hold(gone, key, bits)
    spared = stored(ids.select(key).filter(chosen).join(gone, key, "left_anti"), "spared-ids")
    both = df.filter(chosen & may_hold(spared, key, bits)).join(gone.select(key), key, "left_anti").select(*df.columns)
    return df.filter(~chosen).unionByName(both)


def keyed(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``df`` with a column that tells its rows apart, and its name: the ids where none repeats or is null, else numbers
    in a stored copy."""
    row, = names_apart(df, "row")
    odd = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
    if odd.isEmpty():
        return df, id_col
    return stored(df.withColumn(row, F.monotonically_increasing_id()), "numbered-rows"), row
