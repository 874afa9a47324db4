"""Exact integer and fixed-point text helpers shared by the column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c):
    return F.col(c) if isinstance(c, str) else c


def int_div(a, b) -> Column:
    """Integer quotient rounded toward zero, without a detour through DOUBLE."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", col(a), b)


def floor_div(a, b) -> Column:
    """Integer quotient rounded toward minus infinity."""
    a = col(a)
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a - F.pmod(a, b), b)


def shift_right(a, bits) -> Column:
    """Arithmetic shift; ``bits`` may differ from row to row."""
    bits = bits if isinstance(bits, Column) else F.lit(bits)
    return F.call_function("shiftright", col(a), bits.cast("int"))


def shift_left(a, bits) -> Column:
    bits = bits if isinstance(bits, Column) else F.lit(bits)
    return F.call_function("shiftleft", col(a), bits.cast("int"))


def fixed_text(value, places: int, ties: str = "even") -> Column:
    """``value`` (DOUBLE) with ``places`` decimals, rounded on its exact binary value.

    ``format_string`` and ``round`` work on the shortest decimal form of a double, so 6.55 (stored slightly
    below) becomes 6.6; ``format_number`` rounds the stored value, an exact tie to even.  With ``ties="up"``
    an exact tie (twice the value times 2^places is then an odd integer) goes away from zero.
    """
    v = col(value)
    if ties == "up":
        is_tie = F.pmod(F.abs(v) * float(2 ** (places + 1)), F.lit(2.0)) == 1.0
        v = F.when(is_tie, v * (1.0 + 2.0**-40)).otherwise(v)
    pattern = "0." + "0" * places if places else "0"
    return F.call_function("format_number", v, F.lit(pattern))
