"""Text forms of durations, sizes, rates and clock times."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arith import col, fixed_text, int_div


def fmt_ns(ns) -> Column:
    """Report form: ``1.25s``, ``3.4ms``, ``5.6µs``, ``7ns``."""
    n = col(ns)
    return (
        F.when(n >= 1_000_000_000, F.concat(fixed_text(n / 1e9, 2), F.lit("s")))
        .when(n >= 1_000_000, F.concat(fixed_text(n / 1e6, 1), F.lit("ms")))
        .when(n >= 1_000, F.concat(fixed_text(n / 1e3, 1), F.lit("µs")))
        .otherwise(F.concat(n.cast("string"), F.lit("ns")))
    )


def format_time(ms) -> Column:
    """Compact axis form of a DOUBLE number of milliseconds."""
    m = col(ms)
    size = F.abs(m)
    return (
        F.when(size < 1e-3, F.concat(fixed_text(m * 1e6, 0, "up"), F.lit(" ns")))
        .when(size < 0.1, F.concat(fixed_text(m * 1e3, 1, "up"), F.lit(" µs")))
        .when(size < 1.0, F.concat(fixed_text(m * 1e3, 0, "up"), F.lit(" µs")))
        .when(size < 10.0, F.concat(fixed_text(m, 2, "up"), F.lit(" ms")))
        .when(size < 1e3, F.concat(fixed_text(m, 1, "up"), F.lit(" ms")))
        .otherwise(F.concat(fixed_text(m / 1e3, 2, "up"), F.lit(" s")))
    )


def format_time_precise(ms) -> Column:
    """Nanosecond-exact form with trailing zeros trimmed."""
    ns = F.floor(col(ms) * 1e6 + 0.5).cast("long")
    size = F.abs(ns)
    sign = F.when(ns < 0, "-").otherwise("")

    def scaled(places, unit):
        ten = F.lit(10**places)
        text = F.concat(
            sign, int_div(size, ten).cast("string"), F.lit("."),
            F.lpad(F.pmod(size, ten).cast("string"), places, "0"),
        )
        return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit(" " + unit))

    return (
        F.when(size < 1_000, F.concat(ns.cast("string"), F.lit(" ns")))
        .when(size < 1_000_000, scaled(3, "µs"))
        .when(size < 1_000_000_000, scaled(6, "ms"))
        .otherwise(scaled(9, "s"))
    )


def _size_ladder(n, units, text):
    """Pick the largest of ``units`` (each 1024 times the one before) that leaves at least 1."""
    out = text(n / float(1024 ** len(units)), units[-1])
    for step in range(len(units) - 1, 0, -1):
        out = F.when(n < 1024 ** (step + 1), text(n / float(1024**step), units[step - 1])).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def human_bytes(n) -> Column:
    """Report form, one decimal, up to GB."""
    return _size_ladder(
        col(n), ["KB", "MB", "GB"], lambda v, u: F.concat(fixed_text(v, 1), F.lit(" " + u))
    )


def format_bytes(n) -> Column:
    """Header form: one decimal below 10, none above, up to TB."""
    def text(v, unit):
        number = F.when(v < 10, fixed_text(v, 1, "up")).otherwise(fixed_text(v, 0, "up"))
        return F.concat(number, F.lit(" " + unit))

    return _size_ladder(col(n), ["KB", "MB", "GB", "TB"], text)


def format_rate(per_second) -> Column:
    r = col(per_second)
    return (
        F.when(r >= 1000, F.concat(fixed_text(r / 1000.0, 1, "up"), F.lit("k/s")))
        .when(r < 10, F.concat(fixed_text(r, 1, "up"), F.lit("/s")))
        .otherwise(F.concat(fixed_text(r, 0, "up"), F.lit("/s")))
    )


def pct(n, total) -> Column:
    """``n / total`` as a percentage with one decimal; ``0.0%`` of nothing."""
    share = col(n).cast("double") / F.nullif(col(total), F.lit(0)).cast("double") * 100.0
    return F.coalesce(F.concat(fixed_text(share, 1), F.lit("%")), F.lit("0.0%"))


def axis_clock(t_ms, epoch_ms, mode: str = "utc", zone: str = "UTC") -> Column:
    """Axis label: ``HH:mm:ss.SSS`` in UTC or ``zone``; the relative form without an epoch."""
    relative = format_time(t_ms)
    if mode == "relative":
        return relative
    at = (col(epoch_ms) + col(t_ms)).cast("long")
    if mode == "local":
        at = F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(at), zone))
    of_day = F.pmod(at, F.lit(86_400_000))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat(
        two(int_div(of_day, 3_600_000)), F.lit(":"), two(F.pmod(int_div(of_day, 60_000), F.lit(60))),
        F.lit(":"), two(F.pmod(int_div(of_day, 1000), F.lit(60))), F.lit("."),
        F.lpad(F.pmod(of_day, F.lit(1000)).cast("string"), 3, "0"),
    )
    return F.when(col(epoch_ms).isNull(), relative).otherwise(clock)


def nice_step(raw) -> Column:
    """``raw`` rounded up to 1, 2 or 5 times a power of ten."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(col(raw))).cast("double"))
    f = col(raw) / power
    return F.when(f <= 1, 1.0).when(f <= 2, 2.0).when(f <= 5, 5.0).otherwise(10.0) * power
