"""Fields out of collected process and cgroup status texts (one text per row)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arith import col


def _number(text):
    return F.coalesce(F.expr("null").cast("long") if text is None else text.try_cast("long"), F.lit(0))


def parse_proc_status(text) -> Column:
    """``Key: value`` lines as STRUCT<name, state, threads, rss_kb, vm_peak_kb, ctxt switches>.

    A line that is absent leaves NULL; a number that does not parse becomes 0.
    """
    t = col(text)

    def field(key):
        hit = F.regexp_extract(t, rf"(?m)^{key}:(.*)$", 1)
        return F.when(F.regexp_like(t, F.lit(rf"(?m)^{key}:")), F.trim(F.translate(hit, "\t\r", "  ")))

    def count(key):
        v = field(key)
        return F.when(v.isNotNull(), _number(F.when(F.regexp_like(v, F.lit(r"^\+?[0-9]+$")), v)))

    def kilobytes(key):
        v = field(key)
        return F.when(v.isNotNull(), _number(F.regexp_extract(v, r"^([0-9]+)(\s|$)", 1)))

    return F.struct(
        field("Name").alias("name"), field("State").alias("state"), count("Threads").alias("threads"),
        kilobytes("VmRSS").alias("rss_kb"), kilobytes("VmPeak").alias("vm_peak_kb"),
        count("voluntary_ctxt_switches").alias("voluntary_ctxt"),
        count("nonvoluntary_ctxt_switches").alias("involuntary_ctxt"),
    )


def _words(text):
    return F.split(F.trim(F.regexp_replace(col(text), r"\s+", " ")), " ")


def parse_schedstat(text) -> Column:
    """STRUCT<on_cpu_ns, runq_ns> of a schedstat line; NULL unless both numbers parse."""
    w = _words(text)
    on_cpu, runq = F.get(w, F.lit(0)).try_cast("long"), F.get(w, F.lit(1)).try_cast("long")
    both = on_cpu.isNotNull() & runq.isNotNull()
    return F.when(both, F.struct(on_cpu.alias("on_cpu_ns"), runq.alias("runq_ns")))


def parse_cpu_stat(text) -> Column:
    """STRUCT<nr_periods, nr_throttled, throttled_usec>; a field that is absent is 0."""
    def count(key):
        return _number(F.regexp_extract(col(text), rf"(?m)^{key}\s+([0-9]+)(\s|$)", 1))

    return F.struct(*[count(k).alias(k) for k in ("nr_periods", "nr_throttled", "throttled_usec")])


def parse_psi(text) -> Column:
    """The ``avg10`` number of the ``some`` line of a pressure text, or NULL."""
    return F.regexp_extract(col(text), r"(?m)^some .*?\bavg10=(\S+)", 1).try_cast("double")


def parse_cpu_max(text) -> Column:
    """Quota in whole CPUs; NULL when unlimited.  The period defaults to 100000."""
    w = _words(text)
    quota = F.get(w, F.lit(0)).try_cast("double")
    period = F.coalesce(F.get(w, F.lit(1)).try_cast("double"), F.lit(100_000.0))
    return F.when((F.get(w, F.lit(0)) != "max") & (period > 0), F.try_divide(quota, period))
