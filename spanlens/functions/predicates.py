"""Row predicates, labels and scores over execution columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BLOCKED_NS, CPU_WARN, I64_MAX, LAG_BAD_MS_S, LAG_WARN_MS_S, LONG_NS
from .arith import col


def is_hub(name) -> Column:
    """The scheduler's own track: its name starts with ``hub`` in any letter case."""
    return F.lower(F.substring(col(name), 1, 3)) == "hub"


def clamp_bound(t):
    """A range bound as a LONG; anything past the LONG range means "no bound"."""
    return F.lit(min(int(t), I64_MAX)) if not isinstance(t, Column) else t


def overlaps(t0, t1, start="start", end="end") -> Column:
    """Strict overlap with ``[t0, t1]``.  Compares stored columns only, so it reaches the Parquet scan."""
    return (col(start) < clamp_bound(t1)) & (col(end) > clamp_bound(t0))


def start_in(after, before, start="start") -> Column:
    """``after < start < before``; both ends are exclusive."""
    return (col(start) > clamp_bound(after)) & (col(start) < clamp_bound(before))


def tier_filter(tier: str, long_ns=LONG_NS, blocked_ns=BLOCKED_NS, dur="dur", hub="is_hub") -> Column:
    """Rows of a slow tier: ``all``, ``long`` or ``blocked``; hub rows never match."""
    band = {
        "all": col(dur) >= long_ns,
        "long": (col(dur) >= long_ns) & (col(dur) < blocked_ns),
        "blocked": col(dur) >= blocked_ns,
    }[tier]
    return ~col(hub) & band


def slow_level(dur="dur", blocked_ns=BLOCKED_NS) -> Column:
    """Level of a slow-log row: 2 blocked, else 1."""
    return F.when(col(dur) >= blocked_ns, 2).otherwise(1)


def timeline_level(dur="dur", hub="is_hub", long_ns=LONG_NS, blocked_ns=BLOCKED_NS) -> Column:
    """Level of any row: 2 blocked, 1 long, 0 otherwise and for the hub."""
    return F.when(col(hub), 0).when(col(dur) >= blocked_ns, 2).when(col(dur) >= long_ns, 1).otherwise(0)


def duration_band(dur="dur", hub="is_hub", long_ns=LONG_NS, blocked_ns=BLOCKED_NS) -> Column:
    return (
        F.when(col(hub), "hub").when(col(dur) >= blocked_ns, "blocked")
        .when(col(dur) >= long_ns, "long").otherwise("ok")
    )


def heat_score(dur="dur", hub="is_hub", long_ns=LONG_NS, blocked_ns=BLOCKED_NS) -> Column:
    """0 at 1 ms or less, 1 at the long threshold (log scale), 2 at the blocked one (linear); hub is NULL."""
    ms = col(dur) / 1e6
    long_ms, blocked_ms = long_ns / 1e6, blocked_ns / 1e6
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    cool = unit(F.ln(ms) / F.ln(F.lit(long_ms))) if long_ms > 1 else F.lit(1.0)
    warm = unit((ms - long_ms) / (blocked_ms - long_ms)) if blocked_ms > long_ms else F.lit(1.0)
    return (
        F.when(col(hub), F.lit(None).cast("double"))
        .when(ms <= 1.0, 0.0).when(ms >= blocked_ms, 2.0).when(ms <= long_ms, cool).otherwise(1.0 + warm)
    )


def track_label(kind, ident) -> Column:
    """``kind-ident``, or just ``kind`` where there is no ident."""
    return F.concat_ws("-", col(kind), col(ident).cast("string"))


def track_name_fallback(name, gid) -> Column:
    """The name, or ``0x`` and the id in lower-case hex where the name is empty."""
    return F.coalesce(F.nullif(col(name), F.lit("")), F.concat(F.lit("0x"), F.lower(F.hex(col(gid)))))


def correlation_id(*candidates) -> Column:
    """First non-NULL candidate with newlines as spaces, else an empty string."""
    first = F.coalesce(*[col(c).cast("string") for c in candidates], F.lit(""))
    return F.replace(first, F.lit("\n"), F.lit(" "))


def stack_gate(mode: str, stack, dur="dur", hub="is_hub", long_ns=LONG_NS) -> Column:
    """The stack a trace mode keeps: ``off`` none, ``all`` every one, ``slow`` those of slow non-hub rows."""
    if mode == "all":
        return col(stack)
    if mode == "off":
        return F.lit("")
    return F.when(~col(hub) & (col(dur) >= long_ns), col(stack)).otherwise("")


def missing_stack_reason(mode, stack) -> Column:
    """``off`` or ``slow`` where that trace mode explains an empty stack, else NULL."""
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    return F.when((col(stack) == "") & mode.isin("off", "slow"), mode)


def evicted_flag(retained_from, origin) -> Column:
    return col(retained_from) > col(origin)


def cpu_tier(fraction) -> Column:
    return F.when(col(fraction) > CPU_WARN, "warn").otherwise("ok")


def lag_tier(lag_ms_s) -> Column:
    return (
        F.when(col(lag_ms_s) >= LAG_BAD_MS_S, "bad").when(col(lag_ms_s) >= LAG_WARN_MS_S, "warn")
        .otherwise("ok")
    )


def arrival_lag(now_ms, epoch_ms, span_ns, live, stalled) -> Column:
    """Milliseconds the newest data trails ``now_ms``; 0 when not live, stalled or without an epoch."""
    trails = F.greatest(F.lit(0.0), (col(now_ms) - col(epoch_ms)).cast("double") - col(span_ns) / 1e6)
    return F.when(col(live) & ~col(stalled) & col(epoch_ms).isNotNull(), trails).otherwise(0.0)


def arrival_lag_tier(lag_ms) -> Column:
    return F.when(col(lag_ms) >= 5000, "danger").when(col(lag_ms) >= 1000, "warn").otherwise("ok")
