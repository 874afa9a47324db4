"""Table schemas and the fixed default values of the data model."""

from pyspark.sql import types as T

CAPTURE = "capture_id"
SEQ = "seq"

# Thresholds and labels of the data model.
LONG_NS = 20_000_000
BLOCKED_NS = 50_000_000
REPORT_TOP = 10
OVERFLOW_LABEL = "…(other greenlets)"
STACK_SEPARATOR = " <- "
DETAIL_SLACK_NS = 2_000_000
DELTA_MAX = (1 << 24) - 1
STALL_INTERVAL_NS = 5_000_000_000
LAG_FULL_SCALE_MIN = 50.0
CPU_WARN = 0.9
LAG_WARN_MS_S = 20.0
LAG_BAD_MS_S = 50.0
I64_MAX = 9223372036854775807


def _table(**columns):
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_L, _S, _D, _B = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()

SWITCHES = _table(
    capture_id=_S, seq=_L, thread=_L, ts=_L, target=_L, label=_S, func=_S, task=_S, stack=_S
)
EXECUTIONS = _table(
    capture_id=_S, seq=_L, gid=_L, start=_L, dur=_L, end=_L, name=_S, func=_S, task=_S, stack=_S,
    is_hub=_B,
)
GC_EVENTS = _table(capture_id=_S, seq=_L, start=_L, dur=_L, generation=_L, collected=_L, end=_L)
SYS_SAMPLES = _table(capture_id=_S, seq=_L, start=_L, lag_ms_s=_D, cpu_ms_s=_D)
SESSION_META = _table(capture_id=_S, seq=_L, epoch_ms=_L, tid=_L, pid=_L, pyinfo=_S)
