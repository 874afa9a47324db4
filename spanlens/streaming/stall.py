"""Live stall monitor: a timer for each capture that fires whether or not rows arrive."""

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..schema import CAPTURE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COUNT = "capture_id string, new_rows long, new_bytes long"
_OUT = (
    "capture_id string, at_ms long, total long, new_rows long, rows_per_s long, kib_per_s long, "
    "stalled boolean, transition string"
)


class _Monitor(StatefulProcessor):
    def __init__(self, interval_ms):
        self.interval_ms = interval_ms

    def init(self, handle):
        self.handle = handle
        self.counts = handle.getValueState("counts", "total long, rows long, bytes long, stalled boolean")

    def _load(self):
        return self.counts.get() if self.counts.exists() else None

    def handleInputRows(self, key, rows, timerValues):
        held = self._load()
        total, new, size, stalled = held or (0, 0, 0, False)
        if held is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.interval_ms)
        for batch in rows:
            n, b = int(batch["new_rows"].sum()), int(batch["new_bytes"].sum())
            total, new, size = total + n, new + n, size + b
        self.counts.update((total, new, size, stalled))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        total, new, size, was = self._load()
        seconds = self.interval_ms / 1000
        stalled = total > 0 and new == 0
        change = None if stalled == was else "stalled" if stalled else "resumed"
        self.counts.update((total, 0, 0, stalled))
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.interval_ms)
        yield pd.DataFrame([{
            "capture_id": key[0], "at_ms": at, "total": total, "new_rows": new,
            "rows_per_s": int(new / seconds + 0.5), "kib_per_s": int(size / seconds / 1024 + 0.5),
            "stalled": stalled, "transition": change,
        }])

    def close(self):
        pass


def _count(batches):
    for batch in batches:
        n = batch.groupby(CAPTURE, as_index=False).agg(new_rows=("bytes", "size"), new_bytes=("bytes", "sum"))
        yield n.astype({CAPTURE: object, "new_rows": "int64", "new_bytes": "int64"})


def stall_monitor(stream: DataFrame, interval_ms: int = 5000) -> DataFrame:
    """One row for each capture and interval: throughput, ``stalled`` and its transitions.

    Rows (``capture_id``, ``bytes``) are counted in the map stage, so only counts reach a capture's state.
    The session needs the RocksDB state store (``ROCKSDB``).
    """
    counts = stream.select(CAPTURE, F.col("bytes").cast("long").alias("bytes")).mapInPandas(_count, _COUNT)
    return counts.groupBy(CAPTURE).transformWithStateInPandas(
        statefulProcessor=_Monitor(interval_ms), outputStructType=_OUT, outputMode="append",
        timeMode="processingTime",
    )
