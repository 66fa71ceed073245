"""Stateful monitoring of sensors in a stream.

One state per sensor: the two sums of a CUSUM test for drift, the last reading, and the
readings that are not yet older than the watermark. Readings are taken in the order of
their time once the watermark has passed them, so the alarms don't depend on how they
arrive; event-time timers raise the alarm of a silent sensor and drop the state of one
that is gone.

The waiting readings lie in the state as sorted runs cut into blocks. Python holds the
run that is being sorted, or the blocks that are being merged, never all readings of a
sensor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.timefn import freq_micros, from_micros, to_micros
from ..operators.layout import spread_join
from .stream import event_time

ALARMS = "series_id string, us long, kind string, score double"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


RUN = 1 << 17             # readings that are sorted or merged at once
BLOCK = 1 << 12           # waiting readings that are one entry of the state


def _turned(bits: np.ndarray) -> np.ndarray:
    """The bits of doubles as whole numbers of the same order, NaN last, and back."""
    return bits ^ (bits >> 63 & np.int64(2**63 - 1))


def _packed(pdf: pd.DataFrame) -> np.ndarray:
    """(us, rank of z) of readings."""
    z = pdf["z"].to_numpy(np.float64, na_value=np.nan)
    return np.stack([pdf["us"].to_numpy(np.int64), _turned(np.where(np.isnan(z), np.nan, z).view(np.int64))], axis=1)


def _sorted(parts: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(parts)
    return x[np.lexsort((x[:, 1], x[:, 0]))]


class DriftMonitor(StatefulProcessor):
    """Times are microseconds; ``slack`` and ``limit`` are in sd of the reading."""

    def __init__(self, slack: float, limit: float, silence: int, forget: int):
        self.slack, self.limit, self.silence, self.forget = slack, limit, silence, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "up double, down double, last long, silent boolean")
        # a block by its first reading; no two blocks of a sensor have the same number
        self.waiting = handle.getMapState("waiting", "us long, rank long, number long", "readings binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        blocks = list(self.waiting.keys())
        new: list[np.ndarray] = []
        for pdf in rows:
            new.append(_packed(pdf))
            if sum(map(len, new)) >= RUN:
                self._keep(_sorted(new), blocks)
                new = []
        if new:
            self._keep(_sorted(new), blocks)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000, blocks)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000, list(self.waiting.keys()))

    def _keep(self, run: np.ndarray, blocks: list[tuple]) -> None:
        """Put sorted readings into the state and their blocks' keys into ``blocks``."""
        number = 1 + max((b[2] for b in blocks), default=0)
        for k, at in enumerate(range(0, len(run), BLOCK)):
            blocks.append((int(run[at, 0]), int(run[at, 1]), number + k))
            self.waiting.updateValue(blocks[-1], (run[at:at + BLOCK].tobytes(),))

    def _due(self, blocks: list[tuple], now: int) -> Iterator[np.ndarray]:
        """The readings up to ``now`` in their order, part by part; they leave the state,
        and ``blocks`` keeps the keys of those that stay."""
        ahead = sorted(b for b in blocks if b[0] <= now)
        blocks[:] = [b for b in blocks if b[0] > now]
        open_, k = np.empty((0, 2), np.int64), 0
        while k < len(ahead):
            got = [open_]
            while k < len(ahead) and sum(map(len, got[1:])) < RUN:
                got.append(np.frombuffer(self.waiting.getValue(ahead[k])[0], np.int64).reshape(-1, 2))
                self.waiting.removeKey(ahead[k])
                k += 1
            open_ = _sorted(got)
            us = open_[:, 0]
            cut = np.searchsorted(us, now, "right")
            if k < len(ahead):           # the other blocks hold nothing before the next one's first reading
                lo, hi = np.searchsorted(us, ahead[k][0], "left"), np.searchsorted(us, ahead[k][0], "right")
                cut = min(cut, lo + np.searchsorted(open_[lo:hi, 1], ahead[k][1], "right"))
            yield open_[:cut]
            open_ = open_[cut:]
        self._keep(open_, blocks)

    def _advance(self, key, now: int, blocks: list[tuple]) -> Iterator[pd.DataFrame]:
        """Take the readings up to ``now``, the watermark, and set the next timer."""
        up, down, last, silent = self.sums.get() if self.sums.exists() else (0.0, 0.0, None, False)
        out: list[tuple] = []
        for ready in self._due(blocks, now):
            for us, z in zip(ready[:, 0].tolist(), _turned(ready[:, 1]).view(np.float64).tolist(), strict=True):
                if last is not None and us - last > self.silence and not silent:
                    out.append((last + self.silence, "silent", 0.0))
                up, down = max(0.0, up + z - self.slack), max(0.0, down - z - self.slack)
                for kind, x in (("drift_up", up), ("drift_down", down)):
                    if x > self.limit:
                        out.append((us, kind, x))
                up, down = (0.0 if x > self.limit else x for x in (up, down))
                last, silent = us, False
            if out:
                yield self._alarms(key, out)
                out = []
        if last is not None and not silent and last + self.silence <= now:
            out.append((last + self.silence, "silent", 0.0))
            silent = True
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if last is not None and not blocks and last + self.forget <= now:
            self.sums.clear()
        else:
            if last is not None:
                self.sums.update((up, down, last, silent))
            due = [min(b[0] for b in blocks)] if blocks else []
            if last is not None:
                due.append(last + (self.forget if silent else self.silence))
            if due:
                self.handle.registerTimer(max(min(due), now) // 1000 + 1)
        if out:
            yield self._alarms(key, out)

    @staticmethod
    def _alarms(key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"series_id": [key[0]] * len(out), "us": [o[0] for o in out],
                             "kind": [o[1] for o in out], "score": [o[2] for o in out]})

    def close(self) -> None:
        pass


def drift_alarms(readings: DataFrame, params: DataFrame, slack: float = 0.5, limit: float = 5.0,
                 silence: str = "1 hour", forget: str = "7 days", watermark: str = "10 minutes") -> DataFrame:
    """Alarms (series_id, ts, kind, score) of a stream of readings.

    ``drift_up`` / ``drift_down``: a CUSUM of the z-scores (``params``: series_id, mean,
    std) above ``slack`` passes ``limit``; its sum starts anew. ``silent``: no reading
    for longer than ``silence``, raised at last reading + silence, once per pause.
    Readings older than the watermark are dropped; a sensor is forgotten, with its
    state, ``forget`` after its last reading. Null values and readings without a time take
    no part. Equal times are taken in the order of their z."""
    spark = readings.sparkSession
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    x = spread_join(readings.where("value is not null and ts is not null"), params.select("series_id", "mean", "std"), ["series_id"], by="ts")
    x = (x.withColumn("_et", event_time()).withWatermark("_et", watermark)
         .select("series_id", "_et", to_micros("ts").alias("us"), ((F.col("value") - F.col("mean")) / F.col("std")).alias("z")))
    monitor = DriftMonitor(slack, limit, freq_micros(silence), freq_micros(forget))
    out = x.groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=monitor, outputStructType=ALARMS, outputMode="append", timeMode="EventTime")
    return out.select("series_id", from_micros(F.col("us")).alias("ts"), "kind", "score")
