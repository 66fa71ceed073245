"""Zone-free time arithmetic on TIMESTAMP_NTZ columns.

Buckets, chunks and steps are computed as integer microseconds since
1970-01-01 with ``timestamp_diff`` / ``timestamp_add``, which never consult the
session time zone, so results are identical on every cluster setting and equal
to DuckDB's ``time_bucket`` on naive timestamps.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {
    "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000, "seconds": 1_000_000,
    "min": 60_000_000, "minute": 60_000_000, "minutes": 60_000_000, "t": 60_000_000,
    "h": 3_600_000_000, "hour": 3_600_000_000, "hours": 3_600_000_000,
    "d": 86_400_000_000, "day": 86_400_000_000, "days": 86_400_000_000,
}


def freq_micros(freq: str | int) -> int:
    """'15 minutes', '15min', '1h', '1 day' or an int of microseconds."""
    if isinstance(freq, int):
        return freq
    m = re.fullmatch(r"\s*(\d+)?\s*([A-Za-z]+)\s*", freq)
    if not m or m.group(2).lower() not in _UNITS:
        raise ValueError(f"unsupported frequency {freq!r}")
    return int(m.group(1) or 1) * _UNITS[m.group(2).lower()]


def freq_interval(freq: str | int) -> str:
    """SQL interval literal text for a frequency, e.g. '900 seconds'."""
    return f"{freq_micros(freq) // 1_000_000} seconds"


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def to_micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ column."""
    return F.timestamp_diff("MICROSECOND", epoch(), F.col(ts) if isinstance(ts, str) else ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, epoch())


def bucket_index(ts: str | Column, freq: str | int) -> Column:
    """Integer bucket number (left-closed buckets aligned to the epoch)."""
    return F.floor(to_micros(ts) / F.lit(freq_micros(freq))).cast("long")


def bucket_start(ts: str | Column, freq: str | int) -> Column:
    """Left-labelled bucket start, as TIMESTAMP_NTZ."""
    return from_micros(bucket_index(ts, freq) * F.lit(freq_micros(freq)))


def add_steps(ts: str | Column, steps: Column | int, freq: str | int) -> Column:
    """ts + steps * freq."""
    s = steps if isinstance(steps, Column) else F.lit(steps)
    return F.timestamp_add("MICROSECOND", s.cast("long") * F.lit(freq_micros(freq)),
                           F.col(ts) if isinstance(ts, str) else ts)


def steps_between(start: str | Column, end: str | Column, freq: str | int) -> Column:
    """Whole number of freq steps from start to end (both on the grid)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return (F.timestamp_diff("MICROSECOND", s, e) / F.lit(freq_micros(freq))).cast("long")


def chunk_index(ts: str | Column, freq: str | int, chunk_buckets: int) -> Column:
    """Chunk number: ``chunk_buckets`` consecutive buckets share a chunk.

    After resampling a chunk holds at most ``chunk_buckets`` rows per series,
    which is the bound that keeps every window task small, however hot a series.
    """
    return F.floor(to_micros(ts) / F.lit(freq_micros(freq) * chunk_buckets)).cast("long")


def ts_literal(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def calendar_columns(ts: str | Column) -> dict[str, Column]:
    """minute, hour, day, day_of_week (Monday = 0), month, is_weekend."""
    t = F.col(ts) if isinstance(ts, str) else ts
    dow = F.weekday(t)
    return {
        "minute": F.minute(t),
        "hour": F.hour(t),
        "day": F.dayofmonth(t),
        "day_of_week": dow,
        "month": F.month(t),
        "is_weekend": (dow >= 5).cast("int"),
    }
