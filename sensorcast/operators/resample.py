"""D1 resample to a regular grid, W1/W2 gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import add_steps, bucket_start, chunk_index, steps_between
from .layout import CHUNK, neighbour, running_total


def resample_mean(df: DataFrame, freq: str, keys=("series_id", "segment_id"),
                  ts_col: str = "ts", value_col: str = "value",
                  chunk_buckets: int | None = None) -> DataFrame:
    """Mean per left-closed, left-labelled bucket; merges duplicate stamps.

    Default plan: partial aggregate -> hash exchange -> final aggregate, so a
    dense sensor is combined on the map side before anything is shuffled.

    With ``chunk_buckets`` the readings are instead hash-partitioned once by
    (series, chunk) and the chunk is kept as a grouping column: the aggregate
    and every later ordered window on (series, chunk) share that single
    exchange. Better when there is about one reading per bucket (nothing to
    combine); the output keeps the chunk column for ``fill_gaps``."""
    b = bucket_start(ts_col, freq)
    if chunk_buckets is None:
        return df.groupBy(*keys, b.alias(ts_col)).agg(F.avg(value_col).alias(value_col))
    x = df.select("*", chunk_index(ts_col, freq, chunk_buckets).alias(CHUNK))
    x = x.repartition(keys[0], CHUNK)
    return (x.groupBy(*keys, CHUNK, b.alias(ts_col)).agg(F.avg(value_col).alias(value_col)))


def fill_gaps(df: DataFrame, freq: str, limit: int | None = 30,
              keys=("series_id",), segment_col: str | None = "segment_id",
              ts_col: str = "ts", value_col: str = "value",
              chunk_buckets: int = 1440, fill_long_gaps: bool = True,
              index_col: str | None = None) -> DataFrame:
    """Time-linear interpolation of missing buckets.

    For each observed bucket and the next observed bucket of the same series
    (and segment), the first ``min(gap, limit)`` missing buckets are generated
    and interpolated towards the far end; the rest of a long gap is never
    generated (pandas ``interpolate(limit=...)`` then ``dropna``). ``limit=None``
    fills every gap. ``fill_long_gaps=False`` leaves gaps longer than the limit
    untouched. No dense grid is built: cost is O(observed + filled rows).
    Adds ``filled`` (BOOLEAN). With ``index_col`` also the dense 0-based row
    index per series of the output (W6) - the rows generated before an origin
    are a running count over the origins in this same partitioning, so no
    separate index pass (and its shuffle) is needed.
    """
    keys = list(keys)
    cols = [value_col] + ([segment_col] if segment_col else [])
    # a chunk column from resample_mean(chunk_buckets=...) is reused as is, so
    # the window sits on the aggregate's partitioning (no second exchange)
    x = df if CHUNK in df.columns else df.withColumn(CHUNK, chunk_index(ts_col, freq, chunk_buckets))
    x = neighbour(x, keys, ts_col, CHUNK, cols, "next", prefix="_n_", placed=CHUNK in df.columns)
    same = F.col(f"_n_{ts_col}").isNotNull()
    if segment_col:
        same = same & (F.col(f"_n_{segment_col}") == F.col(segment_col))
    gap = steps_between(ts_col, f"_n_{ts_col}", freq) - F.lit(1)
    if limit is None:
        n_fill = gap
    elif fill_long_gaps:
        n_fill = F.least(gap, F.lit(limit))
    else:
        n_fill = F.when(gap <= F.lit(limit), gap).otherwise(F.lit(0))
    n = F.when(same & (gap > 0), n_fill).otherwise(F.lit(0)).cast("long")
    if index_col:
        x = x.select("*", (n + F.lit(1)).alias("_cnt"))
        x = running_total(x, keys, ts_col, CHUNK, F.col("_cnt"), "_before", inclusive=False, placed=True)
    if limit is not None and limit <= chunk_buckets:
        # at most `limit` (<= one chunk) rows per origin: generate in place
        x = x.select("*", gap.alias("_gap"),
                     F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("_k"))
    else:
        # unbounded fills: cut each gap into pieces of one chunk, spread the
        # pieces over tasks by (series, chunk of the piece), then generate,
        # so a year-long hole is not produced by one task
        B = F.lit(chunk_buckets).cast("long")
        x = x.select("*", gap.alias("_gap"), n.alias("_n"),
                     F.explode(F.sequence(F.lit(0).cast("long"),
                                          F.floor(n / B).cast("long"))).alias("_piece"))
        x = x.repartition(*keys, F.col(CHUNK) + F.col("_piece"))
        lo = F.col("_piece") * B
        hi = F.least(lo + B - F.lit(1), F.col("_n"))
        x = x.select("*", F.explode(F.sequence(lo, hi)).alias("_k")).drop("_n", "_piece")
    v, nv, k = F.col(value_col), F.col(f"_n_{value_col}"), F.col("_k")
    value = F.when(k == 0, v).otherwise(v + (nv - v) * k / (F.col("_gap") + F.lit(1)))
    out = [F.col(c) for c in keys]
    if segment_col and segment_col not in keys:
        out.append(F.col(segment_col))
    extra = [(F.col("_before") + k).cast("long").alias(index_col)] if index_col else []
    return x.select(*out, add_steps(ts_col, k, freq).alias(ts_col), value.alias(value_col),
                    (k > 0).alias("filled"), *extra)
