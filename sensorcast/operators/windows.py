"""context/horizon windows and row selections.

Window arrays cost (L + H) times the data; the forecasters never build them
(they use frame aggregates and lags). Arrays exist for export and for the
user-supplied predictors of ``score_windows``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions.timefn import chunk_index
from .layout import CHUNK, spread_join, top_k_per_group, with_halo


def make_windows(df: DataFrame, context: int, horizon: int, within_segment: bool = True,
                 chunk_rows: int = 4096, idx_col: str = "time_idx", value_col: str = "value",
                 keys=("series_id",), drop_last: bool = False) -> DataFrame:
    """Every full (context, horizon) pair at stride 1, keyed by its origin
    (the last context row). Input needs a dense ``time_idx``. Chunks of
    ``chunk_rows`` index positions with a halo of L-1 rows behind and H ahead
    keep each task bounded. ``within_segment`` drops windows that straddle two
    segments. ``drop_last`` drops each series' last window (the reference's
    one-short count n - L - H). Output: keys, origin_ts, origin_idx, x, y."""
    L, H = context, horizon
    x = with_halo(df, idx_col, chunk_rows, back=L - 1, fwd=H)
    w = Window.partitionBy(*keys, CHUNK).orderBy(idx_col)
    xs = F.collect_list(value_col).over(w.rowsBetween(-(L - 1), 0))
    ys = F.collect_list(value_col).over(w.rowsBetween(1, H))
    span = w.rowsBetween(-(L - 1), H)
    first_idx = F.min(idx_col).over(span)
    last_idx = F.max(idx_col).over(span)
    ok = (first_idx == F.col(idx_col) - F.lit(L - 1)) & (last_idx == F.col(idx_col) + F.lit(H))
    if within_segment and "segment_id" in df.columns:
        ok = ok & (F.min("segment_id").over(span) == F.max("segment_id").over(span))
    out = x.select(*keys, F.col("ts").alias("origin_ts"), F.col(idx_col).alias("origin_idx"),
                   xs.alias("x"), ys.alias("y"), ok.alias("_ok"), "_own")
    out = out.where(F.col("_own") & F.col("_ok")).drop("_own", "_ok")
    if drop_last:
        last = out.groupBy(*keys).agg(F.max("origin_idx").alias("_last"))
        out = (spread_join(out, last, keys, by="origin_idx")
               .where(F.col("origin_idx") < F.col("_last")).drop("_last"))
    return out


def window_count(df: DataFrame, context: int, horizon: int, keys=("series_id",),
                 segment_col: str = "segment_id") -> DataFrame:
    """Windows per series: the full count n-L-H+1, the reference's
    one-short formula n-L-H, and the count inside segments."""
    need = context + horizon
    seg = df.groupBy(*keys, segment_col).agg(F.count(F.lit(1)).alias("_n"))
    return seg.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.greatest(F.sum("_n") - F.lit(need) + 1, F.lit(0)).cast("long").alias("windows_full"),
        (F.sum("_n") - F.lit(need)).cast("long").alias("windows_reference"),
        F.sum(F.greatest(F.col("_n") - F.lit(need) + 1, F.lit(0))).cast("long")
        .alias("windows_in_segments"))


def last_window(df: DataFrame, context: int, horizon: int, keys=("series_id",),
                idx_col: str = "time_idx") -> DataFrame:
    """The last L+H rows of each series (one last window): a per-series
    count joined back and an index filter - no sort of the whole series."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    start = F.col("_n") - F.lit(context + horizon)
    return (spread_join(df, n, keys).where(F.col(idx_col) >= start)
            .withColumn("pos", (F.col(idx_col) - start).cast("long"))
            .withColumn("role", F.when(F.col("pos") < context, F.lit("context"))
                        .otherwise(F.lit("horizon"))).drop("_n"))


def explode_forecast(windows: DataFrame, array_col: str = "y", out_col: str = "actual",
                     keys=("series_id", "origin_ts")) -> DataFrame:
    """Flatten [windows, H] arrays into (keys, step, value) rows."""
    return windows.select(*keys, F.posexplode(array_col).alias("_pos", out_col)).select(
        *keys, (F.col("_pos") + 1).cast("int").alias("step"), out_col)


def window_slice(arr: str | Column, start: int, length: int) -> Column:
    """0-based slice of an array column."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.slice(a, start + 1, length)


def first_rows(df: DataFrame, n: int, keys: list[str], order_cols: list[str], freq: str,
               chunk_buckets: int = 1440, ts_col: str = "ts") -> DataFrame:
    """First ``n`` rows per group in time order (bounded top-k)."""
    return top_k_per_group(df, keys, order_cols, n, chunk_index(ts_col, freq, chunk_buckets),
                           rank_col="row_no")


def sample_pairs(aligned: DataFrame, n: int = 10, freq: str = "1 hour",
                 keys=("model", "series_id"), chunk_buckets: int = 1440) -> DataFrame:
    """W11 + S9: the first ``n`` valid pairs per model and series with their
    absolute error."""
    v = aligned.where(E.is_valid_number("actual") & E.is_valid_number("predicted"))
    v = v.withColumn("abs_error", E.abs_error())
    return first_rows(v, n, list(keys), ["target_ts", "origin_ts"], freq, chunk_buckets,
                      ts_col="target_ts")


def chart_feed(df: DataFrame, n: int = 500, freq: str = "1 minute", keys=("series_id",),
               chunk_buckets: int = 1440) -> DataFrame:
    """The first ``n`` points of each series, for a chart."""
    return first_rows(df, n, list(keys), ["ts"], freq, chunk_buckets)


def combine(*dfs: DataFrame) -> DataFrame:
    """Concatenate segments or splits (UNION ALL by name)."""
    return reduce(lambda a, b: a.unionByName(b), dfs)
