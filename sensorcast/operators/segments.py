"""Gaps, continuous segments, dense time index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import chunk_index, freq_micros
from .layout import CHUNK, neighbour, place, row_index, spread_join, with_keys


def _chunked(df: DataFrame, ts_col: str, freq: str, chunk_buckets: int) -> DataFrame:
    return df.withColumn(CHUNK, chunk_index(ts_col, freq, chunk_buckets))


def gap_seconds(df: DataFrame, freq: str = "1 minute", keys=("series_id",), ts_col: str = "ts",
                chunk_buckets: int = 1440, out_col: str = "gap_seconds") -> DataFrame:
    """Seconds since the previous reading of the same series (NULL first)."""
    x = neighbour(_chunked(df, ts_col, freq, chunk_buckets), list(keys), ts_col, CHUNK, [],
                  "prev", prefix="_p_")
    gap = F.timestamp_diff("MICROSECOND", F.col(f"_p_{ts_col}"), F.col(ts_col)) / F.lit(1e6)
    return x.withColumn(out_col, gap).drop(CHUNK, f"_p_{ts_col}")


def continuous_segments(df: DataFrame, max_gap: str = "60 minutes", freq: str = "1 minute",
                        keys=("series_id",), ts_col: str = "ts",
                        segment_col: str = "segment_id", chunk_buckets: int = 1440,
                        index_col: str | None = None) -> DataFrame:
    """Renumber segments per series: a gap strictly longer than ``max_gap``
    (or a change of an existing segment label) starts a new one; ids are
    0-based. With ``index_col`` the dense 0-based row index (W6) is added in
    the same pass.

    One local window per (series, chunk) gives each row its in-chunk flag and
    running counts; one summary row per chunk (first row, last row, totals)
    and one window over those summaries give the first row's flag and the
    offsets from earlier chunks; one join brings them back."""
    keys = list(keys)
    has_seg = segment_col in df.columns
    df = with_keys(df, keys)
    x = place(_chunked(df, ts_col, freq, chunk_buckets), keys, CHUNK, False)
    w = Window.partitionBy(*keys, CHUNK).orderBy(ts_col)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap_us = F.lit(freq_micros(max_gap))
    p_ts = F.lag(ts_col).over(w)
    new = p_ts.isNotNull() & (F.timestamp_diff("MICROSECOND", p_ts, F.col(ts_col)) > gap_us)
    if has_seg:
        new = new | (p_ts.isNotNull() & (F.lag(segment_col).over(w) != F.col(segment_col)))
    x = x.select("*", new.cast("int").alias("_new"))
    x = x.select("*", F.sum("_new").over(run).alias("_run"),
                 F.row_number().over(w).alias("_rn"))
    seg_c = [F.col(segment_col)] if has_seg else [F.lit(0)]
    summ = x.groupBy(*keys, CHUNK).agg(
        F.min(F.struct(F.col(ts_col).alias("t"), seg_c[0].alias("s"))).alias("_first"),
        F.max(F.struct(F.col(ts_col).alias("t"), seg_c[0].alias("s"))).alias("_last"),
        F.sum("_new").alias("_tot"), F.count(F.lit(1)).alias("_n"),
        F.max(F.struct(*df.columns)).alias("_row")).where(F.col("_row").isNotNull())
    ws = Window.partitionBy(*keys).orderBy(CHUNK)
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    prev_last = F.lag("_last").over(ws)
    first_new = (prev_last.isNotNull()
                 & ((F.timestamp_diff("MICROSECOND", prev_last.getField("t"),
                                      F.col("_first").getField("t")) > gap_us)
                    | (prev_last.getField("s") != F.col("_first").getField("s")))).cast("int")
    summ = summ.select(*keys, CHUNK, first_new.alias("_fn"), "_tot", "_n")
    summ = summ.select(*keys, CHUNK, "_fn",
                       F.coalesce(F.sum(F.col("_tot") + F.col("_fn")).over(before), F.lit(0))
                       .alias("_off"),
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_noff"))
    y = x.join(summ, [*keys, CHUNK], "left")
    out = [F.col(c) for c in df.columns if c != segment_col]
    out.append((F.col("_off") + F.col("_fn") + F.col("_run")).cast("int").alias(segment_col))
    if index_col:
        out.append((F.col("_noff") + F.col("_rn") - F.lit(1)).cast("long").alias(index_col))
    return y.select(*out)


def keep_long_segments(df: DataFrame, min_length: int = 3, keys=("series_id",),
                       segment_col: str = "segment_id") -> DataFrame:
    """Keep segments with at least ``min_length`` rows. The length is a
    grouped count joined back (partial aggregation, no per-segment task)."""
    sizes = (df.groupBy(*keys, segment_col).agg(F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") >= F.lit(min_length)).drop("_n"))
    return spread_join(df, sizes, [*keys, segment_col], "left_semi", by="ts" if "ts" in df.columns else None)


def dense_time_index(df: DataFrame, freq: str = "1 minute", keys=("series_id",),
                     ts_col: str = "ts", out_col: str = "time_idx",
                     chunk_buckets: int = 1440) -> DataFrame:
    """Dense 0-based row number per series in time order (a row count, not
    a clock), from per-chunk counts and their prefix sums."""
    x = row_index(_chunked(df, ts_col, freq, chunk_buckets), list(keys), ts_col, CHUNK, out_col)
    return x.drop(CHUNK)


def segment_lengths(df: DataFrame, keys=("series_id",), segment_col: str = "segment_id",
                    ts_col: str = "ts") -> DataFrame:
    """Rows, first and last stamp of each segment."""
    return df.groupBy(*keys, segment_col).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts_col).alias("first_ts"),
        F.max(ts_col).alias("last_ts"))
