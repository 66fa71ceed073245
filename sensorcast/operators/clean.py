"""Removed periods, the A/B segment label and the leftover check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import chunk_index, ts_literal
from .layout import spread_join

#: Per-series periods are met day by day.
DAY = "1 day"


def _in_any(ts: Column, intervals, half_open: bool = False) -> Column:
    cond = F.lit(False)
    for start, end in intervals:
        if half_open:
            cond = cond | ((ts >= ts_literal(start)) & (ts < ts_literal(end)))
        else:
            cond = cond | ts.between(ts_literal(start), ts_literal(end))
    return cond


def exclude_interval(df: DataFrame, intervals, ts_col: str = "ts",
                     series_col: str = "series_id", half_open: bool = False) -> DataFrame:
    """Drop readings inside closed intervals (``half_open``: [start, end),
    for ends given as the next period's first instant - a closed end of
    23:59:59 lets 23:59:59.5 escape, as it does in the reference).

    ``intervals`` is a list of ``(start, end)`` text pairs valid for every
    series, or a DataFrame ``(series_id, start, end)`` of per-series periods. These
    are cut into the days they touch and met by an equi join on (series, day), so a
    reading sees the periods of its day only, however many its sensor has, and a hot
    sensor is spread over its days. A period without a start, or that ends before it
    starts, removes nothing.
    """
    if isinstance(intervals, DataFrame):
        iv = (intervals.select(F.col(series_col).alias("_sid"), F.col("start").alias("_s"), F.col("end").alias("_e"))
              .where(F.col("_s") <= F.col("_e"))
              .select("*", F.explode(F.sequence(chunk_index("_s", DAY, 1), chunk_index("_e", DAY, 1))).alias("_iday")))
        x = df.withColumn("_day", chunk_index(ts_col, DAY, 1))
        inside = x[ts_col] < iv["_e"] if half_open else x[ts_col] <= iv["_e"]
        cond = ((x[series_col] == iv["_sid"]) & (x["_day"] == iv["_iday"]) & (x[ts_col] >= iv["_s"]) & inside)
        return x.join(iv, cond, "left_anti").drop("_day")
    if not intervals:
        return df
    return df.where(~_in_any(F.col(ts_col), intervals, half_open))


def label_segment(df: DataFrame, intervals, ts_col: str = "ts", out_col: str = "segment_id",
                  series_col: str = "series_id") -> DataFrame:
    """Segment number = how many removed periods lie before the reading
    (0 = before the first one: segment A, 1 = after it: segment B, ...).
    ``intervals`` as in ``exclude_interval``: text pairs for every series, or a
    DataFrame (series_id, start, end) of per-series periods, whose ends are
    gathered per series (one short list each) and joined back spread."""
    if isinstance(intervals, DataFrame):
        ends = intervals.groupBy(series_col).agg(F.collect_list("end").alias("_ends"))
        x = spread_join(df, ends, [series_col], "left", by=ts_col)
        before = F.size(F.filter("_ends", lambda e: e < F.col(ts_col)))
        seg = F.when(F.col("_ends").isNull(), F.lit(0)).otherwise(before)
        return x.select(*[F.col(c) for c in df.columns if c != out_col],
                        seg.cast("int").alias(out_col))
    seg = F.lit(0)
    for _, end in intervals:
        seg = seg + (F.col(ts_col) > ts_literal(end)).cast("int")
    return df.withColumn(out_col, seg.cast("int"))


def invalid_remaining(df: DataFrame, intervals, ts_col: str = "ts") -> DataFrame:
    """Number of rows still inside a removed period (expected 0)."""
    return df.agg(F.count_if(_in_any(F.col(ts_col), intervals)).cast("long")
                  .alias("invalid_rows"))


def assert_excluded(df: DataFrame, intervals, ts_col: str = "ts") -> DataFrame:
    """B8 guard form: the same rows; one inside a removed period fails the job."""
    inside = _in_any(F.col(ts_col), intervals)
    return df.where(F.when(inside, F.raise_error(F.lit("reading inside a removed period"))
                           .cast("boolean")).otherwise(F.lit(True)))
