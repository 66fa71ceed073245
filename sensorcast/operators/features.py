"""S1-S3 calendar features, S10-S13 model input features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import calendar_columns
from ..sources.writers import materialize
from .layout import spread_join


def calendar_features(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Minute, hour, day, day_of_week (Monday = 0), month, is_weekend."""
    return df.withColumns(calendar_columns(ts_col))


def relative_time_idx(df: DataFrame, origin_col: str = "origin_idx", idx_col: str = "time_idx",
                      context: int | None = None, out_col: str = "relative_time_idx") -> DataFrame:
    """Steps from the forecast origin; divided by the context length when
    given (the scaled form used as a model input)."""
    rel = F.col(idx_col) - F.col(origin_col)
    if context:
        rel = rel / F.lit(float(context))
    return df.withColumn(out_col, rel)


def target_scales(df: DataFrame, keys=("series_id",), value_col: str = "value",
                  split_col: str | None = "split") -> DataFrame:
    """Per-series centre and scale of the target (train rows), attached to
    every row as features. Grouped aggregate + join, not a per-series window."""
    src = df.where(F.col(split_col) == "train") if split_col else df
    sc = src.groupBy(*keys).agg(F.avg(value_col).alias("target_center"),
                                F.stddev_pop(value_col).alias("target_scale"))
    return spread_join(df, sc, keys, "left")


def encoder_length(df: DataFrame, context: int, idx_col: str = "time_idx",
                   out_col: str = "encoder_length") -> DataFrame:
    """History available at each row, capped at the context length."""
    return df.withColumn(out_col, F.least(F.col(idx_col) + F.lit(1), F.lit(context)).cast("long"))


def series_codes(df: DataFrame, col: str = "series_id", out_col: str = "series_code") -> DataFrame:
    """(col, code): dense 0-based code of a category in sorted order.

    Distributed: the distinct keys are range-sorted, ``monotonically_increasing_id``
    numbers them inside each sorted partition, and a table with one row per
    partition (bounded by the partition count) turns those ids into a dense
    rank. No single-task global window."""
    keys = df.select(col).distinct().orderBy(col)
    keys = keys.select("*", F.monotonically_increasing_id().alias("_mid"))
    keys = materialize(keys.select("*", F.shiftright("_mid", 33).alias("_part")), "series_codes")
    parts = keys.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    # prefix over the per-partition table, one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select("_part", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (keys.join(offs, "_part")
            .select(col, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long").alias(out_col)))


def encode_series(df: DataFrame, col: str = "series_id", out_col: str = "series_code") -> DataFrame:
    """The code of ``series_codes`` attached to every row."""
    return spread_join(df, series_codes(df, col, out_col), [col], "left")
