"""Standardiser fit on train only, apply, inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import spread_join


def fit_scaler(df: DataFrame, keys=("series_id",), value_col: str = "value",
               split_col: str | None = "split", train_value: str = "train") -> DataFrame:
    """Mean and population std per key on train rows only; a zero (or
    undefined) std becomes 1. ``keys=()`` fits one global scaler (the
    reference's single sensor). Output: keys + (mean, std)."""
    x = df.where(F.col(split_col) == train_value) if split_col else df
    std = F.stddev_pop(value_col)
    agg = [F.avg(value_col).alias("mean"),
           F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std).alias("std")]
    return x.groupBy(*keys).agg(*agg) if keys else x.agg(*agg)


def apply_params(df: DataFrame, params: DataFrame, keys=("series_id",)) -> DataFrame:
    """Attach per-key parameters. Spark broadcasts the parameter table when
    its measured size is under the broadcast threshold (AQE re-checks at run
    time); otherwise the rows of a key are spread over several tasks. One global
    row (``keys=()``) is joined on a constant, lazily."""
    if keys:
        return spread_join(df, params, keys, "left")
    one = "_global"
    return spread_join(df.withColumn(one, F.lit(0)), params.withColumn(one, F.lit(0)), [one],
                       "left").drop(one)


def scale(df: DataFrame, params: DataFrame, keys=("series_id",), value_col: str = "value",
          out_col: str = "value_scaled") -> DataFrame:
    """(x - mean) / std with the fitted parameters."""
    x = apply_params(df, params, keys)
    return x.select(*[F.col(c) for c in df.columns],
                    ((F.col(value_col) - F.col("mean")) / F.col("std")).alias(out_col))


def unscale(df: DataFrame, params: DataFrame, cols=("actual", "predicted"),
            keys=("series_id",), marker: str = "scaled") -> DataFrame:
    """X * std + mean for ``cols``. Guarded by the boolean ``marker``
    column: rows already in original units (marker false) are left as they are,
    so a second inverse is a no-op. Sets the marker to false."""
    x = apply_params(df, params, keys)
    is_scaled = F.col(marker) if marker in df.columns else F.lit(True)
    out = []
    for c in df.columns:
        if c in cols:
            out.append(F.when(is_scaled, F.col(c) * F.col("std") + F.col("mean"))
                       .otherwise(F.col(c)).alias(c))
        elif c != marker:
            out.append(F.col(c))
    return x.select(*out, F.lit(False).alias(marker))


def scaled_stats(df: DataFrame, keys=("series_id",), col: str = "value_scaled",
                 split_col: str = "split") -> DataFrame:
    """D3: mean and population std of the scaled column per key and split
    (train should give 0 and 1)."""
    return df.groupBy(*keys, split_col).agg(F.avg(col).alias("mean_scaled"),
                                            F.stddev_pop(col).alias("std_scaled"))
