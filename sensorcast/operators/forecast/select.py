"""choose settings per series on a validation slice taken from the end of
train (never from the evaluation range)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.timefn import bucket_index, ts_literal
from ..layout import spread_join
from . import basis


def select_best(df: DataFrame, freq: str, period: int, val_start: str,
                harmonics_grid=(0, 1, 2, 3)) -> DataFrame:
    """Fit trend + seasonality on train rows before ``val_start``, score each
    number of harmonics by MSE on the train rows from ``val_start`` on, keep
    the best per series (``min_by``). The grid is columns of one projection,
    unpivoted - no join with a candidate table."""
    tr = df.where(F.col("split") == "train")
    fit = tr.where(F.col("ts") < ts_literal(val_start))
    val = tr.where(F.col("ts") >= ts_literal(val_start))
    kmax = max(harmonics_grid)
    trend = basis.trend_fit(fit, freq)
    seas = basis.seasonal_fit(fit, trend, freq, period, kmax)
    x = spread_join(val, trend.join(seas, "series_id"), ["series_id"])
    t = bucket_index("ts", freq)
    cands = {k: F.pow(F.col("value") - basis.decompose_value(t, k, period), 2)
             for k in harmonics_grid}
    x = x.select("series_id", *[c.alias(f"se_{k}") for k, c in cands.items()])
    long = x.unpivot(["series_id"], [f"se_{k}" for k in harmonics_grid], "cand", "se")
    scores = (long.groupBy("series_id", "cand").agg(F.avg("se").alias("mse"))
              .withColumn("harmonics", F.regexp_extract("cand", r"(\d+)$", 1).cast("int")))
    return scores.groupBy("series_id").agg(
        F.min_by("harmonics", F.struct("mse", "harmonics")).alias("best_harmonics"),
        F.min("mse").alias("best_mse"))
