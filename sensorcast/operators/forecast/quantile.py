"""quantile profile forecaster (the TFT contract: several quantiles,
known calendar inputs, static series id, horizon H). Quantiles of the train
values per (series, hour, is_weekend) are the forecast for any future slot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.timefn import calendar_columns
from ..layout import spread_join
from ..quantiles import group_quantiles
from .common import explode_steps, forecast_frame, origin_rows

# The quantile levels reported (the reference's library default
# list is 0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98; its point forecast took 0.1).
QUANTILES = (0.1, 0.5, 0.9)
PROFILE_KEYS = ["series_id", "hour", "is_weekend"]


def _slots(ts: str) -> list:
    cal = calendar_columns(ts)
    return [cal["hour"].alias("hour"), cal["is_weekend"].alias("is_weekend")]


def quantile_profile(df: DataFrame, qs=QUANTILES, method: str = "exact") -> DataFrame:
    """(series_id, hour, is_weekend, q, value) from train rows only."""
    x = df.where(F.col("split") == "train").select("series_id", *_slots("ts"), "value")
    return group_quantiles(x, PROFILE_KEYS, "value", list(qs), method)


def quantile_forecast(df: DataFrame, profile: DataFrame, horizon: int, freq: str,
                      model: str = "quantile_profile", origins: str = "eval", context: int = 0,
                      chunk_buckets: int = 1440) -> DataFrame:
    """The origins of a window mode, steps 1..H, one row per quantile level."""
    o = origin_rows(df, origins, context, horizon, freq, chunk_buckets).drop("origin_value")
    x = explode_steps(o, horizon, freq).select("*", *_slots("target_ts"))
    x = spread_join(x, profile.withColumnRenamed("value", "_qv"), PROFILE_KEYS, by="origin_ts")
    return forecast_frame(x, model, F.col("_qv"), q=F.col("q"))


def pick_quantile(fc: DataFrame, q: float) -> DataFrame:
    """One quantile level, chosen by value (never by list position)."""
    return fc.where(F.abs(F.col("q") - F.lit(q)) < F.lit(1e-9))
