"""Shared pieces of the forecasters: contiguous lags, origins, step explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.timefn import add_steps, chunk_index, freq_micros
from ..layout import CHUNK, neighbour, spread_join
from ..segments import dense_time_index

FORECAST_COLS = ["model", "series_id", "origin_ts", "step", "target_ts", "q", "predicted"]


def with_prev(df: DataFrame, freq: str, chunk_buckets: int, value_col: str = "value",
              keys=("series_id",), out_col: str = "prev_value") -> DataFrame:
    """Previous bucket's value when it is exactly one step earlier in the same
    segment, else NULL (chunked lag, no per-series task)."""
    x = df.withColumn(CHUNK, chunk_index("ts", freq, chunk_buckets))
    cols = [value_col] + (["segment_id"] if "segment_id" in df.columns else [])
    x = neighbour(x, list(keys), "ts", CHUNK, cols, "prev", prefix="_pv_")
    ok = F.timestamp_diff("MICROSECOND", F.col("_pv_ts"), F.col("ts")) == F.lit(freq_micros(freq))
    if "segment_id" in df.columns:
        ok = ok & (F.col("_pv_segment_id") == F.col("segment_id"))
    return x.select(*[F.col(c) for c in df.columns],
                    F.when(ok, F.col(f"_pv_{value_col}")).alias(out_col))


def explode_steps(df: DataFrame, horizon: int, freq: str, origin_col: str = "origin_ts") -> DataFrame:
    """One row per step 1..H with its true target time."""
    x = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return x.select("*", add_steps(origin_col, F.col("step"), freq).alias("target_ts"))


def forecast_frame(df: DataFrame, model: str, predicted: Column, q: Column | None = None,
                   extra: list[str] | None = None) -> DataFrame:
    return df.select(F.lit(model).alias("model"), "series_id", "origin_ts",
                     F.col("step").cast("int").alias("step"), "target_ts",
                     (q if q is not None else F.lit(None).cast("double")).alias("q"),
                     predicted.cast("double").alias("predicted"), *(extra or []))


#: Which windows a forecaster is asked for. By time: ``eval`` - every eval row is
#: an origin, its last windows reach past the range; ``last`` - the last train row
#: (a live forecast). By row index, full windows only: ``all`` - from the last
#: train row, with the context before it as warm-up, to the last origin whose
#: horizon lies in the range; ``no_warmup`` - also the context lies in the range;
#: ``last_eval`` - the one window over the last rows of the range.
MODES = ("eval", "last", "all", "no_warmup", "last_eval")


def target_names(horizon: int) -> list[str]:
    return [f"y_{h}" for h in range(1, horizon + 1)]


def train_rows(feat: DataFrame) -> DataFrame:
    """Feature rows whose context and targets lie inside train."""
    return feat.where((F.col("split") == "train") & F.col("targets_ok")
                      & (F.col("target_split") == "train"))


def pick_origins(df: DataFrame, mode: str, context: int, horizon: int,
                 idx_col: str = "origin_idx", ts_col: str = "origin_ts") -> DataFrame:
    """The rows of ``df`` (with ``split`` and a dense row index) that are origins
    in a window mode. The bounds are one row per series, joined back spread."""
    if mode == "eval":
        return df.where(F.col("split") == "eval")
    if mode not in MODES:
        raise ValueError(f"unknown window mode {mode!r}: one of {MODES}")

    def at(split):
        return F.max(F.when(F.col("split") == split, F.col(ts_col if mode == "last" else idx_col)))
    bounds = df.groupBy("series_id").agg(at("train").alias("_cut"), at("eval").alias("_end"))
    x = spread_join(df, bounds, ["series_id"], by=ts_col)
    idx, cut, end = F.col(idx_col), F.col("_cut"), F.col("_end")
    hit = {"last": F.col(ts_col) == cut,
           "all": (idx >= cut) & (idx <= end - horizon),
           "no_warmup": (idx >= cut + context) & (idx <= end - horizon),
           "last_eval": (idx == end - horizon) & (idx >= cut)}[mode]
    return x.where(hit).drop("_cut", "_end")


def origin_rows(df: DataFrame, mode: str = "eval", context: int = 0, horizon: int = 0,
                freq: str = "1 minute", chunk_buckets: int = 1440) -> DataFrame:
    """Forecast origins of a window mode: (series_id, origin_ts, origin_value)."""
    if mode not in ("eval", "last") and "time_idx" not in df.columns:
        df = dense_time_index(df, freq, chunk_buckets=chunk_buckets)
    picked = pick_origins(df, mode, context, horizon, "time_idx", "ts")
    return picked.select("series_id", F.col("ts").alias("origin_ts"),
                         F.col("value").alias("origin_value"))
