"""patch features and a shared direct linear head (the PatchTST contract:
context L cut into patches of length p at stride s, window-normalised, direct
H-step output). Patch means are frame averages over p rows read back by a lag;
no window arrays are materialised."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.timefn import freq_micros
from ..layout import CHUNK, with_halo
from . import linear
from .common import pick_origins, target_names, train_rows


def n_patches(context: int, patch: int, stride: int) -> int:
    return (context - patch) // stride + 1


def patch_features(df: DataFrame, context: int, horizon: int, patch: int, stride: int,
                   freq: str, chunk_rows: int = 4096) -> DataFrame:
    """One row per origin (last context row) with a full, clock-contiguous
    context: ctx_mean, p_0..p_{n-1} (patch mean minus context mean), and the
    normalised targets y_1..y_H (NULL unless the H rows ahead are contiguous).
    Input: series_id, ts, value, split, time_idx."""
    L, H, us = context, horizon, freq_micros(freq)
    n = n_patches(L, patch, stride)
    x = with_halo(df, "time_idx", chunk_rows, back=L - 1, fwd=H)
    w = Window.partitionBy("series_id", CHUNK).orderBy("time_idx")
    ctx = w.rowsBetween(-(L - 1), 0)
    ahead = w.rowsBetween(1, H)
    x = x.select("*", F.avg("value").over(w.rowsBetween(-(patch - 1), 0)).alias("_pm"),
                 F.avg("value").over(ctx).alias("ctx_mean"),
                 F.count(F.lit(1)).over(ctx).alias("_nc"), F.min("ts").over(ctx).alias("_t0"),
                 F.count(F.lit(1)).over(ahead).alias("_nh"), F.max("ts").over(ahead).alias("_t1"),
                 F.lead("split", H).over(w).alias("_tsplit"))
    def back_pm(k):
        return F.col("_pm") if k == 0 else F.lag("_pm", k).over(w)
    cols = [(back_pm(L - patch - j * stride) - F.col("ctx_mean")).alias(f"p_{j}")
            for j in range(n)]
    cols += [(F.lead("value", h).over(w) - F.col("ctx_mean")).alias(f"y_{h}")
             for h in range(1, H + 1)]
    x = x.select("*", *cols)
    ctx_ok = (F.col("_nc") == L) & (F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col("ts"))
                                    == F.lit((L - 1) * us))
    tgt_ok = (F.col("_nh") == H) & (F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("_t1"))
                                    == F.lit(H * us))
    x = x.where(F.col("_own") & ctx_ok)
    return x.select("series_id", F.col("ts").alias("origin_ts"), F.col("time_idx").alias("origin_idx"),
                    "split", F.col("_tsplit").alias("target_split"), tgt_ok.alias("targets_ok"),
                    "ctx_mean", *[f"p_{j}" for j in range(n)],
                    *[f"y_{h}" for h in range(1, H + 1)])


def patch_linear_forecast(df: DataFrame, context: int, horizon: int, patch: int, stride: int,
                          freq: str, chunk_rows: int = 4096, model: str = "patch_linear",
                          origins: str = "eval", w=None):
    """Fit the shared head on train windows (context and targets inside train;
    unless its coefficients ``w`` are given), forecast from the origins of the
    window mode. Returns (forecasts, W)."""
    feat = patch_features(df, context, horizon, patch, stride, freq, chunk_rows)
    fnames = feature_names(context, patch, stride)
    if w is None:
        w = linear.fit_head(train_rows(feat), fnames, target_names(horizon))
    fc = linear.predict_head(pick_origins(feat, origins, context, horizon), w, fnames, "ctx_mean",
                             freq, model)
    return fc, w


def feature_names(context: int, patch: int, stride: int) -> list[str]:
    return [f"p_{j}" for j in range(n_patches(context, patch, stride))]
