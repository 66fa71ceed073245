"""causal dilated filter bank + direct linear head (the TCN contract:
kernel 3, dilations 1/2/4, past-only receptive field, last step -> H outputs).
Filters are fixed difference and smoothing taps computed with lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.timefn import freq_micros
from ..layout import CHUNK, with_halo
from . import linear
from .common import pick_origins, target_names, train_rows

# Kernel size and dilations of the reference network.
KERNEL = 3
DILATIONS = (1, 2, 4)


def filter_names(dilations=DILATIONS) -> list[str]:
    return [f"diff_{d}" for d in dilations] + [f"smooth_{d}" for d in dilations]


def causal_filter_bank(df: DataFrame, freq: str, horizon: int = 0, dilations=DILATIONS,
                       kernel: int = KERNEL, chunk_rows: int = 4096) -> DataFrame:
    """Per row with a full, clock-contiguous receptive field of
    (kernel-1)*max(d) rows: diff_d = v_t - v_{t-d}; smooth_d = mean of the
    kernel taps v_t, v_{t-d}, ... minus v_t. Only past rows are read. With
    ``horizon`` > 0 also the targets y_h = v_{t+h} - v_t."""
    us = freq_micros(freq)
    back = (kernel - 1) * max(dilations)
    x = with_halo(df, "time_idx", chunk_rows, back=back, fwd=horizon)
    w = Window.partitionBy("series_id", CHUNK).orderBy("time_idx")
    v = F.col("value")
    cols = [(v - F.lag("value", d).over(w)).alias(f"diff_{d}") for d in dilations]
    for d in dilations:
        taps = v
        for k in range(1, kernel):
            taps = taps + F.lag("value", k * d).over(w)
        cols.append((taps / F.lit(float(kernel)) - v).alias(f"smooth_{d}"))
    cols.append(F.lag("ts", back).over(w).alias("_t0"))
    if horizon:
        cols += [(F.lead("value", h).over(w) - v).alias(f"y_{h}") for h in range(1, horizon + 1)]
        cols += [F.lead("ts", horizon).over(w).alias("_t1"),
                 F.lead("split", horizon).over(w).alias("target_split")]
    x = x.select("*", *cols)
    ok = F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col("ts")) == F.lit(back * us)
    x = x.where(F.col("_own") & ok)
    out = ["series_id", "ts", "time_idx", "split", "value", *filter_names(dilations)]
    if horizon:
        tgt_ok = F.coalesce(F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("_t1"))
                            == F.lit(horizon * us), F.lit(False))
        out += ["target_split", tgt_ok.alias("targets_ok"),
                *[f"y_{h}" for h in range(1, horizon + 1)]]
    return x.select(*out)


def filter_linear_forecast(df: DataFrame, horizon: int, freq: str, chunk_rows: int = 4096,
                           model: str = "filter_linear", origins: str = "eval",
                           context: int = 0, w=None):
    """Fit the shared head on train rows (unless its coefficients ``w`` are
    given), forecast from the origins of the window mode. Returns (forecasts, W)."""
    feat = causal_filter_bank(df, freq, horizon, chunk_rows=chunk_rows)
    fnames = filter_names()
    if w is None:
        w = linear.fit_head(train_rows(feat), fnames, target_names(horizon))
    ev = pick_origins(feat.withColumnsRenamed({"ts": "origin_ts", "time_idx": "origin_idx"}),
                      origins, context, horizon)
    return linear.predict_head(ev, w, fnames, "value", freq, model), w
