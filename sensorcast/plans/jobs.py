"""End-to-end jobs, the two steps of each reference pipeline as Spark jobs:

* ``preprocess_job``: raw csv -> prepared table (partitioned by split) and the
  scaler table, written under ``out_dir``;
* ``forecast_job``: prepared table -> forecasts of the chosen models, aligned
  with actuals, metrics (long Metric/Value form) and a leaderboard, written
  under ``out_dir``.

Both are lazy plans up to their writes; tables read back between the steps
are the process boundary (as the reference's files are)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators import evaluate as EV
from ..operators.features import calendar_features
from ..operators.forecast import autoreg, basis, causal, linear, patch
from ..operators.forecast import quantile as QF
from ..operators.forecast.common import FORECAST_COLS, target_names, train_rows
from ..operators.scaling import unscale
from ..operators.segments import dense_time_index
from ..sources import readers as RD
from ..sources import writers as WR
from . import prepare as P

MODELS = ("ar1", "decompose", "quantile_profile", "patch_linear", "filter_linear")


def preprocess_job(spark: SparkSession, raw_path: str, out_dir: str, cfg: PipelineConfig,
                   series_id: str | None = None) -> dict[str, str]:
    """Raw csv files (DateTime, Value, QualityStatus [, series_id]) ->
    ``out_dir``/prepared (by split, with calendar features and time_idx) and
    ``out_dir``/scaler."""
    raw = RD.read_raw(spark, raw_path, series_id=series_id)
    prep, params = P.prepare(raw, cfg, with_index=True)
    prep = calendar_features(prep)
    out = {"prepared": f"{out_dir}/prepared", "scaler": f"{out_dir}/scaler"}
    WR.write_prepared(prep, out["prepared"])
    WR.save_params(params, out["scaler"])
    return out


def fit_models(prep: DataFrame, cfg: PipelineConfig, models=MODELS,
               chunk_rows: int = 4096) -> dict[str, DataFrame]:
    """One parameter or coefficient table per model, fitted on train rows."""
    L, H, freq = cfg.context, cfg.horizon, cfg.freq
    spark = prep.sparkSession
    x = _indexed(prep, cfg)
    out = {}
    if "ar1" in models:
        out["ar1"] = autoreg.ar_fit(prep, freq, cfg.chunk_buckets)
    if "decompose" in models:
        tr = basis.trend_fit(prep, freq)
        out["decompose"] = tr.join(basis.seasonal_fit(prep, tr, freq, cfg.period, cfg.harmonics),
                                   "series_id")
    if "quantile_profile" in models:
        out["quantile_profile"] = QF.quantile_profile(prep)
    if "patch_linear" in models:
        names = patch.feature_names(L, cfg.patch_len, cfg.stride)
        feat = patch.patch_features(x, L, H, cfg.patch_len, cfg.stride, freq, chunk_rows)
        w = linear.fit_head(train_rows(feat), names, target_names(H))
        out["patch_linear"] = linear.coefficients_frame(spark, w, names, "patch_linear")
    if "filter_linear" in models:
        names = causal.filter_names()
        feat = causal.causal_filter_bank(x, freq, H, chunk_rows=chunk_rows)
        w = linear.fit_head(train_rows(feat), names, target_names(H))
        out["filter_linear"] = linear.coefficients_frame(spark, w, names, "filter_linear")
    return out


def save_models(fitted: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """A10: every fitted model as a table under ``out_dir``/<model>."""
    return {name: WR.save_model(table, f"{out_dir}/{name}") for name, table in fitted.items()}


def load_models(spark: SparkSession, out_dir: str, models=MODELS) -> dict[str, DataFrame]:
    return {name: RD.load_params(spark, f"{out_dir}/{name}") for name in models}


def predict(prep: DataFrame, fitted: dict[str, DataFrame], cfg: PipelineConfig,
            chunk_rows: int = 4096) -> DataFrame:
    """Point forecasts (quantile median for the profile) of fitted models, one
    long table, from the origins of the window mode ``cfg.origins``."""
    L, H, freq = cfg.context, cfg.horizon, cfg.freq
    x = _indexed(prep, cfg) if cfg.origins not in ("eval", "last") else prep
    mode = {"origins": cfg.origins, "context": L, "chunk_buckets": cfg.chunk_buckets}
    parts = []
    if "ar1" in fitted:
        parts.append(autoreg.ar_forecast(x, fitted["ar1"], H, freq, **mode).select(*FORECAST_COLS))
    if "decompose" in fitted:
        both = fitted["decompose"]
        trend = both.select("series_id", "slope", "intercept")
        season = both.select("series_id", *[f"{c}_{k}" for k in range(1, cfg.harmonics + 1) for c in "ab"])
        parts.append(basis.decompose_forecast(x, trend, season, H, freq, cfg.period, cfg.harmonics, **mode))
    if "quantile_profile" in fitted:
        fc = QF.quantile_forecast(x, fitted["quantile_profile"], H, freq, **mode)
        parts.append(QF.pick_quantile(fc, 0.5))
    if "patch_linear" in fitted:
        w = linear.coefficients(fitted["patch_linear"], patch.feature_names(L, cfg.patch_len, cfg.stride))
        parts.append(patch.patch_linear_forecast(_indexed(prep, cfg), L, H, cfg.patch_len, cfg.stride, freq,
                                                 chunk_rows, origins=cfg.origins, w=w)[0])
    if "filter_linear" in fitted:
        w = linear.coefficients(fitted["filter_linear"], causal.filter_names())
        parts.append(causal.filter_linear_forecast(_indexed(prep, cfg), H, freq, chunk_rows,
                                                   origins=cfg.origins, context=L, w=w)[0])
    return reduce(DataFrame.unionByName, parts)


def forecast(prep: DataFrame, cfg: PipelineConfig, models=MODELS, chunk_rows: int = 4096,
             origins: str | None = None) -> DataFrame:
    """Fit and forecast in one plan."""
    cfg = cfg if origins is None else cfg.with_(origins=origins)
    return predict(prep, fit_models(prep, cfg, models, chunk_rows), cfg, chunk_rows)


def _indexed(prep: DataFrame, cfg: PipelineConfig) -> DataFrame:
    return prep if "time_idx" in prep.columns else dense_time_index(
        prep, cfg.freq, chunk_buckets=cfg.chunk_buckets)


def forecast_job(spark: SparkSession, prepared_path: str, out_dir: str, cfg: PipelineConfig,
                 models=MODELS, models_dir: str | None = None, scaler_path: str | None = None,
                 chunk_rows: int = 4096) -> dict[str, str]:
    """Prepared table -> fitted model tables, forecasts (with actuals), metrics,
    leaderboard.

    With ``models_dir`` nothing is fitted: the saved tables are applied. With
    ``cfg.forecast_scaled`` the models see the scaled column, and forecasts and
    actuals are turned back with the scaler table of ``scaler_path``."""
    prep = RD.read_prepared(spark, prepared_path).select(
        "series_id", "segment_id", "ts", "value", "value_scaled", "filled", "split", "time_idx")
    if cfg.forecast_scaled:
        if scaler_path is None:
            raise ValueError("forecast_scaled needs the scaler table")
        prep = prep.withColumn("value", F.col("value_scaled"))
    prep = prep.drop("value_scaled")
    out = {"forecasts": f"{out_dir}/forecasts", "metrics": f"{out_dir}/metrics",
           "leaderboard": f"{out_dir}/leaderboard"}
    if models_dir is None:
        models_dir = f"{out_dir}/models"
        out |= {f"model_{k}": v for k, v in save_models(fit_models(prep, cfg, models, chunk_rows),
                                                        models_dir).items()}
    aligned = EV.align(predict(prep, load_models(spark, models_dir, models), cfg, chunk_rows), prep)
    if cfg.forecast_scaled:
        params = RD.load_params(spark, scaler_path)
        aligned = unscale(aligned.withColumn("scaled", F.lit(True)), params,
                          keys=("series_id",) if "series_id" in params.columns else ()).drop("scaled")
    WR.write_forecasts(aligned, out["forecasts"])
    scored = spark.read.parquet(out["forecasts"])
    m = EV.metrics(scored)
    WR.write_metrics(EV.metrics_long(m, relative=cfg.relative_metric), out["metrics"],
                     mode="overwrite")
    EV.leaderboard(m).write.mode("overwrite").parquet(out["leaderboard"])
    return out
