"""Alignment, metrics, reports and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions.timefn import add_steps

METRICS = ["mae", "mse", "rmse", "smape", "mape", "r2"]
# Metric labels of the reference's Metric/Value table.
METRIC_LABELS = {"mae": "MAE", "mse": "MSE", "rmse": "RMSE", "smape": "SMAPE (%)",
                 "mape": "MAPE (%)", "r2": "R-Squared"}
LOWER_IS_BETTER = {"mae": True, "mse": True, "rmse": True, "smape": True, "mape": True,
                   "r2": False}


def with_target_ts(fc: DataFrame, freq: str) -> DataFrame:
    """True target time = origin + step * freq."""
    return fc.withColumn("target_ts", add_steps("origin_ts", F.col("step"), freq))


def align(fc: DataFrame, actuals: DataFrame, value_col: str = "value") -> DataFrame:
    """Pair each forecast row with the actual at (series_id, target_ts).
    An equi join; forecasts without an actual keep a NULL actual."""
    a = actuals.select("series_id", F.col("ts").alias("target_ts"),
                       F.col(value_col).alias("actual"))
    return fc.join(a, ["series_id", "target_ts"], "left")


def valid_pairs(df: DataFrame) -> DataFrame:
    """Keep pairs where both actual and prediction are numbers."""
    return df.where(E.is_valid_number("actual") & E.is_valid_number("predicted"))


def _metric_aggs():
    n = F.count(F.lit(1))
    sse = F.sum(E.sq_error())
    sst = F.var_pop("actual") * n
    return [
        n.alias("n"),
        F.avg(E.abs_error()).alias("mae"),
        F.avg(E.sq_error()).alias("mse"),
        F.sqrt(F.avg(E.sq_error())).alias("rmse"),
        (F.avg(E.smape_term()) * F.lit(100.0)).alias("smape"),
        (F.avg(E.mape_term()) * F.lit(100.0)).alias("mape"),
        F.when(sst > 0, F.lit(1.0) - sse / sst).alias("r2"),
    ]


def metrics(aligned: DataFrame, by=("model",)) -> DataFrame:
    """N, MAE, MSE, RMSE, SMAPE %, MAPE %, R^2 (1 - SSE/SST; NULL
    for constant actuals) per group, on valid pairs only. One hash aggregate."""
    return valid_pairs(aligned).groupBy(*by).agg(*_metric_aggs())


def variance_check(aligned: DataFrame, by=("model",)) -> DataFrame:
    """Population variance of actual and prediction, Pearson r."""
    return valid_pairs(aligned).groupBy(*by).agg(
        F.var_pop("actual").alias("var_actual"), F.var_pop("predicted").alias("var_predicted"),
        F.corr("actual", "predicted").alias("corr"))


def metrics_long(metrics_df: DataFrame, by=("model",), relative: str | None = None) -> DataFrame:
    """The Metric/Value table, five rows per group (MAE, MSE, RMSE, the
    relative metric, R-Squared)."""
    rel = relative or "smape"
    names = ["mae", "mse", "rmse", rel, "r2"]
    return metrics_df.unpivot(list(by), names, "metric_key", "value").select(
        *by, F.create_map(*[x for k in names for x in (F.lit(k), F.lit(METRIC_LABELS[k]))])
        [F.col("metric_key")].alias("metric"), F.col("value").cast("double").alias("value"))


def leaderboard(metrics_df: DataFrame, by=("model",)) -> DataFrame:
    """Rank of each model per metric (1 = best). The window is
    partitioned by metric over a table of one row per model and metric."""
    long = metrics_df.unpivot(list(by), METRICS, "metric", "value")
    order = F.when(F.col("metric") == "r2", -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy("metric").orderBy(order.asc_nulls_last())
    return long.withColumn("rank", F.rank().over(w)).withColumn("is_best", F.col("rank") == 1)


def forecast_stats(aligned: DataFrame, by=("model",)) -> DataFrame:
    """Min / max / mean / population std of actual and forecast."""
    v = valid_pairs(aligned)
    aggs = []
    for c in ("actual", "predicted"):
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
                 F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return v.groupBy(*by).agg(*aggs)


def pinball_loss(aligned: DataFrame, by=("model",)) -> DataFrame:
    """mean quantile (pinball) loss per group and quantile level."""
    return (valid_pairs(aligned).where(F.col("q").isNotNull()).groupBy(*by, "q")
            .agg(F.avg(E.pinball_term(F.col("q"))).alias("pinball"),
                 F.count(F.lit(1)).alias("n")))


def gaussian_nll(aligned: DataFrame, by=("model",), sd_col: str = "sd") -> DataFrame:
    """mean Gaussian negative log-likelihood of (predicted, sd)."""
    return (valid_pairs(aligned).where(F.col(sd_col) > 0).groupBy(*by)
            .agg(F.avg(E.gaussian_nll_term(sd=sd_col)).alias("nll"),
                 F.count(F.lit(1)).alias("n")))


def loss_table(aligned: DataFrame, by=("model",)) -> DataFrame:
    """MSE and RMSE per group (training-loss view)."""
    return valid_pairs(aligned).groupBy(*by).agg(
        F.avg(E.sq_error()).alias("mse"), F.sqrt(F.avg(E.sq_error())).alias("rmse"))
