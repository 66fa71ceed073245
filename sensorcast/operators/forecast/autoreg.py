"""autoregressive forecaster with Gaussian intervals (the DeepAR contract:
probabilistic, autoregressive, horizon H), fitted per series in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.timefn import add_steps, bucket_index
from ..layout import CHUNK, spread_join, with_halo
from ..segments import dense_time_index
from .common import explode_steps, forecast_frame, origin_rows, pick_origins, with_prev

# Fixed value: the 0.9 quantile of the standard normal, for 80 % intervals.
Z80 = 1.2815515655446004


def ar_fit(df: DataFrame, freq: str, chunk_buckets: int = 1440, value_col: str = "value",
           split_value: str | None = "train") -> DataFrame:
    """AR(1) per series on contiguous train pairs (x = previous bucket, y = value):
    phi = regr_slope, c = regr_intercept, sigma = population sd of the residual
    (sqrt(var_pop(y) - covar_pop(x, y)^2 / var_pop(x))), all in one pass."""
    x = with_prev(df, freq, chunk_buckets, value_col)
    if split_value:
        x = x.where(F.col("split") == split_value)
    x = x.where(F.col("prev_value").isNotNull())
    y, p = F.col(value_col), F.col("prev_value")
    # a constant history (var_pop(x) = 0) has no slope: phi = 0, c = mean(y)
    explained = F.when(F.var_pop(p) > 0,
                       F.covar_pop(p, y) * F.covar_pop(p, y) / F.var_pop(p)).otherwise(F.lit(0.0))
    resid_var = F.var_pop(y) - explained
    return x.groupBy("series_id").agg(
        F.coalesce(F.regr_slope(y, p), F.lit(0.0)).alias("phi"),
        F.coalesce(F.regr_intercept(y, p), F.avg(y)).alias("c"),
        F.sqrt(F.greatest(resid_var, F.lit(0.0))).alias("sigma"),
        F.count(F.lit(1)).alias("n_pairs"))


def _mean_sd(h, phi, c, sigma, y):
    ph = F.pow(phi, h)
    geo = F.when(phi == 1, h.cast("double")).otherwise((F.lit(1.0) - ph) / (F.lit(1.0) - phi))
    geo2 = F.when(phi * phi == 1, h.cast("double")).otherwise(
        (F.lit(1.0) - ph * ph) / (F.lit(1.0) - phi * phi))
    return ph * y + c * geo, sigma * F.sqrt(geo2)


def ar_forecast(df: DataFrame, params: DataFrame, horizon: int, freq: str,
                origins: str = "last", model: str = "ar1", context: int = 0,
                chunk_buckets: int = 1440) -> DataFrame:
    """Closed-form H-step forecast: mean phi^h*y + c*(1-phi^h)/(1-phi) and sd
    sigma*sqrt((1-phi^2h)/(1-phi^2)); 80 % interval = mean -/+ z*sd.

    ``origins`` is a window mode of ``common.MODES``; an origin's own value is
    known at forecast time."""
    o = origin_rows(df, origins, context, horizon, freq, chunk_buckets)
    x = explode_steps(spread_join(o, params, ["series_id"]), horizon, freq)
    mean, sd = _mean_sd(F.col("step"), F.col("phi"), F.col("c"), F.col("sigma"),
                        F.col("origin_value"))
    x = x.select("*", mean.alias("predicted"), sd.alias("sd"))
    return forecast_frame(x, model, F.col("predicted"), extra=[
        F.col("sd"), (F.col("predicted") - F.lit(Z80) * F.col("sd")).alias("lower"),
        (F.col("predicted") + F.lit(Z80) * F.col("sd")).alias("upper")])


# ------------------------------------------------------------ any number of lags

def lagged(df: DataFrame, freq: str, lags: int, chunk_buckets: int = 1440,
           value_col: str = "value") -> DataFrame:
    """``df`` with lag_1 .. lag_p: the value exactly so many buckets earlier, else NULL.
    Rows lie in (series, chunk) frames with a halo of p buckets."""
    x = df.withColumn("_t", bucket_index("ts", freq))
    x = with_halo(x, "_t", chunk_buckets, back=lags)
    w = Window.partitionBy("series_id", CHUNK).orderBy("_t")
    x = x.select("*", *[F.max(value_col).over(w.rangeBetween(-k, -k)).alias(f"lag_{k}")
                        for k in range(1, lags + 1)])
    return x.where("_own").drop("_t", CHUNK, "_own")


def arp_fit(df: DataFrame, lags: int, freq: str, chunk_buckets: int = 1440,
            value_col: str = "value", split_value: str | None = "train") -> DataFrame:
    """AR(p) per series by Yule-Walker: (series_id, mean, phi_1 .. phi_p, sigma, n).

    Autocovariance k sums (y_t - mean)(y_{t-k} - mean) over the rows whose k-th
    earlier bucket is there and divides by the number of all rows: a missing bucket
    counts as the mean, so the autocovariances of a gapped series stay those of a
    stationary process and the fit is stable. They come from one aggregate over chunk
    frames; the Levinson-Durbin recursion runs in the columns of one row per series. A
    constant series has phi = 0."""
    x = df.where(F.col(value_col).isNotNull())
    if split_value:
        x = x.where(F.col("split") == split_value)
    mean = x.groupBy("series_id").agg(F.avg(value_col).alias("mean"))
    x = lagged(x.select("series_id", "ts", value_col), freq, lags, chunk_buckets, value_col)
    x = spread_join(x, mean, ["series_id"], by="ts")
    y = F.col(value_col) - F.col("mean")
    n = F.count(F.lit(1))
    frame = x.groupBy("series_id", "mean").agg(
        n.alias("n"), (F.sum(y * y) / n).alias("g_0"),
        *[(F.coalesce(F.sum(y * (F.col(f"lag_{k}") - F.col("mean"))), F.lit(0.0)) / n).alias(f"g_{k}")
          for k in range(1, lags + 1)])
    kept = ["series_id", "mean", "n", *[f"g_{k}" for k in range(lags + 1)]]
    frame = frame.select(*kept, F.col("g_0").alias("v"))
    for m in range(1, lags + 1):
        known = F.lit(0.0)
        for j in range(1, m):
            known = known + F.col(f"phi_{j}") * F.col(f"g_{m - j}")
        step = F.when(F.col("v") > 0, (F.col(f"g_{m}") - known) / F.col("v")).otherwise(F.lit(0.0))
        frame = frame.withColumn("_k", step)
        frame = frame.select(*kept, (F.col("v") * (1.0 - F.col("_k") * F.col("_k"))).alias("v"),
                             *[(F.col(f"phi_{j}") - F.col("_k") * F.col(f"phi_{m - j}")).alias(f"phi_{j}")
                               for j in range(1, m)], F.col("_k").alias(f"phi_{m}"))
    return frame.select("series_id", "mean", *[f"phi_{k}" for k in range(1, lags + 1)],
                        F.sqrt(F.greatest("v", F.lit(0.0))).alias("sigma"), "n")


def _rolled(start: Column, phi: Column, lags: int, steps: int) -> Column:
    """``start`` (newest first) continued by the recursion, oldest first."""
    def ahead(state, _):
        terms = F.zip_with(phi, F.slice(state, 1, lags), lambda a, b: a * b)
        return F.concat(F.array(F.aggregate(terms, F.lit(0.0), lambda acc, z: acc + z)), state)
    if steps < 1:
        return start
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, ahead)


def arp_forecast(df: DataFrame, params: DataFrame, lags: int, horizon: int, freq: str,
                 origins: str = "last", model: str = "arp", context: int = 0,
                 chunk_buckets: int = 1440) -> DataFrame:
    """H-step forecasts of an AR(p): the recursion run ahead from the last p values (a
    missing one counts as the mean), sd from the psi weights: sigma * sqrt(psi_0^2 + ...
    + psi_{h-1}^2); 80 % interval. The weights are one row per series."""
    x = lagged(df, freq, lags - 1, chunk_buckets) if lags > 1 else df
    if origins not in ("eval", "last") and "time_idx" not in x.columns:
        x = dense_time_index(x, freq, chunk_buckets=chunk_buckets)
    x = pick_origins(x, origins, context, horizon, "time_idx", "ts")
    x = x.select("series_id", F.col("ts").alias("origin_ts"), F.col("value").alias("lag_0"),
                 *[f"lag_{k}" for k in range(1, lags)])
    phi = F.array(*[F.col(f"phi_{k}") for k in range(1, lags + 1)])
    unit = F.array(F.lit(1.0), *[F.lit(0.0)] * (lags - 1))
    psi = F.reverse(F.slice(_rolled(unit, phi, lags, horizon - 1), 1, horizon))
    params = params.select("series_id", "mean", "sigma", phi.alias("phi"), psi.alias("psi"))
    x = spread_join(x, params, ["series_id"], by="origin_ts")
    last = F.array(*[F.coalesce(F.col(f"lag_{k}") - F.col("mean"), F.lit(0.0)) for k in range(lags)])
    path = F.reverse(F.slice(_rolled(last, F.col("phi"), lags, horizon), 1, horizon))
    x = x.select("series_id", "origin_ts", "mean", "sigma", "psi", F.posexplode(path).alias("_i", "ahead"))
    x = x.withColumn("step", F.col("_i") + 1).withColumn("target_ts", add_steps("origin_ts", F.col("step"), freq))
    squares = F.aggregate(F.slice("psi", F.lit(1), F.col("step")), F.lit(0.0), lambda acc, z: acc + z * z)
    x = x.select("*", (F.col("mean") + F.col("ahead")).alias("predicted"), (F.col("sigma") * F.sqrt(squares)).alias("sd"))
    return forecast_frame(x, model, F.col("predicted"), extra=[
        F.col("sd"), (F.col("predicted") - F.lit(Z80) * F.col("sd")).alias("lower"),
        (F.col("predicted") + F.lit(Z80) * F.col("sd")).alias("upper")])


# ------------------------------------------------------- validation on many splits

def fold_number(ts: str, starts: list[str]) -> Column:
    """0 before the first start, then the number of starts that have passed."""
    at = F.lit(0)
    for s in starts:
        at = at + (F.col(ts) >= F.lit(s).cast("timestamp_ntz")).cast("int")
    return at


def backtest_ar(df: DataFrame, starts: list[str], horizon: int, freq: str, chunk_buckets: int = 1440) -> DataFrame:
    """Rolling-origin validation of AR(1): forecasts (and ``fold``) from every row of
    fold f, fitted on all rows before its start.

    The rows are read once: their sufficient statistics are summed per (series, fold)
    and a running sum over the folds before - one row per series and fold - gives every
    fold's fit; there is no refit per fold. Values are taken relative to the series
    mean, which cancels in the fit."""
    starts = sorted(starts)
    x = with_prev(df, freq, chunk_buckets).select("series_id", "ts", "value", "prev_value")
    mean = x.groupBy("series_id").agg(F.avg("value").alias("_mid"))
    x = spread_join(x, mean, ["series_id"], by="ts").withColumn("fold", fold_number("ts", starts))
    pair = x.where("prev_value is not null").select(
        "series_id", "fold", "_mid", (F.col("value") - F.col("_mid")).alias("y"), (F.col("prev_value") - F.col("_mid")).alias("x"))
    parts = {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"),
             "sxy": F.col("x") * F.col("y"), "syy": F.col("y") * F.col("y")}
    sums = pair.groupBy("series_id", "_mid", "fold").agg(*[F.sum(v).alias(k) for k, v in parts.items()])
    # a fold without rows of a series still has a fit: the folds before it
    every = sums.select("series_id", "_mid").distinct().withColumn(
        "fold", F.explode(F.sequence(F.lit(1), F.lit(len(starts)))))
    frame = sums.unionByName(every, allowMissingColumns=True).groupBy("series_id", "_mid", "fold").agg(
        *[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in parts])
    w = Window.partitionBy("series_id").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    frame = frame.select("series_id", "_mid", "fold", *[F.sum(k).over(w).alias(k) for k in parts]).where("n > 0")
    n = F.col("n")
    vx, vy = (F.col(f"s{c}{c}") / n - (F.col(f"s{c}") / n) * (F.col(f"s{c}") / n) for c in "xy")
    cov = F.col("sxy") / n - F.col("sx") / n * (F.col("sy") / n)
    flat = vx <= F.lit(1e-12) * F.greatest(F.col("sxx") / n, F.lit(1e-300))
    params = frame.select("series_id", "_mid", "fold", F.when(flat, F.lit(0.0)).otherwise(cov / vx).alias("phi"),
                          F.sqrt(F.greatest(vy - F.when(flat, F.lit(0.0)).otherwise(cov * cov / vx), F.lit(0.0))).alias("sigma"),
                          (F.col("sy") / n).alias("_my"), (F.col("sx") / n).alias("_mx"), n.cast("long").alias("n_pairs"))
    params = params.select("series_id", "fold", "phi", "sigma", "n_pairs", (
        F.col("_my") - F.col("phi") * F.col("_mx") + F.col("_mid") * (1.0 - F.col("phi"))).alias("c"))
    o = x.where("fold > 0").select("series_id", "fold", F.col("ts").alias("origin_ts"), F.col("value").alias("origin_value"))
    o = explode_steps(spread_join(o, params, ["series_id", "fold"], by="origin_ts"), horizon, freq)
    mean_, sd = _mean_sd(F.col("step"), F.col("phi"), F.col("c"), F.col("sigma"), F.col("origin_value"))
    o = o.select("*", mean_.alias("predicted"), sd.alias("sd"))
    return forecast_frame(o, "ar1", F.col("predicted"), extra=[F.col("sd"), F.col("fold"), F.col("n_pairs")])
