"""trend + seasonality decomposition (the N-BEATS idea of a trend stack
and a seasonality stack fitted to the trend's residual), per series by
aggregates: a least-squares line, then harmonic projections of the residual."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.timefn import bucket_index
from ..layout import spread_join
from .common import explode_steps, forecast_frame, origin_rows
from .solve import gram_sums, solve_rows


def _t(ts: str | Column, freq: str) -> Column:
    return bucket_index(ts, freq)


def _phase(t: Column, k: int, period: int) -> Column:
    m = F.pmod(t, F.lit(period))
    return F.lit(2.0) * F.lit(math.pi) * F.lit(k) * m / F.lit(period)


def trend_fit(df: DataFrame, freq: str, split_value: str | None = "train") -> DataFrame:
    """Linear trend in the bucket number t per series: slope, intercept, n."""
    x = df.where(F.col("split") == split_value) if split_value else df
    t = _t("ts", freq).cast("double")
    return x.groupBy("series_id").agg(F.regr_slope("value", t).alias("slope"),
                                      F.regr_intercept("value", t).alias("intercept"),
                                      F.count(F.lit(1)).alias("n"))


def poly_trend_fit(df: DataFrame, freq: str, degree: int = 2,
                   split_value: str | None = "train") -> DataFrame:
    """Polynomial trend of a series: (series_id, mid, half, c_0 .. c_degree, n) in
    u = (t - mid) / half, where the fitted buckets lie in [-1, 1].

    One aggregate finds the span, a second the sums of u^k and value * u^k; the
    small system is solved by elimination in one row's columns. A series with too
    few distinct buckets for the degree has NULL coefficients."""
    x = df.where(F.col("split") == split_value) if split_value else df
    t = _t("ts", freq).cast("double")
    span = x.groupBy("series_id").agg(((F.min(t) + F.max(t)) / 2).alias("mid"),
                                      F.greatest((F.max(t) - F.min(t)) / 2, F.lit(1.0)).alias("half"))
    u = (t - F.col("mid")) / F.col("half")
    x = spread_join(x.select("series_id", "ts", "value"), span, ["series_id"], by="ts").withColumn("_u", u)

    def power(k):
        return F.lit(1.0) if k == 0 else F.pow(F.col("_u"), F.lit(float(k)))
    sums = x.groupBy("series_id", "mid", "half").agg(
        *[F.sum(power(k)).alias(f"s_{k}") for k in range(2 * degree + 1)],
        *[F.sum(F.col("value") * power(k)).alias(f"v_{k}") for k in range(degree + 1)],
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("_last"), F.min("ts").alias("_first"))
    # the input is resampled: one row per bucket, so the rows are distinct times
    sums = sums.withColumn("_times", F.when(F.col("_first") == F.col("_last"), 1).otherwise(F.col("n")))
    k = degree + 1
    frame = sums.select("series_id", "mid", "half", "n", "_times", *[
        F.col(f"s_{i + j}" if j < k else f"v_{i}").alias(f"m_{i}_{j}") for i in range(k) for j in range(k + 1)])
    for p in range(k):                   # Gauss-Jordan, one column at a time
        pivot = F.col(f"m_{p}_{p}")
        row = {j: F.try_divide(F.col(f"m_{p}_{j}"), pivot) for j in range(p + 1, k + 1)}
        frame = frame.select("series_id", "mid", "half", "n", "_times", *[
            (row[j] if i == p else F.col(f"m_{i}_{j}") - F.col(f"m_{i}_{p}") * row[j]).alias(f"m_{i}_{j}")
            for i in range(k) for j in range(p + 1, k + 1)])
    enough = F.col("_times") > degree
    return frame.select("series_id", "mid", "half",
                        *[F.when(enough, F.col(f"m_{i}_{k}")).alias(f"c_{i}") for i in range(k)], "n")


def poly_trend_value(t: Column, degree: int) -> Column:
    """The fitted polynomial at bucket t, given the columns of its table."""
    u = (t.cast("double") - F.col("mid")) / F.col("half")
    e = F.col(f"c_{degree}")
    for k in range(degree - 1, -1, -1):
        e = e * u + F.col(f"c_{k}")
    return e


def trend_value(trend_cols=("intercept", "slope"), t: Column | None = None) -> Column:
    return F.col(trend_cols[0]) + F.col(trend_cols[1]) * t.cast("double")


def seasonal_fit(df: DataFrame, trend: DataFrame, freq: str, period: int, harmonics: int,
                 split_value: str | None = "train") -> DataFrame:
    """Harmonic k of the residual r = value - trend(t):
    a_k = 2 avg(r cos(2 pi k (t mod P) / P)), b_k = 2 avg(r sin(...)).
    Projection averages, so gaps in the grid do not couple the harmonics.

    The residual is linear in the trend's parameters, so its averages follow from
    those of value * wave, wave and t * wave: one partial + final aggregate of
    the rows, joined with the trend when there is one row per series left."""
    x = df.where(F.col("split") == split_value) if split_value else df
    t = _t("ts", freq)
    sums, waves = [], {}
    for k in range(1, harmonics + 1):
        waves |= {f"a_{k}": F.cos(_phase(t, k, period)), f"b_{k}": F.sin(_phase(t, k, period))}
    for name, wave in waves.items():
        sums += [F.avg(F.col("value") * wave).alias(f"v_{name}"), F.avg(wave).alias(f"w_{name}"),
                 F.avg(t.cast("double") * wave).alias(f"t_{name}")]
    if not sums:
        return x.select("series_id").distinct()
    out = x.groupBy("series_id").agg(*sums).join(trend, "series_id")
    return out.select("series_id", *[
        (F.lit(2.0) * (F.col(f"v_{n}") - F.col("intercept") * F.col(f"w_{n}")
                       - F.col("slope") * F.col(f"t_{n}"))).alias(n) for n in waves])


def joint_fit(df: DataFrame, freq: str, period: int, harmonics: int,
              split_value: str | None = "train") -> DataFrame:
    """Line and harmonics of a series by one least-squares fit: (series_id, intercept,
    slope, a_1, b_1, ..., n), to be used wherever ``trend_fit`` and ``seasonal_fit``
    are. Projections are exact on a full grid only; where buckets are missing the line
    and the waves are not orthogonal, and only the joint system separates them.

    One aggregate finds the span, a second one small Gram matrix per series in
    u = (t - mid) / half; it is solved by Cholesky in the tasks. A series with too few
    buckets, or all at the same phases, has NULL coefficients."""
    x = df.where(F.col("split") == split_value) if split_value else df
    x = x.where(F.col("value").isNotNull())
    t = _t("ts", freq).cast("double")
    span = x.groupBy("series_id").agg(((F.min(t) + F.max(t)) / 2).alias("mid"),
                                      F.greatest((F.max(t) - F.min(t)) / 2, F.lit(1.0)).alias("half"))
    x = spread_join(x.select("series_id", "ts", "value"), span, ["series_id"], by="ts")
    waves = {f"{c}_{k}": f(_phase(_t("ts", freq), k, period))
             for k in range(1, harmonics + 1) for c, f in (("a", F.cos), ("b", F.sin))}
    x = x.select("series_id", "mid", "half", "value", ((t - F.col("mid")) / F.col("half")).alias("u"),
                 *[w.alias(n) for n, w in waves.items()])
    columns = [F.lit(1.0), F.col("u"), *[F.col(n) for n in waves]]
    sums = x.groupBy("series_id", "mid", "half").agg(*gram_sums(columns, F.col("value")), F.count(F.lit(1)).alias("n"))
    c = solve_rows(sums, ["series_id", "mid", "half", "n"], len(columns))
    return c.select("series_id", (F.col("c_0") - F.col("c_1") * F.col("mid") / F.col("half")).alias("intercept"),
                    (F.col("c_1") / F.col("half")).alias("slope"),
                    *[F.col(f"c_{i}").alias(n) for i, n in enumerate(waves, 2)], "n")


def decompose_value(t: Column, harmonics: int, period: int) -> Column:
    """trend(t) + sum_k a_k cos + b_k sin, given trend and seasonal columns."""
    e = trend_value(t=t)
    for k in range(1, harmonics + 1):
        e = e + (F.col(f"a_{k}") * F.cos(_phase(t, k, period))
                 + F.col(f"b_{k}") * F.sin(_phase(t, k, period)))
    return e


def decompose_forecast(df: DataFrame, trend: DataFrame, seasonal: DataFrame, horizon: int,
                       freq: str, period: int, harmonics: int,
                       model: str = "decompose", origins: str = "eval", context: int = 0,
                       chunk_buckets: int = 1440) -> DataFrame:
    """Forecast for steps 1..H from the origins of a window mode: the fitted function of the target's time (the origin only fixes which
    targets are asked for)."""
    o = origin_rows(df, origins, context, horizon, freq, chunk_buckets).drop("origin_value")
    params = trend.join(seasonal, "series_id")       # one row per series on both sides
    x = explode_steps(spread_join(o, params, ["series_id"]), horizon, freq)
    return forecast_frame(x, model, decompose_value(_t("target_ts", freq), harmonics, period))
