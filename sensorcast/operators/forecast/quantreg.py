"""conditional quantiles by regression on known inputs (the contract of a model with
quantile outputs and known future covariates).

Per series and level q, a smooth stand-in of the pinball loss of value - x'b,
(|r| - eps ln(eps + |r|)) / 2 + (q - 1/2) r, is minimised over the calendar features x
of the time stamp. Each pass replaces it by the quadratic that touches it at the
residuals of the pass before (weights 1 / (eps + |r|), a push of 2q - 1), so a pass is
one weighted Gram matrix per (series, q) by partial aggregates and one small solution
per key. The coefficients of a pass are written to the
shared folder, so a lost executor repeats one pass at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.timefn import bucket_index
from ...sources.writers import materialize
from ..layout import spread_join
from .common import explode_steps, forecast_frame, origin_rows
from .solve import gram_sums, solve_rows

QUANTILES = (0.1, 0.5, 0.9)
PASSES = 12
#: eps in standard deviations of the series: wide in the first pass, then narrower to a
#: floor. A wide eps moves the outer levels outwards, a narrow one alone settles slowly.
SMOOTH, NARROWER, FLOOR = 0.2, 0.6, 0.005
RIDGE = 1e-9


def smoothing(step: int) -> float:
    return max(FLOOR, SMOOTH * NARROWER ** (step - 1))


def design(ts: str, freq: str, period: int, harmonics: int) -> list[Column]:
    """[1, weekend, cos and sin of each harmonic of the period], all known beforehand."""
    at = F.pmod(bucket_index(ts, freq), F.lit(period)) / F.lit(float(period))
    waves = [f(F.lit(2.0 * math.pi * k) * at) for k in range(1, harmonics + 1) for f in (F.cos, F.sin)]
    return [F.lit(1.0), (F.weekday(ts) >= 5).cast("double"), *waves]


def _value(features: list[Column]) -> Column:
    e = F.col("c_0") * features[0]
    for i, f in enumerate(features[1:], 1):
        e = e + F.col(f"c_{i}") * f
    return e


def quantile_regression(df: DataFrame, freq: str, period: int, harmonics: int = 2,
                        quantiles=QUANTILES, passes: int = PASSES,
                        ridge: float = RIDGE, split_value: str | None = "train") -> DataFrame:
    """Coefficients (series_id, q, n, scale, c_0 .. c_{k-1}) of ``design`` per series
    and level. Rows without a value take no part; a series whose features are
    linearly dependent (no weekend, say) gets the ridge solution, one without rows
    none. The first pass is least squares."""
    x = df.where(F.col("split") == split_value) if split_value else df
    x = x.where(F.col("value").isNotNull() & ~F.isnan("value"))
    k = 2 + 2 * harmonics
    names = [F.col(f"f_{i}") for i in range(k)]
    x = x.select("series_id", "ts", F.col("value").cast("double").alias("value"),
                 *[f.alias(f"f_{i}") for i, f in enumerate(design("ts", freq, period, harmonics))])
    sums = x.groupBy("series_id").agg(
        *gram_sums(names, F.col("value")), F.count(F.lit(1)).alias("n"),
        F.greatest(F.stddev_pop("value"), F.lit(1e-9)).alias("scale"))
    fit = solve_rows(sums, ["series_id", "n", "scale"], k, ridge)
    fit = fit.select("series_id", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"),
                     "n", "scale", *names_of(k))
    fit = materialize(fit, "quantreg-0")
    for step in range(1, passes + 1):
        rows = spread_join(x, _by_series(fit, k), ["series_id"], by="ts")
        rows = rows.select("series_id", "value", *[f"f_{i}" for i in range(k)], F.inline("fits"))
        weight = 1.0 / (F.lit(smoothing(step)) * F.col("scale") + F.abs(F.col("value") - _value(names)))
        sums = (rows.withColumn("w", weight).groupBy("series_id", "q", "n", "scale")
                .agg(*gram_sums(names, F.col("value"), F.col("w"), 2.0 * F.col("q") - 1.0)))
        fit = materialize(solve_rows(sums, ["series_id", "q", "n", "scale"], k, ridge), f"quantreg-{step}")
    return fit


def names_of(k: int) -> list[str]:
    return [f"c_{i}" for i in range(k)]


def _by_series(fit: DataFrame, k: int) -> DataFrame:
    """One row per series with the fits of all levels, so rows meet them in one join."""
    return fit.groupBy("series_id").agg(F.collect_list(F.struct("q", "n", "scale", *names_of(k))).alias("fits"))


def quantile_regression_forecast(df: DataFrame, fit: DataFrame, horizon: int, freq: str, period: int,
                                 harmonics: int = 2, model: str = "quantile_regression",
                                 origins: str = "eval", context: int = 0, chunk_buckets: int = 1440) -> DataFrame:
    """The fitted quantiles at the target times of steps 1..H, in rising order: where
    fits of two levels cross, they are exchanged (which never raises the pinball loss)."""
    k = 2 + 2 * harmonics
    o = origin_rows(df, origins, context, horizon, freq, chunk_buckets).drop("origin_value")
    x = explode_steps(spread_join(o, _by_series(fit, k), ["series_id"], by="origin_ts"), horizon, freq)
    x = x.select("*", *[f.alias(f"f_{i}") for i, f in enumerate(design("target_ts", freq, period, harmonics))])

    def at(c):
        e = c["c_0"] * F.col("f_0")
        for i in range(1, k):
            e = e + c[f"c_{i}"] * F.col(f"f_{i}")
        return e
    levels = F.sort_array(F.transform("fits", lambda c: c["q"]))
    values = F.sort_array(F.transform("fits", at))
    x = x.select("series_id", "origin_ts", "step", "target_ts",
                 F.inline(F.arrays_zip(levels.alias("q"), values.alias("value"))))
    return forecast_frame(x, model, F.col("value"), q=F.col("q"))
