"""Monitoring extensions named as goals in the reference's README
(no reference code): anomalies, early warning, interval coverage, ensembles,
multivariate views, spikes and KPI roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions.timefn import bucket_start
from .forecast.common import forecast_frame
from .layout import CHUNK, spread_join, with_halo

# Fixed value: logistic approximation of the normal CDF, Phi(z) ~ 1/(1+e^(-1.702 z)).
LOGISTIC_K = 1.702


def flag_anomalies(df: DataFrame, expected_col: str = "expected", z_limit: float = 3.0) -> DataFrame:
    """Residual z-score per series. ``expected_col`` is the model's value
    for the row's own time; residual mean / population sd come from train rows
    only, the flag is |z| > z_limit."""
    x = df.withColumn("resid", F.col("value") - F.col(expected_col))
    st = (x.where(F.col("split") == "train").groupBy("series_id")
          .agg(F.avg("resid").alias("_rm"), F.stddev_pop("resid").alias("_rs")))
    z = F.when(F.col("_rs") > 0, (F.col("resid") - F.col("_rm")) / F.col("_rs"))
    x = spread_join(x, st, ["series_id"]).withColumn("z", z)
    return x.withColumn("is_anomaly", F.abs(F.col("z")) > F.lit(z_limit)).drop("_rm", "_rs")


def breach_probability(fc: DataFrame, limits: DataFrame, sd_col: str = "sd") -> DataFrame:
    """P(value > limit) per forecast row from its mean and sd, with the
    logistic approximation of the normal CDF. ``limits``: (series_id, limit)."""
    z = (F.col("predicted") - F.col("limit")) / F.col(sd_col)
    certain = F.when(F.col("predicted") > F.col("limit"), F.lit(1.0)).otherwise(F.lit(0.0))
    prob = F.when(F.col(sd_col) > 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(LOGISTIC_K) * z))
                  ).otherwise(certain)
    return spread_join(fc, limits, ["series_id"]).withColumn("prob_breach", prob)


def interval_coverage(aligned_q: DataFrame, lower_q: float = 0.1, upper_q: float = 0.9,
                      keys=("model",)) -> DataFrame:
    """Share of actuals inside [q_lower, q_upper] of a quantile forecast."""
    k = [*keys, "series_id", "origin_ts", "step"]
    def level(q):
        return F.max(F.when(F.abs(F.col("q") - q) < 1e-9, F.col("predicted")))
    x = (aligned_q.where(E.is_valid_number("actual")).groupBy(*k)
         .agg(level(lower_q).alias("lo"), level(upper_q).alias("hi"), F.max("actual").alias("actual"))
         .where(F.col("lo").isNotNull() & F.col("hi").isNotNull()))
    inside = (F.col("actual") >= F.col("lo")) & (F.col("actual") <= F.col("hi"))
    return x.groupBy(*keys).agg(F.avg(inside.cast("double")).alias("coverage"),
                                F.count(F.lit(1)).alias("n"))


def inverse_rmse_weights(metrics_df: DataFrame, keys=("series_id",)) -> DataFrame:
    """Weights proportional to 1 / RMSE per key, normalised to sum to one.
    Feed metrics from a validation run, never from the evaluation range."""
    # a perfect model (rmse 0) gets a large finite weight instead of 1/0
    inv = metrics_df.select(*keys, "model", (F.lit(1.0) / F.greatest(F.col("rmse"), F.lit(1e-12)))
                            .alias("_inv"))
    tot = inv.groupBy(*keys).agg(F.sum("_inv").alias("_tot"))
    return inv.join(tot, list(keys)).select(*keys, "model",
                                            (F.col("_inv") / F.col("_tot")).alias("weight"))


def ensemble(fc: DataFrame, weights: DataFrame, model: str = "ensemble") -> DataFrame:
    """Weighted mean of point forecasts sharing (series, origin, step);
    weights renormalised over the models present for each row."""
    x = spread_join(fc.where(F.col("q").isNull()), weights, ["series_id", "model"], by="origin_ts")
    g = x.groupBy("series_id", "origin_ts", "step", "target_ts").agg(
        (F.sum(F.col("weight") * F.col("predicted")) / F.sum("weight")).alias("predicted"))
    return forecast_frame(g, model, F.col("predicted"))


def to_wide(df: DataFrame, series: list[str], value_col: str = "value") -> DataFrame:
    """One column per sensor on a shared time grid (ts). ``series`` lists
    the sensors, one column each; nothing is collected to find them."""
    return df.groupBy("ts").pivot("series_id", list(series)).agg(F.first(value_col))


def cross_correlation(df: DataFrame, pairs: DataFrame, value_col: str = "value") -> DataFrame:
    """Pearson r on shared stamps for the sensor pairs of a table (series_a,
    series_b) - the caller's choice, so the work grows with the pairs asked for.

    Long form: the readings of each wanted sensor are tagged with its pairs,
    brought together by (pair, ts), and reduced by one partial + final
    aggregate."""
    sides = [pairs.select("series_a", "series_b", F.col(c).alias("series_id"), F.lit(c[-1]).alias("_side"))
             for c in ("series_a", "series_b")]
    tagged = spread_join(df.select("series_id", "ts", value_col),
                         sides[0].unionByName(sides[1]), ["series_id"], by="ts")

    def of(side):
        return F.max(F.when(F.col("_side") == side, F.col(value_col)))
    both = (tagged.groupBy("series_a", "series_b", "ts").agg(of("a").alias("_a"), of("b").alias("_b")))
    shared = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.groupBy("series_a", "series_b").agg(
        F.corr("_a", "_b").alias("corr"), F.count(F.when(shared, 1)).alias("n"))


def residual_correction(fc: DataFrame, validation: DataFrame, model: str = "corrected") -> DataFrame:
    """Every point forecast plus its model's mean residual per series and
    step on a validation run (aligned forecasts, never the evaluation range)."""
    bias = (validation.where(E.is_valid_number("actual") & E.is_valid_number("predicted"))
            .groupBy("series_id", "model", "step")
            .agg(F.avg(F.col("actual") - F.col("predicted")).alias("_bias")))
    x = spread_join(fc.where(F.col("q").isNull()), bias, ["series_id", "model", "step"], "left")
    return forecast_frame(x, model, F.col("predicted") + F.coalesce("_bias", F.lit(0.0)),
                          extra=[F.col("model").alias("base_model")])


def flag_spikes(with_prev: DataFrame, k: float = 4.0) -> DataFrame:
    """First difference beyond k population sd of the train differences.
    Input has prev_value (contiguous previous bucket, else NULL)."""
    x = with_prev.where(F.col("prev_value").isNotNull()).withColumn(
        "diff", F.col("value") - F.col("prev_value"))
    sd = (x.where(F.col("split") == "train").groupBy("series_id")
          .agg(F.stddev_pop("diff").alias("_sd")))
    return (spread_join(x, sd, ["series_id"]).withColumn("threshold", F.lit(k) * F.col("_sd"))
            .where(F.abs(F.col("diff")) > F.col("threshold")).drop("_sd"))


def kpi_rollup(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Min / avg / max per series for every hour and every day
    (grouping sets: one aggregate, partial + final)."""
    x = df.select("series_id", bucket_start("ts", "1 day").alias("day"),
                  bucket_start("ts", "1 hour").alias("hour"), value_col)
    g = x.groupingSets([["series_id", "day"], ["series_id", "day", "hour"]],
                       "series_id", "day", "hour")
    out = g.agg(F.min(value_col).alias("min_value"), F.avg(value_col).alias("avg_value"),
                F.max(value_col).alias("max_value"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("level", F.when(F.col("hour").isNull(), F.lit("day"))
                          .otherwise(F.lit("hour")))



# Fixed value: the MAD of a normal distribution times this is its sd.
MAD_TO_SD = 1.4826


def _median(ordered: Column) -> Column:
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def hampel_spikes(df: DataFrame, half: int = 6, limit: float = 3.0, chunk_rows: int = 1440,
                  idx_col: str = "time_idx") -> DataFrame:
    """Rows further from the median of the ``half`` rows on either side (and their
    own) than ``limit`` robust sd, MAD_TO_SD times the median absolute deviation. A
    spike moves neither, so neighbouring spikes don't hide each other. Input has a dense
    row index; frames lie in (series, chunk) with a halo of ``half`` rows, so a task
    holds one chunk. Around a constant stretch (MAD 0) every other value is a spike."""
    x = with_halo(df.where(F.col("value").isNotNull()), idx_col, chunk_rows, back=half, fwd=half)
    w = Window.partitionBy("series_id", CHUNK).orderBy(idx_col).rowsBetween(-half, half)
    x = x.select("*", F.sort_array(F.collect_list("value").over(w)).alias("_near")).where("_own")
    x = x.withColumn("median", _median(F.col("_near")))
    away = F.sort_array(F.transform("_near", lambda v: F.abs(v - F.col("median"))))
    x = x.withColumn("robust_sd", F.lit(MAD_TO_SD) * _median(away))
    return (x.where(F.abs(F.col("value") - F.col("median")) > F.lit(limit) * F.col("robust_sd"))
            .drop("_near", "_own", CHUNK))


def normal_draw(*key: Column) -> Column:
    """A standard normal number that is a function of its key alone (MD5 counter,
    Box-Muller): the same on every engine, partitioning and rerun."""
    def uniform(part: str) -> Column:
        digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key], F.lit(part)))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)
    return (F.sqrt(-2.0 * F.log(uniform("a") + F.lit(2.0 ** -53))) * F.cos(F.lit(2.0 * 3.141592653589793) * uniform("b")))


def time_to_breach(origins: DataFrame, params: DataFrame, limits: DataFrame, horizon: int,
                   paths: int = 200, seed: int = 0) -> DataFrame:
    """Probability that a series has passed its limit by step 1..H of an AR(1).

    A breach at some step is not a breach at this step: the first passage needs whole
    paths. ``paths`` paths per origin (series_id, origin_ts, origin_value) are simulated
    row by row with draws keyed by (seed, series, origin, path, step). Returns
    (series_id, origin_ts, step, prob_by, mean_step), ``mean_step`` over the paths that
    breach, null if none does. Series without parameters or a limit are left out."""
    x = spread_join(spread_join(origins, params.select("series_id", "phi", "c", "sigma"), ["series_id"], by="origin_ts"),
                    limits, ["series_id"], by="origin_ts")
    x = x.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    key = (F.lit(seed), F.col("series_id"), F.unix_micros(F.col("origin_ts").cast("timestamp")), F.col("path"))

    def walk(state: Column, step: Column) -> Column:
        y = F.col("c") + F.col("phi") * state["y"] + F.col("sigma") * normal_draw(*key, step)
        hit = F.when(state["hit"] > 0, state["hit"]).when(y > F.col("limit"), step).otherwise(F.lit(0))
        return F.struct(y.alias("y"), hit.alias("hit"))
    start = F.struct(F.col("origin_value").alias("y"), F.lit(0).alias("hit"))
    x = x.select("series_id", "origin_ts", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, walk)["hit"].alias("hit"))
    by = [F.avg(((F.col("hit") > 0) & (F.col("hit") <= h)).cast("double")) for h in range(1, horizon + 1)]
    x = x.groupBy("series_id", "origin_ts").agg(F.array(*by).alias("by"),
                                                F.avg(F.when(F.col("hit") > 0, F.col("hit"))).alias("mean_step"))
    return x.select("series_id", "origin_ts", F.posexplode("by").alias("_i", "prob_by"), "mean_step").select(
        "series_id", "origin_ts", (F.col("_i") + 1).alias("step"), "prob_by", "mean_step")
