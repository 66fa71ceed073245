"""Which of two sensors leads, and by how much.

The cross-covariance of a pair at every lag up to a limit is a sum over time, so it can
be cut into chunks: a chunk of the first sensor meets the same span of the second one,
longer by the largest lag on either side (overlap-add), and one FFT per pair and chunk
gives the partial sums of all lags at once. The partial sums are added up per pair and
lag; a task holds one pair's chunk, whatever the length of the series.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import bucket_index
from .layout import CHUNK, spread_join, with_halo


def lead_lag(df: DataFrame, pairs: DataFrame, max_lag: int, freq: str, chunk_buckets: int = 1440,
             value_col: str = "value") -> DataFrame:
    """(series_a, series_b, lag, corr) for the pairs of a table (series_a, series_b) and
    lags -max_lag .. max_lag: sum (a_t - mean)(b_{t+lag} - mean) over the buckets that
    both have, divided by the root of the product of the sums of squares. At a positive
    lag b follows a. A missing bucket counts as the mean, so |corr| <= 1 and short
    overlaps don't win; a constant series gives NULL; lags without any common bucket
    may be left out."""
    size = max(chunk_buckets, max_lag, 1)
    x = df.where(F.col(value_col).isNotNull()).select(
        "series_id", bucket_index("ts", freq).alias("_t"), F.col(value_col).cast("double").alias("_v"))
    stats = x.groupBy("series_id").agg(F.avg("_v").alias("mean"), (F.var_pop("_v") * F.count(F.lit(1))).alias("squares"))
    x = spread_join(x, stats.drop("squares"), ["series_id"], by="_t").select(
        "series_id", "_t", (F.col("_v") - F.col("mean")).alias("_d"))
    pairs = pairs.select("series_a", "series_b").distinct()

    def side(name):
        return spread_join(x, pairs.withColumn("series_id", F.col(name)), ["series_id"], by="_t").drop("series_id")
    first = side("series_a").withColumn(CHUNK, F.floor(F.col("_t") / F.lit(size)).cast("long")).withColumn("_a", F.lit(True))
    second = with_halo(side("series_b"), "_t", size, back=max_lag, fwd=max_lag).drop("_own").withColumn("_a", F.lit(False))
    n = 1 << (size + 2 * max_lag - 1).bit_length()

    def sums(t: pa.Table) -> pa.Table:
        at = t.column("_t").to_numpy() - t.column(CHUNK)[0].as_py() * size + max_lag
        d, own = t.column("_d").to_numpy(), t.column("_a").to_numpy(zero_copy_only=False)
        if own.all() or not own.any():
            at, lags = at[:0], np.empty(0, np.int64)
        else:
            lags = np.arange(-max_lag, max_lag + 1)
        a, b = np.zeros(size), np.zeros(size + 2 * max_lag)
        if len(lags):
            np.add.at(a, at[own] - max_lag, d[own])
            np.add.at(b, at[~own], d[~own])
        # entry k: the sum of a[i] * b[i + k]
        whole = np.fft.irfft(np.conj(np.fft.rfft(a, n)) * np.fft.rfft(b, n), n)[:len(lags)]
        return pa.table({"series_a": pa.array([t.column("series_a")[0].as_py()] * len(lags), pa.string()),
                         "series_b": pa.array([t.column("series_b")[0].as_py()] * len(lags), pa.string()),
                         "lag": pa.array(lags, pa.int64()), "part": pa.array(whole, pa.float64())})

    columns = ["series_a", "series_b", CHUNK, "_t", "_d", "_a"]
    parts = (first.select(*columns).unionByName(second.select(*columns)).groupBy("series_a", "series_b", CHUNK)
             .applyInArrow(sums, "series_a string, series_b string, lag long, part double"))
    out = parts.groupBy("series_a", "series_b", "lag").agg(F.sum("part").alias("sum"))
    for c in "ab":
        out = spread_join(out, stats.select(F.col("series_id").alias(f"series_{c}"), F.col("squares").alias(f"_s{c}")),
                          [f"series_{c}"], by="lag")
    scale = F.sqrt(F.col("_sa") * F.col("_sb"))
    return out.select("series_a", "series_b", "lag", F.when(scale > 0, F.col("sum") / scale).alias("corr"))


def best_lag(lags: DataFrame) -> DataFrame:
    """The lag of the largest |corr| per pair (of equal ones the shortest, then the
    positive one), beside the correlation at lag 0."""
    rank = F.struct(F.abs("corr").alias("size"), (-F.abs("lag")).alias("near"), F.col("lag"), F.col("corr"))
    out = lags.where("corr is not null").groupBy("series_a", "series_b").agg(
        F.max(rank).alias("b"), F.max(F.when(F.col("lag") == 0, F.col("corr"))).alias("corr_0"))
    return out.select("series_a", "series_b", F.col("b.lag").alias("lag"), F.col("b.corr").alias("corr"), "corr_0")
