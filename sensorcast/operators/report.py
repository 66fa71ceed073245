"""Time extent, stage counts and the preparation summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_extent(df: DataFrame, keys=("series_id",), ts_col: str = "ts") -> DataFrame:
    """First and last stamp (and row count) per key."""
    return df.groupBy(*keys).agg(F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"),
                                 F.count(F.lit(1)).alias("n_rows"))


def stage_counts(raw: DataFrame, prepared: DataFrame, intervals, ok=("Good",)) -> DataFrame:
    """Row counts of every stage, two passes in total: one aggregate over
    the raw readings (raw / good / outside the removed periods), one over the
    prepared rows (buckets / filled / train / eval). Long form (stage, n_rows)."""
    from .clean import _in_any
    good = F.col("quality").isin(list(ok)) & F.col("value").isNotNull() & ~F.isnan("value")
    r = raw.agg(F.count(F.lit(1)).alias("raw"), F.count_if(good).alias("good"),
                F.count_if(good & ~_in_any(F.col("ts"), intervals)).alias("valid"))
    p = prepared.agg(F.count_if(~F.col("filled")).alias("observed_buckets"),
                     F.count_if(F.col("filled")).alias("filled_buckets"),
                     F.count(F.lit(1)).alias("regular_rows"),
                     F.count_if(F.col("split") == "train").alias("train_rows"),
                     F.count_if(F.col("split") == "eval").alias("eval_rows"))
    rl = r.unpivot([], ["raw", "good", "valid"], "stage", "n_rows")
    pl = p.unpivot([], ["observed_buckets", "filled_buckets", "regular_rows", "train_rows",
                        "eval_rows"], "stage", "n_rows")
    return rl.unionByName(pl).withColumn("n_rows", F.col("n_rows").cast("long"))


def prep_summary(raw: DataFrame, prepared: DataFrame, freq: str, limit) -> DataFrame:
    """Item / Value table (values as text) of a preparation run: two
    one-row aggregates unpivoted and stacked, no join."""
    # The item labels of the reference's summary table.
    r = raw.agg(F.count(F.lit(1)).cast("string").alias("Total raw data"),
                F.lit(freq).alias("Resample frequency"),
                F.lit("none" if limit is None else str(limit)).alias("Interpolation limit"))
    p = prepared.agg(F.count(F.lit(1)).cast("string").alias("Final valid data"),
                     F.count_if(F.col("split") == "train").cast("string").alias("Train data"),
                     F.count_if(F.col("split") == "eval").cast("string").alias("Evaluation data"))
    return (r.unpivot([], r.columns, "item", "value")
            .unionByName(p.unpivot([], p.columns, "item", "value")))
