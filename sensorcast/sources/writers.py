"""Sinks: prepared tables, split stamps, parameter / model tables, metrics and
forecasts. All parquet (columnar, pruned on read); csv where asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_prepared(df: DataFrame, path: str, fmt: str = "parquet",
                   partition_by: tuple[str, ...] = ("split",), mode: str = "overwrite") -> str:
    """A4/A5: write train / eval (and full) rows, partitioned by split so a
    reader of one split prunes the other's files."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def write_raw_csv(df: DataFrame, path: str) -> str:
    """Text readings as csv with a header (the reference's raw input layout)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def split_timestamps(df: DataFrame, split: str, split_col: str = "split") -> DataFrame:
    """(series_id, ts) of one split, ready to be written next to it."""
    return df.where(F.col(split_col) == split).select("series_id", "ts")


def save_params(params: DataFrame, path: str) -> str:
    """Persist a per-series parameter or coefficient table. Written
    as one small parquet table, so a later join sees its true size."""
    params.write.mode("overwrite").parquet(path)
    return path


save_model = save_params


def write_metrics(metrics: DataFrame, path: str, mode: str = "append") -> str:
    """Append metrics rows, partitioned by model."""
    metrics.write.mode(mode).partitionBy("model").parquet(path)
    return path


def write_forecasts(fc: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Long-form forecasts (with actuals when aligned), by model."""
    fc.write.mode(mode).partitionBy("model").parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the cluster's shared checkpoint folder
    (``spark.checkpoint.dir``) and return the table read back.

    Used at stage boundaries that several later branches read (the prepared
    series feeds the scaler fit, every forecaster and the alignment): the
    upstream scan, shuffles and windows run once, later plans start from a
    columnar table with exact size statistics, and lineage is cut, so a lost
    executor never replays the preparation."""
    from ..session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
