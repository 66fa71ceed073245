"""Adapters from the driver tables to the canonical sensor frame
``(series_id, ts, value, quality)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import table

# A reading is 'Bad' when the first number in `props` is below 5.
BAD_BELOW = 5


def _quality(props: str = "props"):
    k = F.expr(f"try_cast(regexp_extract({props}, '([0-9]+)', 1) AS INT)")
    return F.when(k < BAD_BELOW, F.lit("Bad")).otherwise(F.lit("Good"))


def sensor_raw(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """events -> sensor readings; ``key`` = event_type (5 sensors) or user_id."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col(key).cast("string").alias("series_id"), "ts", "value",
                     _quality().alias("quality"))


def sensor_raw_text(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """The same readings as text columns, i.e. as a raw csv is read."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col(key).cast("string").alias("series_id"),
                     F.col("ts").cast("string").alias("DateTime"),
                     F.col("value").cast("string").alias("Value"),
                     _quality().alias("QualityStatus"))


def daily_supplier_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as one daily series per supplier (value = extended price)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias("series_id"),
                     F.col("l_shipdate").alias("ts"),
                     F.col("l_extendedprice").alias("value"),
                     F.lit("Good").alias("quality"))


def daily_priority_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as one daily series per order priority (value = total price)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("series_id"),
                    F.col("o_orderdate").alias("ts"),
                    F.col("o_totalprice").alias("value"),
                    F.lit("Good").alias("quality"))
