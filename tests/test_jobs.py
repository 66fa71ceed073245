"""The two reference steps as jobs, from a raw csv (DateTime, Value,
QualityStatus) written from the events table, to metrics on disk."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from conftest import SF_MID  # noqa: E402
from sensorcast import EVENTS_HOURLY, forecast_job, preprocess_job  # noqa: E402
from sensorcast.session import scratch_path  # noqa: E402
from sensorcast.sources.tables import sensor_raw_text  # noqa: E402


def test_preprocess_then_forecast(spark):
    raw_dir = scratch_path(spark, "raw_csv")
    (sensor_raw_text(spark, SF_MID).withColumn("Extra", F.lit("ignored"))
     .write.option("header", True).csv(raw_dir))
    out = scratch_path(spark, "job")
    paths = preprocess_job(spark, raw_dir, out, EVENTS_HOURLY)
    prep = spark.read.parquet(paths["prepared"])
    assert prep.count() == 2999          # FIXTURES: hourly rows after filling
    assert {"hour", "day_of_week", "is_weekend", "time_idx", "value_scaled"} <= set(prep.columns)
    assert spark.read.parquet(paths["prepared"]).where("split = 'eval'").count() == 840
    res = forecast_job(spark, paths["prepared"], out, EVENTS_HOURLY)
    m = spark.read.parquet(res["metrics"])
    assert m.select("model").distinct().count() == 5
    assert m.groupBy("model").count().where("count <> 5").count() == 0
    assert spark.read.parquet(res["model_ar1"]).count() == 5
    heads = spark.read.parquet(res["model_patch_linear"])
    assert heads.select("step").distinct().count() == EVENTS_HOURLY.horizon
    lb = spark.read.parquet(res["leaderboard"])
    assert lb.where("is_best").select("metric").distinct().count() == 6


def test_one_last_window_per_series(spark):
    from sensorcast import EVENTS_HOURLY, forecast
    from sensorcast.plans.catalog import prepared
    p = prepared(spark, SF_MID, EVENTS_HOURLY)
    fc = forecast(p, EVENTS_HOURLY, origins="last", chunk_rows=64)
    per = fc.groupBy("model", "series_id").agg(F.countDistinct("origin_ts").alias("o"),
                                              F.count(F.lit(1)).alias("n")).collect()
    assert {r.o for r in per} == {1} and {r.n for r in per} == {EVENTS_HOURLY.horizon}
    assert len({r.model for r in per}) == 5
