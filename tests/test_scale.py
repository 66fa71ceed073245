"""Plans and layouts that hold at scale: one scan per ordered operator, no raw
row by series alone, ties and hot sensors, csv headers, scratch folders."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from conftest import SF_MID  # noqa: E402
from sensorcast import session  # noqa: E402
from sensorcast.operators import clean, resample  # noqa: E402
from sensorcast.operators.forecast import basis, common  # noqa: E402
from sensorcast.operators.layout import spread_join, with_halo  # noqa: E402
from sensorcast.operators.quantiles import group_quantiles  # noqa: E402
from sensorcast.operators.segments import dense_time_index  # noqa: E402
from sensorcast.plans.catalog import QUERIES  # noqa: E402
from sensorcast.session import scratch_path  # noqa: E402
from sensorcast.sources.readers import read_raw  # noqa: E402


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["fill_gaps", "time_index", "continuous_segments", "kpi_rollup", "time_gaps"])
def test_one_scan_per_ordered_operator(spark, name):
    plan = final_plan(QUERIES[name](spark, SF_MID))
    scans = len(re.findall(r"Scan parquet", plan))
    assert scans - len(re.findall(r"ReusedExchange|ReusedQueryStage", plan)) <= 1 or scans == 1, plan


def hot_frame(spark, n=20000):
    base = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 17))).alias("series_id"),
        F.col("id").alias("time_idx"), (F.col("id") % 7).cast("double").alias("value"))
    return base.select("*", F.timestamp_add("MINUTE", F.col("time_idx").cast("int"),
                                            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"))


def test_parameter_join_spreads_a_hot_series(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = hot_frame(spark)
        params = df.groupBy("series_id").agg(F.avg("value").alias("mean"))
        out = spread_join(df, params, ["series_id"])
        per = out.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
        assert per.sum() == 20000 and per.max() < 0.45 * 20000
        assert "_part" not in out.columns
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(series_id" in plan and "_part" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_stuck_sensor_quantiles(spark):
    df = spark.range(30000).select(F.lit("a").alias("g"), F.when(F.col("id") % 10 < 9, F.lit(5.0))
                                   .otherwise(F.col("id").cast("double")).alias("v"))
    qs = [0.0, 0.1, 0.5, 0.899, 0.95, 1.0]
    got = {r.q: r.value for r in group_quantiles(df, ["g"], "v", qs).collect()}
    x = np.array([r.v for r in df.collect()])
    for q in qs:
        assert got[q] == pytest.approx(np.quantile(x, q), rel=1e-12)


def test_seasonal_fit_equals_residual_projection(spark):
    df = hot_frame(spark, 3000).withColumn("split", F.lit("train"))
    tr = basis.trend_fit(df, "1 minute")
    got = {r.series_id: r for r in basis.seasonal_fit(df, tr, "1 minute", 24, 2).collect()}
    for sid, g in df.join(tr, "series_id").toPandas().groupby("series_id"):
        t = (g["ts"].astype("datetime64[us]").astype("int64") // 60_000_000).to_numpy()
        r = g["value"] - (g["intercept"] + g["slope"] * t)
        for k in (1, 2):
            w = 2 * np.pi * k * (t % 24) / 24
            assert got[sid][f"a_{k}"] == pytest.approx(2 * (r * np.cos(w)).mean(), abs=1e-7)
            assert got[sid][f"b_{k}"] == pytest.approx(2 * (r * np.sin(w)).mean(), abs=1e-7)


def test_cubic_trend_equals_polyfit(spark):
    df = hot_frame(spark, 600).withColumn("split", F.lit("train"))
    df = df.withColumn("value", F.pow(F.col("time_idx") / 100, 3.0) - 2 * F.col("time_idx") / 100 + F.col("value") / 10)
    few = df.limit(1).withColumn("series_id", F.lit("few"))
    fit = basis.poly_trend_fit(df.unionByName(few), "1 minute", 3)
    got = {r.series_id: r for r in fit.collect()}
    assert got["few"].c_0 is None and got["few"].n == 1
    for sid, g in df.toPandas().groupby("series_id"):
        u = ((g["ts"].astype("datetime64[us]").astype("int64") // 60_000_000) - got[sid].mid) / got[sid].half
        want = np.polynomial.polynomial.polyfit(u, g["value"], 3)
        assert [got[sid][f"c_{i}"] for i in range(4)] == pytest.approx(want, abs=1e-8)


def test_window_modes(spark):
    L, H = 5, 3
    df = hot_frame(spark, 300).where("series_id = 'hot'")
    df = dense_time_index(df.drop("time_idx"), "1 minute").withColumn(
        "split", F.when(F.col("time_idx") < 120, "train").otherwise("eval"))
    n_eval = df.where("split = 'eval'").count()

    def origins(mode):
        o = common.origin_rows(df, mode, L, H, "1 minute")
        return sorted(r.time_idx for r in o.join(df.select(F.col("ts").alias("origin_ts"), "time_idx"), "origin_ts").collect())
    last = 120 + n_eval - 1
    assert origins("all") == list(range(119, last - H + 1)) and len(origins("all")) == n_eval - H + 1
    assert origins("no_warmup") == list(range(119 + L, last - H + 1))
    assert origins("last_eval") == [last - H]
    assert origins("eval") == list(range(120, last + 1)) and origins("last") == [119]
    # the reference's counts: 27,875 eval rows, horizon 12, one last window of 12 steps
    assert 27_875 - 12 + 1 == 27_864


def test_halo_longer_than_a_chunk(spark):
    df = hot_frame(spark, 200).where("series_id = 'hot'")
    out = with_halo(df, "time_idx", 4, back=30, fwd=10)
    assert out.where("_own").count() == df.count()


def test_fill_limit_above_chunk(spark):
    df = spark.createDataFrame([("a", 0, "2024-01-01 00:00:00", 0.0), ("a", 0, "2024-01-01 01:00:00", 60.0)],
                               "series_id string, segment_id int, ts string, value double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    for limit in (5, 20, 100):
        got = resample.fill_gaps(df, "1 minute", limit, chunk_buckets=8).orderBy("ts").toPandas()
        assert len(got) == 2 + min(limit, 59)
        assert np.allclose(got["value"], (got["ts"] - got["ts"].iloc[0]).dt.total_seconds() / 60)


def test_raw_csv_with_other_headers(spark):
    path = scratch_path(spark, "headers")
    a = spark.createDataFrame([("2024-01-01 00:00:00", "1.5", "Good")], "DateTime string, Value string, QualityStatus string")
    a.write.option("header", True).csv(f"{path}/a")
    (a.select("QualityStatus", "DateTime", F.lit("x,y").alias("Note"), F.lit("2.5").alias("Value"))
     .write.option("header", True).csv(f"{path}/b"))
    with pytest.raises(Exception, match="(?i)header|conform|number of column"):
        read_raw(spark, f"{path}/*", series_id="s").collect()
    got = read_raw(spark, f"{path}/*", series_id="s", mixed_headers=True).collect()
    assert sorted((r.ts_raw, r.value_raw, r.quality) for r in got) == [
        ("2024-01-01 00:00:00", "1.5", "Good"), ("2024-01-01 00:00:00", "2.5", "Good")]
    a.select("DateTime", "Value").write.option("header", True).csv(f"{path}/c")
    with pytest.raises(ValueError, match="QualityStatus"):
        read_raw(spark, f"{path}/*", series_id="s", mixed_headers=True)
    with pytest.raises(ValueError, match="QualityStatus"):
        read_raw(spark, f"{path}/c", series_id="s")


def test_segments_of_per_series_periods(spark):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-03 00:00:00"), ("b", "2024-01-03 00:00:00"), ("c", "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "series_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    iv = spark.createDataFrame([("a", "2024-01-02 00:00:00"), ("b", "2024-01-04 00:00:00")], "series_id string, d string").select(
        "series_id", F.col("d").cast("timestamp_ntz").alias("start"), F.col("d").cast("timestamp_ntz").alias("end"))
    got = {(r.series_id, str(r.ts)): r.segment_id for r in clean.label_segment(df, iv).collect()}
    assert got["a", "2024-01-01 00:00:00"] == 0
    assert got["a", "2024-01-03 00:00:00"] == 1 and got["b", "2024-01-03 00:00:00"] == 0 == got["c", "2024-01-03 00:00:00"]
    with pytest.raises(Exception, match="removed period"):
        clean.assert_excluded(df, [("2024-01-03 00:00:00", "2024-01-03 01:00:00")]).collect()
    assert clean.assert_excluded(df, [("2025-01-03 00:00:00", "2025-01-03 01:00:00")]).count() == 4


def test_scratch_refuses_a_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        session.checkpoint_root(Session())


def test_drop_scratch(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(fs_path)
    # only this test's table: the session's other scratch is still read
    assert fs.delete(fs_path, True) and not fs.exists(fs_path)
