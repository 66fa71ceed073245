"""Golden cases G1-G10 (hand-checked values, see FIXTURES.md)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sensorcast.operators import clean, evaluate, ingest, scaling, segments
from sensorcast.operators.forecast import autoreg
from sensorcast.operators.resample import fill_gaps, resample_mean
from sensorcast.operators.windows import window_count
from sensorcast.operators.forecast.patch import n_patches


def T(s):
    return dt.datetime.fromisoformat(s)


def frame(spark, rows, schema="series_id string, ts timestamp_ntz, value double"):
    return spark.createDataFrame(rows, schema)


def test_g1_resample_fill(spark):
    day = "2024-01-01 "
    rows = [("s", T(day + t), v) for t, v in [("00:00:10", 1.0), ("00:00:50", 3.0),
            ("00:01:00", 4.0), ("00:04:30", 10.0), ("00:10:00", 22.0), ("00:10:30", 24.0)]]
    b = resample_mean(frame(spark, rows).withColumn("segment_id", F.lit(0)), "1 minute")
    out = fill_gaps(b, "1 minute", 3, chunk_buckets=4).orderBy("ts").collect()
    got = [(r.ts.strftime("%H:%M"), round(r.value, 6), r.filled) for r in out]
    assert got == [("00:00", 2.0, False), ("00:01", 4.0, False), ("00:02", 6.0, True),
                   ("00:03", 8.0, True), ("00:04", 10.0, False), ("00:05", 12.166667, True),
                   ("00:06", 14.333333, True), ("00:07", 16.5, True), ("00:10", 23.0, False)]


def test_g1_fill_variants(spark):
    rows = [("s", T("2024-01-01 00:00:00"), 0.0), ("s", T("2024-01-01 00:06:00"), 6.0)]
    b = frame(spark, rows).withColumn("segment_id", F.lit(0))
    assert fill_gaps(b, "1 minute", None).count() == 7
    assert fill_gaps(b, "1 minute", 3, fill_long_gaps=False).count() == 2


def test_g2_metrics(spark):
    rows = [("m", "s", a, p) for a, p in [(10., 11.), (12., 11.), (14., 15.), (8., 6.), (0., 1.)]]
    df = spark.createDataFrame(rows, "model string, series_id string, actual double, predicted double")
    m = evaluate.metrics(df).first()
    assert m.n == 5
    assert m.mae == pytest.approx(1.2)
    assert m.mse == pytest.approx(1.6)
    assert m.rmse == pytest.approx(1.264911, abs=1e-6)
    assert m.smape == pytest.approx(50.737488, abs=1e-6)
    assert m.r2 == pytest.approx(0.931507, abs=1e-6)
    v = evaluate.variance_check(df).first()
    assert v.var_actual == pytest.approx(23.36) and v.var_predicted == pytest.approx(23.36)
    assert v.corr == pytest.approx(0.965753, abs=1e-6)
    m4 = evaluate.metrics(df.where("actual <> 0")).first()
    assert m4.mape == pytest.approx(12.619048, abs=1e-6)


def test_g2_r2_constant_actual_is_null(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 1.0, 0.5)],
                               "model string, actual double, predicted double")
    assert evaluate.metrics(df).first().r2 is None


def test_g3_scaler(spark):
    rows = [("s", T("2024-01-01 00:00:00") + dt.timedelta(minutes=i), v, "train")
            for i, v in enumerate([2., 4., 4., 4., 5., 5., 7., 9.])]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double, split string")
    p = scaling.fit_scaler(df).first()
    assert p.mean == 5.0 and p.std == pytest.approx(2.0)   # population, not 2.138090
    probe = spark.createDataFrame([("s", 9.0), ("s", 1.0)], "series_id string, value double")
    got = sorted(r.value_scaled for r in scaling.scale(probe, scaling.fit_scaler(df)).collect())
    assert got == pytest.approx([-2.0, 2.0])
    const = df.withColumn("value", F.lit(3.0))
    assert scaling.fit_scaler(const).first().std == 1.0


def test_g4_segments(spark):
    stamps = ["00:00", "00:01", "00:02", "01:02", "02:03", "02:04", "02:05", "05:00"]
    rows = [("s", T(f"2024-01-01 {t}:00"), float(i)) for i, t in enumerate(stamps)]
    seg = segments.continuous_segments(frame(spark, rows), "60 minutes", "1 minute",
                                       chunk_buckets=30)
    assert [r.segment_id for r in seg.orderBy("ts").collect()] == [0, 0, 0, 0, 1, 1, 1, 2]
    kept = segments.keep_long_segments(seg, 3)
    assert sorted({r.segment_id for r in kept.collect()}) == [0, 1]


def test_g5_pinball(spark):
    rows = [(q, a, p) for q in (0.1, 0.5, 0.9) for a, p in [(10., 8.), (12., 13.)]]
    df = spark.createDataFrame(rows, "q double, actual double, predicted double").withColumn(
        "model", F.lit("m"))
    got = {r.q: r.pinball for r in evaluate.pinball_loss(df).collect()}
    assert got[0.1] == pytest.approx(0.55) and got[0.5] == pytest.approx(0.75)
    assert got[0.9] == pytest.approx(0.95)


def test_g6_ar1(spark):
    vals = [1, 2, 1.5, 2.5, 2, 3]
    rows = [("s", T("2024-01-01 00:00:00") + dt.timedelta(hours=i), float(v), "train", 0)
            for i, v in enumerate(vals)]
    df = spark.createDataFrame(
        rows, "series_id string, ts timestamp_ntz, value double, split string, segment_id int")
    p = autoreg.ar_fit(df, "1 hour", chunk_buckets=2).first()
    assert p.phi == pytest.approx(-0.038462, abs=1e-6)
    assert p.c == pytest.approx(2.269231, abs=1e-6)
    assert p.sigma == pytest.approx(0.509525, abs=1e-6)
    fc = autoreg.ar_forecast(df, autoreg.ar_fit(df, "1 hour"), 2, "1 hour").orderBy("step").collect()
    m1 = p.c + p.phi * 3.0
    assert fc[0].predicted == pytest.approx(m1)
    assert fc[1].predicted == pytest.approx(p.c + p.phi * m1)
    assert fc[1].sd == pytest.approx(p.sigma * math.sqrt(1 + p.phi ** 2))


def test_g7_window_counts(spark):
    df = spark.range(498_240).select(F.lit("s").alias("series_id"), F.lit(0).alias("segment_id"))
    r = window_count(df, 144, 12).first()
    assert r.windows_full == 498_085 and r.windows_reference == 498_084
    assert n_patches(144, 16, 8) == 17


def test_g8_calendar(spark):
    from sensorcast.operators.features import calendar_features
    df = frame(spark, [("s", T("2026-07-06 10:00:00"), 1.0), ("s", T("2026-07-11 10:00:00"), 1.0)])
    got = [(r.day_of_week, r.is_weekend) for r in calendar_features(df).orderBy("ts").collect()]
    assert got == [(0, 0), (5, 1)]


def test_g9_coercion(spark):
    vals = ["1.5", " 2 ", "1e3", "x", "", "nan", None, "inf"]
    df = spark.createDataFrame([(v,) for v in vals], "value_raw string")
    got = [r.value for r in ingest.parse_value(df).collect()]
    assert got[:3] == [1.5, 2.0, 1000.0]
    assert got[3:7] == [None] * 4
    assert got[7] == math.inf
    kept = ingest.drop_missing(ingest.parse_value(df).select("value"), ["value"]).count()
    assert kept == 4


def test_g9_strict_timestamp_fails(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("not a time",)], "ts_raw string")
    assert ingest.parse_ts(df, strict=False).where("ts IS NULL").count() == 1
    with pytest.raises(Exception):
        ingest.parse_ts(df, strict=True).collect()


def test_g10_invalid_interval(spark):
    stamps = ["2025-07-31 23:59:59", "2025-08-01 00:00:00", "2026-04-30 23:59:59",
              "2026-05-01 00:00:00"]
    df = frame(spark, [("s", T(t), 1.0) for t in stamps])
    iv = (("2025-08-01 00:00:00", "2026-04-30 23:59:59"),)
    kept = [r.ts for r in clean.exclude_interval(df, iv).orderBy("ts").collect()]
    assert kept == [T(stamps[0]), T(stamps[3])]
    seg = clean.label_segment(clean.exclude_interval(df, iv), iv).orderBy("ts").collect()
    assert [r.segment_id for r in seg] == [0, 1]
    ho = (("2025-08-01 00:00:00", "2026-05-01 00:00:00"),)
    assert clean.exclude_interval(df, ho, half_open=True).count() == 2
    per_series = spark.createDataFrame([("s", T("2025-08-01 00:00:00"), T("2026-04-30 23:59:59"))],
                                       "series_id string, start timestamp_ntz, end timestamp_ntz")
    assert clean.exclude_interval(df, per_series).count() == 2


def test_g3_global_scaler(spark):
    rows = [("a", T("2024-01-01 00:00:00"), 2.0, "train"), ("b", T("2024-01-01 00:00:00"), 4.0, "train")]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double, split string")
    params = scaling.fit_scaler(df, keys=())
    got = sorted(r.value_scaled for r in scaling.scale(df, params, keys=()).collect())
    assert got == pytest.approx([-1.0, 1.0])


def test_constant_sensor_under_ansi(spark):
    """ANSI mode (Spark 4 default) raises on x / 0: a flat sensor must still fit."""
    rows = [("s", T("2024-01-01 00:00:00") + dt.timedelta(hours=i), 5.0,
             "train" if i < 20 else "eval", 0) for i in range(30)]
    df = spark.createDataFrame(
        rows, "series_id string, ts timestamp_ntz, value double, split string, segment_id int")
    p = autoreg.ar_fit(df, "1 hour").first()
    assert (p.phi, p.c, p.sigma) == (0.0, 5.0, 0.0)
    fc = autoreg.ar_forecast(df, autoreg.ar_fit(df, "1 hour"), 3, "1 hour", "eval")
    assert {r.predicted for r in fc.collect()} == {5.0}
    from sensorcast.operators.monitor import breach_probability
    lim = spark.createDataFrame([("s", 4.0)], "series_id string, limit double")
    assert {r.prob_breach for r in breach_probability(fc, lim).collect()} == {1.0}


def test_baseline_window_counts(spark):
    """BASELINE: 498,240 train rows and 27,875 eval rows at L = 144, H = 12 give
    498,085 train windows and, with 144 train rows as warm-up before the
    cutoff, 27,864 eval windows."""
    from sensorcast.operators.split import eval_with_halo, split_at_cutoff
    n_train, n_eval = 498_240, 27_875
    df = spark.range(n_train + n_eval).select(
        F.lit("s").alias("series_id"), F.lit(0).alias("segment_id"),
        F.col("id").alias("time_idx"),
        F.when(F.col("id") < n_train, F.lit("train")).otherwise(F.lit("eval")).alias("split"))
    cut = split_at_cutoff(df)
    train = window_count(cut.where("part = 'train'"), 144, 12).first()
    assert train.windows_full == 498_085
    ev = window_count(eval_with_halo(cut, 144).where("time_idx > cutoff - 144"), 144, 12).first()
    assert ev.n_rows == n_eval + 144 and ev.windows_full == 27_864
