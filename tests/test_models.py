"""Later forecasters and monitors against NumPy, brute force and themselves."""

import os
import sys
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest import SF_SMALL  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sensorcast.config import EVENTS_HOURLY as CFG  # noqa: E402
from sensorcast.operators import clean, evaluate, layout, leadlag, monitor, segments  # noqa: E402
from sensorcast.operators.forecast import autoreg, basis, quantile, quantreg, solve  # noqa: E402
from sensorcast.plans.catalog import QUERIES, prepared  # noqa: E402
from sensorcast.session import scratch_path  # noqa: E402
from sensorcast.streaming import monitor as SM  # noqa: E402
from sensorcast.streaming import stream as ST  # noqa: E402

START = datetime(2024, 3, 1)
SCHEMA = "series_id string, segment_id int, ts timestamp_ntz, value double, split string"


def frame(spark, series, train=None):
    """{series: [value or None per hour]} as prepared rows."""
    rows = [(s, 0, START + timedelta(hours=k), float(v), "train" if train is None or k < train else "eval")
            for s, values in series.items() for k, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, SCHEMA)


def gapped(n, seed, f=lambda k, r: r.normal()):
    r = np.random.default_rng(seed)
    return [None if r.random() < 0.15 else f(k, r) for k in range(n)]


@pytest.fixture(scope="module")
def hourly(spark):
    return prepared(spark, SF_SMALL, CFG, materialize=True)


# ---------------------------------------------------------------- least squares per key

def test_cholesky_solves_and_refuses():
    r = np.random.default_rng(1)
    a = r.normal(size=(4, 9, 3))
    m, v = np.einsum("nri,nrj->nij", a, a), r.normal(size=(4, 3))
    m[2] = np.outer([1, 2, 3], [1, 2, 3])                  # one dimension only
    m[3] = np.nan
    got = solve.cholesky_solve(m, v)
    for n in (0, 1):
        assert np.allclose(got[n], np.linalg.solve(m[n], v[n]))
    assert np.isnan(got[2:]).all()
    assert len(solve.cholesky_solve(m[:0], v[:0])) == 0


def test_joint_fit_on_a_gapped_series(spark):
    def f(k, r):
        return 5 + 0.02 * k + 3 * np.cos(2 * np.pi * k / 24) + r.normal() * 0.1
    values = [None if 100 < k < 160 or k % 24 in (3, 4, 5) else f(k, np.random.default_rng(k)) for k in range(400)]
    df = frame(spark, {"a": values, "short": [1.0, 2.0], "flat": [4.0] * 60})
    got = {r.series_id: r for r in basis.joint_fit(df, "1 hour", 24, 2).collect()}
    t0 = int((START - datetime(1970, 1, 1)).total_seconds() // 3600)
    t = np.array([t0 + k for k, v in enumerate(values) if v is not None], float)
    y = np.array([v for v in values if v is not None])
    waves = [g(2 * np.pi * k * (t % 24) / 24) for k in (1, 2) for g in (np.cos, np.sin)]
    mid = t.mean()
    want = np.linalg.lstsq(np.stack([np.ones_like(t), t - mid, *waves], 1), y, rcond=None)[0]
    assert got["a"].slope == pytest.approx(want[1], rel=1e-6)
    assert got["a"].intercept + got["a"].slope * mid == pytest.approx(want[0], rel=1e-8)
    assert [got["a"][c] for c in ("a_1", "b_1", "a_2", "b_2")] == pytest.approx(list(want[2:]), abs=1e-8)
    assert got["short"].slope is None and got["short"].n == 2
    assert got["flat"].slope == pytest.approx(0, abs=1e-9)
    # projections mix the line and the waves on such a grid
    tr = basis.trend_fit(df.where("series_id = 'a'"), "1 hour")
    se = basis.seasonal_fit(df.where("series_id = 'a'"), tr, "1 hour", 24, 2).first()
    assert abs(se.a_1 - want[2]) > 10 * abs(got["a"].a_1 - want[2])


# ------------------------------------------------------------------ conditional quantiles

def test_quantile_regression_passes_lower_the_loss(spark):
    values = gapped(900, 5, lambda k, r: 10 + 4 * np.sin(2 * np.pi * k / 24) + (1 + (k % 24 > 12)) * r.gumbel())
    df = frame(spark, {"a": values, "b": [1.0] * 50})
    x = {k: v for k, v in enumerate(values) if v is not None}
    losses = []
    for passes in (0, 2, 5, quantreg.PASSES):
        fits = {(r.series_id, r.q): r for r in quantreg.quantile_regression(df, "1 hour", 24, 1, passes=passes).collect()}
        total = 0
        for q in quantreg.QUANTILES:
            c = fits["a", q]
            for k, v in x.items():
                ts = START + timedelta(hours=k)
                p = 2 * np.pi * (k % 24) / 24            # START is midnight
                e = v - (c.c_0 + c.c_1 * (ts.weekday() >= 5) + c.c_2 * np.cos(p) + c.c_3 * np.sin(p))
                total += max(q * e, (q - 1) * e)
        losses.append(total)
    assert losses == sorted(losses, reverse=True) and losses[2] - losses[3] < 0.05 * (losses[0] - losses[2])
    shares = [np.mean([v < fits["a", q].c_0 + fits["a", q].c_1 * ((START + timedelta(hours=k)).weekday() >= 5)
                       + fits["a", q].c_2 * np.cos(2 * np.pi * (k % 24) / 24) + fits["a", q].c_3 * np.sin(2 * np.pi * (k % 24) / 24)
                       for k, v in x.items()]) for q in quantreg.QUANTILES]
    assert shares == pytest.approx(list(quantreg.QUANTILES), abs=0.03)


def test_quantile_regression_is_no_worse_than_the_profile(hourly):
    p = hourly
    fit = quantreg.quantile_regression(p, CFG.freq, 24, 2)
    fc = quantreg.quantile_regression_forecast(p, fit, 6, CFG.freq, 24, 2)
    both = fc.unionByName(quantile.quantile_forecast(p, quantile.quantile_profile(p), 6, CFG.freq))
    loss = {(r.model, r.q): r.pinball for r in evaluate.pinball_loss(evaluate.align(both, p)).collect()}
    mean = {m: np.mean([v for (n, _), v in loss.items() if n == m]) for m in {m for m, _ in loss}}
    assert mean["quantile_regression"] <= 1.02 * mean["quantile_profile"]
    wide = fc.groupBy("series_id", "origin_ts", "step").pivot("q", [0.1, 0.5, 0.9]).agg(F.first("predicted"))
    assert wide.where("`0.1` > `0.5` or `0.5` > `0.9`").isEmpty()


# ---------------------------------------------------------------------------- AR(p)

def yule_walker(values, p):
    y = np.array([np.nan if v is None else v for v in values])
    d = np.nan_to_num(y - np.nanmean(y))
    n = np.isfinite(y).sum()
    g = [d[k:] @ d[:len(d) - k] / n for k in range(p + 1)]
    phi = np.linalg.solve([[g[abs(i - j)] for j in range(p)] for i in range(p)], g[1:])
    return np.nanmean(y), phi, np.sqrt(g[0] - phi @ g[1:])


@pytest.mark.parametrize("chunk", [7, 1000])
def test_arp_against_numpy(spark, chunk):
    r = np.random.default_rng(3)
    x = [0.0, 0.0]
    for _ in range(600):
        x.append(0.5 * x[-1] + 0.3 * x[-2] + r.normal())
    values = [None if r.random() < 0.1 else 20 + v for v in x]
    values[-1] = 21.0
    df = frame(spark, {"a": values, "flat": [3.0] * 30})
    fit = autoreg.arp_fit(df, 2, "1 hour", chunk)
    got = {k.series_id: k for k in fit.collect()}
    mean, phi, sigma = yule_walker(values, 2)
    a = got["a"]
    assert (a.mean, a.phi_1, a.phi_2, a.sigma) == pytest.approx((mean, *phi, sigma), rel=1e-9)
    assert got["flat"].phi_1 == 0 and got["flat"].sigma == 0
    fc = {(k.series_id, k.step): k for k in autoreg.arp_forecast(df, fit, 2, 5, "1 hour", chunk_buckets=chunk).collect()}
    state = [v - mean if v is not None else 0.0 for v in (values[-1], values[-2])]
    psi, var = [1.0, 0.0], 0.0
    for h in range(1, 6):
        state.insert(0, phi[0] * state[0] + phi[1] * state[1])
        var += psi[0] ** 2
        psi.insert(0, phi[0] * psi[0] + phi[1] * psi[1])
        assert fc["a", h].predicted == pytest.approx(mean + state[0], rel=1e-9)
        assert fc["a", h].sd == pytest.approx(sigma * np.sqrt(var), rel=1e-9)
        assert fc["flat", h].predicted == 3.0
    # one lag: close to the fit by regression
    one = autoreg.arp_fit(df.where("series_id = 'a'"), 1, "1 hour", chunk).first()
    assert one.phi_1 == pytest.approx(autoreg.ar_fit(df.where("series_id = 'a'"), "1 hour", chunk).first().phi, abs=0.15)


# ------------------------------------------------------------------ folds, spikes, breaches

def test_backtest_equals_refits(hourly):
    p = hourly
    starts = ["2024-01-17 00:00:00", "2024-01-22 00:00:00", "2024-02-20 00:00:00"]
    fc = autoreg.backtest_ar(p, starts, 2, CFG.freq, CFG.chunk_buckets).cache()
    assert {r.fold for r in fc.select("fold").distinct().collect()} == {1, 2}       # nothing after the last start
    for f, s in enumerate(starts[:2], 1):
        refit = autoreg.ar_fit(p.where(F.col("ts") < s).withColumn("split", F.lit("train")), CFG.freq, CFG.chunk_buckets)
        want = {r.series_id: r for r in refit.collect()}
        for r in fc.where((F.col("fold") == f) & (F.col("step") == 1)).join(
                p.select("series_id", F.col("ts").alias("origin_ts"), "value"), ["series_id", "origin_ts"]).collect():
            w = want[r.series_id]
            assert r.predicted == pytest.approx(w.phi * r.value + w.c, rel=1e-8)
            assert r.sd == pytest.approx(w.sigma, rel=1e-7) and r.n_pairs == w.n_pairs


@pytest.mark.parametrize("chunk", [5, 500])
def test_hampel_against_brute_force(spark, chunk):
    values = gapped(300, 9)
    values[50] = values[51] = 40.0
    df = segments.dense_time_index(frame(spark, {"a": values, "flat": [1.0] * 20 + [2.0] + [1.0] * 9}), "1 hour", chunk_buckets=chunk)
    got = {(r.series_id, r.time_idx) for r in monitor.hampel_spikes(df, 4, 3.0, chunk).collect()}
    x = np.array([v for v in values if v is not None])
    want = set()
    for i, v in enumerate(x):
        near = x[max(0, i - 4):i + 5]
        if abs(v - np.median(near)) > 3 * 1.4826 * np.median(np.abs(near - np.median(near))):
            want.add(("a", i))
    assert {g for g in got if g[0] == "a"} == want and len(want) >= 2
    assert {g for g in got if g[0] == "flat"} == {("flat", 20)}


def test_breaches_are_repeatable_and_calibrated(spark):
    origins = spark.createDataFrame([("a", START, 0.0), ("b", START, 9.0), ("none", START, 1.0)],
                                    "series_id string, origin_ts timestamp_ntz, origin_value double")
    params = spark.createDataFrame([("a", 1.0, 0.0, 1.0), ("b", 0.0, 9.0, 0.0), ("none", 0.5, 0.0, 1.0)],
                                   "series_id string, phi double, c double, sigma double")
    limits = spark.createDataFrame([("a", 1.0), ("b", 8.0)], "series_id string, limit double")
    runs = [sorted(monitor.time_to_breach(o, params, limits, 8, 4000).collect())
            for o in (origins, origins.repartition(5), origins.coalesce(1))]
    assert runs[0] == runs[1] == runs[2]
    prob = {(r.series_id, r.step): r.prob_by for r in runs[0]}
    assert {s for s, _ in prob} == {"a", "b"} and all(prob["b", h] == 1 for h in range(1, 9))
    r = np.random.default_rng(0)
    top = np.maximum.accumulate(np.cumsum(r.normal(size=(200_000, 8)), axis=1), axis=1)
    for h in range(1, 9):
        assert prob["a", h] == pytest.approx((top[:, h - 1] > 1).mean(), abs=0.03)


def test_lead_lag_against_direct_sums(spark):
    base = gapped(200, 4)
    b = [None] * 3 + [None if v is None else 2 * v for v in base[:-3]]
    df = frame(spark, {"a": base, "b": b, "flat": [1.0] * 30})
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "flat"), ("a", "gone")], "series_a string, series_b string")

    def centred(values):
        y = np.array([np.nan if v is None else v for v in values])
        return np.nan_to_num(y - np.nanmean(y))
    x, y = centred(base), centred(b)
    for chunk in (6, 64):
        rows = leadlag.lead_lag(df, pairs, 10, "1 hour", chunk)
        got = {(r.series_a, r.series_b, r.lag): r.corr for r in rows.collect()}
        for k in range(-10, 11):
            pad = np.pad(y, 10)[10 + k:10 + k + len(x)]
            assert got["a", "b", k] == pytest.approx((x @ pad) / np.sqrt((x @ x) * (y @ y)), abs=1e-10)
            assert got["b", "a", -k] == pytest.approx(got["a", "b", k], abs=1e-10)
            assert got.get(("a", "flat", k)) is None
        best = {(r.series_a, r.series_b): r.lag for r in leadlag.best_lag(rows).collect()}
        assert best == {("a", "b"): 3, ("b", "a"): -3}


# ------------------------------------------------------------------- many removed periods

def test_many_periods_meet_by_day(spark):
    r = np.random.default_rng(2)
    begin = r.integers(0, 60 * 24 * 60, 10_000)
    length = r.integers(0, 4, 10_000)
    length[:3] = 5000, 0, 2000
    at = lambda m: START + timedelta(minutes=int(m))
    periods = [("a", at(b), at(b + n)) for b, n in zip(begin, length, strict=True)]
    periods += [("b", at(10), at(5)), ("b", None, at(20)), ("b", at(7), None), (None, at(0), at(100_000))]
    iv = spark.createDataFrame(periods, "series_id string, start timestamp_ntz, end timestamp_ntz")
    rows = [(s, at(m), 1.0) for s in ("a", "b") for m in range(0, 60 * 24 * 60, 7)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")
    out = clean.exclude_interval(df, iv)
    got = Counter((x.series_id, x.ts) for x in out.collect())
    gone = np.zeros(60 * 24 * 60 + 6000, bool)
    half = gone.copy()
    for b, n in zip(begin, length, strict=True):
        gone[b:b + n + 1] = True
        half[b:b + n] = True
    assert got == Counter((s, t) for s, t, _ in rows if s == "b" or not gone[int((t - START).total_seconds() // 60)])
    open_ = clean.exclude_interval(df, iv, half_open=True)
    assert open_.where("series_id = 'a'").count() == sum(
        not half[m] for m in range(0, 60 * 24 * 60, 7))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_iday" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


# ------------------------------------------------------------------------ joins by size

def test_small_parameters_are_broadcast_once(spark):
    rows = spark.range(1000).select((F.col("id") % 7).cast("string").alias("series_id"), F.col("id").alias("ts"))
    spark.range(450_000).selectExpr("cast(id as string) series_id", "id + 0.5 as mean").write.mode("overwrite").parquet(
        path := scratch_path(spark, "params"))
    params = spark.read.parquet(path)
    small = layout.spread_join(rows, params, ["series_id"], by="ts")
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Generate" not in plan
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = layout.spread_join(rows, params, ["series_id"], by="ts")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "_part" in plan
        df = frame(spark, {"a": [1.0] * 5})
        plan = segments.keep_long_segments(df, 2)._jdf.queryExecution().executedPlan().toString()
        assert "_part" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# --------------------------------------------------------------------------- streams

def batch_alarms(rows, slack, limit, silence, now):
    out = []
    for s in sorted({r[0] for r in rows}):
        up = down = 0.0
        mine = sorted((t, v) for x, t, v in rows if x == s and v is not None and t <= now)
        for k, (t, v) in enumerate(mine):
            if k and t - mine[k - 1][0] > silence:
                out.append((s, mine[k - 1][0] + silence, "silent"))
            up, down = max(0.0, up + v - slack), max(0.0, down - v - slack)
            if up > limit:
                out.append((s, t, "drift_up"))
                up = 0.0
            if down > limit:
                out.append((s, t, "drift_down"))
                down = 0.0
        if mine and mine[-1][0] + silence <= now:
            out.append((s, mine[-1][0] + silence, "silent"))
    return Counter(out)


def test_drift_alarms_do_not_depend_on_arrival(spark):
    r = np.random.default_rng(8)
    minute = timedelta(minutes=1)
    rows = [(s, START + minute * int(5 * k + r.integers(0, 5)), float(r.normal() + (k > 60) * (1.5 if s == "a" else -1.5)))
            for s in "ab" for k in range(120) if not 80 <= k < 100]
    rows += [("quiet", START + minute * 3, 0.0), ("quiet", START + minute * 4, None)]
    rows = sorted(rows, key=lambda x: x[1])
    # files arrive in time order, with neighbours exchanged inside the watermark
    cut = [rows[k:k + 40] for k in range(0, len(rows), 40)]
    for a, b in zip(cut, cut[1:]):
        a[-1], b[0] = b[0], a[-1]
    late = ("a", START, 1e6)
    cut[-1].append(late)                                  # older than the watermark by then
    schema = "series_id string, ts timestamp_ntz, value double"
    params = spark.createDataFrame([(s, 0.0, 1.0) for s in ("a", "b", "quiet")], "series_id string, mean double, std double")
    landing = scratch_path(spark, "drift")
    for k, part in enumerate(cut):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{landing}/b{k:02d}")
    import time
    for k in range(len(cut)):                             # the source takes files by age
        os.utime(next(f"{landing.removeprefix('file:')}/b{k:02d}/{f}" for f in os.listdir(
            f"{landing.removeprefix('file:')}/b{k:02d}") if f.endswith(".parquet")), (time.time() - 1000 + k,) * 2)
    src = ST.file_stream(spark, f"{landing}/*", spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
    alarms = SM.drift_alarms(src, params, 0.5, 4.0, "1 hour", "2 hours", "30 minutes")
    got = Counter((x.series_id, x.ts, x.kind) for x in ST.run_to_table(spark, alarms, "drift_test").collect())
    now = max(x[1] for x in rows) - timedelta(minutes=30)
    want = batch_alarms(rows, 0.5, 4.0, timedelta(hours=1), now)
    # a forgotten sensor starts anew: 'quiet' has only its one silence, a and b pause for less
    assert got == want and {k for _, _, k in got} == {"drift_up", "drift_down", "silent"}


def test_stream_scores_match_alignment(spark):
    got = QUERIES["stream_scores"](spark, SF_SMALL)
    assert got.count() > 0 and got.where("ts < target_ts or abs(error - (predicted - actual)) > 1e-6").isEmpty()


class _Value:
    def __init__(self):
        self.x = None

    def exists(self):
        return self.x is not None

    def get(self):
        return self.x

    def update(self, x):
        self.x = x

    def clear(self):
        self.x = None


class _Map(dict):
    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class _Handle:
    """State and timers of one sensor, in this process."""
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return _Value()

    def getMapState(self, *_):
        return _Map()

    def listTimers(self):
        return sorted(self.timers)

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class _Watermark:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def test_drift_state_lies_in_blocks_and_is_merged_in_parts(monkeypatch):
    """Python holds a run or the open blocks of all runs, not all readings of a sensor."""
    monkeypatch.setattr(SM, "RUN", 64)
    monkeypatch.setattr(SM, "BLOCK", 8)
    r = np.random.default_rng(3)
    rows = [("a", START + timedelta(seconds=int(t)), float(z)) for t, z in zip(
        r.integers(0, 4000, 900), np.append(r.normal(0.4, 1, 500), r.integers(-2, 3, 400)), strict=True)]
    rows += [("a", START + timedelta(seconds=9000 + k), float(-k % 3)) for k in range(200)]
    rows += [("a", START + timedelta(seconds=9500), 1.0)] * 300      # one time, more than a run
    r.shuffle(rows)
    us = {t: round((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for _, t, _ in rows}
    monitor = SM.DriftMonitor(0.5, 4.0, 600_000_000, 10**15)
    monitor.init(_Handle())
    seen, due = [], monitor._due
    monitor._due = lambda *a: (seen.append(len(x)) or x for x in due(*a))
    pdfs = [pd.DataFrame({"us": [us[t] for _, t, _ in part], "z": [float(z) for _, _, z in part]})
            for part in (rows[k:k + 50] for k in range(0, len(rows), 50))]
    assert list(monitor.handleInputRows(("a",), iter(pdfs), _Watermark(0))) == []
    assert len(monitor.waiting) >= len(rows) // 8 and all(len(v[0]) <= 16 * 8 for v in monitor.waiting.values())
    got = Counter()
    for now in (us[rows[0][1]] // 2 + us[min(rows, key=lambda x: x[1])[1]] // 2, us[min(rows, key=lambda x: x[1])[1]] + 9_500_000_000):
        for pdf in monitor.handleExpiredTimer(("a",), _Watermark(now), None):
            got += Counter(("a", datetime(1970, 1, 1) + timedelta(microseconds=u), k) for u, k in zip(pdf["us"], pdf["kind"], strict=True))
    runs = -(-len(rows) // 64)
    assert not monitor.waiting and sum(seen) == len(rows) and max(seen) <= 64 + 8 * (runs + 1)
    assert got == batch_alarms(rows, 0.5, 4.0, timedelta(minutes=10), START + timedelta(seconds=9500))


def test_stream_scores_meet_by_bucket_and_once(spark):
    """The join key holds the bucket; spans off the grid touch two buckets, and a pair meets once."""
    minute = timedelta(minutes=1)
    targets = [START + minute * k for k in (0, 25, 60, 90, 119)]
    times = [START + minute * k for k in range(-5, 200, 5)] + [START + timedelta(microseconds=25 * 60_000_000 - 1)]
    a, b = (scratch_path(spark, f"scores-{x}") for x in "ab")
    spark.createDataFrame([("m", s, START, 1, t, 1.0) for s in "xy" for t in targets],
                          "model string, series_id string, origin_ts timestamp_ntz, step int, target_ts timestamp_ntz, "
                          "predicted double").write.parquet(a)
    spark.createDataFrame([(s, t, 2.0) for s in "xy" for t in times],
                          "series_id string, ts timestamp_ntz, value double").write.parquet(b)
    fc, readings = (ST.file_stream(spark, p, spark.read.parquet(p).schema) for p in (a, b))
    met = ST.stream_scores(fc, readings, "1 hour")
    got = Counter((x.series_id, x.target_ts, x.ts) for x in ST.run_to_table(spark, met, "scores_test").collect())
    assert got == Counter((s, t, u) for s in "xy" for t in targets for u in times if t <= u < t + minute * 60)
    join = next(x for x in met._jdf.queryExecution().analyzed().toString().splitlines() if "Join" in x)
    assert "_span" in join and "_bucket" in join
