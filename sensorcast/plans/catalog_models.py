"""Registered queries of the later forecasters and monitors, with their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.timefn import freq_micros, to_micros
from ..operators import clean as CL
from ..operators import evaluate as EV
from ..operators import monitor as MO
from ..operators import scaling as SC
from ..operators.forecast import autoreg, basis
from ..operators.forecast import quantile as QF
from ..operators.forecast import quantreg as QR
from ..operators.leadlag import best_lag, lead_lag
from ..operators.segments import dense_time_index
from ..session import scratch_path
from ..sources import readers as RD
from ..sources import writers as WR
from ..sources.tables import sensor_raw
from ..streaming import monitor as SM
from ..streaming import stream as ST
from . import oracle as O
from .catalog import (CHAIN, CFG, FC_COLS, H_, H_CHAIN, HARM, HEAD_DIGITS, HOURLY, PERIOD, QFC, QP, RAW, SENSORS, US_H, ar_rolling,
                      events_stream, prepared, query)
from .report import rounded

# ---------------------------------------------------- conditional quantiles
QH = 2
QK = 2 + 2 * QH


def design_sql(ts: str) -> list[str]:
    at = f"((epoch_us({ts}) // {US_H}) % {PERIOD}) / {float(PERIOD)!r}"
    return ["1.0", f"CAST(isodow({ts}) - 1 >= 5 AS DOUBLE)"] + [
        f"{f}({2.0 * math.pi * k!r} * ({at}))" for k in range(1, QH + 1) for f in ("cos", "sin")]


def weighted_solve(rows: str, by: str, name: str, k: int, ridge: float, weight: str, push: str) -> str:
    """{name}: (by, c_0 ..) of the weighted normal equations, by Gauss-Jordan."""
    sums = [f"sum({weight} * f_{min(i, j)} * f_{max(i, j)}) AS m_{i}_{j}" for i in range(k) for j in range(k)]
    sums += [f"sum(({weight} * value + {push}) * f_{i}) AS m_{i}_{k}" for i in range(k)]
    trace = " + ".join(f"m_{i}_{i}" for i in range(k))
    out = [f"{name}_s AS (SELECT {by}, {', '.join(sums)} FROM {rows} GROUP BY {by})",
           f"{name}_0 AS (SELECT {by}, " + ", ".join(
               f"m_{i}_{j}" + (f" + {ridge!r} * greatest(1.0, ({trace}) / {k})" if i == j else "") + f" AS m_{i}_{j}"
               for i in range(k) for j in range(k + 1)) + f" FROM {name}_s)"]
    for p in range(k):
        step = ", ".join((f"m_{p}_{j} / m_{p}_{p}" if i == p else f"m_{i}_{j} - m_{i}_{p} * (m_{p}_{j} / m_{p}_{p})")
                         + f" AS m_{i}_{j}" for i in range(k) for j in range(p + 1, k + 1))
        out.append(f"{name}_{p + 1} AS (SELECT {by}, {step} FROM {name}_{p})")
    out.append(f"{name} AS MATERIALIZED (SELECT {by}, "
               + ", ".join(f"m_{i}_{k} AS c_{i}" for i in range(k)) + f" FROM {name}_{k})")
    return ",\n".join(out)


def _dot(c: str = "w") -> str:
    return " + ".join(f"{c}.c_{i} * x.f_{i}" for i in range(QK))


def quantreg_ctes() -> str:
    f = ", ".join(f"{e} AS f_{i}" for i, e in enumerate(design_sql("ts")))
    out = [f"""qrx AS MATERIALIZED (
  SELECT series_id, CAST(value AS DOUBLE) AS value, {f} FROM prep
  WHERE split = 'train' AND value IS NOT NULL AND NOT isnan(value)),
qre AS (SELECT series_id, count(*) AS n, greatest(stddev_pop(value), 1e-9) AS scale FROM qrx GROUP BY series_id)""",
           weighted_solve("qrx", "series_id", "qri", QK, QR.RIDGE, "1.0", "0.0"),
           "qr0 AS (SELECT *, unnest([" + ", ".join(f"CAST({q} AS DOUBLE)" for q in QR.QUANTILES) + "]) AS q FROM qri)"]
    for p in range(1, QR.PASSES + 1):
        out.append(f"""qrw{p} AS (
  SELECT x.*, w.q, 1.0 / ({QR.smoothing(p)!r} * e.scale + abs(x.value - ({_dot()}))) AS w
  FROM qrx x JOIN qr{p - 1} w USING (series_id) JOIN qre e USING (series_id))""")
        out.append(weighted_solve(f"qrw{p}", "series_id, q", f"qr{p}", QK, QR.RIDGE, "w", "2.0 * q - 1.0"))
    return ",\n".join(out)


QREG = quantreg_ctes()
QREG_FC = f"""qrt AS (
  SELECT s.*, {', '.join(f'{e} AS f_{i}' for i, e in enumerate(design_sql('s.target_ts')))} FROM qrfc_s s),
qrfc AS (
  SELECT 'quantile_regression' AS model, series_id, origin_ts, step, target_ts, unnest(qs) AS q, unnest(vs) AS predicted
  FROM (SELECT x.series_id, x.origin_ts, x.step, x.target_ts, list_sort(list(w.q)) AS qs, list_sort(list({_dot()})) AS vs
        FROM qrt x JOIN qr{QR.PASSES} w USING (series_id) GROUP BY ALL))"""
QREG_CHAIN = O.with_(H_CHAIN, QREG, O.steps_cte(HOURLY, "qrfc_s"), QREG_FC)
PINBALL = "avg(greatest(q * (actual - predicted), (q - 1) * (actual - predicted)))"


def quantreg(p):
    return QR.quantile_regression(p, HOURLY.freq, PERIOD, QH)


@query("quantile_regression", O.with_(H_CHAIN, QREG) + "SELECT w.series_id, w.q, e.n, " + ", ".join(
    O.r(f"c_{i}", digits=HEAD_DIGITS) for i in range(QK)) + f" FROM qr{QR.PASSES} w JOIN qre e USING (series_id)")
def q_quantile_regression(spark, sf):
    """quantiles given weekend and two daily harmonics, twelve reweighted passes."""
    return rounded(quantreg(prepared(spark, sf, HOURLY, materialize=True)).drop("scale"), HEAD_DIGITS)


def quantreg_fc(p):
    return QR.quantile_regression_forecast(p, quantreg(p), H_, HOURLY.freq, PERIOD, QH)


@query("quantile_regression_forecast", QREG_CHAIN + f"SELECT {FC_COLS}, {O.r('predicted', digits=HEAD_DIGITS)} FROM qrfc")
def q_quantile_regression_forecast(spark, sf):
    return rounded(quantreg_fc(prepared(spark, sf, HOURLY, materialize=True)), HEAD_DIGITS)


@query("quantile_regression_loss", O.with_(H_CHAIN, QREG, O.steps_cte(HOURLY, "qrfc_s"), QREG_FC, QP, QFC, """both_fc AS (
  SELECT * FROM qrfc UNION ALL SELECT model, series_id, origin_ts, step, target_ts, q, predicted FROM qfc)""",
                                           O.aligned_cte("both_fc")) + f"""
SELECT model, q, {O.r(PINBALL, 'pinball', HEAD_DIGITS)}, count(*) AS n
FROM aligned WHERE actual IS NOT NULL AND NOT isnan(actual) GROUP BY model, q""")
def q_quantile_regression_loss(spark, sf):
    """Pinball loss on the eval range, beside that of the quantile profile."""
    p = prepared(spark, sf, HOURLY, materialize=True)
    both = quantreg_fc(p).unionByName(QF.quantile_forecast(p, QF.quantile_profile(p), H_, HOURLY.freq))
    return rounded(EV.pinball_loss(EV.align(both, p)), HEAD_DIGITS)


# ------------------------------------------------------- autoregression with p lags
LAGS = 3


def arp_ctes(p: int = LAGS) -> str:
    lags = ",\n         ".join(
        f"max(value) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING) AS lag_{k}"
        for k in range(1, p + 1))
    out = [f"""arx AS (
  SELECT *, {lags}
  FROM (SELECT series_id, ts, split, value, epoch_us(ts) // {US_H} AS t FROM prep)),
arm AS (SELECT series_id, avg(value) AS mean FROM prep WHERE split = 'train' GROUP BY series_id),
arg AS (
  SELECT series_id, mean, count(*) AS n, sum((value - mean) * (value - mean)) / count(*) AS g_0,
         {', '.join(f'coalesce(sum((value - mean) * (lag_{k} - mean)), 0.0) / count(*) AS g_{k}' for k in range(1, p + 1))}
  FROM arx JOIN arm USING (series_id) WHERE split = 'train' GROUP BY series_id, mean),
ld0 AS (SELECT *, g_0 AS v FROM arg)"""]
    g = ", ".join(["series_id", "mean", "n", *[f"g_{k}" for k in range(p + 1)]])
    for m in range(1, p + 1):
        known = " + ".join(["0.0", *[f"phi_{j} * g_{m - j}" for j in range(1, m)]])
        new = ", ".join([*[f"phi_{j} - k * phi_{m - j} AS phi_{j}" for j in range(1, m)], f"k AS phi_{m}"])
        out.append(f"""ld{m} AS (
  SELECT {g}, v * (1.0 - k * k) AS v, {new}
  FROM (SELECT *, CASE WHEN v > 0 THEN (g_{m} - ({known})) / v ELSE 0.0 END AS k FROM ld{m - 1}))""")
    out.append(f"arpf AS (SELECT *, sqrt(greatest(v, 0.0)) AS sigma FROM ld{p})")
    return ",\n".join(out)


def arp_forecast_ctes(p: int = LAGS, horizon: int = H_) -> str:
    """Means a_h and psi weights b_h, step by step."""
    first = ", ".join([f"value - mean AS a_0, 1.0 AS b_0, {', '.join(f'0.0 AS b_{-k}' for k in range(1, p))}",
                       *[f"coalesce(lag_{k} - mean, 0.0) AS a_{-k}" for k in range(1, p)]]).replace("_-", "_m")
    out = [f"""as0 AS (
  SELECT x.series_id, ts AS origin_ts, mean, sigma, {', '.join(f'phi_{k}' for k in range(1, p + 1))}, {first}
  FROM arx x JOIN arpf USING (series_id)
  WHERE split = 'train' AND ts = (SELECT max(ts) FROM prep z WHERE z.series_id = x.series_id AND z.split = 'train'))"""]
    for h in range(1, horizon + 1):
        def rolled(c, h=h):
            return " + ".join(["0.0", *[f"phi_{k} * {c}_{h - k}" for k in range(1, p + 1)]]).replace("_-", "_m")
        out.append(f"as{h} AS (SELECT *, {rolled('a')} AS a_{h}, {rolled('b')} AS b_{h} FROM as{h - 1})")
    rows = "\n  UNION ALL ".join(
        f"SELECT series_id, origin_ts, {h} AS step, mean + a_{h} AS predicted, sigma * sqrt("
        + " + ".join(["0.0", *[f"b_{j} * b_{j}" for j in range(h)]]) + f") AS sd FROM as{horizon}"
        for h in range(1, horizon + 1))
    return ",\n".join([*out, f"arpfc AS ({rows})"])


def arp(p):
    return autoreg.arp_fit(p, LAGS, HOURLY.freq, HOURLY.chunk_buckets)


@query("arp_fit", O.with_(H_CHAIN, arp_ctes()) + f"""
SELECT series_id, {O.r('mean')}, {', '.join(O.r(f'phi_{k}', digits=HEAD_DIGITS) for k in range(1, LAGS + 1))},
       {O.r('sigma', digits=HEAD_DIGITS)}, n FROM arpf""")
def q_arp_fit(spark, sf):
    """F4 with three lags: Yule-Walker on chunk frames, Levinson-Durbin in columns."""
    fit = arp(prepared(spark, sf, HOURLY))
    return rounded(fit.select("series_id", "mean", "n")).join(rounded(fit.drop("mean", "n"), HEAD_DIGITS), "series_id")


@query("arp_forecast", O.with_(H_CHAIN, arp_ctes(), arp_forecast_ctes()) + f"""
SELECT 'arp' AS model, series_id, origin_ts, CAST(step AS INTEGER) AS step,
       origin_ts + to_microseconds(step * {US_H}) AS target_ts, CAST(NULL AS DOUBLE) AS q,
       {O.r('predicted', digits=HEAD_DIGITS)}, {O.r('sd', digits=HEAD_DIGITS)},
       {O.r('predicted - 1.2815515655446004 * sd', 'lower', HEAD_DIGITS)},
       {O.r('predicted + 1.2815515655446004 * sd', 'upper', HEAD_DIGITS)} FROM arpfc""")
def q_arp_forecast(spark, sf):
    p = prepared(spark, sf, HOURLY, materialize=True)
    return rounded(autoreg.arp_forecast(p, arp(p), LAGS, H_, HOURLY.freq, "last",
                                        chunk_buckets=HOURLY.chunk_buckets), HEAD_DIGITS)


# ------------------------------------------------------------ joint trend and season (F2)
JT = f"CAST(epoch_us(ts) // {US_H} AS BIGINT)"
J_WAVES = [f"{f}(2.0 * pi() * {k} * (t % {PERIOD}) / {PERIOD})" for k in range(1, HARM + 1) for f in ("cos", "sin")]
J_NAMES = [f"{c}_{k}" for k in range(1, HARM + 1) for c in "ab"]
JOINT = f"""jt AS (SELECT series_id, value, {JT} AS t FROM prep WHERE split = 'train' AND value IS NOT NULL),
js AS (
  SELECT series_id, (min(t::DOUBLE) + max(t::DOUBLE)) / 2 AS mid, greatest((max(t::DOUBLE) - min(t::DOUBLE)) / 2, 1.0) AS half,
         count(*) AS n FROM jt GROUP BY series_id),
ju AS (
  SELECT jt.series_id, value, (t::DOUBLE - mid) / half AS u, {', '.join(f'{w} AS {n}' for w, n in zip(J_WAVES, J_NAMES))}
  FROM jt JOIN js USING (series_id)),
""" + O.solve_ctes("ju", ["u", *J_NAMES], ["value"], "jw", 0.0, "series_id") + f""",
joint AS (
  SELECT series_id, w_0_0 - w_1_0 * mid / half AS intercept, w_1_0 / half AS slope,
         {', '.join(f'w_{i}_0 AS {n}' for i, n in enumerate(J_NAMES, 2))}, n FROM jw_w JOIN js USING (series_id))"""


def joint(p):
    return basis.joint_fit(p, HOURLY.freq, PERIOD, HARM)


@query("joint_fit", O.with_(H_CHAIN, JOINT) + "SELECT series_id, " + ", ".join(
    O.r(c, digits=HEAD_DIGITS) for c in ("intercept", "slope", *J_NAMES)) + ", n FROM joint")
def q_joint_fit(spark, sf):
    """F2: line and harmonics in one least-squares fit per series."""
    return rounded(joint(prepared(spark, sf, HOURLY)), HEAD_DIGITS)


@query("joint_forecast", O.with_(H_CHAIN, JOINT, "tr AS (SELECT series_id, intercept, slope FROM joint)",
                                 "se AS (SELECT * EXCLUDE (intercept, slope, n) FROM joint)",
                                 O.decompose_fc_cte(HOURLY, PERIOD, HARM)) + f"""
SELECT {FC_COLS}, {O.r('predicted', digits=HEAD_DIGITS)} FROM dcfc""")
def q_joint_forecast(spark, sf):
    p = prepared(spark, sf, HOURLY, materialize=True)
    fit = joint(p)
    fc = basis.decompose_forecast(p, fit.select("series_id", "intercept", "slope"), fit.drop("intercept", "slope", "n"),
                                  H_, HOURLY.freq, PERIOD, HARM)
    return rounded(fc, HEAD_DIGITS)


# ------------------------------------------------------------- rolling-origin validation
# The folds' starts; the last fold goes on to the end of the data.
FOLDS = ["2024-01-16 00:00:00", "2024-01-19 00:00:00", "2024-01-22 00:00:00", "2024-01-25 00:00:00"]
FOLD_OF = " + ".join(f"CAST(ts >= TIMESTAMP '{s}' AS INTEGER)" for s in FOLDS)


def backtest_sql() -> str:
    starts = ", ".join(f"({i}, TIMESTAMP '{s}')" for i, s in enumerate(FOLDS, 1))
    return O.with_(H_CHAIN, O.prev_cte(HOURLY), f"""folds(fold, start) AS (VALUES {starts}),
bt AS (
  SELECT series_id, fold, coalesce(regr_slope(value, prev_value), 0.0) AS phi,
         coalesce(regr_intercept(value, prev_value), avg(value)) AS c, count(*) AS n_pairs,
         sqrt(greatest(var_pop(value) - CASE WHEN var_pop(prev_value) > 0
              THEN covar_pop(prev_value, value) * covar_pop(prev_value, value) / var_pop(prev_value) ELSE 0.0 END, 0.0)) AS sigma
  FROM pv JOIN folds ON ts < start WHERE prev_value IS NOT NULL GROUP BY ALL),
bo AS (SELECT series_id, ts AS origin_ts, value AS y, {FOLD_OF} AS fold FROM prep),
fc AS (
  SELECT o.series_id, o.fold, origin_ts + to_microseconds(step * {US_H}) AS target_ts,
         pow(phi, step) * y + c * CASE WHEN phi = 1 THEN step ELSE (1.0 - pow(phi, step)) / (1.0 - phi) END AS predicted
  FROM (SELECT *, unnest(range(1, {H_} + 1)) AS step FROM bo WHERE fold > 0) o JOIN bt USING (series_id, fold))""",
                   O.aligned_cte("fc")) + O.metric_select("series_id, fold").replace("AS n,", "AS n,", 1)


@query("backtest", backtest_sql())
def q_backtest(spark, sf):
    """AR(1) scored on four later folds, each fitted on all rows before it."""
    p = prepared(spark, sf, HOURLY, materialize=True)
    fc = autoreg.backtest_ar(p, FOLDS, H_, HOURLY.freq, HOURLY.chunk_buckets)
    return rounded(EV.metrics(EV.align(fc, p), ("series_id", "fold")))


# ------------------------------------------------------------------------ monitors
@query("hampel_spikes", O.with_(CHAIN, O.indexed_cte()) + f""", near AS (
  SELECT *, list(value) OVER (PARTITION BY series_id ORDER BY time_idx ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS l
  FROM idx),
med AS (SELECT *, list_aggregate(l, 'median') AS median FROM near),
dev AS (SELECT *, 1.4826 * list_aggregate(list_transform(l, lambda v: abs(v - median)), 'median') AS robust_sd FROM med)
SELECT series_id, ts, {O.r('value')}, {O.r('median')}, {O.r('robust_sd')}
FROM dev WHERE abs(value - median) > 3.0 * robust_sd""")
def q_hampel_spikes(spark, sf):
    """Readings far from the sliding median in robust sd."""
    p = dense_time_index(prepared(spark, sf), CFG.freq, chunk_buckets=CFG.chunk_buckets)
    out = MO.hampel_spikes(p, 6, 3.0, CFG.chunk_buckets)
    return rounded(out.select("series_id", "ts", "value", "median", "robust_sd"))


PATHS = 200


def breach_sql() -> str:
    def uniform(part):
        key = f"'0:' || series_id || ':' || epoch_us(origin_ts) || ':' || path || ':' || s || ':{part}'"
        return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT)::DOUBLE / {2.0 ** 52!r}"
    draw = (f"sqrt(-2.0 * ln({uniform('a')} + {2.0 ** -53!r})) * cos({2.0 * 3.141592653589793!r} * ({uniform('b')}))")
    return O.with_(H_CHAIN, O.ar_params_cte(HOURLY), O.params_cte(), f"""o AS (
  SELECT series_id, ts AS origin_ts, value AS y FROM prep z WHERE split = 'train'
   AND ts = (SELECT max(ts) FROM prep m WHERE m.series_id = z.series_id AND m.split = 'train')),
start AS (
  SELECT o.series_id, origin_ts, y, phi, c, sigma, mean + std AS lim, unnest(range({PATHS})) AS path
  FROM o JOIN arp USING (series_id) JOIN params USING (series_id)),
walk(series_id, origin_ts, y, phi, c, sigma, lim, path, step, hit) AS (
  SELECT *, 0, 0 FROM start
  UNION ALL
  SELECT series_id, origin_ts, ny, phi, c, sigma, lim, path, s, CASE WHEN hit > 0 THEN hit WHEN ny > lim THEN s ELSE 0 END
  FROM (SELECT *, c + phi * y + sigma * ({draw}) AS ny FROM (SELECT *, step + 1 AS s FROM walk WHERE step < {H_}))),
done AS (SELECT series_id, origin_ts, hit FROM walk WHERE step = {H_}),
stp AS (SELECT unnest(range(1, {H_} + 1)) AS step)""").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT series_id, origin_ts, step::INTEGER AS step, {O.r('avg((hit > 0 AND hit <= step)::INT::DOUBLE)', 'prob_by')},
       {O.r('avg(CASE WHEN hit > 0 THEN hit END)', 'mean_step')}
FROM done, stp GROUP BY series_id, origin_ts, step"""


@query("time_to_breach", breach_sql())
def q_time_to_breach(spark, sf):
    """Probability that a sensor has passed mean + sd by each step."""
    p = prepared(spark, sf, HOURLY, materialize=True)
    params = autoreg.ar_fit(p, HOURLY.freq, HOURLY.chunk_buckets)
    limits = SC.fit_scaler(p).select("series_id", (F.col("mean") + F.col("std")).alias("limit"))
    from ..operators.forecast.common import origin_rows
    return rounded(MO.time_to_breach(origin_rows(p, "last"), params, limits, H_, PATHS))


HALF_US = 1_800_000_000


@query("exclude_many_intervals", O.with_(RAW) + f"""
SELECT r.series_id, r.ts, r.value FROM raw r
WHERE NOT EXISTS (SELECT 1 FROM raw b WHERE b.quality <> 'Good' AND b.series_id = r.series_id
                  AND epoch_us(r.ts) BETWEEN epoch_us(b.ts) - {HALF_US} AND epoch_us(b.ts) + {HALF_US})""")
def q_exclude_many_intervals(spark, sf):
    """Half an hour around every bad reading is a removed period of its sensor."""
    raw = sensor_raw(spark, sf)
    bad = raw.where(F.col("quality") != "Good").select(
        "series_id", F.timestamp_add("MICROSECOND", F.lit(-HALF_US), F.col("ts")).alias("start"),
        F.timestamp_add("MICROSECOND", F.lit(HALF_US), F.col("ts")).alias("end"))
    return CL.exclude_interval(raw.select("series_id", "ts", "value"), bad)


SILENCE = "2 hours"


def drift_sql() -> str:
    s = freq_micros(SILENCE)
    return O.with_(CHAIN, O.params_cte(), f"""zs AS (
  SELECT r.series_id, epoch_us(ts) AS us, (r.value - p.mean) / p.std AS z
  FROM raw r JOIN params p USING (series_id) WHERE quality = 'Good' AND r.value IS NOT NULL),
wm AS (SELECT (max(us) // 1000 - 600000) * 1000 AS now FROM zs),
seq AS (
  SELECT *, row_number() OVER w AS rn, lead(us) OVER w AS next_us FROM zs, wm WHERE us <= now
  WINDOW w AS (PARTITION BY series_id ORDER BY us, z)),
run(series_id, rn, us, up, down) AS (
  SELECT series_id, rn, us, greatest(0.0, 0.0 + z - 0.5), greatest(0.0, 0.0 - z - 0.5) FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.series_id, s.rn, s.us, greatest(0.0, CASE WHEN r.up > 5.0 THEN 0.0 ELSE r.up END + z - 0.5),
         greatest(0.0, CASE WHEN r.down > 5.0 THEN 0.0 ELSE r.down END - z - 0.5)
  FROM run r JOIN seq s ON s.series_id = r.series_id AND s.rn = r.rn + 1),
alarms AS (
  SELECT series_id, us, 'drift_up' AS kind, up AS score FROM run WHERE up > 5.0
  UNION ALL SELECT series_id, us, 'drift_down', down FROM run WHERE down > 5.0
  UNION ALL SELECT series_id, us + {s}, 'silent', 0.0 FROM seq
  WHERE CASE WHEN next_us IS NULL THEN us + {s} <= now ELSE next_us - us > {s} END)""").replace(
        "WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT series_id, make_timestamp(us) AS ts, kind, {O.r('score')} FROM alarms"""


@query("drift_alarms", drift_sql())
def q_drift_alarms(spark, sf):
    """CUSUM drift and silent sensors, with state and timers per sensor."""
    params = WR.materialize(SC.fit_scaler(prepared(spark, sf)), "scaler")
    readings = events_stream(spark, sf).where(F.col("quality") == "Good")
    s = SM.drift_alarms(readings, params, 0.5, 5.0, SILENCE, "30 days", "10 minutes")
    return rounded(ST.run_to_table(spark, s, "drift_alarms", "append"))


AR_SCORE = ",\n".join([O.ar_params_cte(HOURLY), O.ar_forecast_cte(HOURLY, "eval", "fc")])


@query("stream_scores", O.with_(H_CHAIN, AR_SCORE) + f"""
SELECT model, f.series_id, origin_ts, step, target_ts, r.ts, {O.r('predicted')}, {O.r('r.value', 'actual')},
       {O.r('predicted - r.value', 'error')}
FROM fc f JOIN raw r ON r.series_id = f.series_id AND r.ts >= f.target_ts AND r.ts < f.target_ts + INTERVAL '1 hour'
WHERE r.quality = 'Good'""")
def q_stream_scores(spark, sf):
    """Readings scored against the forecasts of their hour as both arrive."""
    _, fc = ar_rolling(spark, sf)
    path = scratch_path(spark, "forecasts")
    fc = fc.select("model", "series_id", "origin_ts", "step", "target_ts", "predicted")
    fc.write.parquet(path)
    readings = events_stream(spark, sf).where(F.col("quality") == "Good")
    s = ST.stream_scores(ST.file_stream(spark, path, fc.schema), readings, HOURLY.freq)
    return rounded(ST.run_to_table(spark, s, "stream_scores", "append"))


# --------------------------------------------------------------------- lead and lag
MAX_LAG = 12


@query("lead_lag", O.with_(H_CHAIN, f"""dv AS (
  SELECT series_id, epoch_us(ts) // {US_H} AS t, value - avg(value) OVER (PARTITION BY series_id) AS d FROM prep),
sq AS (SELECT series_id, var_pop(value) * count(*) AS s FROM prep GROUP BY series_id),
lagged_sums AS (
  SELECT a.series_id AS series_a, b.series_id AS series_b, l.lag, sum(a.d * b.d) AS total
  FROM dv a CROSS JOIN (SELECT unnest(range(-{MAX_LAG}, {MAX_LAG} + 1)) AS lag) l
  JOIN dv b ON b.t = a.t + l.lag AND a.series_id < b.series_id GROUP BY ALL),
cc AS (
  SELECT series_a, series_b, lag, total / sqrt(x.s * y.s) AS corr
  FROM lagged_sums JOIN sq x ON x.series_id = series_a JOIN sq y ON y.series_id = series_b)""") + f"""
SELECT series_a, series_b, arg_max(lag, (abs(corr), -abs(lag), lag)) AS lag,
       {O.r('arg_max(corr, (abs(corr), -abs(lag), lag))', 'corr', HEAD_DIGITS)},
       {O.r('max(corr) FILTER (WHERE lag = 0)', 'corr_0', HEAD_DIGITS)}
FROM cc GROUP BY series_a, series_b""")
def q_lead_lag(spark, sf):
    """The best of 25 lags for every pair of sensors."""
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(SENSORS) for b in SENSORS[i + 1:]],
                                  "series_a string, series_b string")
    p = prepared(spark, sf, HOURLY, materialize=True)
    return rounded(best_lag(lead_lag(p, pairs, MAX_LAG, HOURLY.freq, HOURLY.chunk_buckets)), HEAD_DIGITS)
