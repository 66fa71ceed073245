"""DuckDB oracle SQL for the registered queries.

The CTE builders below restate, in plain SQL, what each Spark operator
computes on the `events` sensors (settings of ``config.EVENTS``). They are the
correctness reference the driver compares against at sf0.01.
"""

from __future__ import annotations

from ..config import EVENTS, PipelineConfig
from ..functions.timefn import freq_micros

# Reported DOUBLEs are rounded to a binary grid that grows with
# the magnitude: 2^-34 below 2^-10, 2^-28 below 1, 2^-20 below 2^10, then one step
# of 2^10 per decade of 2^10 (about 6-9 significant digits), none from 2^60 on. Both engines use the same
# exact IEEE operations, floor(x / g + 0.5) * g, and pick g by exact threshold
# comparisons. A decimal grid would put exact decimal ties (a mean such as
# 36.5421875) on a rounding boundary, where summation order decides the last
# bit; data with decimal fractions does not land on a binary grid's half-points.
DIGITS = 20
SCALE = 2.0 ** DIGITS
GRID = [(2.0 ** -10, 2.0 ** -34), (1.0, 2.0 ** -28), (2.0 ** 10, 2.0 ** -20), (2.0 ** 20, 2.0 ** -10), (2.0 ** 30, 1.0),
        (2.0 ** 40, 2.0 ** 10), (2.0 ** 50, 2.0 ** 20), (2.0 ** 60, 2.0 ** 30)]


def rnd(expr: str, digits: int = DIGITS) -> str:
    """Round to the grid; fewer ``digits`` coarsen every step by powers of two."""
    x = f"({expr})"
    grid = [(lim, g * 2.0 ** (DIGITS - digits)) for lim, g in GRID]
    arms = " ".join(f"WHEN abs({x}) < {lim!r} THEN floor({x} / {g!r} + 0.5) * {g!r}"
                    for lim, g in grid)
    return f"CASE {arms} ELSE {x} END"


def r(expr: str, alias: str | None = None, digits: int = DIGITS) -> str:
    return f"{rnd(expr, digits)} AS {alias or expr}"


def raw_cte(key: str = "event_type") -> str:
    if key == "orders":
        return """raw AS (
  SELECT o_orderpriority AS series_id, o_orderdate AS ts, o_totalprice AS value,
         'Good' AS quality
  FROM orders)"""
    if key == "supplier":
        return """raw AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS series_id, l_shipdate AS ts, l_extendedprice AS value,
         'Good' AS quality
  FROM lineitem)"""
    return f"""raw AS (
  SELECT CAST({key} AS VARCHAR) AS series_id, ts, value,
         CASE WHEN TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) < 5
              THEN 'Bad' ELSE 'Good' END AS quality
  FROM events)"""


def clean_cte(cfg: PipelineConfig = EVENTS) -> str:
    if not cfg.invalid_intervals:
        return """good AS (
  SELECT series_id, ts, value FROM raw
  WHERE quality = 'Good' AND ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
clean AS (SELECT series_id, ts, value, 0 AS segment_id FROM good)"""
    (s, e), = cfg.invalid_intervals
    seg = (f"CAST(ts > TIMESTAMP '{e}' AS INTEGER)" if cfg.per_segment else "0")
    return f"""good AS (
  SELECT series_id, ts, value FROM raw
  WHERE quality = 'Good' AND ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
clean AS (
  SELECT series_id, ts, value, {seg} AS segment_id FROM good
  WHERE NOT (ts BETWEEN TIMESTAMP '{s}' AND TIMESTAMP '{e}'))"""


def buckets_cte(cfg: PipelineConfig = EVENTS, src: str = "clean") -> str:
    sec = freq_micros(cfg.freq) // 1_000_000
    b = f"time_bucket(INTERVAL '{sec} seconds', ts, TIMESTAMP '1970-01-01 00:00:00')"
    return f"""buckets AS (
  SELECT series_id, segment_id, {b} AS ts, avg(value) AS value
  FROM {src} GROUP BY series_id, segment_id, {b})"""


def filled_cte(cfg: PipelineConfig = EVENTS, limit: int | None | str = "cfg",
               src: str = "buckets") -> str:
    us = freq_micros(cfg.freq)
    lim = cfg.fill_limit if limit == "cfg" else limit
    n = "gap" if lim is None else f"least(gap, {lim})"
    return f"""nx AS (
  SELECT *, lead(ts) OVER w AS n_ts, lead(value) OVER w AS n_value,
         lead(segment_id) OVER w AS n_seg
  FROM {src} WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
gp AS (
  SELECT *, CASE WHEN n_ts IS NOT NULL AND n_seg = segment_id
                 THEN (epoch_us(n_ts) - epoch_us(ts)) // {us} - 1 ELSE 0 END AS gap
  FROM nx),
gk AS (
  SELECT *, unnest(range(0, CASE WHEN gap > 0 THEN {n} ELSE 0 END + 1)) AS k FROM gp),
filled AS (
  SELECT series_id, segment_id, ts + to_microseconds(k * {us}) AS ts,
         CASE WHEN k = 0 THEN value ELSE value + (n_value - value) * k / (gap + 1) END AS value,
         k > 0 AS filled
  FROM gk)"""


def split_cte(cfg: PipelineConfig = EVENTS, src: str = "filled") -> str:
    return f"""prep AS (
  SELECT * FROM (
    SELECT *, CASE WHEN ts <= TIMESTAMP '{cfg.train_end}' THEN 'train'
                   WHEN ts BETWEEN TIMESTAMP '{cfg.eval_start}' AND TIMESTAMP '{cfg.eval_end}'
                   THEN 'eval' END AS split
    FROM {src}) WHERE split IS NOT NULL)"""


def params_cte(src: str = "prep", by: str = "series_id") -> str:
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""params AS (
  SELECT {sel}avg(value) AS mean,
         CASE WHEN stddev_pop(value) IS NULL OR stddev_pop(value) = 0 THEN 1.0
              ELSE stddev_pop(value) END AS std
  FROM {src} WHERE split = 'train'{grp})"""


def prep_chain(cfg: PipelineConfig = EVENTS, key: str = "event_type") -> str:
    """WITH-list up to ``prep`` (series_id, segment_id, ts, value, filled, split)."""
    return ",\n".join([raw_cte(key), clean_cte(cfg), buckets_cte(cfg), filled_cte(cfg),
                       split_cte(cfg)])


def indexed_cte(src: str = "prep") -> str:
    return f"""idx AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS time_idx FROM {src})"""


def prev_cte(cfg: PipelineConfig, src: str = "prep", name: str = "pv") -> str:
    us = freq_micros(cfg.freq)
    return f"""{name}_l AS (
  SELECT *, lag(ts) OVER w AS p_ts, lag(value) OVER w AS p_value, lag(segment_id) OVER w AS p_seg
  FROM {src} WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
{name} AS (
  SELECT * EXCLUDE (p_ts, p_value, p_seg),
         CASE WHEN epoch_us(ts) - epoch_us(p_ts) = {us} AND p_seg = segment_id
              THEN p_value END AS prev_value
  FROM {name}_l)"""


def ar_params_cte(cfg: PipelineConfig, src: str = "prep") -> str:
    return prev_cte(cfg, src) + """,
arp AS (
  SELECT series_id, coalesce(regr_slope(value, prev_value), 0.0) AS phi,
         coalesce(regr_intercept(value, prev_value), avg(value)) AS c,
         sqrt(greatest(var_pop(value) - CASE WHEN var_pop(prev_value) > 0
                                             THEN covar_pop(prev_value, value) * covar_pop(prev_value, value)
                                                  / var_pop(prev_value) ELSE 0.0 END, 0.0)) AS sigma,
         count(*) AS n_pairs
  FROM pv WHERE split = 'train' AND prev_value IS NOT NULL GROUP BY series_id)"""


def ar_forecast_cte(cfg: PipelineConfig, origins: str = "last", name: str = "arfc") -> str:
    us = freq_micros(cfg.freq)
    if origins == "last":
        o = """SELECT series_id, max(struct_pack(ts := ts, value := value)) AS o FROM prep
  WHERE split = 'train' GROUP BY series_id"""
        o = f"""{name}_o AS (SELECT series_id, o.ts AS origin_ts, o.value AS origin_value FROM (
  {o}))"""
    else:
        o = f"""{name}_o AS (SELECT series_id, ts AS origin_ts, value AS origin_value FROM prep
  WHERE split = 'eval')"""
    return o + f""",
{name}_s AS (
  SELECT o.*, a.phi, a.c, a.sigma, unnest(range(1, {cfg.horizon} + 1)) AS step
  FROM {name}_o o JOIN arp a USING (series_id)),
{name} AS (
  SELECT 'ar1' AS model, series_id, origin_ts, CAST(step AS INTEGER) AS step,
         origin_ts + to_microseconds(step * {us}) AS target_ts, CAST(NULL AS DOUBLE) AS q,
         pow(phi, step) * origin_value
           + c * CASE WHEN phi = 1 THEN CAST(step AS DOUBLE)
                      ELSE (1.0 - pow(phi, step)) / (1.0 - phi) END AS predicted,
         sigma * sqrt(CASE WHEN phi * phi = 1 THEN CAST(step AS DOUBLE)
                           ELSE (1.0 - pow(phi, step) * pow(phi, step)) / (1.0 - phi * phi) END) AS sd
  FROM {name}_s)"""


def aligned_cte(fc: str = "fc", name: str = "aligned") -> str:
    return f"""{name} AS (
  SELECT f.*, p.value AS actual FROM {fc} f
  LEFT JOIN prep p ON p.series_id = f.series_id AND p.ts = f.target_ts)"""


def metric_select(by: str = "model", src: str = "aligned") -> str:
    n = "count(*)"
    sst = f"var_pop(actual) * {n}"
    return f"""SELECT {by}, {n} AS n,
  {r('avg(abs(actual - predicted))', 'mae')},
  {r('avg((actual - predicted) * (actual - predicted))', 'mse')},
  {r('sqrt(avg((actual - predicted) * (actual - predicted)))', 'rmse')},
  {r('avg(2.0 * abs(predicted - actual) / (abs(actual) + abs(predicted) + 1e-8)) * 100.0', 'smape')},
  {r('avg(abs((actual - predicted) / (actual + 1e-8))) * 100.0', 'mape')},
  {r(f'CASE WHEN {sst} > 0 THEN 1.0 - sum((actual - predicted) * (actual - predicted)) / ({sst}) END', 'r2')}
FROM {src}
WHERE actual IS NOT NULL AND NOT isnan(actual) AND predicted IS NOT NULL AND NOT isnan(predicted)
GROUP BY {by}"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ----------------------------------------------------------------- forecasters
def basis_ctes(cfg: PipelineConfig, period: int, harmonics: int, where: str = "split = 'train'",
               suffix: str = "") -> str:
    """tr{suffix}: trend per series; se{suffix}: harmonics of the residual."""
    us = freq_micros(cfg.freq)
    t = f"CAST(epoch_us(ts) // {us} AS BIGINT)"
    harm = ",\n         ".join(
        f"2.0 * avg(r * cos(2.0 * pi() * {k} * (t % {period}) / {period})) AS a_{k}, "
        f"2.0 * avg(r * sin(2.0 * pi() * {k} * (t % {period}) / {period})) AS b_{k}"
        for k in range(1, harmonics + 1))
    return f"""tr{suffix} AS (
  SELECT series_id, regr_slope(value, CAST({t} AS DOUBLE)) AS slope,
         regr_intercept(value, CAST({t} AS DOUBLE)) AS intercept, count(*) AS n
  FROM prep WHERE {where} GROUP BY series_id),
se{suffix} AS (
  SELECT series_id, {harm}
  FROM (SELECT p.series_id, {t.replace('ts', 'p.ts')} AS t,
               p.value - (tr.intercept + tr.slope * CAST({t.replace('ts', 'p.ts')} AS DOUBLE)) AS r
        FROM prep p JOIN tr{suffix} tr USING (series_id) WHERE {where.replace('split', 'p.split').replace('ts <', 'p.ts <')})
  GROUP BY series_id)"""


def decompose_expr(t: str, period: int, harmonics: int) -> str:
    e = f"(intercept + slope * CAST({t} AS DOUBLE))"
    for k in range(1, harmonics + 1):
        e = (f"({e} + (a_{k} * cos(2.0 * pi() * {k} * ({t} % {period}) / {period})"
             f" + b_{k} * sin(2.0 * pi() * {k} * ({t} % {period}) / {period})))")
    return e


def steps_cte(cfg: PipelineConfig, name: str, origins: str = "eval") -> str:
    us = freq_micros(cfg.freq)
    return f"""{name} AS (
  SELECT series_id, origin_ts, CAST(step AS INTEGER) AS step,
         origin_ts + to_microseconds(step * {us}) AS target_ts
  FROM (SELECT series_id, ts AS origin_ts, unnest(range(1, {cfg.horizon} + 1)) AS step
        FROM prep WHERE split = '{origins}'))"""


def decompose_fc_cte(cfg: PipelineConfig, period: int, harmonics: int, name: str = "dcfc") -> str:
    us = freq_micros(cfg.freq)
    t = f"CAST(epoch_us(target_ts) // {us} AS BIGINT)"
    return steps_cte(cfg, f"{name}_s") + f""",
{name} AS (
  SELECT 'decompose' AS model, series_id, origin_ts, step, target_ts, CAST(NULL AS DOUBLE) AS q,
         {decompose_expr(t, period, harmonics)} AS predicted
  FROM {name}_s JOIN tr USING (series_id) JOIN se USING (series_id))"""


def profile_cte(qs=(0.1, 0.5, 0.9), name: str = "qp") -> str:
    parts = [f"""SELECT series_id, CAST(hour(ts) AS INTEGER) AS hour,
         CAST(isodow(ts) - 1 >= 5 AS INTEGER) AS is_weekend, CAST({q} AS DOUBLE) AS q,
         quantile_cont(value, {q}) AS value
  FROM prep WHERE split = 'train' GROUP BY ALL""" for q in qs]
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def quantile_fc_cte(cfg: PipelineConfig, name: str = "qfc") -> str:
    return steps_cte(cfg, f"{name}_s") + f""",
{name} AS (
  SELECT 'quantile_profile' AS model, s.series_id, s.origin_ts, s.step, s.target_ts, p.q,
         p.value AS predicted
  FROM {name}_s s JOIN qp p ON p.series_id = s.series_id
   AND p.hour = CAST(hour(s.target_ts) AS INTEGER)
   AND p.is_weekend = CAST(isodow(s.target_ts) - 1 >= 5 AS INTEGER))"""


def renamed(sql: str, names: list[str], suffix: str) -> str:
    """Rename CTE names (whole words) - used to build a second, validation
    copy of a CTE chain next to the first."""
    import re
    for n in names:
        sql = re.sub(rf"\b{n}\b", n + suffix, sql)
    return sql


def solve_ctes(train: str, features: list[str], targets: list[str], name: str,
               ridge: float = 1e-8, by: str = "") -> str:
    """{name}_w: one row (per value of ``by``) with the coefficients w_i_h of the ridge normal equations
    of ``targets`` on [1, features] over ``train``, by Gauss-Jordan elimination
    written out column by column."""
    k, h = len(features) + 1, len(targets)
    cols = ["1.0", *features]
    sums = [f"sum({cols[i]} * {cols[j]}) AS m_{i}_{j}" for i in range(k) for j in range(k)]
    sums += [f"sum({cols[i]} * {t}) AS m_{i}_{k + j}" for i in range(k) for j, t in enumerate(targets)]
    trace = " + ".join(f"m_{i}_{i}" for i in range(k))
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    out = [f"{name}_s AS (SELECT {key}{', '.join(sums)} FROM {train}{group})"]
    first = ", ".join(
        (f"m_{i}_{j} + {ridge!r} * greatest(1.0, ({trace}) / {k}) AS m_{i}_{j}" if ridge and i == j else f"m_{i}_{j}")
        for i in range(k) for j in range(k + h))
    out.append(f"{name}_0 AS (SELECT {key}{first} FROM {name}_s)")
    for p in range(k):
        step = ", ".join(
            (f"m_{p}_{j} / m_{p}_{p}" if i == p else f"m_{i}_{j} - m_{i}_{p} * (m_{p}_{j} / m_{p}_{p})")
            + f" AS m_{i}_{j}" for i in range(k) for j in range(p + 1, k + h))
        keep = ", ".join(f"m_{i}_{j}" for i in range(k) for j in range(p + 1))
        out.append(f"{name}_{p + 1} AS (SELECT {key}{keep}, {step} FROM {name}_{p})")
    out.append(f"{name}_w AS (SELECT {key}" + ", ".join(
        f"m_{i}_{k + j} AS w_{i}_{j}" for i in range(k) for j in range(h)) + f" FROM {name}_{k})")
    return ",\n".join(out)


def head_forecast_cte(src: str, features: list[str], base: str, horizon: int, us: int, name: str,
                      model: str, origin: str = "origin_ts", where: str = "split = 'eval'") -> str:
    """{name}: forecasts of the head solved as {name}_w from the rows of ``src``."""
    preds = ", ".join(
        f"{base} + w_0_{j} + " + " + ".join(f"w_{i + 1}_{j} * {f}" for i, f in enumerate(features))
        for j in range(horizon))
    return f"""{name} AS (
  SELECT '{model}' AS model, series_id, origin_ts, CAST(step AS INTEGER) AS step,
         origin_ts + to_microseconds(step * {us}) AS target_ts, CAST(NULL AS DOUBLE) AS q, preds[step] AS predicted
  FROM (SELECT series_id, {origin} AS origin_ts, [{preds}] AS preds, unnest(range(1, {horizon} + 1)) AS step
        FROM {src}, {name}_w WHERE {where}))"""


def normal_equations_sql(train: str, features: list[str], targets: list[str], digits: int = DIGITS) -> str:
    """Long form (i, j, value) of X'X (j < k) and X'Y (j >= k)."""
    cols = ["1.0", *features]
    return "\nUNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, {r(f'coalesce(sum({a} * {b}), 0.0)', 'value', digits)} FROM {train}"
        for i, a in enumerate(cols) for j, b in enumerate([*cols, *targets]) if j >= i)
