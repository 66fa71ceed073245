"""Registered queries: one per operator of the blueprint, each a Spark job on
the driver tables (``events`` as sensors, plus the many-series adapters),
paired with DuckDB oracle SQL where an exact SQL statement exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EVENTS, EVENTS_HOURLY, PipelineConfig
from ..operators import evaluate as EV
from ..operators.forecast import autoreg
from ..sources.tables import sensor_raw
from . import jobs as J
from . import oracle as O
from . import prepare as P
from .report import rounded
from ..operators import clean as CL
from ..operators import ingest as IN
from ..operators import split as SP
from ..session import scratch_path
from ..sources import readers as RD
from ..sources.tables import sensor_raw_text
from ..operators import features as FE
from ..operators import report as RP
from ..operators import scaling as SC
from ..operators import segments as SG
from ..operators import windows as WN
from ..operators.resample import fill_gaps, resample_mean
from ..functions.timefn import freq_micros
from ..operators.forecast import basis, causal, patch, score
from ..operators.forecast import quantile as QF
from ..operators.forecast import select as SEL
from ..operators import monitor as MO
from ..operators.forecast import linear
from ..operators.forecast.common import FORECAST_COLS, target_names, train_rows, with_prev
from ..operators.layout import spread_join
from ..streaming import stream as ST
from ..sources.tables import daily_priority_orders, daily_supplier_sales
from ..sources import writers as WR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOURLY = EVENTS_HOURLY


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def regular(spark: SparkSession, sf: str, cfg: PipelineConfig = EVENTS,
            key: str = "event_type", materialize: bool = False) -> DataFrame:
    """events -> regular series (series_id, segment_id, ts, value, filled).
    ``materialize`` writes it once to the shared checkpoint folder (the
    preprocess / train boundary), for queries where several branches - fits,
    forecasts, alignment - read it."""
    out = P.regularise(P.clean(sensor_raw(spark, sf, key), cfg), cfg)
    return WR.materialize(out, "regular") if materialize else out


def prepared(spark: SparkSession, sf: str, cfg: PipelineConfig = EVENTS,
             key: str = "event_type", materialize: bool = False) -> DataFrame:
    """events -> (series_id, segment_id, ts, value, filled, split)."""
    return P.split(regular(spark, sf, cfg, key, materialize), cfg)


# ---------------------------------------------------------------- forecasters
H_CHAIN = O.prep_chain(HOURLY)


@query("ar_fit", O.with_(H_CHAIN, O.ar_params_cte(HOURLY)) + f"""
SELECT series_id, {O.r('phi')}, {O.r('c')}, {O.r('sigma')}, n_pairs FROM arp""")
def q_ar_fit(spark, sf):
    return rounded(autoreg.ar_fit(prepared(spark, sf, HOURLY), HOURLY.freq, HOURLY.chunk_buckets))


@query("ar_forecast", O.with_(H_CHAIN, O.ar_params_cte(HOURLY),
                              O.ar_forecast_cte(HOURLY, "last")) + f"""
SELECT model, series_id, origin_ts, step, target_ts, q, {O.r('predicted')}, {O.r('sd')},
       {O.r('predicted - 1.2815515655446004 * sd', 'lower')},
       {O.r('predicted + 1.2815515655446004 * sd', 'upper')}
FROM arfc""")
def q_ar_forecast(spark, sf):
    p = prepared(spark, sf, HOURLY)
    params = autoreg.ar_fit(p, HOURLY.freq, HOURLY.chunk_buckets)
    return rounded(autoreg.ar_forecast(p, params, HOURLY.horizon, HOURLY.freq, "last"))


def ar_rolling(spark, sf):
    p = prepared(spark, sf, HOURLY)
    params = autoreg.ar_fit(p, HOURLY.freq, HOURLY.chunk_buckets)
    return p, autoreg.ar_forecast(p, params, HOURLY.horizon, HOURLY.freq, "eval")



# ------------------------------------------------------- ingest and cleaning

CFG = EVENTS
(INV_S, INV_E), = CFG.invalid_intervals
RAW = O.raw_cte()
CLEAN_CHAIN = ",\n".join([RAW, O.clean_cte(CFG)])
CHAIN = O.prep_chain(CFG)
REAL = "NOT isnan(value)"


@query("quality_filter", O.with_(RAW) + "SELECT * FROM raw WHERE quality = 'Good'")
def q_quality_filter(spark, sf):
    return IN.filter_quality(sensor_raw(spark, sf))


@query("normalise_columns",
       "SELECT event_type AS series_id, ts, value FROM events")
def q_normalise_columns(spark, sf):
    return IN.normalise_columns(RD.table(spark, sf, "events"),
                                {"event_type": "series_id", "ts": "ts", "value": "value"})


def raw_text(spark, sf):
    return sensor_raw_text(spark, sf).select(
        "series_id", F.col("DateTime").alias("ts_raw"), F.col("Value").alias("value_raw"),
        F.col("QualityStatus").alias("quality"))


@query("parse_ts_coerce", "SELECT event_type AS series_id, ts FROM events")
def q_parse_ts_coerce(spark, sf):
    return IN.parse_ts(raw_text(spark, sf), strict=False).select("series_id", "ts")


@query("parse_value_coerce", "SELECT event_type AS series_id, value FROM events")
def q_parse_value_coerce(spark, sf):
    return IN.parse_value(raw_text(spark, sf)).select("series_id", "value")


@query("drop_missing", O.with_(RAW) + f"""
SELECT series_id, ts, value FROM raw WHERE ts IS NOT NULL AND value IS NOT NULL AND {REAL}""")
def q_drop_missing(spark, sf):
    x = IN.parse_value(IN.parse_ts(raw_text(spark, sf), strict=True))
    return IN.drop_missing(x.select("series_id", "ts", "value"), ["ts", "value"])


@query("exclude_interval", O.with_(RAW) + f"""
SELECT series_id, ts, value FROM raw
WHERE NOT (ts BETWEEN TIMESTAMP '{INV_S}' AND TIMESTAMP '{INV_E}')""")
def q_exclude_interval(spark, sf):
    return CL.exclude_interval(sensor_raw(spark, sf).select("series_id", "ts", "value"),
                               CFG.invalid_intervals)


@query("segment_ab", O.with_(CLEAN_CHAIN) + "SELECT series_id, ts, value, segment_id FROM clean")
def q_segment_ab(spark, sf):
    return P.clean(sensor_raw(spark, sf), CFG)


@query("invalid_remaining", O.with_(
    RAW, O.clean_cte(CFG), O.buckets_cte(CFG), O.filled_cte(CFG),
    O.clean_cte(CFG.with_(per_segment=False)).replace("good AS", "good2 AS").replace(
        "clean AS", "clean2 AS").replace("FROM good", "FROM good2"),
    O.buckets_cte(CFG, "clean2").replace("buckets AS", "buckets2 AS"),
    O.filled_cte(CFG, src="buckets2").replace("nx AS", "nx2 AS").replace("FROM nx", "FROM nx2")
    .replace("gp AS", "gp2 AS").replace("FROM gp", "FROM gp2").replace("gk AS", "gk2 AS")
    .replace("FROM gk", "FROM gk2").replace("filled AS", "filled2 AS")) + f"""
SELECT 'per_segment' AS variant,
       CAST(count_if(ts BETWEEN TIMESTAMP '{INV_S}' AND TIMESTAMP '{INV_E}') AS BIGINT) AS invalid_rows
FROM filled
UNION ALL
SELECT 'per_series', CAST(count_if(ts BETWEEN TIMESTAMP '{INV_S}' AND TIMESTAMP '{INV_E}') AS BIGINT)
FROM filled2""")
def q_invalid_remaining(spark, sf):
    raw = sensor_raw(spark, sf)
    out = []
    for name, cfg in (("per_segment", CFG), ("per_series", CFG.with_(per_segment=False))):
        reg = P.regularise(P.clean(raw, cfg), cfg)
        out.append(CL.invalid_remaining(reg, cfg.invalid_intervals)
                   .select(F.lit(name).alias("variant"), "invalid_rows"))
    return out[0].unionByName(out[1])


@query("time_split", O.with_(CHAIN) + "SELECT series_id, segment_id, ts, " + O.r("value")
       + ", filled, split FROM prep")
def q_time_split(spark, sf):
    return rounded(prepared(spark, sf))


@query("flag_interval", O.with_(RAW, O.clean_cte(CFG), O.buckets_cte(CFG), O.filled_cte(CFG)) + f"""
SELECT series_id, ts, CAST(ts BETWEEN TIMESTAMP '{CFG.eval_start}' AND TIMESTAMP '{CFG.eval_end}'
       AS INTEGER) AS is_eval FROM filled""")
def q_flag_interval(spark, sf):
    reg = P.regularise(P.clean(sensor_raw(spark, sf), CFG), CFG)
    return SP.flag_interval(reg, CFG.eval_start, CFG.eval_end).select("series_id", "ts", "is_eval")


@query("split_counts", O.with_(RAW, O.clean_cte(CFG), O.buckets_cte(CFG), O.filled_cte(CFG)) + f"""
SELECT CAST(ts BETWEEN TIMESTAMP '{CFG.eval_start}' AND TIMESTAMP '{CFG.eval_end}' AS INTEGER)
       AS is_eval, count(*) AS n_rows FROM filled GROUP BY 1""")
def q_split_counts(spark, sf):
    reg = P.regularise(P.clean(sensor_raw(spark, sf), CFG), CFG)
    return SP.split_counts(SP.flag_interval(reg, CFG.eval_start, CFG.eval_end))


def indexed(spark, sf, cfg=CFG):
    from ..operators.segments import dense_time_index
    return dense_time_index(prepared(spark, sf, cfg), cfg.freq, chunk_buckets=cfg.chunk_buckets)


CUT_SQL = O.with_(CHAIN, O.indexed_cte(), """cut AS (
  SELECT i.*, c.cutoff, CASE WHEN i.time_idx <= c.cutoff THEN 'train' ELSE 'eval' END AS part
  FROM idx i JOIN (SELECT series_id, max(time_idx) AS cutoff FROM idx WHERE split = 'train'
                   GROUP BY series_id) c USING (series_id))""")


@query("time_index", O.with_(CHAIN, O.indexed_cte()) + "SELECT series_id, ts, time_idx FROM idx")
def q_time_index(spark, sf):
    p = prepared(spark, sf).select("series_id", "ts")
    return SG.dense_time_index(p, CFG.freq, chunk_buckets=CFG.chunk_buckets)


@query("cutoff_split", CUT_SQL + "SELECT series_id, ts, time_idx, cutoff, part FROM cut")
def q_cutoff_split(spark, sf):
    return SP.split_at_cutoff(indexed(spark, sf)).select("series_id", "ts", "time_idx", "cutoff",
                                                          "part")


@query("eval_halo", CUT_SQL + f"""
SELECT series_id, ts, time_idx, part FROM cut WHERE time_idx > cutoff - {CFG.context}""")
def q_eval_halo(spark, sf):
    c = SP.split_at_cutoff(indexed(spark, sf))
    return SP.eval_with_halo(c, CFG.context).select("series_id", "ts", "time_idx", "part")


@query("series_key", "SELECT 'events' AS series_id, ts, value FROM events")
def q_series_key(spark, sf):
    ev = RD.table(spark, sf, "events").select("ts", "value")
    return IN.with_series_id(ev, "events").select("series_id", "ts", "value")


@query("cast_float32", O.with_(CLEAN_CHAIN) + "SELECT series_id, ts, CAST(value AS FLOAT) AS value FROM clean")
def q_cast_float32(spark, sf):
    return IN.cast_value(P.clean(sensor_raw(spark, sf), CFG), "float").select("series_id", "ts",
                                                                                "value")


@query("min_length_report", O.with_(CHAIN) + f"""
SELECT series_id, split, count(*) AS n_rows, CAST({CFG.context + CFG.horizon} AS BIGINT) AS needed,
       count(*) >= {CFG.context + CFG.horizon} AS ok
FROM prep GROUP BY series_id, split""")
def q_min_length_report(spark, sf):
    return SP.min_length_report(prepared(spark, sf), CFG.context, CFG.horizon)


# ---------------------------------------------------------- sources and sinks
@query("scan_csv", O.with_(RAW) + f"""
SELECT series_id, ts, value FROM raw WHERE quality = 'Good' AND {REAL}""")
def q_scan_csv(spark, sf):
    path = WR.write_raw_csv(sensor_raw_text(spark, sf), scratch_path(spark, "raw_csv"))
    return IN.clean_readings(RD.read_raw(spark, path, series_col="series_id"))


@query("scan_csv_mixed", O.with_(RAW) + f"""
SELECT series_id, ts, value FROM raw WHERE quality = 'Good' AND {REAL}""")
def q_scan_csv_mixed(spark, sf):
    """A1: files whose headers differ in order and in extra columns."""
    path = scratch_path(spark, "raw_csv_mixed")
    raw = sensor_raw_text(spark, sf)
    half = F.col("series_id").isin(["click", "error"])
    WR.write_raw_csv(raw.where(half), f"{path}/a")
    WR.write_raw_csv(raw.where(~half).select(F.lit("x").alias("Extra"), "QualityStatus", "Value", "series_id",
                                             "DateTime"), f"{path}/b")
    return IN.clean_readings(RD.read_raw(spark, f"{path}/*", mixed_headers=True))


@query("scan_prepared", O.with_(CHAIN) + "SELECT series_id, segment_id, ts, " + O.r("value")
       + ", filled, split FROM prep")
def q_scan_prepared(spark, sf):
    path = WR.write_prepared(prepared(spark, sf), scratch_path(spark, "prepared_csv"), fmt="csv",
                             partition_by=())
    from pyspark.sql import types as T
    schema = T.StructType(list(RD.PREPARED_SCHEMA.fields) + [T.StructField("split", T.StringType())])
    return rounded(RD.read_prepared(spark, path, "csv", schema))


@query("sink_prepared", O.with_(CHAIN) + "SELECT series_id, segment_id, ts, " + O.r("value")
       + ", filled, split FROM prep")
def q_sink_prepared(spark, sf):
    path = WR.write_prepared(prepared(spark, sf), scratch_path(spark, "prepared"))
    return rounded(RD.read_prepared(spark, path).select("series_id", "segment_id", "ts", "value",
                                                        "filled", "split"))


@query("split_timestamps", O.with_(CHAIN) + "SELECT series_id, ts FROM prep WHERE split = 'eval'")
def q_split_timestamps(spark, sf):
    return WR.split_timestamps(prepared(spark, sf), "eval")


@query("scaler_params", O.with_(CHAIN, O.params_cte()) + f"""
SELECT series_id, {O.r('mean')}, {O.r('std')} FROM params""")
def q_scaler_params(spark, sf):
    from ..operators.scaling import fit_scaler
    path = WR.save_params(fit_scaler(prepared(spark, sf)), scratch_path(spark, "scaler"))
    return rounded(RD.load_params(spark, path))


@query("model_params", SQL["ar_fit"])
def q_model_params(spark, sf):
    p = prepared(spark, sf, HOURLY)
    path = WR.save_model(autoreg.ar_fit(p, HOURLY.freq, HOURLY.chunk_buckets),
                         scratch_path(spark, "ar_model"))
    return rounded(RD.load_params(spark, path))


@query("forecast_table", SQL["ar_forecast"])
def q_forecast_table(spark, sf):
    p = prepared(spark, sf, HOURLY)
    fc = autoreg.ar_forecast(p, autoreg.ar_fit(p, HOURLY.freq, HOURLY.chunk_buckets),
                             HOURLY.horizon, HOURLY.freq, "last")
    path = WR.write_forecasts(fc, scratch_path(spark, "forecasts"))
    return rounded(spark.read.parquet(path).select(*fc.columns))


# ------------------------------------------- aggregates, fill, segments, index

BUCKET_CHAIN = ",\n".join([RAW, O.clean_cte(CFG), O.buckets_cte(CFG)])
FILL_CHAIN = ",\n".join([BUCKET_CHAIN, O.filled_cte(CFG)])


def clean_df(spark, sf, cfg=CFG):
    return P.clean(sensor_raw(spark, sf), cfg)


@query("resample_mean", O.with_(BUCKET_CHAIN) + "SELECT series_id, segment_id, ts, "
       + O.r("value") + " FROM buckets")
def q_resample_mean(spark, sf):
    return rounded(resample_mean(clean_df(spark, sf), CFG.freq))


@query("fill_gaps", O.with_(FILL_CHAIN) + "SELECT series_id, segment_id, ts, " + O.r("value")
       + ", filled FROM filled")
def q_fill_gaps(spark, sf):
    b = resample_mean(clean_df(spark, sf), CFG.freq)
    return rounded(fill_gaps(b, CFG.freq, CFG.fill_limit, chunk_buckets=CFG.chunk_buckets))


_UNL = CFG.with_(per_segment=False, fill_limit=None)


@query("fill_gaps_unlimited", O.with_(RAW, O.clean_cte(_UNL), O.buckets_cte(_UNL),
                                      O.filled_cte(_UNL)) + "SELECT series_id, ts, "
       + O.r("value") + ", filled FROM filled")
def q_fill_gaps_unlimited(spark, sf):
    b = resample_mean(clean_df(spark, sf, _UNL), _UNL.freq)
    return rounded(fill_gaps(b, _UNL.freq, None, chunk_buckets=_UNL.chunk_buckets)
                   .select("series_id", "ts", "value", "filled"))


@query("time_gaps", O.with_(CLEAN_CHAIN) + """
SELECT series_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)))
       / 1e6 AS gap_seconds FROM clean""")
def q_time_gaps(spark, sf):
    return SG.gap_seconds(clean_df(spark, sf).select("series_id", "ts"), CFG.freq,
                          chunk_buckets=CFG.chunk_buckets)


def cont_cte(src: str, max_gap_us: int, name: str = "cs") -> str:
    return f"""{name}_l AS (
  SELECT *, lag(ts) OVER w AS p_ts, lag(segment_id) OVER w AS p_seg
  FROM {src} WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
{name} AS (
  SELECT * EXCLUDE (p_ts, p_seg, segment_id),
         CAST(sum(CASE WHEN p_ts IS NOT NULL AND (epoch_us(ts) - epoch_us(p_ts) > {max_gap_us}
                                                OR p_seg <> segment_id) THEN 1 ELSE 0 END)
              OVER (PARTITION BY series_id ORDER BY ts
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS segment_id
  FROM {name}_l)"""


@query("continuous_segments", O.with_(BUCKET_CHAIN, cont_cte("buckets", 3_600_000_000))
       + "SELECT series_id, ts, " + O.r("value") + ", segment_id FROM cs")
def q_continuous_segments(spark, sf):
    b = resample_mean(clean_df(spark, sf), CFG.freq)
    return rounded(SG.continuous_segments(b, "60 minutes", CFG.freq,
                                          chunk_buckets=CFG.chunk_buckets)
                   .select("series_id", "ts", "value", "segment_id"))


@query("long_segments", O.with_(BUCKET_CHAIN, cont_cte("buckets", 3_600_000_000)) + """
SELECT series_id, ts, """ + O.r("value") + """, segment_id FROM cs
WHERE (series_id, segment_id) IN (SELECT series_id, segment_id FROM cs
                                  GROUP BY series_id, segment_id HAVING count(*) >= 3)""")
def q_long_segments(spark, sf):
    b = resample_mean(clean_df(spark, sf), CFG.freq)
    s = SG.continuous_segments(b, "60 minutes", CFG.freq, chunk_buckets=CFG.chunk_buckets)
    return rounded(SG.keep_long_segments(s, 3).select("series_id", "ts", "value", "segment_id"))


@query("segment_lengths", O.with_(FILL_CHAIN, cont_cte("filled", 3_600_000_000)) + """
SELECT series_id, segment_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts
FROM cs GROUP BY series_id, segment_id""")
def q_segment_lengths(spark, sf):
    reg = P.regularise(clean_df(spark, sf), CFG)
    s = SG.continuous_segments(reg, "60 minutes", CFG.freq, chunk_buckets=CFG.chunk_buckets)
    return SG.segment_lengths(s)


@query("scaler_fit", O.with_(CHAIN, O.params_cte()) + f"""
SELECT series_id, {O.r('mean')}, {O.r('std')} FROM params""")
def q_scaler_fit(spark, sf):
    return rounded(SC.fit_scaler(prepared(spark, sf)))


SCALED_CHAIN = O.with_(CHAIN, O.params_cte(), """scaled AS (
  SELECT p.*, (p.value - s.mean) / s.std AS value_scaled FROM prep p JOIN params s USING (series_id))""")


def scaled_df(spark, sf):
    p = prepared(spark, sf)
    return SC.scale(p, SC.fit_scaler(p))


@query("scale_apply", SCALED_CHAIN + "SELECT series_id, ts, split, " + O.r("value_scaled")
       + " FROM scaled")
def q_scale_apply(spark, sf):
    return rounded(scaled_df(spark, sf).select("series_id", "ts", "split", "value_scaled"))


@query("scaled_stats", SCALED_CHAIN + f"""
SELECT series_id, split, {O.r('avg(value_scaled)', 'mean_scaled')},
       {O.r('stddev_pop(value_scaled)', 'std_scaled')} FROM scaled GROUP BY series_id, split""")
def q_scaled_stats(spark, sf):
    return rounded(SC.scaled_stats(scaled_df(spark, sf)))


@query("time_extent", O.with_(CLEAN_CHAIN) + """
SELECT series_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows
FROM clean GROUP BY series_id""")
def q_time_extent(spark, sf):
    return RP.time_extent(clean_df(spark, sf))


@query("stage_counts", O.with_(CHAIN) + f"""
SELECT stage, CAST(n_rows AS BIGINT) AS n_rows FROM (
  SELECT 'raw' AS stage, count(*) AS n_rows, 1 AS o FROM raw
  UNION ALL SELECT 'good', count(*), 2 FROM good
  UNION ALL SELECT 'valid', count(*), 3 FROM clean
  UNION ALL SELECT 'observed_buckets', count_if(NOT filled), 4 FROM prep
  UNION ALL SELECT 'filled_buckets', count_if(filled), 5 FROM prep
  UNION ALL SELECT 'regular_rows', count(*), 6 FROM prep
  UNION ALL SELECT 'train_rows', count_if(split = 'train'), 7 FROM prep
  UNION ALL SELECT 'eval_rows', count_if(split = 'eval'), 8 FROM prep)""")
def q_stage_counts(spark, sf):
    return RP.stage_counts(sensor_raw(spark, sf), prepared(spark, sf), CFG.invalid_intervals)


@query("prep_summary", O.with_(CHAIN) + f"""
SELECT item, value FROM (
  SELECT 'Total raw data' AS item, CAST(count(*) AS VARCHAR) AS value FROM raw
  UNION ALL SELECT 'Final valid data', CAST(count(*) AS VARCHAR) FROM prep
  UNION ALL SELECT 'Train data', CAST(count_if(split = 'train') AS VARCHAR) FROM prep
  UNION ALL SELECT 'Evaluation data', CAST(count_if(split = 'eval') AS VARCHAR) FROM prep
  UNION ALL SELECT 'Resample frequency', '{CFG.freq}'
  UNION ALL SELECT 'Interpolation limit', '{CFG.fill_limit}')""")
def q_prep_summary(spark, sf):
    return RP.prep_summary(sensor_raw(spark, sf), prepared(spark, sf), CFG.freq, CFG.fill_limit)


@query("calendar_features", O.with_(CHAIN) + """
SELECT series_id, ts, CAST(minute(ts) AS INTEGER) AS minute, CAST(hour(ts) AS INTEGER) AS hour,
       CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 >= 5 AS INTEGER) AS is_weekend
FROM prep""")
def q_calendar_features(spark, sf):
    return FE.calendar_features(prepared(spark, sf)).select(
        "series_id", "ts", "minute", "hour", "day", "day_of_week", "month", "is_weekend")


@query("combine_segments", O.with_(FILL_CHAIN) + "SELECT series_id, segment_id, ts, "
       + O.r("value") + ", filled FROM filled")
def q_combine_segments(spark, sf):
    c = clean_df(spark, sf)
    parts = [P.regularise(c.where(F.col("segment_id") == s), CFG) for s in (0, 1)]
    return rounded(WN.combine(*parts))


@query("chart_feed", O.with_(CHAIN) + """
SELECT series_id, ts, """ + O.r("value") + """, row_no FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS row_no FROM prep)
WHERE row_no <= 500""")
def q_chart_feed(spark, sf):
    return rounded(WN.chart_feed(prepared(spark, sf), 500, CFG.freq, chunk_buckets=CFG.chunk_buckets)
                   .select("series_id", "ts", "value", F.col("row_no").cast("long")))


# ------------------------------------------------------------- windows (hourly)
W_CFG = HOURLY
W_GAP_US = 7_200_000_000


def windows_src(spark, sf):
    """Hourly prepared rows, continuous segments (gap > 120 min), dense index."""
    p = prepared(spark, sf, W_CFG)
    return SG.continuous_segments(p, "120 minutes", W_CFG.freq, chunk_buckets=W_CFG.chunk_buckets,
                                  index_col="time_idx")


def windows_df(spark, sf):
    return WN.make_windows(windows_src(spark, sf), W_CFG.context, W_CFG.horizon, chunk_rows=64)


L_, H_ = W_CFG.context, W_CFG.horizon
WIN_SQL = O.with_(H_CHAIN, cont_cte("prep", W_GAP_US), O.indexed_cte("cs"), f"""wn AS (
  SELECT series_id, ts AS origin_ts, time_idx AS origin_idx,
         list(value) OVER (w ROWS BETWEEN {L_ - 1} PRECEDING AND CURRENT ROW) AS x,
         list(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND {H_} FOLLOWING) AS y,
         min(time_idx) OVER (w ROWS BETWEEN {L_ - 1} PRECEDING AND {H_} FOLLOWING) AS lo,
         max(time_idx) OVER (w ROWS BETWEEN {L_ - 1} PRECEDING AND {H_} FOLLOWING) AS hi,
         min(segment_id) OVER (w ROWS BETWEEN {L_ - 1} PRECEDING AND {H_} FOLLOWING) AS smin,
         max(segment_id) OVER (w ROWS BETWEEN {L_ - 1} PRECEDING AND {H_} FOLLOWING) AS smax
  FROM idx WINDOW w AS (PARTITION BY series_id ORDER BY time_idx)),
wins AS (
  SELECT series_id, origin_ts, origin_idx, x, y FROM wn
  WHERE lo = origin_idx - {L_ - 1} AND hi = origin_idx + {H_} AND smin = smax)""")


def long_form_sql(arrays: dict[str, str]) -> str:
    """(series_id, origin_ts, part, pos, value) rows of list columns."""
    parts = [f"""SELECT series_id, origin_ts, '{name}' AS part,
       CAST(unnest(range(0, len({expr}))) AS INTEGER) AS pos, {O.rnd(f"unnest({expr})")} AS value
FROM wins""" for name, expr in arrays.items()]
    return "\nUNION ALL\n".join(parts)


def long_form(df, arrays: dict):
    """Registered reports flatten window arrays to the long form
    (series_id, origin_ts, part, pos, value): same content, no array column."""
    parts = F.array(*[F.struct(F.lit(name).alias("part"), col.alias("v")) for name, col in arrays.items()])
    x = df.select("series_id", "origin_ts", F.explode(parts).alias("_p"))
    return rounded(x.select("series_id", "origin_ts", "_p.part",
                            F.posexplode("_p.v").alias("pos", "value")))


@query("windows_pairs", WIN_SQL + long_form_sql({"x": "x", "y": "y"}))
def q_windows_pairs(spark, sf):
    w = windows_df(spark, sf)
    return long_form(w, {"x": F.col("x"), "y": F.col("y")})


@query("window_count", O.with_(H_CHAIN, cont_cte("prep", W_GAP_US)) + f"""
SELECT series_id, CAST(sum(n) AS BIGINT) AS n_rows, CAST(greatest(sum(n) - {L_ + H_} + 1, 0) AS BIGINT) AS windows_full,
       CAST(sum(n) - {L_ + H_} AS BIGINT) AS windows_reference,
       CAST(sum(greatest(n - {L_ + H_} + 1, 0)) AS BIGINT) AS windows_in_segments
FROM (SELECT series_id, segment_id, count(*) AS n FROM cs GROUP BY series_id, segment_id)
GROUP BY series_id""")
def q_window_count(spark, sf):
    return WN.window_count(windows_src(spark, sf), L_, H_)


@query("last_window", O.with_(H_CHAIN, O.indexed_cte()) + f"""
SELECT series_id, ts, time_idx, {O.r('value')}, pos, CASE WHEN pos < {L_} THEN 'context' ELSE 'horizon' END AS role
FROM (SELECT i.*, i.time_idx - (c.n - {L_ + H_}) AS pos FROM idx i
      JOIN (SELECT series_id, count(*) AS n FROM idx GROUP BY series_id) c USING (series_id))
WHERE pos >= 0""")
def q_last_window(spark, sf):
    x = SG.dense_time_index(prepared(spark, sf, W_CFG), W_CFG.freq,
                            chunk_buckets=W_CFG.chunk_buckets)
    return rounded(WN.last_window(x, L_, H_).select("series_id", "ts", "time_idx", "value", "pos",
                                                    "role"))


@query("explode_windows", WIN_SQL + f"""
SELECT series_id, origin_ts, CAST(unnest(range(1, len(y) + 1)) AS INTEGER) AS step,
       {O.rnd("unnest(y)")} AS actual FROM wins""")
def q_explode_windows(spark, sf):
    return rounded(WN.explode_forecast(windows_df(spark, sf)))


@query("window_slice", WIN_SQL + long_form_sql(
    {"context": f"(x || y)[1:{L_}]", "horizon": f"(x || y)[{L_ + 1}:{L_ + H_}]"}))
def q_window_slice(spark, sf):
    """The joined window array sliced back into context and horizon."""
    w = windows_df(spark, sf).select("series_id", "origin_ts", F.concat("x", "y").alias("_w"))
    return long_form(w, {"context": WN.window_slice("_w", 0, L_),
                         "horizon": WN.window_slice("_w", L_, H_)})


# ------------------------------------------------------------ model features
HCUT_SQL = O.with_(H_CHAIN, O.indexed_cte(), """cut AS (
  SELECT i.*, c.cutoff FROM idx i JOIN (SELECT series_id, max(time_idx) AS cutoff FROM idx
  WHERE split = 'train' GROUP BY series_id) c USING (series_id))""")


def hourly_cut(spark, sf):
    x = SG.dense_time_index(prepared(spark, sf, W_CFG), W_CFG.freq,
                            chunk_buckets=W_CFG.chunk_buckets)
    return SP.split_at_cutoff(x)


@query("relative_time", HCUT_SQL + f"""
SELECT series_id, ts, time_idx, (time_idx - cutoff) / {float(L_)} AS relative_time_idx
FROM cut WHERE time_idx > cutoff - {L_}""")
def q_relative_time(spark, sf):
    x = SP.eval_with_halo(hourly_cut(spark, sf), L_)
    return FE.relative_time_idx(x, "cutoff", context=L_).select("series_id", "ts", "time_idx",
                                                                "relative_time_idx")


@query("target_scales", O.with_(H_CHAIN) + f"""
SELECT p.series_id, p.ts, {O.r('s.target_center', 'target_center')}, {O.r('s.target_scale', 'target_scale')}
FROM prep p JOIN (SELECT series_id, avg(value) AS target_center, stddev_pop(value) AS target_scale
                  FROM prep WHERE split = 'train' GROUP BY series_id) s USING (series_id)""")
def q_target_scales(spark, sf):
    return rounded(FE.target_scales(prepared(spark, sf, W_CFG)).select(
        "series_id", "ts", "target_center", "target_scale"))


@query("encoder_length", O.with_(H_CHAIN, O.indexed_cte()) + f"""
SELECT series_id, ts, CAST(least(time_idx + 1, {L_}) AS BIGINT) AS encoder_length FROM idx""")
def q_encoder_length(spark, sf):
    x = SG.dense_time_index(prepared(spark, sf, W_CFG), W_CFG.freq,
                            chunk_buckets=W_CFG.chunk_buckets)
    return FE.encoder_length(x, L_).select("series_id", "ts", "encoder_length")


@query("encode_series", """
SELECT series_id, CAST(dense_rank() OVER (ORDER BY series_id) - 1 AS BIGINT) AS series_code
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS series_id FROM events)""")
def q_encode_series(spark, sf):
    raw = sensor_raw(spark, sf, key="user_id")
    return FE.series_codes(raw)


# ------------------------------------------------------ forecasters F1-F8

PERIOD, HARM = 24, 3
PATCH, STRIDE = 8, 4
CHUNK_ROWS = 64
US_H = freq_micros(HOURLY.freq)
IDX_H = O.with_(H_CHAIN, O.indexed_cte())


def hourly_indexed(spark, sf):
    return indexed(spark, sf, HOURLY)


def _patch_sql() -> str:
    n = patch.n_patches(L_, PATCH, STRIDE)
    lags = ", ".join(
        (f"pm - ctx_mean AS p_{j}" if L_ - PATCH - j * STRIDE == 0 else
         f"lag(pm, {L_ - PATCH - j * STRIDE}) OVER w - ctx_mean AS p_{j}") for j in range(n))
    leads = ", ".join(f"lead(value, {h}) OVER w - ctx_mean AS y_{h}" for h in range(1, H_ + 1))
    outs = ", ".join([O.r("ctx_mean")] + [O.r(f"p_{j}") for j in range(n)]
                     + [O.r(f"y_{h}") for h in range(1, H_ + 1)])
    return IDX_H + f""", pf1 AS (
  SELECT *, avg(value) OVER (w ROWS BETWEEN {PATCH - 1} PRECEDING AND CURRENT ROW) AS pm,
         avg(value) OVER (w ROWS BETWEEN {L_ - 1} PRECEDING AND CURRENT ROW) AS ctx_mean,
         count(*) OVER (w ROWS BETWEEN {L_ - 1} PRECEDING AND CURRENT ROW) AS nc,
         min(ts) OVER (w ROWS BETWEEN {L_ - 1} PRECEDING AND CURRENT ROW) AS t0,
         count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND {H_} FOLLOWING) AS nh,
         max(ts) OVER (w ROWS BETWEEN 1 FOLLOWING AND {H_} FOLLOWING) AS t1,
         lead(split, {H_}) OVER w AS target_split
  FROM idx WINDOW w AS (PARTITION BY series_id ORDER BY time_idx)),
pf AS (
  SELECT *, {lags}, {leads} FROM pf1 WINDOW w AS (PARTITION BY series_id ORDER BY time_idx))
SELECT series_id, ts AS origin_ts, time_idx AS origin_idx, split, target_split,
       (nh = {H_} AND epoch_us(t1) - epoch_us(ts) = {H_ * US_H}) AS targets_ok, {outs}
FROM pf WHERE nc = {L_} AND epoch_us(ts) - epoch_us(t0) = {(L_ - 1) * US_H}"""


@query("patch_features", _patch_sql())
def q_patch_features(spark, sf):
    return rounded(patch.patch_features(hourly_indexed(spark, sf), L_, H_, PATCH, STRIDE,
                                        HOURLY.freq, CHUNK_ROWS))


#: The heads' values come from a solved system: compared on a coarser grid.
HEAD_DIGITS = 12
P_NAMES, Y_NAMES = patch.feature_names(L_, PATCH, STRIDE), target_names(H_)
PATCH_FEATURES = _patch_sql()[:_patch_sql().rindex("SELECT series_id, ts AS origin_ts")].rstrip() + f""",
pfeat AS (
  SELECT *, ts AS origin_ts, (nh = {H_} AND epoch_us(t1) - epoch_us(ts) = {H_ * US_H}) AS targets_ok
  FROM pf WHERE nc = {L_} AND epoch_us(ts) - epoch_us(t0) = {(L_ - 1) * US_H}),
ptrain AS (SELECT * FROM pfeat WHERE split = 'train' AND targets_ok AND target_split = 'train')"""
PATCH_HEAD = [O.solve_ctes("ptrain", P_NAMES, Y_NAMES, "ph"),
              O.head_forecast_cte("pfeat", P_NAMES, "ctx_mean", H_, US_H, "ph", "patch_linear")]
FC_OUT = "SELECT model, series_id, origin_ts, step, target_ts, q, "


def patch_train(spark, sf):
    return train_rows(patch.patch_features(hourly_indexed(spark, sf), L_, H_, PATCH, STRIDE,
                                           HOURLY.freq, CHUNK_ROWS))


@query("patch_normal_equations", PATCH_FEATURES + "\n"
       + O.normal_equations_sql("ptrain", P_NAMES, Y_NAMES))
def q_patch_normal_equations(spark, sf):
    return rounded(linear.normal_equations(patch_train(spark, sf), P_NAMES, Y_NAMES))


@query("patch_linear_forecast", ",\n".join([PATCH_FEATURES, *PATCH_HEAD]) + "\n" + FC_OUT
       + O.r("predicted", digits=HEAD_DIGITS) + " FROM ph")
def q_patch_linear_forecast(spark, sf):
    fc, _ = patch.patch_linear_forecast(hourly_indexed(spark, sf), L_, H_, PATCH, STRIDE,
                                        HOURLY.freq, CHUNK_ROWS)
    return rounded(fc, HEAD_DIGITS)


def _causal_sql() -> str:
    back = (causal.KERNEL - 1) * max(causal.DILATIONS)
    cols = [f"value - lag(value, {d}) OVER w AS diff_{d}" for d in causal.DILATIONS]
    for d in causal.DILATIONS:
        taps = " + ".join(["value"] + [f"lag(value, {k * d}) OVER w" for k in range(1, causal.KERNEL)])
        cols.append(f"({taps}) / {float(causal.KERNEL)} - value AS smooth_{d}")
    outs = ", ".join(O.r(c) for c in ["value", *causal.filter_names()])
    return IDX_H + f""", cf AS (
  SELECT *, {', '.join(cols)}, lag(ts, {back}) OVER w AS t0
  FROM idx WINDOW w AS (PARTITION BY series_id ORDER BY time_idx))
SELECT series_id, ts, time_idx, split, {outs} FROM cf
WHERE epoch_us(ts) - epoch_us(t0) = {back * US_H}"""


@query("causal_filter_bank", _causal_sql())
def q_causal_filter_bank(spark, sf):
    return rounded(causal.causal_filter_bank(hourly_indexed(spark, sf), HOURLY.freq,
                                             chunk_rows=CHUNK_ROWS))


F_NAMES = causal.filter_names()


def _filter_features_sql() -> str:
    back = (causal.KERNEL - 1) * max(causal.DILATIONS)
    head = _causal_sql()[:_causal_sql().rindex("SELECT series_id, ts, time_idx")].rstrip()
    leads = ", ".join(f"lead(value, {h}) OVER w - value AS y_{h}" for h in range(1, H_ + 1))
    return head + f""",
ffeat AS (SELECT * FROM (
  SELECT *, {leads}, lead(ts, {H_}) OVER w AS t1, lead(split, {H_}) OVER w AS target_split
  FROM cf WINDOW w AS (PARTITION BY series_id ORDER BY time_idx))
  WHERE epoch_us(ts) - epoch_us(t0) = {back * US_H}),
ftrain AS (SELECT * FROM ffeat WHERE split = 'train' AND target_split = 'train'
           AND epoch_us(t1) - epoch_us(ts) = {H_ * US_H})"""


FILTER_FEATURES = _filter_features_sql()
FILTER_HEAD = [O.solve_ctes("ftrain", F_NAMES, Y_NAMES, "fh"),
               O.head_forecast_cte("ffeat", F_NAMES, "value", H_, US_H, "fh", "filter_linear", origin="ts")]


@query("filter_normal_equations", FILTER_FEATURES + "\n"
       + O.normal_equations_sql("ftrain", F_NAMES, Y_NAMES))
def q_filter_normal_equations(spark, sf):
    feat = causal.causal_filter_bank(hourly_indexed(spark, sf), HOURLY.freq, H_, chunk_rows=CHUNK_ROWS)
    return rounded(linear.normal_equations(train_rows(feat), F_NAMES, Y_NAMES))


@query("filter_linear_forecast", ",\n".join([FILTER_FEATURES, *FILTER_HEAD]) + "\n" + FC_OUT
       + O.r("predicted", digits=HEAD_DIGITS) + " FROM fh")
def q_filter_linear_forecast(spark, sf):
    fc, _ = causal.filter_linear_forecast(hourly_indexed(spark, sf), H_, HOURLY.freq, CHUNK_ROWS)
    return rounded(fc, HEAD_DIGITS)


def basis_fit(p):
    tr = basis.trend_fit(p, HOURLY.freq)
    return tr, basis.seasonal_fit(p, tr, HOURLY.freq, PERIOD, HARM)


BASIS = O.basis_ctes(HOURLY, PERIOD, HARM)


@query("trend_fit", O.with_(H_CHAIN, BASIS) + f"""
SELECT series_id, {O.r('slope')}, {O.r('intercept')}, n FROM tr""")
def q_trend_fit(spark, sf):
    return rounded(basis.trend_fit(prepared(spark, sf, HOURLY), HOURLY.freq))


POLY = 3
POLY_SQL = O.with_(H_CHAIN, f"""pt AS (
  SELECT series_id, value, CAST(epoch_us(ts) // {US_H} AS DOUBLE) AS t FROM prep WHERE split = 'train'),
span AS (
  SELECT series_id, (min(t) + max(t)) / 2 AS mid, greatest((max(t) - min(t)) / 2, 1.0) AS half, count(*) AS n
  FROM pt GROUP BY series_id),
pu AS (
  SELECT *, pow(u, 2.0) AS u2, pow(u, 3.0) AS u3
  FROM (SELECT p.series_id, p.value, (p.t - s.mid) / s.half AS u FROM pt p JOIN span s USING (series_id)))""",
                   O.solve_ctes("pu", ["u", "u2", "u3"], ["value"], "pw", 0.0, "series_id"))


@query("trend_poly_fit", POLY_SQL + f"""SELECT series_id, {O.r('mid')}, {O.r('half')}, """ + ", ".join(
    O.r(f"w_{i}_0", f"c_{i}", HEAD_DIGITS) for i in range(POLY + 1)) + """, n
FROM pw_w JOIN span USING (series_id)""")
def q_trend_poly_fit(spark, sf):
    """F2 with a cubic trend."""
    fit = basis.poly_trend_fit(prepared(spark, sf, HOURLY), HOURLY.freq, POLY)
    exact = rounded(fit.select("series_id", "mid", "half", "n"))
    return exact.join(rounded(fit.drop("mid", "half", "n"), HEAD_DIGITS), "series_id")


@query("seasonal_fit", O.with_(H_CHAIN, BASIS) + "SELECT series_id, " + ", ".join(
    O.r(f"{c}_{k}") for k in range(1, HARM + 1) for c in "ab") + " FROM se")
def q_seasonal_fit(spark, sf):
    return rounded(basis_fit(prepared(spark, sf, HOURLY))[1])


DEC = O.decompose_fc_cte(HOURLY, PERIOD, HARM)
FC_COLS = "model, series_id, origin_ts, step, target_ts, q"


@query("decompose_forecast", O.with_(H_CHAIN, BASIS, DEC) + f"""
SELECT {FC_COLS}, {O.r('predicted')} FROM dcfc""")
def q_decompose_forecast(spark, sf):
    p = prepared(spark, sf, HOURLY)
    tr, se = basis_fit(p)
    return rounded(basis.decompose_forecast(p, tr, se, H_, HOURLY.freq, PERIOD, HARM))


QP = O.profile_cte()


@query("quantile_profile", O.with_(H_CHAIN, QP) + f"""
SELECT series_id, hour, is_weekend, q, {O.r('value')} FROM qp""")
def q_quantile_profile(spark, sf):
    return rounded(QF.quantile_profile(prepared(spark, sf, HOURLY)))


QFC = O.quantile_fc_cte(HOURLY)


def quantile_fc(spark, sf, p=None):
    p = p if p is not None else prepared(spark, sf, HOURLY)
    return QF.quantile_forecast(p, QF.quantile_profile(p), H_, HOURLY.freq)


@query("quantile_forecast", O.with_(H_CHAIN, QP, QFC) + f"""
SELECT {FC_COLS}, {O.r('predicted')} FROM qfc""")
def q_quantile_forecast(spark, sf):
    return rounded(quantile_fc(spark, sf))


@query("quantile_pick", O.with_(H_CHAIN, QP, QFC) + f"""
SELECT {FC_COLS}, {O.r('predicted')} FROM qfc WHERE q = 0.5""")
def q_quantile_pick(spark, sf):
    return rounded(QF.pick_quantile(quantile_fc(spark, sf), 0.5))


@query("pinball_loss", O.with_(H_CHAIN, QP, QFC, O.aligned_cte("qfc")) + f"""
SELECT model, q, {O.r('avg(greatest(q * (actual - predicted), (q - 1) * (actual - predicted)))', 'pinball')},
       count(*) AS n
FROM aligned WHERE actual IS NOT NULL AND NOT isnan(actual) GROUP BY model, q""")
def q_pinball_loss(spark, sf):
    p = prepared(spark, sf, HOURLY)
    return rounded(EV.pinball_loss(EV.align(quantile_fc(spark, sf, p), p)))


@query("gaussian_nll", O.with_(H_CHAIN, O.ar_params_cte(HOURLY),
                               O.ar_forecast_cte(HOURLY, "eval", "fc"), O.aligned_cte("fc")) + f"""
SELECT model, {O.r('avg(0.9189385332046727 + ln(sd) + (actual - predicted) * (actual - predicted) / (2.0 * sd * sd))', 'nll')},
       count(*) AS n
FROM aligned WHERE actual IS NOT NULL AND NOT isnan(actual) AND sd > 0 GROUP BY model""")
def q_gaussian_nll(spark, sf):
    p, fc = ar_rolling(spark, sf)
    return rounded(EV.gaussian_nll(EV.align(fc, p)))


VAL_START = "2024-01-21 00:00:00"


def _select_sql() -> str:
    where = f"split = 'train' AND ts < TIMESTAMP '{VAL_START}'"
    t = f"CAST(epoch_us(v.ts) // {US_H} AS BIGINT)"
    cands = ", ".join(f"pow(v.value - {O.decompose_expr(t, PERIOD, k)}, 2) AS se_{k}"
                      for k in range(0, 4))
    return O.with_(H_CHAIN, O.basis_ctes(HOURLY, PERIOD, 3, where)) + f""", val AS (
  SELECT v.series_id, {cands}
  FROM prep v JOIN tr USING (series_id) JOIN se USING (series_id)
  WHERE v.split = 'train' AND v.ts >= TIMESTAMP '{VAL_START}'),
scores AS (
  SELECT series_id, k AS harmonics, avg(se) AS mse FROM (
    {' UNION ALL '.join(f'SELECT series_id, {k} AS k, se_{k} AS se FROM val' for k in range(4))})
  GROUP BY series_id, k)
SELECT series_id, CAST(arg_min(harmonics, mse) AS INTEGER) AS best_harmonics, {O.r('min(mse)', 'best_mse')}
FROM scores GROUP BY series_id"""


@query("select_best", _select_sql())
def q_select_best(spark, sf):
    return rounded(SEL.select_best(prepared(spark, sf, HOURLY), HOURLY.freq, PERIOD, VAL_START))


@query("score_windows", WIN_SQL + f"""
SELECT 'user' AS model, series_id, origin_ts, CAST(step AS INTEGER) AS step,
       origin_ts + to_microseconds(step * {US_H}) AS target_ts, CAST(NULL AS DOUBLE) AS q,
       {O.r('m', 'predicted')}
FROM (SELECT series_id, origin_ts, list_avg(x) AS m, unnest(range(1, {H_} + 1)) AS step FROM wins)""")
def q_score_windows(spark, sf):
    return rounded(score.score_windows(windows_df(spark, sf), H_, HOURLY.freq))


# --------------------------------------------------------------- evaluation

AR_EVAL = O.ar_params_cte(HOURLY) + ",\n" + O.ar_forecast_cte(HOURLY, "eval", "fc")
MODELS_SQL = O.with_(H_CHAIN, AR_EVAL, BASIS, DEC, QP, QFC, f"""allfc AS (
  SELECT {FC_COLS}, predicted FROM fc
  UNION ALL SELECT {FC_COLS}, predicted FROM dcfc
  UNION ALL SELECT {FC_COLS}, predicted FROM qfc WHERE q = 0.5)""", O.aligned_cte("allfc"))
VALID = "actual IS NOT NULL AND NOT isnan(actual) AND predicted IS NOT NULL AND NOT isnan(predicted)"


def model_forecasts(p):
    """Point forecasts of the SQL-checkable forecasters from every eval origin:
    AR(1), trend + seasonality, and the median of the quantile profile."""
    ar = autoreg.ar_forecast(p, autoreg.ar_fit(p, HOURLY.freq, HOURLY.chunk_buckets), H_,
                             HOURLY.freq, "eval")
    tr, se = basis_fit(p)
    dc = basis.decompose_forecast(p, tr, se, H_, HOURLY.freq, PERIOD, HARM)
    qm = QF.pick_quantile(QF.quantile_forecast(p, QF.quantile_profile(p), H_, HOURLY.freq), 0.5)
    return ar.select(*FORECAST_COLS).unionByName(dc).unionByName(qm)


def aligned_models(spark, sf):
    p = prepared(spark, sf, HOURLY, materialize=True)
    return EV.align(model_forecasts(p), p)


@query("metrics_by_model", MODELS_SQL + O.metric_select("model, series_id"))
def q_metrics_by_model(spark, sf):
    """Flagship: AR(1), trend + seasonality and the quantile-profile median
    from every eval origin, aligned with the actuals, scored per sensor."""
    return rounded(EV.metrics(aligned_models(spark, sf), ("model", "series_id")))


@query("align_forecast", O.with_(H_CHAIN, AR_EVAL, O.aligned_cte("fc")) + f"""
SELECT model, series_id, origin_ts, step, target_ts, {O.r('predicted')}, {O.r('actual')} FROM aligned""")
def q_align_forecast(spark, sf):
    p, fc = ar_rolling(spark, sf)
    return rounded(EV.align(fc, p).select("model", "series_id", "origin_ts", "step", "target_ts",
                                          "predicted", "actual"))


@query("valid_pairs", O.with_(H_CHAIN, AR_EVAL, O.aligned_cte("fc")) + f"""
SELECT model, series_id, origin_ts, step, target_ts, {O.r('predicted')}, {O.r('actual')}
FROM aligned WHERE {VALID}""")
def q_valid_pairs(spark, sf):
    p, fc = ar_rolling(spark, sf)
    return rounded(EV.valid_pairs(EV.align(fc, p)).select(
        "model", "series_id", "origin_ts", "step", "target_ts", "predicted", "actual"))


@query("sample_pairs", MODELS_SQL + f"""
SELECT model, series_id, origin_ts, step, target_ts, {O.r('actual')}, {O.r('predicted')},
       {O.r('abs(actual - predicted)', 'abs_error')}, row_no
FROM (SELECT *, row_number() OVER (PARTITION BY model, series_id ORDER BY target_ts, origin_ts) AS row_no
      FROM aligned WHERE {VALID}) WHERE row_no <= 10""")
def q_sample_pairs(spark, sf):
    s = WN.sample_pairs(aligned_models(spark, sf), 10, HOURLY.freq, chunk_buckets=HOURLY.chunk_buckets)
    return rounded(s.select("model", "series_id", "origin_ts", "step", "target_ts", "actual",
                            "predicted", "abs_error", F.col("row_no").cast("long")))


@query("unscale", O.with_(H_CHAIN, AR_EVAL, O.aligned_cte("fc")) + f"""
SELECT series_id, origin_ts, step, {O.r('actual')}, {O.r('predicted')} FROM aligned""")
def q_unscale(spark, sf):
    p, fc = ar_rolling(spark, sf)
    params = SC.fit_scaler(p)
    a = spread_join(EV.align(fc, p), params, ["series_id"], by="target_ts")
    scaled = a.select("series_id", "origin_ts", "step",
                      ((F.col("actual") - F.col("mean")) / F.col("std")).alias("actual"),
                      ((F.col("predicted") - F.col("mean")) / F.col("std")).alias("predicted"),
                      F.lit(True).alias("scaled"))
    once = SC.unscale(scaled, params)
    twice = SC.unscale(once, params)  # guarded: a second inverse changes nothing
    return rounded(twice.select("series_id", "origin_ts", "step", "actual", "predicted"))


GLOBAL_METRICS = O.metric_select("model")


@query("variance_check", MODELS_SQL + f"""
SELECT model, {O.r('var_pop(actual)', 'var_actual')}, {O.r('var_pop(predicted)', 'var_predicted')},
       {O.r('corr(actual, predicted)', 'corr')}
FROM aligned WHERE {VALID} GROUP BY model""")
def q_variance_check(spark, sf):
    return rounded(EV.variance_check(aligned_models(spark, sf)))


# Metric labels of the reference's Metric/Value table.
_LABELS = [("mae", "MAE"), ("mse", "MSE"), ("rmse", "RMSE"), ("smape", "SMAPE (%)"),
           ("r2", "R-Squared")]


@query("metrics_long", MODELS_SQL + ", m AS (" + GLOBAL_METRICS + ")\n" + " UNION ALL ".join(
    f"SELECT model, '{lab}' AS metric, {k} AS value FROM m" for k, lab in _LABELS))
def q_metrics_long(spark, sf):
    return EV.metrics_long(rounded(EV.metrics(aligned_models(spark, sf))))


@query("leaderboard", MODELS_SQL + ", m AS (" + GLOBAL_METRICS + "),\nl AS ("
       + " UNION ALL ".join(f"SELECT model, '{k}' AS metric, {k} AS value FROM m"
                            for k in EV.METRICS) + """)
SELECT model, metric, value,
       CAST(rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'r2' THEN -value ELSE value END
                         ASC NULLS LAST) AS INTEGER) AS rank,
       rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'r2' THEN -value ELSE value END
                    ASC NULLS LAST) = 1 AS is_best
FROM l""")
def q_leaderboard(spark, sf):
    return EV.leaderboard(rounded(EV.metrics(aligned_models(spark, sf)))).drop("n")


@query("forecast_stats", MODELS_SQL + "SELECT model, " + ", ".join(
    O.r(f"{f}({c})", f"{c}_{n}") for c in ("actual", "predicted")
    for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_pop", "std")))
    + f" FROM aligned WHERE {VALID} GROUP BY model")
def q_forecast_stats(spark, sf):
    return rounded(EV.forecast_stats(aligned_models(spark, sf)))


def _ctes_after(chain: str, text: str) -> str:
    """The CTE list of ``text`` without the ``chain`` it begins with."""
    assert text.startswith(chain.rstrip()), "another chain"
    return text[len(chain.rstrip()):].lstrip(", \n")


ALL_MODELS_SQL = ",\n".join([
    O.with_(H_CHAIN, O.indexed_cte(), AR_EVAL, BASIS, DEC, QP, QFC).rstrip(),
    _ctes_after(IDX_H, PATCH_FEATURES), *PATCH_HEAD, _ctes_after(IDX_H, FILTER_FEATURES), *FILTER_HEAD,
    f"""allfc AS (
  SELECT {FC_COLS}, predicted FROM fc
  UNION ALL SELECT {FC_COLS}, predicted FROM dcfc
  UNION ALL SELECT {FC_COLS}, predicted FROM qfc WHERE q = 0.5
  UNION ALL SELECT {FC_COLS}, predicted FROM ph
  UNION ALL SELECT {FC_COLS}, predicted FROM fh)""", O.aligned_cte("allfc")]) + "\n"


@query("metrics_all_models", ALL_MODELS_SQL + GLOBAL_METRICS)
def q_metrics_all_models(spark, sf):
    """All five forecasters from every eval origin, the linear heads included."""
    p = prepared(spark, sf, HOURLY, materialize=True)
    return rounded(EV.metrics(EV.align(J.forecast(p, HOURLY, chunk_rows=CHUNK_ROWS), p)))


@query("forecast_from_saved", SQL["metrics_all_models"])
def q_forecast_from_saved(spark, sf):
    """A10: the five models' tables are saved, loaded and applied: the refit's scores."""
    p = prepared(spark, sf, HOURLY, materialize=True)
    path = scratch_path(spark, "models")
    J.save_models(J.fit_models(p, HOURLY, chunk_rows=CHUNK_ROWS), path)
    fc = J.predict(p, J.load_models(spark, path), HOURLY, chunk_rows=CHUNK_ROWS)
    return rounded(EV.metrics(EV.align(fc, p)))


def _modes_sql() -> str:
    """AR(1) from the windows of each mode, by row index."""
    where = {"all": f"time_idx >= cut AND time_idx <= fin - {H_}",
             "no_warmup": f"time_idx >= cut + {L_} AND time_idx <= fin - {H_}",
             "last_eval": f"time_idx = fin - {H_} AND time_idx >= cut"}
    steps = " UNION ALL ".join(
        f"SELECT '{m}' AS mode, series_id, ts, value FROM bounded WHERE {w}" for m, w in where.items())
    return O.with_(H_CHAIN, O.indexed_cte(), O.ar_params_cte(HOURLY), f"""bounded AS (
  SELECT i.*, b.cut, b.fin FROM idx i JOIN (
    SELECT series_id, max(time_idx) FILTER (WHERE split = 'train') AS cut,
           max(time_idx) FILTER (WHERE split = 'eval') AS fin FROM idx GROUP BY series_id) b USING (series_id)),
origins AS ({steps}),
mfc AS (
  SELECT o.mode, o.series_id, o.ts + to_microseconds(step * {US_H}) AS target_ts,
         pow(phi, step) * o.value + c * CASE WHEN phi = 1 THEN CAST(step AS DOUBLE)
           ELSE (1.0 - pow(phi, step)) / (1.0 - phi) END AS predicted
  FROM (SELECT *, unnest(range(1, {H_} + 1)) AS step FROM origins) o JOIN arp a USING (series_id)),
aligned AS (SELECT f.*, p.value AS actual FROM mfc f
            LEFT JOIN prep p ON p.series_id = f.series_id AND p.ts = f.target_ts)""") \
        + O.metric_select("mode")


@query("metrics_by_window_mode", _modes_sql())
def q_metrics_by_window_mode(spark, sf):
    """The reference's evaluation windows: all (warm-up before the range), none
    without a context inside it, and the one last window."""
    p = prepared(spark, sf, HOURLY, materialize=True)
    params = autoreg.ar_fit(p, HOURLY.freq, HOURLY.chunk_buckets)
    parts = [EV.align(autoreg.ar_forecast(p, params, H_, HOURLY.freq, m, context=L_,
                                          chunk_buckets=HOURLY.chunk_buckets), p)
             .withColumn("mode", F.lit(m)) for m in ("all", "no_warmup", "last_eval")]
    return rounded(EV.metrics(WN.combine(*parts), ("mode",)))


@query("residual_correction", O.with_(H_CHAIN, AR_EVAL, O.split_cte(
    HOURLY.with_(train_end="2024-01-20 23:59:59", eval_start=VAL_START, eval_end=HOURLY.train_end)
).replace("prep AS", "prepv AS"), O.renamed(
    O.ar_params_cte(HOURLY) + ",\n" + O.ar_forecast_cte(HOURLY, "eval", "fc"),
    ["prep", "pv_l", "pv", "arp", "fc_o", "fc_s", "fc"], "v"),
    O.renamed(O.aligned_cte("fc"), ["prep", "fc", "aligned"], "v"), f"""bias AS (
  SELECT series_id, step, avg(actual - predicted) AS bias FROM alignedv WHERE {VALID} GROUP BY ALL)""")
    + f"""SELECT 'corrected' AS model, f.series_id, origin_ts, f.step, target_ts, q,
       {O.r('predicted + coalesce(bias, 0.0)', 'predicted')}, 'ar1' AS base_model
FROM fc f LEFT JOIN bias b ON b.series_id = f.series_id AND b.step = f.step""")
def q_residual_correction(spark, sf):
    """AR(1) plus its mean residual per series and step on the end of train."""
    def ar(p):
        return autoreg.ar_forecast(p, autoreg.ar_fit(p, HOURLY.freq, HOURLY.chunk_buckets), H_,
                                   HOURLY.freq, "eval").select(*FORECAST_COLS)
    reg = regular(spark, sf, HOURLY, materialize=True)
    pv = P.split(reg, VAL_CFG)
    return rounded(MO.residual_correction(ar(P.split(reg, HOURLY)), EV.align(ar(pv), pv)))


# ------------------------------------------------------- extensions X1-X7
@query("interval_coverage", O.with_(H_CHAIN, QP, QFC, O.aligned_cte("qfc")) + f"""
SELECT lo.model, {O.r('avg(CAST(lo.actual >= lo.predicted AND lo.actual <= hi.predicted AS DOUBLE))', 'coverage')},
       count(*) AS n
FROM aligned lo JOIN aligned hi ON lo.model = hi.model AND lo.series_id = hi.series_id
 AND lo.origin_ts = hi.origin_ts AND lo.step = hi.step AND hi.q = 0.9
WHERE lo.q = 0.1 AND lo.actual IS NOT NULL AND NOT isnan(lo.actual) GROUP BY lo.model""")
def q_interval_coverage(spark, sf):
    p = prepared(spark, sf, HOURLY)
    return rounded(MO.interval_coverage(EV.align(quantile_fc(spark, sf, p), p)))


@query("early_warning", O.with_(H_CHAIN, O.ar_params_cte(HOURLY), O.ar_forecast_cte(HOURLY, "last"),
                                O.params_cte()) + f"""
SELECT f.series_id, f.target_ts, f.step, {O.r('f.predicted', 'predicted')},
       {O.r('s.mean + 2.0 * s.std', 'limit')},
       {O.r("CASE WHEN f.sd > 0 THEN 1.0 / (1.0 + exp(-1.702 * ((f.predicted - (s.mean + 2.0 * s.std)) / f.sd))) WHEN f.predicted > s.mean + 2.0 * s.std THEN 1.0 ELSE 0.0 END", 'prob_breach')}
FROM arfc f JOIN params s USING (series_id)""")
def q_early_warning(spark, sf):
    p = prepared(spark, sf, HOURLY)
    fc = autoreg.ar_forecast(p, autoreg.ar_fit(p, HOURLY.freq, HOURLY.chunk_buckets), H_,
                             HOURLY.freq, "last")
    limits = SC.fit_scaler(p).select("series_id", (F.col("mean") + F.lit(2.0) * F.col("std"))
                                     .alias("limit"))
    return rounded(MO.breach_probability(fc, limits).select(
        "series_id", "target_ts", "step", "predicted", "limit", "prob_breach"))


@query("anomaly_flags", O.with_(H_CHAIN, BASIS) + f""", ex AS (
  SELECT p.series_id, p.ts, p.value, p.split,
         {O.decompose_expr(f'CAST(epoch_us(p.ts) // {US_H} AS BIGINT)', PERIOD, HARM)} AS expected
  FROM prep p JOIN tr USING (series_id) JOIN se USING (series_id)),
st AS (SELECT series_id, avg(value - expected) AS rm, stddev_pop(value - expected) AS rs
       FROM ex WHERE split = 'train' GROUP BY series_id)
SELECT series_id, ts, {O.r('value')}, {O.r('expected')}, {O.r('value - expected', 'resid')},
       {O.r('CASE WHEN rs > 0 THEN ((value - expected) - rm) / rs END', 'z')},
       CASE WHEN rs > 0 THEN abs(((value - expected) - rm) / rs) END > 3.0 AS is_anomaly
FROM ex JOIN st USING (series_id)""")
def q_anomaly_flags(spark, sf):
    p = prepared(spark, sf, HOURLY)
    tr, se = basis_fit(p)
    from ..functions.timefn import bucket_index
    x = spread_join(p, tr.join(se, "series_id"), ["series_id"]).withColumn(
        "expected", basis.decompose_value(bucket_index("ts", HOURLY.freq), HARM, PERIOD))
    return rounded(MO.flag_anomalies(x).select(
        "series_id", "ts", "value", "expected", "resid", "z", "is_anomaly"))


VAL_CFG = HOURLY.with_(train_end="2024-01-20 23:59:59", eval_start=VAL_START,
                       eval_end=HOURLY.train_end)


def _ensemble_sql() -> str:
    v_split = O.split_cte(VAL_CFG).replace("prep AS", "prepv AS")
    v_ar = O.renamed(O.ar_params_cte(HOURLY) + ",\n" + O.ar_forecast_cte(HOURLY, "eval", "fc"),
                     ["prep", "pv_l", "pv", "arp", "fc_o", "fc_s", "fc"], "v")
    v_basis = O.renamed(O.basis_ctes(HOURLY, PERIOD, HARM) + ",\n" + O.decompose_fc_cte(
        HOURLY, PERIOD, HARM), ["prep", "tr", "se", "dcfc_s", "dcfc"], "v")
    v_al = O.renamed(O.aligned_cte("allfc"), ["prep", "allfc", "aligned"], "v")
    return O.with_(H_CHAIN, AR_EVAL, BASIS, DEC, v_split, v_ar, v_basis, f"""allfcv AS (
  SELECT {FC_COLS}, predicted FROM fcv UNION ALL SELECT {FC_COLS}, predicted FROM dcfcv)""", v_al,
                   f"""vm AS (
  SELECT series_id, model, 1.0 / greatest(sqrt(avg((actual - predicted) * (actual - predicted))), 1e-12) AS inv
  FROM alignedv WHERE {VALID} GROUP BY series_id, model),
wt AS (SELECT series_id, model, inv / sum(inv) OVER (PARTITION BY series_id) AS weight FROM vm),
duo AS (SELECT {FC_COLS}, predicted FROM fc UNION ALL SELECT {FC_COLS}, predicted FROM dcfc)""") + f"""
SELECT 'ensemble' AS model, series_id, origin_ts, CAST(step AS INTEGER) AS step, target_ts,
       CAST(NULL AS DOUBLE) AS q, {O.r('sum(weight * predicted) / sum(weight)', 'predicted')}
FROM duo JOIN wt USING (series_id, model) GROUP BY series_id, origin_ts, step, target_ts"""


@query("ensemble_forecast", _ensemble_sql())
def q_ensemble_forecast(spark, sf):
    def two_models(p):
        ar = autoreg.ar_forecast(p, autoreg.ar_fit(p, HOURLY.freq, HOURLY.chunk_buckets), H_,
                                 HOURLY.freq, "eval").select(*FORECAST_COLS)
        tr, se = basis_fit(p)
        return ar.unionByName(basis.decompose_forecast(p, tr, se, H_, HOURLY.freq, PERIOD, HARM))
    reg = regular(spark, sf, HOURLY, materialize=True)
    pv = P.split(reg, VAL_CFG)   # validation run: eval = the last days of train
    weights = MO.inverse_rmse_weights(EV.metrics(EV.align(two_models(pv), pv),
                                                 ("series_id", "model")))
    p = P.split(reg, HOURLY)
    return rounded(MO.ensemble(two_models(p), weights))


# The five event types of the driver's events table (the sensors).
SENSORS = ["click", "error", "purchase", "signup", "view"]
WIDE_SQL = O.with_(CHAIN, "wide AS (SELECT ts, " + ", ".join(
    f"first(value) FILTER (WHERE series_id = '{s}') AS \"{s}\"" for s in SENSORS)
    + " FROM prep GROUP BY ts)")


@query("multivariate_wide", WIDE_SQL + "SELECT ts, " + ", ".join(O.r(f'"{s}"', f'"{s}"')
                                                             for s in SENSORS) + " FROM wide")
def q_multivariate_wide(spark, sf):
    return rounded(MO.to_wide(prepared(spark, sf), SENSORS))


@query("cross_correlation", WIDE_SQL + " UNION ALL ".join(
    f"""SELECT '{a}' AS series_a, '{b}' AS series_b, {O.r(f'corr("{a}", "{b}")', 'corr')},
       count(*) FILTER (WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL) AS n FROM wide"""
    for i, a in enumerate(SENSORS) for b in SENSORS[i + 1:]))
def q_cross_correlation(spark, sf):
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(SENSORS) for b in SENSORS[i + 1:]],
                                  "series_a string, series_b string")
    return rounded(MO.cross_correlation(prepared(spark, sf), pairs))


@query("spike_flags", O.with_(CHAIN, O.prev_cte(CFG)) + f""", d AS (
  SELECT *, value - prev_value AS diff FROM pv WHERE prev_value IS NOT NULL),
sd AS (SELECT series_id, stddev_pop(diff) AS s FROM d WHERE split = 'train' GROUP BY series_id)
SELECT series_id, ts, {O.r('value')}, {O.r('diff')}, {O.r('4.0 * s', 'threshold')}
FROM d JOIN sd USING (series_id) WHERE abs(diff) > 4.0 * s""")
def q_spike_flags(spark, sf):
    x = with_prev(prepared(spark, sf), CFG.freq, CFG.chunk_buckets)
    return rounded(MO.flag_spikes(x, 4.0).select("series_id", "ts", "value", "diff", "threshold"))


@query("kpi_rollup", O.with_(CHAIN) + f"""
SELECT series_id, time_bucket(INTERVAL '1 day', ts) AS day,
       CASE WHEN grouping(time_bucket(INTERVAL '1 hour', ts)) = 0 THEN time_bucket(INTERVAL '1 hour', ts) END AS hour,
       {O.r('min(value)', 'min_value')}, {O.r('avg(value)', 'avg_value')}, {O.r('max(value)', 'max_value')},
       count(*) AS n,
       CASE WHEN grouping(time_bucket(INTERVAL '1 hour', ts)) = 1 THEN 'day' ELSE 'hour' END AS level
FROM prep
GROUP BY GROUPING SETS ((series_id, time_bucket(INTERVAL '1 day', ts)),
                        (series_id, time_bucket(INTERVAL '1 day', ts), time_bucket(INTERVAL '1 hour', ts)))""")
def q_kpi_rollup(spark, sf):
    return rounded(MO.kpi_rollup(prepared(spark, sf)))


# -------------------------------------------------------------- streaming X8


def events_stream(spark, sf):
    path = f"{sf.rstrip('/')}/events.parquet"
    ev = ST.file_stream(spark, path, RD.table(spark, sf, "events").schema)
    from ..sources.tables import _quality
    return ev.select(F.col("event_type").alias("series_id"), "ts", "value",
                     _quality().alias("quality"))


@query("stream_resample", O.with_(RAW) + """, good AS (SELECT * FROM raw WHERE quality = 'Good'),
w AS (SELECT series_id, time_bucket(INTERVAL '3600 seconds', ts) AS ts, avg(value) AS value, count(*) AS n
      FROM good GROUP BY ALL)
SELECT series_id, ts, """ + O.r("value") + """, n FROM w
WHERE ts + INTERVAL '1 hour' <= (SELECT max(ts) FROM good) - INTERVAL '10 minutes'""")
def q_stream_resample(spark, sf):
    """Good readings only, append mode: each window once, when the watermark has
    passed its end; its state is dropped then."""
    readings = IN.filter_quality(events_stream(spark, sf))
    s = ST.stream_resample(readings, "1 hour", "10 minutes")
    return rounded(ST.run_to_table(spark, s, "stream_resample", "append"))


@query("stream_alerts", O.with_(CHAIN, O.params_cte()) + f"""
SELECT r.series_id, r.ts, {O.r('r.value', 'value')}, {O.r('(r.value - s.mean) / s.std', 'z')}
FROM raw r JOIN params s USING (series_id)
WHERE r.quality = 'Good' AND abs((r.value - s.mean) / s.std) > 3.0""")
def q_stream_alerts(spark, sf):
    params_path = WR.save_params(SC.fit_scaler(prepared(spark, sf)), scratch_path(spark, "scaler"))
    params = RD.load_params(spark, params_path)
    readings = events_stream(spark, sf).where(F.col("quality") == "Good")
    s = ST.stream_alerts(readings, params, 3.0)
    return rounded(ST.run_to_table(spark, s, "stream_alerts", "append"))


# ------------------------------------------------ many series, other tables

MINUTE = EVENTS.with_(freq="1 minute", fill_limit=30, chunk_buckets=1440, shuffle_raw_once=True)


@query("prepare_minutely", O.with_(O.prep_chain(MINUTE), O.params_cte(), """scaled AS (
  SELECT p.*, (p.value - s.mean) / s.std AS value_scaled FROM prep p JOIN params s USING (series_id))""")
       + "SELECT series_id, segment_id, ts, " + O.r("value") + ", filled, split, "
       + O.r("value_scaled") + " FROM scaled")
def q_prepare_minutely(spark, sf):
    """The whole preparation at 1-minute buckets, limit 30 (reference defaults)."""
    out, _ = P.prepare(sensor_raw(spark, sf), MINUTE)
    return rounded(out)


USERS = EVENTS.with_(freq="1 day", fill_limit=3, horizon=3, chunk_buckets=8)


@query("metrics_many_series", O.with_(O.prep_chain(USERS, key="user_id"), O.ar_params_cte(USERS),
                                      O.ar_forecast_cte(USERS, "eval", "fc"), O.aligned_cte("fc"))
       + O.metric_select("model, series_id"))
def q_metrics_many_series(spark, sf):
    """One daily sensor per user (150 at sf0.01, 1,500 at sf0.1): AR(1) per
    series from every eval origin, scored per series."""
    p = prepared(spark, sf, USERS, key="user_id")
    fc = autoreg.ar_forecast(p, autoreg.ar_fit(p, USERS.freq, USERS.chunk_buckets), USERS.horizon,
                             USERS.freq, "eval")
    return rounded(EV.metrics(EV.align(fc, p), ("model", "series_id")))


SUPPLIERS = PipelineConfig(freq="7 days", fill_limit=2, train_end="1997-12-31 23:59:59",
                           eval_start="1998-01-01 00:00:00", eval_end="1998-12-31 23:59:59",
                           context=8, horizon=4, chunk_buckets=26)


@query("supplier_weekly_metrics", O.with_(O.prep_chain(SUPPLIERS, key="supplier"),
                                          O.ar_params_cte(SUPPLIERS),
                                          O.ar_forecast_cte(SUPPLIERS, "eval", "fc"),
                                          O.aligned_cte("fc")) + O.metric_select("model"))
def q_supplier_weekly_metrics(spark, sf):
    """lineitem as one weekly sales series per supplier; AR(1) per supplier,
    scored over all suppliers."""
    raw = daily_supplier_sales(spark, sf)
    p = P.split(P.regularise(P.clean(raw, SUPPLIERS), SUPPLIERS), SUPPLIERS)
    fc = autoreg.ar_forecast(p, autoreg.ar_fit(p, SUPPLIERS.freq, SUPPLIERS.chunk_buckets),
                             SUPPLIERS.horizon, SUPPLIERS.freq, "eval")
    return rounded(EV.metrics(EV.align(fc, p)))



# ----------------------------------------------- reference variants, metrics sink
from .variants import on_events, variant_counts  # noqa: E402
from ..config import PRESETS  # noqa: E402


def _variant_sql() -> str:
    ctes, sels = [O.raw_cte()], []
    # "filled" is also a column name: rename only its CTE definition and uses
    names = ["good", "clean", "buckets", "nx", "gp", "gk", "prep", "cs_l", "cs"]
    for n in PRESETS:
        cfg = on_events(n)
        chain = [O.clean_cte(cfg), O.buckets_cte(cfg), O.filled_cte(cfg)]
        src = "filled"
        if cfg.continuity_split:
            chain.append(cont_cte("filled", freq_micros(cfg.max_gap)))
            chain.append(f"""long AS (SELECT * FROM cs WHERE (series_id, segment_id) IN (
  SELECT series_id, segment_id FROM cs GROUP BY ALL HAVING count(*) >= {cfg.min_segment_rows}))""")
            src = "long"
        chain.append(O.split_cte(cfg, src))
        if not cfg.filter_quality:
            chain[0] = chain[0].replace("WHERE quality = 'Good' AND", "WHERE")
        text = O.renamed(",\n".join(chain), names + ["long"], "_" + n)
        text = text.replace("filled AS (", f"filled_{n} AS (").replace("FROM filled", f"FROM filled_{n}")
        ctes.append(text)
        sels.append(f"""SELECT '{n}' AS variant, count(*) AS n_rows, count_if(filled) AS n_filled,
       count_if(split = 'train') AS n_train, count_if(split = 'eval') AS n_eval FROM prep_{n}""")
    body = " UNION ALL ".join(sels)
    return O.with_(*ctes) + f"""SELECT variant, CAST(n_rows AS BIGINT) AS n_rows,
  CAST(n_filled AS BIGINT) AS n_filled, CAST(n_train AS BIGINT) AS n_train,
  CAST(n_eval AS BIGINT) AS n_eval FROM ({body})"""


@query("variant_counts", _variant_sql())
def q_variant_counts(spark, sf):
    """The five reference variants (V1-V10 flags) on the events sensors."""
    return variant_counts(sensor_raw(spark, sf))


@query("metrics_table", MODELS_SQL + ", m AS (" + GLOBAL_METRICS + ")\n" + " UNION ALL ".join(
    f"SELECT model, '{lab}' AS metric, {k} AS value FROM m" for k, lab in _LABELS))
def q_metrics_table(spark, sf):
    """The Metric/Value rows appended to a metrics table partitioned by
    model, read back."""
    m = EV.metrics_long(rounded(EV.metrics(aligned_models(spark, sf))))
    path = WR.write_metrics(m, scratch_path(spark, "metrics"))
    return spark.read.parquet(path).select("model", "metric", "value")



PRIORITY = PipelineConfig(freq="1 day", fill_limit=3, train_end="1997-12-31 23:59:59",
                          eval_start="1998-01-01 00:00:00", eval_end="1998-12-31 23:59:59",
                          context=28, horizon=7, chunk_buckets=64,
                          shuffle_raw_once=False)  # many orders per day: combine first
P_PERIOD, P_HARM = 7, 2


@query("priority_daily_forecast", O.with_(
    O.prep_chain(PRIORITY, key="orders"), O.basis_ctes(PRIORITY, P_PERIOD, P_HARM),
    O.decompose_fc_cte(PRIORITY, P_PERIOD, P_HARM), O.aligned_cte("dcfc"))
    + O.metric_select("model, series_id"))
def q_priority_daily_forecast(spark, sf):
    """orders as one daily order-value series per priority; trend + weekly
    seasonality fitted on 1992-1997, scored on every 1998 origin, 7 days ahead."""
    raw = daily_priority_orders(spark, sf)
    p = P.split(P.regularise(P.clean(raw, PRIORITY), PRIORITY), PRIORITY)
    tr = basis.trend_fit(p, PRIORITY.freq)
    se = basis.seasonal_fit(p, tr, PRIORITY.freq, P_PERIOD, P_HARM)
    fc = basis.decompose_forecast(p, tr, se, PRIORITY.horizon, PRIORITY.freq, P_PERIOD, P_HARM)
    return rounded(EV.metrics(EV.align(fc, p), ("model", "series_id")))


# --------------------------------------------------- more operator variants
@query("fill_gaps_short_only", O.with_(BUCKET_CHAIN, O.filled_cte(CFG).replace(
    "least(gap, 3)", "CASE WHEN gap <= 3 THEN gap ELSE 0 END")) + "SELECT series_id, segment_id, ts, "
    + O.r("value") + ", filled FROM filled")
def q_fill_gaps_short_only(spark, sf):
    """W1 with fill_long_gaps=False: gaps longer than the limit stay untouched."""
    b = resample_mean(clean_df(spark, sf), CFG.freq)
    return rounded(fill_gaps(b, CFG.freq, CFG.fill_limit, chunk_buckets=CFG.chunk_buckets,
                             fill_long_gaps=False))


def worst_days(raw):
    """Per sensor, the day with the most Bad readings (ties: the earliest) as
    a closed invalid period - per-series intervals derived from the data."""
    from ..functions.timefn import bucket_start, to_micros
    bad = (raw.where(F.col("quality") != "Good")
           .groupBy("series_id", bucket_start("ts", "1 day").alias("day"))
           .agg(F.count(F.lit(1)).alias("n")))
    best = bad.groupBy("series_id").agg(
        F.max(F.struct("n", (-to_micros("day")).alias("k"), "day"))
        .alias("b"))
    return best.select("series_id", F.col("b.day").alias("start"),
                       F.timestamp_add("MICROSECOND", F.lit(86_400_000_000 - 1), F.col("b.day"))
                       .alias("end"))


@query("exclude_interval_per_series", O.with_(RAW) + """, bad AS (
  SELECT series_id, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01 00:00:00') AS day, count(*) AS n
  FROM raw WHERE quality <> 'Good' GROUP BY ALL),
iv AS (
  SELECT series_id, arg_max(day, (n, -epoch_us(day))) AS start FROM bad GROUP BY series_id)
SELECT r.series_id, r.ts, r.value FROM raw r
WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.series_id = r.series_id
                  AND r.ts >= iv.start AND r.ts <= iv.start + INTERVAL '86399999999 microseconds')""")
def q_exclude_interval_per_series(spark, sf):
    raw = sensor_raw(spark, sf)
    return CL.exclude_interval(raw.select("series_id", "ts", "value"), worst_days(raw))


@query("segment_lengths_strict", O.with_(FILL_CHAIN, cont_cte("filled", 900_000_000)) + """
SELECT series_id, segment_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts
FROM cs GROUP BY series_id, segment_id""")
def q_segment_lengths_strict(spark, sf):
    """D8, the fine view (the reference's 5-minute view on 1-minute data):
    any missing bucket - a gap above one 15-minute step - starts a segment."""
    reg = P.regularise(clean_df(spark, sf), CFG)
    s = SG.continuous_segments(reg, CFG.freq, CFG.freq, chunk_buckets=CFG.chunk_buckets)
    return SG.segment_lengths(s)


# A sketch's value may differ by engine, its rank error may not exceed n / accuracy.
@query("quantile_profile_approx", O.with_(H_CHAIN) + """SELECT series_id, hour, is_weekend,
  unnest([CAST(0.1 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS q, n, true AS within_bound
FROM (SELECT series_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 >= 5 AS INTEGER) AS is_weekend,
             count(*) AS n FROM prep WHERE split = 'train' GROUP BY ALL)""")
def q_quantile_profile_approx(spark, sf):
    """F5 with the bounded-memory sketch (``percentile_approx``): per slot and
    level, whether the value's rank is within n / accuracy (+ 1) of the exact one."""
    from ..functions.timefn import calendar_columns
    p = prepared(spark, sf, HOURLY)
    cal = calendar_columns("ts")
    train = p.where(F.col("split") == "train").select(
        "series_id", cal["hour"].alias("hour"), cal["is_weekend"].alias("is_weekend"),
        F.col("value").alias("v"))
    sketch = QF.quantile_profile(p, method="approx")
    x = spread_join(train, sketch, ["series_id", "hour", "is_weekend"])
    counts = x.groupBy("series_id", "hour", "is_weekend", "q").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("value")).alias("below"),
        F.count_if(F.col("v") <= F.col("value")).alias("upto"))
    slack = F.col("n") / F.lit(10000.0) + F.lit(1.0)
    return counts.select("series_id", "hour", "is_weekend", "q", "n",
                         ((F.col("below") <= F.col("q") * F.col("n") + slack)
                          & (F.col("upto") >= F.col("q") * F.col("n") - slack)).alias("within_bound"))


@query("loss_table", MODELS_SQL + f"""
SELECT model, {O.r('avg((actual - predicted) * (actual - predicted))', 'mse')},
       {O.r('sqrt(avg((actual - predicted) * (actual - predicted)))', 'rmse')}
FROM aligned WHERE {VALID} GROUP BY model""")
def q_loss_table(spark, sf):
    """the MSE / RMSE loss view of every checkable forecaster."""
    return rounded(EV.loss_table(aligned_models(spark, sf)))


from . import catalog_models  # noqa: E402,F401  (registers the model and monitoring queries)
