"""The preparation job: raw readings -> regular, split, scaled series.

Stage order (one pass, lazily planned by Catalyst):
quality filter -> parse -> drop missing -> remove invalid periods -> A/B label
-> resample (partial + final hash aggregate) -> gap fill (chunked lead) ->
optional continuity split -> train/eval split -> scaler fit on train -> scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators.clean import exclude_interval, label_segment
from ..operators.ingest import clean_readings, drop_missing, filter_quality
from ..operators.resample import fill_gaps, resample_mean
from ..operators.scaling import fit_scaler, scale
from ..operators.segments import continuous_segments, dense_time_index, keep_long_segments
from ..operators.split import time_split
from ..sources.writers import materialize as write_materialized


def clean(raw: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Readings (typed ``ts``/``value`` or raw text ``ts_raw``/``value_raw``)
    -> (series_id, segment_id, ts, value) outside the invalid periods."""
    if "ts_raw" in raw.columns:
        df = clean_readings(raw, cfg.ok_quality, cfg.filter_quality, cfg.strict_ts)
    else:
        df = filter_quality(raw, cfg.ok_quality) if cfg.filter_quality else raw
        df = drop_missing(df.select("series_id", "ts", "value"), ["series_id", "ts", "value"])
    df = exclude_interval(df, cfg.invalid_intervals)
    if cfg.per_segment:
        return label_segment(df, cfg.invalid_intervals)
    return df.withColumn("segment_id", F.lit(0))


def regularise(clean_df: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Resample and fill: (series_id, segment_id, ts, value, filled)."""
    buckets = resample_mean(clean_df, cfg.freq, ("series_id", "segment_id"),
                            chunk_buckets=cfg.chunk_buckets if cfg.shuffle_raw_once else None)
    out = fill_gaps(buckets, cfg.freq, cfg.fill_limit, ("series_id",), "segment_id",
                    chunk_buckets=cfg.chunk_buckets)
    if cfg.continuity_split:
        out = continuous_segments(out, cfg.max_gap, cfg.freq, ("series_id",),
                                  chunk_buckets=cfg.chunk_buckets)
        out = keep_long_segments(out, cfg.min_segment_rows)
    return out


def split(regular: DataFrame, cfg: PipelineConfig) -> DataFrame:
    return time_split(regular, cfg.train_end, cfg.eval_start, cfg.eval_end)


def prepare(raw: DataFrame, cfg: PipelineConfig, with_index: bool = False,
            materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """Full preparation. Returns ``(prepared, params)`` where ``prepared`` has
    series_id, segment_id, ts, value, filled, split, value_scaled [, time_idx]
    and ``params`` is the scaler table (series_id, mean, std).

    With ``materialize`` the split, regular series is written once to the
    shared checkpoint folder; the scaler fit and the scaling both read that
    table instead of re-running scan, resample and fill."""
    sp = split(regularise(clean(raw, cfg), cfg), cfg)
    if with_index:   # before the scaler's join, so the chunks of a series stay spread
        sp = dense_time_index(sp, cfg.freq, chunk_buckets=cfg.chunk_buckets)
    if materialize:
        sp = write_materialized(sp, "regular")
    keys = ("series_id",) if cfg.scale_by_series else ()
    params = fit_scaler(sp, keys)
    out = scale(sp, params, keys) if cfg.scale else sp.withColumn("value_scaled", F.col("value"))
    return out, params
