"""Pipeline settings.

The defaults are the correct behaviour; each preset reproduces one of the five
reference pipeline variants (they disagree on quality filtering, resample scope,
interpolation limit, continuity split, eval range, scaling, window sizes and the
relative error metric).
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class PipelineConfig:
    # ingest
    ok_quality: tuple[str, ...] = ("Good",)
    filter_quality: bool = True
    strict_ts: bool = True
    # removed period(s), closed at both ends
    invalid_intervals: tuple[tuple[str, str], ...] = ()
    # resample + fill
    freq: str = "1 minute"
    fill_limit: int | None = 30
    per_segment: bool = True          # False: resample/fill across the removed period
    # continuity split
    continuity_split: bool = False
    max_gap: str = "60 minutes"
    min_segment_rows: int = 3
    # train / eval split, closed ranges
    train_end: str = "2026-06-30 23:59:59"
    eval_start: str = "2026-07-01 00:00:00"
    eval_end: str = "2026-07-31 23:59:59"
    # scaling
    scale: bool = True
    scale_by_series: bool = True
    # windows
    context: int = 144
    horizon: int = 12
    # relative error metric reported with the others
    relative_metric: str = "smape"
    # rows per (series, chunk) after resampling; bounds every window task
    chunk_buckets: int = 1440
    # True: shuffle the raw readings once by (series, chunk) and share that
    # exchange between resample and gap fill - for about one reading per bucket,
    # as with 1-minute sensors on a 1-minute grid;
    # False (the default): combine readings map-side first
    shuffle_raw_once: bool = False
    # forecasters: season in buckets, harmonics, patches, and the windows scored
    period: int = 1440
    harmonics: int = 3
    patch_len: int = 16
    stride: int = 8
    origins: str = "all"
    # True: fit and forecast the scaled column, report in original units
    forecast_scaled: bool = False

    def with_(self, **kw) -> "PipelineConfig":
        return replace(self, **kw)


# The reference's removed period, eval ranges and window sizes.
REFERENCE_INVALID = (("2025-08-01 00:00:00", "2026-04-30 23:59:59"),)

PRESETS: dict[str, PipelineConfig] = {
    "deepar": PipelineConfig(invalid_intervals=REFERENCE_INVALID, per_segment=False,
                             context=144, horizon=12, origins="last_eval"),
    "nbeats": PipelineConfig(invalid_intervals=REFERENCE_INVALID, per_segment=False,
                             fill_limit=None, filter_quality=False, strict_ts=False,
                             context=144, horizon=12, origins="all"),
    "patchtst": PipelineConfig(invalid_intervals=REFERENCE_INVALID, continuity_split=True,
                               eval_end="2026-07-07 23:59:59", context=144, horizon=12,
                               patch_len=16, stride=8, origins="no_warmup"),
    "tcn": PipelineConfig(invalid_intervals=REFERENCE_INVALID, context=96, horizon=24,
                          origins="no_warmup"),
    "tft": PipelineConfig(invalid_intervals=REFERENCE_INVALID, scale=False, context=96,
                          horizon=24, relative_metric="mape", origins="last_eval"),
}

# Settings used with the driver's `events` table as a set of five sensors.
EVENTS = PipelineConfig(
    invalid_intervals=(("2024-01-10 00:00:00", "2024-01-14 23:59:59"),),
    freq="15 minutes",
    fill_limit=3,
    train_end="2024-01-23 23:59:59",
    eval_start="2024-01-24 00:00:00",
    eval_end="2024-01-30 23:59:59",
    context=24,
    horizon=6,
    chunk_buckets=96,
    period=96,
    patch_len=8,
    stride=4,
    origins="eval",
)
EVENTS_HOURLY = EVENTS.with_(freq="1 hour", period=24)
