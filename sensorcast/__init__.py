"""sensorcast: sensor time-series preparation, forecasting and evaluation as
Spark DataFrame operators."""

from .config import EVENTS, EVENTS_HOURLY, PRESETS, PipelineConfig
from .operators.clean import assert_excluded, exclude_interval, invalid_remaining, label_segment
from .operators.evaluate import (align, forecast_stats, gaussian_nll, leaderboard, loss_table,
                                 metrics, metrics_long, pinball_loss, valid_pairs,
                                 variance_check, with_target_ts)
from .operators.features import (calendar_features, encode_series, encoder_length,
                                 relative_time_idx, target_scales)
from .operators.forecast.autoreg import ar_fit, ar_forecast
from .operators.forecast.basis import decompose_forecast, seasonal_fit, trend_fit
from .operators.forecast.causal import causal_filter_bank, filter_linear_forecast
from .operators.forecast.patch import patch_features, patch_linear_forecast
from .operators.forecast.quantile import pick_quantile, quantile_forecast, quantile_profile
from .operators.forecast.score import score_windows
from .operators.forecast.select import select_best
from .operators.ingest import (cast_value, clean_readings, drop_missing, filter_quality,
                               normalise_columns, parse_ts, parse_value, with_series_id)
from .operators.monitor import (breach_probability, cross_correlation, ensemble, flag_anomalies,
                                flag_spikes, interval_coverage, inverse_rmse_weights, kpi_rollup,
                                to_wide)
from .operators.quantiles import group_quantiles
from .operators.report import prep_summary, stage_counts, time_extent
from .operators.resample import fill_gaps, resample_mean
from .operators.scaling import apply_params, fit_scaler, scale, scaled_stats, unscale
from .operators.segments import (continuous_segments, dense_time_index, gap_seconds,
                                 keep_long_segments, segment_lengths)
from .operators.split import (eval_with_halo, flag_interval, min_length_report,
                              require_min_length, split_at_cutoff, split_counts, time_split)
from .operators.windows import (chart_feed, combine, explode_forecast, last_window,
                                make_windows, sample_pairs, window_count, window_slice)
from .plans.jobs import forecast, forecast_job, preprocess_job
from .plans.prepare import prepare
from .sources.readers import load_params, read_prepared, read_raw
from .sources.writers import (materialize, save_model, save_params, split_timestamps,
                              write_forecasts, write_metrics, write_prepared)
from .streaming.stream import file_stream, run_to_table, stream_alerts, stream_resample

__all__ = [n for n in dir() if not n.startswith("_")]
