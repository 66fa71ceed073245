"""Forecasters fitted by distributed aggregates (F1-F8).

Forecast table: model, series_id, origin_ts, step, target_ts, q, predicted
(``q`` is NULL for point forecasts and the quantile level otherwise)."""
