"""F8: batch prediction with a user-supplied Python predictor over window
batches - the one place where Python runs inside tasks. Arrow batches of
windows go through ``mapInPandas``; the predictor maps an (n, L) array of
contexts to an (n, H) array of forecasts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.timefn import add_steps


def mean_predictor(horizon: int) -> Callable[[np.ndarray], np.ndarray]:
    """Forecast every step as the context mean."""
    def predict(x: np.ndarray) -> np.ndarray:
        return np.repeat(x.mean(axis=1, keepdims=True), horizon, axis=1)
    return predict


def score_windows(windows: DataFrame, horizon: int, freq: str,
                  predictor: Callable[[np.ndarray], np.ndarray] | None = None,
                  model: str = "user") -> DataFrame:
    """windows (series_id, origin_ts, x ARRAY<DOUBLE>) -> forecast rows."""
    predict = predictor or mean_predictor(horizon)

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["x"].map(np.asarray).to_numpy()).astype("float64")
            y = np.asarray(predict(x), dtype="float64").reshape(len(pdf), horizon)
            yield pd.DataFrame({"series_id": pdf["series_id"].to_numpy(),
                                "origin_ts": pdf["origin_ts"].to_numpy(),
                                "pred": list(y)})

    out = windows.select("series_id", "origin_ts", "x").mapInPandas(
        run, "series_id string, origin_ts timestamp_ntz, pred array<double>")
    out = out.select("series_id", "origin_ts", F.posexplode("pred").alias("_i", "predicted"))
    return out.select(F.lit(model).alias("model"), "series_id", "origin_ts",
                      (F.col("_i") + 1).cast("int").alias("step"),
                      add_steps("origin_ts", F.col("_i") + 1, freq).alias("target_ts"),
                      F.lit(None).cast("double").alias("q"), "predicted")
