"""Semantics checked against pandas, the library the reference computes with:
resample(...).mean() + interpolate(method='time', limit=N) + dropna, per
segment; and the skew bound of the chunk layout."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pandas as pd  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from conftest import SF_MID  # noqa: E402
from sensorcast.config import EVENTS  # noqa: E402
from sensorcast.functions.timefn import chunk_index  # noqa: E402
from sensorcast.operators.resample import fill_gaps, resample_mean  # noqa: E402
from sensorcast.plans import prepare as P  # noqa: E402
from sensorcast.sources.tables import sensor_raw  # noqa: E402


def pandas_process(seg: pd.DataFrame, freq: str, limit) -> pd.DataFrame:
    s = seg.set_index("ts")[["value"]].resample(freq).mean()
    s["value"] = s["value"].interpolate(method="time", limit=limit)
    return s.dropna()


@pytest.mark.parametrize("freq,pfreq,limit", [("15 minutes", "15min", 3), ("1 hour", "1h", 2)])
def test_fill_matches_pandas(spark, freq, pfreq, limit):
    cfg = EVENTS.with_(freq=freq, fill_limit=limit)
    clean = P.clean(sensor_raw(spark, SF_MID), cfg)
    ours = fill_gaps(resample_mean(clean, freq), freq, limit, chunk_buckets=17).toPandas()
    pdf = clean.toPandas()
    ref = []
    for (sid, seg), g in pdf.groupby(["series_id", "segment_id"]):
        r = pandas_process(g, pfreq, limit).reset_index()
        r["series_id"], r["segment_id"] = sid, seg
        ref.append(r)
    ref = pd.concat(ref)
    a = ours.sort_values(["series_id", "ts"]).reset_index(drop=True)
    b = ref.sort_values(["series_id", "ts"]).reset_index(drop=True)
    assert len(a) == len(b)
    assert (a["ts"].astype("datetime64[us]").values == b["ts"].astype("datetime64[us]").values).all()
    assert (a["value"] - b["value"]).abs().max() < 1e-9


def test_hot_sensor_chunks_stay_bounded(spark):
    """One sensor with most of the rows: every (series, chunk) group of the
    regular series holds at most chunk_buckets rows, the bound each ordered
    task works under."""
    raw = sensor_raw(spark, SF_MID)
    hot = raw.withColumn("series_id", F.when(F.col("series_id") != "view", F.lit("hot"))
                         .otherwise(F.col("series_id")))
    cfg = EVENTS.with_(freq="1 minute", fill_limit=30, chunk_buckets=240)
    reg = P.regularise(P.clean(hot, cfg), cfg)
    sizes = reg.groupBy("series_id", chunk_index("ts", cfg.freq, cfg.chunk_buckets)).count()
    assert sizes.agg(F.max("count")).first()[0] <= cfg.chunk_buckets
    share = reg.where("series_id = 'hot'").count() / reg.count()
    assert share > 1 / 3
