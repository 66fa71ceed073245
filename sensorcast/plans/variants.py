"""The five reference pipeline variants as presets, runnable on any input.

``PRESETS`` (config) carry the reference's own dates; ``on_events`` keeps a
preset's behaviour flags (quality filter, resample scope, fill limit,
continuity split, scaling, window sizes, relative metric) and swaps in the
dates of the driver's events table so each variant can be run and compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EVENTS, PRESETS, PipelineConfig
from . import prepare as P

BEHAVIOUR = ("filter_quality", "strict_ts", "per_segment", "fill_limit", "continuity_split",
             "max_gap", "min_segment_rows", "scale", "context", "horizon", "relative_metric")


def on_events(name: str, base: PipelineConfig = EVENTS) -> PipelineConfig:
    preset = PRESETS[name]
    return base.with_(**{k: getattr(preset, k) for k in BEHAVIOUR})


def variant_counts(raw: DataFrame, names=tuple(PRESETS)) -> DataFrame:
    """Rows, filled rows, train and eval rows of each variant's preparation."""
    out = None
    for n in names:
        cfg = on_events(n)
        p = P.split(P.regularise(P.clean(raw, cfg), cfg), cfg)
        c = p.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("filled").alias("n_filled"),
                  F.count_if(F.col("split") == "train").alias("n_train"),
                  F.count_if(F.col("split") == "eval").alias("n_eval")).select(
            F.lit(n).alias("variant"), "*")
        out = c if out is None else out.unionByName(c)
    return out
