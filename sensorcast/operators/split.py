"""Time splits, cutoff, halo and length guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import ts_literal
from .layout import spread_join


def time_split(df: DataFrame, train_end: str, eval_start: str, eval_end: str,
               ts_col: str = "ts", out_col: str = "split") -> DataFrame:
    """``split`` = 'train' (ts <= train_end) or 'eval' (eval_start <= ts <=
    eval_end, both ends inclusive); rows in neither range are dropped."""
    t = F.col(ts_col)
    s = (F.when(t <= ts_literal(train_end), F.lit("train"))
         .when(t.between(ts_literal(eval_start), ts_literal(eval_end)), F.lit("eval")))
    return df.withColumn(out_col, s).where(F.col(out_col).isNotNull())


def flag_interval(df: DataFrame, start: str, end: str, ts_col: str = "ts",
                  out_col: str = "is_eval") -> DataFrame:
    """0/1 flag of a closed time range."""
    return df.withColumn(out_col, F.col(ts_col).between(ts_literal(start), ts_literal(end))
                         .cast("int"))


def split_counts(df: DataFrame, flag_col: str = "is_eval") -> DataFrame:
    """Value counts of a split flag."""
    return df.groupBy(flag_col).agg(F.count(F.lit(1)).alias("n_rows"))


def split_at_cutoff(df: DataFrame, keys=("series_id",), split_col: str = "split",
                    idx_col: str = "time_idx") -> DataFrame:
    """cutoff = last train index per series; rows <= cutoff are 'train',
    later rows 'eval'. Adds ``cutoff`` and ``part``."""
    cut = (df.where(F.col(split_col) == "train").groupBy(*keys)
           .agg(F.max(idx_col).alias("cutoff")))
    return (spread_join(df, cut, keys)
            .withColumn("part", F.when(F.col(idx_col) <= F.col("cutoff"), F.lit("train"))
                        .otherwise(F.lit("eval"))))


def eval_with_halo(df: DataFrame, context: int, idx_col: str = "time_idx",
                   cutoff_col: str = "cutoff") -> DataFrame:
    """Eval rows plus the ``context`` rows before the cutoff as warm-up."""
    return df.where(F.col(idx_col) > F.col(cutoff_col) - F.lit(context))


def min_length_report(df: DataFrame, context: int, horizon: int, keys=("series_id",),
                      split_col: str = "split", fail: bool = False) -> DataFrame:
    """Rows per series and split against the L + H rows one window needs;
    ``fail=True`` turns a short split into a job failure."""
    need = context + horizon
    rep = (df.groupBy(*keys, split_col).agg(F.count(F.lit(1)).alias("n_rows"))
           .withColumn("needed", F.lit(need).cast("long"))
           .withColumn("ok", F.col("n_rows") >= F.col("needed")))
    if fail:
        rep = rep.withColumn("ok", F.when(F.col("ok"), F.col("ok")).otherwise(
            F.raise_error(F.lit(f"split shorter than context + horizon = {need}")).cast("boolean")))
    return rep


def require_min_length(df: DataFrame, context: int, horizon: int, keys=("series_id",),
                       split_col: str = "split") -> DataFrame:
    """B16 guard form: the report with a job failure on any short split."""
    return min_length_report(df, context, horizon, keys, split_col, fail=True)
