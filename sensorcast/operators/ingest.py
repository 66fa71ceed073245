"""Quality filter, column normalisation, typed parsing,
missing-value removal, constant keys and the float32 cast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_quality(df: DataFrame, ok: tuple[str, ...] = ("Good",),
                   quality_col: str = "quality") -> DataFrame:
    """B1: keep readings whose quality status is in ``ok``."""
    return df.where(F.col(quality_col).isin(list(ok)))


def normalise_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """B2: select and rename, ``{old: new}``; everything else is pruned."""
    return df.select([F.col(old).alias(new) for old, new in mapping.items()])


def parse_ts_expr(raw: str | Column, strict: bool = True, fmt: str | None = None) -> Column:
    c = F.col(raw) if isinstance(raw, str) else raw
    parsed = (F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz") if fmt
              else c.try_cast("timestamp_ntz"))
    if not strict:
        return parsed
    return F.when(c.isNotNull() & parsed.isNull(),
                  F.raise_error(F.concat(F.lit("unparsable time stamp: "), c))
                  ).otherwise(parsed)


def parse_ts(df: DataFrame, strict: bool = True, raw_col: str = "ts_raw",
             out_col: str = "ts", fmt: str | None = None) -> DataFrame:
    """Text -> TIMESTAMP_NTZ. ``strict`` fails the job on a bad stamp (as
    the reference's default parse does); otherwise bad stamps become NULL."""
    return df.withColumn(out_col, parse_ts_expr(raw_col, strict, fmt))


def parse_value_expr(raw: str | Column) -> Column:
    c = F.col(raw) if isinstance(raw, str) else raw
    v = F.trim(c).try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def parse_value(df: DataFrame, raw_col: str = "value_raw", out_col: str = "value") -> DataFrame:
    """Text -> DOUBLE; unparsable text and NaN become NULL, infinities stay."""
    return df.withColumn(out_col, parse_value_expr(raw_col))


def drop_missing(df: DataFrame, cols: list[str] | tuple[str, ...] = ("ts", "value")) -> DataFrame:
    """Drop rows with a NULL (or NaN) in any of ``cols``."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
        if dict(df.dtypes).get(c) in ("double", "float"):
            cond = cond & ~F.isnan(F.col(c))
    return df.where(cond)


def with_series_id(df: DataFrame, series_id: str, col: str = "series_id") -> DataFrame:
    """Add a constant key column (single-sensor input)."""
    return df.withColumn(col, F.lit(series_id))


def cast_value(df: DataFrame, dtype: str = "float", col: str = "value") -> DataFrame:
    """Cast the target column (float32 only where a consumer needs it)."""
    return df.withColumn(col, F.col(col).cast(dtype))


def clean_readings(df: DataFrame, ok_quality=("Good",), filter_q: bool = True,
                   strict_ts: bool = True) -> DataFrame:
    """Raw text readings -> (series_id, ts, value): B1, B3, B4, B5 in one pass."""
    if filter_q:
        df = filter_quality(df, ok_quality)
    df = df.select("series_id", parse_ts_expr("ts_raw", strict_ts).alias("ts"),
                   parse_value_expr("value_raw").alias("value"))
    return drop_missing(df, ["series_id", "ts", "value"])
