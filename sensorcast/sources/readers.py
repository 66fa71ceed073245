"""Readers: raw sensor csv, prepared tables, saved parameter tables, and the
adapters that turn the driver's parquet tables into sensor readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The raw csv header names of the reference input.
RAW_TS, RAW_VALUE, RAW_QUALITY = "DateTime", "Value", "QualityStatus"

PREPARED_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("segment_id", T.IntegerType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("filled", T.BooleanType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _headers(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, header line) of every csv file, found by one distributed scan: the
    first line of the block each file begins with. One row per file comes to
    the driver, as many as its own file listing holds."""
    lines = (spark.read.text(path)
             .select("value", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("row"))
             .where("start = 0"))
    return [(r.file, r.header) for r in
            lines.groupBy("file").agg(F.min_by("value", "row").alias("header")).collect()]


def _pick(df: DataFrame, series_id: str | None, ts_col: str, value_col: str, quality_col: str,
          series_col: str | None) -> DataFrame:
    missing = [c for c in (ts_col, value_col, quality_col) if c not in df.columns]
    if missing:
        raise ValueError(f"raw csv without column(s) {', '.join(missing)}: header {df.columns}")
    sid = (F.lit(series_id) if series_id is not None or series_col not in df.columns
           else F.col(series_col))
    return df.select(sid.cast("string").alias("series_id"),
                     F.col(ts_col).cast("string").alias("ts_raw"),
                     F.col(value_col).cast("string").alias("value_raw"),
                     F.col(quality_col).cast("string").alias("quality"))


def read_raw(spark: SparkSession, path: str, series_id: str | None = None,
             ts_col: str = RAW_TS, value_col: str = RAW_VALUE,
             quality_col: str = RAW_QUALITY, series_col: str | None = "series_id",
             schema: T.StructType | None = None, mixed_headers: bool = False) -> DataFrame:
    """A1: read raw sensor csv files with a header; every column stays text.

    Columns are picked by header name, so extra columns are ignored and never
    parsed; nothing is inferred. Every file's header is checked against the
    layout the plan was made for (that of one file, or ``schema``): a file with
    other columns or another order fails the job instead of being read by
    position. With ``mixed_headers`` the files may differ: one extra scan finds
    each file's header, the files of a layout are read together by its names,
    and the layouts are combined; a file without a needed column is refused.
    ``series_id`` comes from a column of the file or from the argument (one
    file = one sensor).
    """
    def csv():                           # a reader keeps what is set on it: take a new one
        return spark.read.option("header", True)

    def checked(paths, names: T.StructType) -> DataFrame:
        return _pick(csv().schema(names).option("enforceSchema", False).csv(paths), series_id, ts_col,
                     value_col, quality_col, series_col)

    def text(columns) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in columns])

    if schema is not None:
        return checked(path, schema)
    if not mixed_headers:
        return checked(path, text(csv().option("inferSchema", False).csv(path).columns))
    layouts: dict[str, list[str]] = {}
    for file, header in _headers(spark, path):
        layouts.setdefault(header, []).append(file)
    if not layouts:
        raise ValueError(f"no raw csv lines under {path}")
    parts = [checked(sorted(files), text(csv().option("inferSchema", False).csv(files[0]).columns))
             for _, files in sorted(layouts.items())]
    return reduce(DataFrame.unionByName, parts)


def read_prepared(spark: SparkSession, path: str, fmt: str = "parquet",
                  schema: T.StructType | None = None) -> DataFrame:
    """A2/A3: read a prepared table back (parquet by default, csv with a typed
    schema so the time column is parsed as TIMESTAMP_NTZ, never inferred)."""
    if fmt == "csv":
        return (spark.read.option("header", True)
                .schema(schema or PREPARED_SCHEMA).csv(path))
    return spark.read.parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    """Load a saved per-series parameter table."""
    return spark.read.parquet(path)
