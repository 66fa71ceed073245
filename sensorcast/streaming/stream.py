"""The real-time variant. Structured Streaming over arriving files:
tumbling means with a watermark, and alerts from a stream-static join with
the (small, persisted) scaler table. Event time is moved to a zone-free epoch
TIMESTAMP (``timestamp_micros`` of the NTZ micros) because watermarks need
TIMESTAMP, and back to TIMESTAMP_NTZ on output, so window borders equal the
batch buckets under any session time zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timefn import bucket_index, freq_interval, freq_micros, from_micros, to_micros
from ..operators.layout import spread_join
from ..session import scratch_path


def file_stream(spark: SparkSession, path: str, schema: T.StructType,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving under ``path`` (a directory or a glob). A path that
    names one file is turned into a one-file glob (the file source lists
    patterns); a directory written by Spark matches it too, as its files."""
    p = path.rstrip("/")
    if p.endswith(".parquet"):
        jp = spark._jvm.org.apache.hadoop.fs.Path(p)
        if jp.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jp).isFile():
            p = p[:-1] + f"[{p[-1]}]"
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(p)


def event_time(ts_col: str = "ts"):
    return F.timestamp_micros(to_micros(ts_col))


def stream_resample(readings: DataFrame, freq: str = "1 hour", watermark: str = "10 minutes"
                    ) -> DataFrame:
    """Tumbling mean per (series, window) with a watermark; the group key is
    the whole ``window`` struct (grouping by its start loses the watermark).
    Run it in append mode in production: each window is emitted once when the
    watermark passes it and its state is dropped. Complete mode keeps every
    window's state and is only for comparing a finished stream with batch."""
    x = readings.withColumn("_et", event_time()).withWatermark("_et", watermark)
    g = x.groupBy("series_id", F.window("_et", freq)).agg(F.avg("value").alias("value"),
                                                        F.count(F.lit(1)).alias("n"))
    return g.select("series_id", from_micros(F.unix_micros(F.col("window.start"))).alias("ts"),
                    "value", "n")


def stream_alerts(readings: DataFrame, params: DataFrame, z_limit: float = 3.0) -> DataFrame:
    """Stream-static join with the scaler table; rows with |z| > z_limit."""
    x = spread_join(readings, params, ["series_id"], by="ts")
    z = (F.col("value") - F.col("mean")) / F.col("std")
    return x.withColumn("z", z).where(F.abs(F.col("z")) > F.lit(z_limit)).select(
        "series_id", "ts", "value", "z")


def stream_scores(forecasts: DataFrame, readings: DataFrame, freq: str, delay: str = "10 minutes") -> DataFrame:
    """Online scoring: every reading with the forecasts of its bucket, as both arrive.

    A stream-stream join on the sensor and a time range (target_ts <= ts < target_ts +
    freq) with watermarks on both sides, so a side's rows are kept only until no partner
    can come. The join key also holds the grid bucket of the time: a reading meets the
    forecasts whose span touches its bucket, not all of its sensor's, and a sensor is
    dealt over as many keys as it has buckets. A span off the grid touches two buckets, a
    reading lies in one, so a pair meets once. Append mode; rows later than ``delay`` are
    lost for the score."""
    last = F.timestamp_add("MICROSECOND", F.lit(freq_micros(freq) - 1), F.col("target_ts"))
    f = (forecasts.withColumn("_ft", event_time("target_ts")).withWatermark("_ft", delay)
         .withColumn("_span", F.explode(F.sequence(bucket_index("target_ts", freq), bucket_index(last, freq)))))
    a = (readings.select(F.col("series_id").alias("_series"), "ts", F.col("value").alias("actual"))
         .withColumn("_at", event_time("ts")).withWatermark("_at", delay)
         .withColumn("_bucket", bucket_index("ts", freq)))
    met = f.join(a, (F.col("series_id") == F.col("_series")) & (F.col("_span") == F.col("_bucket"))
                 & (F.col("_at") >= F.col("_ft"))
                 & (F.col("_at") < F.col("_ft") + F.expr(f"INTERVAL {freq_interval(freq)}")))
    return met.select("model", "series_id", "origin_ts", "step", "target_ts", "ts", "predicted", "actual",
                      (F.col("predicted") - F.col("actual")).alias("error"))


def run_to_table(spark: SparkSession, stream_df: DataFrame, name: str,
                 output_mode: str = "append") -> DataFrame:
    """Run a streaming query until the available input is processed
    (``availableNow``), with its checkpoint and output in the shared scratch
    folder; return the written table. Complete mode rewrites the table per
    micro-batch (``foreachBatch``), append mode uses the exactly-once file sink."""
    out, ck = scratch_path(spark, f"{name}_out"), scratch_path(spark, f"{name}_ck")
    w = stream_df.writeStream.option("checkpointLocation", ck).trigger(availableNow=True)
    if output_mode == "complete":
        q = (w.outputMode("complete")
             .foreachBatch(lambda b, _id: b.write.mode("overwrite").parquet(out)).start())
    else:
        q = w.outputMode("append").format("parquet").option("path", out).start()
    q.awaitTermination()
    return spark.read.schema(stream_df.schema).parquet(out)
