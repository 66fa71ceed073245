import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from conftest import SF_SMALL  # noqa: E402
from sensorcast.session import scratch_path  # noqa: E402
from sensorcast.sources.readers import table  # noqa: E402
from sensorcast.streaming import stream as ST  # noqa: E402


def test_append_mode_drops_late_rows(spark):
    """Files arrive in two batches; the second holds on-time rows and one row
    older than the watermark. Append mode emits closed windows only and the
    late row never changes an emitted window."""
    ev = table(spark, SF_SMALL, "events").where("event_type = 'click'")
    cut = ev.agg(F.percentile_approx("ts", 0.5)).first()[0]
    landing = scratch_path(spark, "landing")
    early, late = ev.where(F.col("ts") <= cut), ev.where(F.col("ts") > cut)
    early.write.parquet(f"{landing}/b1")
    src = ST.file_stream(spark, f"{landing}/*", ev.schema, max_files_per_trigger=1)
    readings = src.select(F.col("event_type").alias("series_id"), "ts", "value")
    agg = ST.stream_resample(readings, "1 hour", "10 minutes")
    out, ck = scratch_path(spark, "app_out"), scratch_path(spark, "app_ck")

    def run():
        q = (agg.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    first = spark.read.schema(agg.schema).parquet(out).count()
    stale = early.orderBy("ts").limit(1).withColumn("value", F.lit(1e9))
    late.unionByName(stale).write.parquet(f"{landing}/b2")
    run()
    res = spark.read.schema(agg.schema).parquet(out)
    assert res.count() >= first
    # the late, huge value is not in any emitted mean
    assert res.agg(F.max("value")).first()[0] < 1e8
    # every emitted window is unique (append emits a window once)
    assert res.count() == res.select("series_id", "ts").distinct().count()
