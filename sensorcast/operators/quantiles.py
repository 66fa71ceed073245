"""Exact group quantiles without holding a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation
buffer, so one hot sensor would land in a single task. Here equal values are
counted first, the (group, value, count) rows are range-partitioned and sorted -
a hot group spreads over many partitions, ties are one row - and a value's
ranks are the counts before it: those of earlier blocks from a table of one row
per group and block, plus the running count in its own block. Only the values
around each quantile position are kept and interpolated: the same linear rule as
SQL ``quantile_cont`` / Spark ``percentile``. ``method='approx'`` uses the
bounded-memory ``percentile_approx`` sketch instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import materialize

#: Sorted values are ranked in blocks of 2^BLOCK_BITS rows of a partition.
BLOCK_BITS = 16


def group_quantiles(df: DataFrame, keys: list[str], value_col: str, qs: list[float],
                    method: str = "exact", accuracy: int = 10000) -> DataFrame:
    """Long table (keys, q, value) of the requested quantile levels."""
    keys = list(keys)
    if method == "approx":
        a = df.groupBy(*keys).agg(F.percentile_approx(value_col, list(qs), accuracy).alias("_v"))
        return a.select(*keys, F.posexplode("_v").alias("_i", "value")).withColumn(
            "q", F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("_i") + 1)
        ).select(*keys, "q", "value")
    # equal values of a group become one row with its count (partial + final
    # aggregate), so a stuck sensor's ties are one row, not one partition
    v = (df.select(*keys, F.col(value_col).alias("_x")).where(F.col("_x").isNotNull())
         .groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")))
    s = (v.repartitionByRange(*keys, "_x").sortWithinPartitions(*keys, "_x")
         .select("*", F.monotonically_increasing_id().alias("_mid"))
         .select("*", F.shiftright("_mid", 33).alias("_pid")))
    # the numbered frame feeds several branches: write it once, so the range
    # sampling, sort and ids run once and every branch sees the same ids
    s = materialize(s, "quantile_ranks")
    # local running counts inside bounded blocks of a partition, prefix over blocks
    s = s.select("*", F.shiftright("_mid", BLOCK_BITS).alias("_block"))
    wl = (Window.partitionBy(*keys, "_block").orderBy("_x")
          .rowsBetween(Window.unboundedPreceding, -1))
    local = s.select("*", F.coalesce(F.sum("_c").over(wl), F.lit(0)).alias("_run"))
    per = s.groupBy(*keys, "_block").agg(F.sum("_c").alias("_pn"))
    wp = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("_off", F.coalesce(F.sum("_pn").over(wp), F.lit(0)))
           .withColumn("_n", F.sum("_pn").over(Window.partitionBy(*keys))))
    ranked = (local.join(per, [*keys, "_block"])
              .withColumn("_first", F.col("_off") + F.col("_run"))
              .withColumn("_last", F.col("_first") + F.col("_c") - 1))
    # positions wanted per group: pos = q * (n - 1), its floor and ceiling
    levels = F.array(*[F.lit(float(q)) for q in qs])
    at = F.transform(levels, lambda q: F.struct(q.alias("q"), (q * (F.col("_n") - F.lit(1))).alias("pos")))
    hit = F.filter(at, lambda p: (F.floor(p["pos"]) <= F.col("_last")) & (F.ceil(p["pos"]) >= F.col("_first")))
    picked = ranked.select(*keys, "_x", "_first", "_last", F.explode(hit).alias("_p"))
    lo, hi = F.floor("_p.pos"), F.ceil("_p.pos")

    def holds(p):
        return (F.col("_first") <= p) & (p <= F.col("_last"))
    ends = (picked.groupBy(*keys, F.col("_p.q").alias("q"), F.col("_p.pos").alias("_pos"))
            .agg(F.max(F.when(holds(lo), F.col("_x"))).alias("_vlo"),
                 F.max(F.when(holds(hi), F.col("_x"))).alias("_vhi")))
    value = F.col("_vlo") + (F.col("_pos") - F.floor("_pos")) * (F.col("_vhi") - F.col("_vlo"))
    return ends.select(*keys, "q", value.alias("value"))
