"""Order-dependent work without one task per series.

A Window partitioned only by ``series_id`` sends a whole sensor to one task;
one hot sensor (a third of all rows) would then stall the job. Every ordered
operator here instead partitions by ``(series, chunk)``, where a chunk is a
fixed span of buckets (at most ``chunk_buckets`` rows after resampling) or a
fixed range of the dense row index. What crosses a chunk border is carried by a
small per-chunk summary table (one row per series and chunk):

* ``neighbour``     previous / next row across chunks (lag / lead),
* ``running_total`` running sum across chunks (prefix of chunk totals),
* ``with_halo``     copies of the rows near a border into the adjacent chunk, so
                    frame aggregates over L rows see the rows they need,
* ``spread_join``   attaches one parameter row per series without sending a
                    whole series to one task.

Rows without a key belong to no series: ``neighbour`` and ``running_total``
leave them out, as ingest does. Both sides of their carry join start from one
exchange by (keys, chunk) with the same columns under the same filter, so Spark
runs the scan and the exchange once and reuses it (``ReusedExchange``) - as long
as the columns that nobody needs were dropped before, not after, the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
SPREAD = 16


def with_keys(df: DataFrame, keys) -> DataFrame:
    """Rows whose keys are all set."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def known_small(df: DataFrame) -> bool:
    """Whether Spark plans ``df`` at a size that it would broadcast."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def spread_join(df: DataFrame, params: DataFrame, keys, how: str = "inner",
                parts: int = SPREAD, by: str | None = None) -> DataFrame:
    """Equi join of rows with a table of one row per key.

    The rows of a key are dealt over ``parts`` tasks (by the hash of ``by``, by
    default of all other columns) and the parameter rows are repeated for each,
    so a hot series never meets its parameters in one task. A parameter table that
    Spark knows to be small is broadcast as it is and nothing is shuffled: its repeated
    rows would be planned at the same size, and broadcast ``parts`` times over."""
    keys = list(keys)
    if not keys:
        raise ValueError("spread_join needs keys")
    if known_small(params):
        return df.join(params, keys, how)
    other = [by] if by else [c for c in df.columns if c not in keys] or keys
    left = df.withColumn("_part", F.pmod(F.xxhash64(*other), F.lit(parts)).cast("int"))
    right = params.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, [*keys, "_part"], how).drop("_part")


def place(df: DataFrame, keys, chunk_col: str, placed: bool) -> DataFrame:
    """The one exchange that the window and the per-chunk summary share."""
    return df if placed else df.repartition(*keys, chunk_col)


def neighbour(df: DataFrame, keys: list[str], order_col: str, chunk_col: str,
              cols: list[str], direction: str = "prev", prefix: str = "_p_",
              placed: bool = False) -> DataFrame:
    """Add ``prefix + c`` for ``order_col`` and each of ``cols``: the value of
    the previous (``prev``) or next (``next``) row in ``keys`` ordered by
    ``order_col``, including across chunk borders. ``placed``: the rows already
    lie together by (keys, chunk)."""
    prev = direction == "prev"
    fn = F.lag if prev else F.lead
    df = place(with_keys(df, keys), keys, chunk_col, placed)
    names = [order_col, *[c for c in cols if c != order_col]]
    w = Window.partitionBy(*keys, chunk_col).orderBy(order_col)
    local = df.select("*", *[fn(c).over(w).alias(f"_nb_{c}") for c in names])
    edge_agg = F.max if prev else F.min
    # the edge row carries every column, so that both sides need the same ones
    rest = [c for c in df.columns if c not in (*names, *keys, chunk_col)]
    edge = local.groupBy(*keys, chunk_col).agg(
        edge_agg(F.struct(*names, *rest)).alias("_edge"))
    ws = Window.partitionBy(*keys).orderBy(chunk_col)
    carry = edge.select(*keys, chunk_col, fn("_edge").over(ws).alias("_carry"))
    out = local.join(carry, [*keys, chunk_col], "left")
    at_border = F.col(f"_nb_{order_col}").isNull()
    keep = [F.col(c) for c in df.columns]
    picked = [F.when(at_border, F.col("_carry").getField(c)).otherwise(F.col(f"_nb_{c}"))
              .alias(prefix + c) for c in names]
    return out.select(*keep, *picked)


def running_total(df: DataFrame, keys: list[str], order_col: str, chunk_col: str,
                  value: Column, out_col: str, inclusive: bool = True,
                  placed: bool = False) -> DataFrame:
    """``out_col`` = running sum of ``value`` over ``keys`` ordered by
    ``order_col`` (inclusive or exclusive of the current row), across chunks."""
    df = place(with_keys(df, keys), keys, chunk_col, placed)
    w = (Window.partitionBy(*keys, chunk_col).orderBy(order_col)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = df.select("*", value.alias("_rv")).select("*", F.sum("_rv").over(w).alias("_run"))
    # a witness row per chunk makes both sides need the same columns
    totals = (local.groupBy(*keys, chunk_col)
              .agg(F.sum("_rv").alias("_tot"), F.max(F.struct(*df.columns)).alias("_row"))
              .where(F.col("_row").isNotNull()))
    ws = (Window.partitionBy(*keys).orderBy(chunk_col)
          .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, chunk_col,
                            F.coalesce(F.sum("_tot").over(ws), F.lit(0)).alias("_off"))
    res = local.join(offsets, [*keys, chunk_col], "left")
    total = F.col("_off") + F.col("_run")
    if not inclusive:
        total = total - F.col("_rv")
    return res.select(*[F.col(c) for c in df.columns], total.alias(out_col))


def row_index(df: DataFrame, keys: list[str], order_col: str, chunk_col: str,
              out_col: str = "time_idx") -> DataFrame:
    """Dense 0-based row number per ``keys`` ordered by ``order_col``."""
    return running_total(df, keys, order_col, chunk_col, F.lit(1).cast("long"), out_col,
                         inclusive=False)


def with_halo(df: DataFrame, idx_col: str, chunk_rows: int, back: int, fwd: int = 0,
              chunk_col: str = CHUNK, own_col: str = "_own") -> DataFrame:
    """Assign each row to chunk ``idx // chunk_rows`` and also copy it into the
    previous / next chunk when it lies within ``fwd`` / ``back`` rows of the
    border. Frame functions over at most ``back`` rows before and ``fwd`` rows
    after a row are then exact inside ``(series, chunk)`` for the rows the chunk
    owns (``own_col``)."""
    chunk_rows = max(chunk_rows, back, fwd)
    idx = F.col(idx_col)
    c = F.floor(idx / F.lit(chunk_rows)).cast("long")
    pos = idx - c * F.lit(chunk_rows)
    chunks = F.array(c)
    if back > 0:
        chunks = F.when(pos >= F.lit(chunk_rows - back), F.array_append(chunks, c + 1)).otherwise(chunks)
    if fwd > 0:
        chunks = F.when(pos < F.lit(fwd), F.array_prepend(chunks, c - 1)).otherwise(chunks)
    return (df.select("*", c.alias("_home"), F.explode(chunks).alias(chunk_col))
            .select(*[F.col(x) for x in df.columns], chunk_col,
                    (F.col(chunk_col) == F.col("_home")).alias(own_col)))


def top_k_per_group(df: DataFrame, keys: list[str], order_cols: list[str], k: int,
                    chunk: Column, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per group in ``order_cols`` order, exact.

    Stage 1 keeps the local top ``k`` of each (group, chunk) - chunks are
    bounded spans - and stage 2 ranks only those candidates (at most ``k``
    per chunk) per group, so no task ever holds a whole group.
    ``chunk`` must be monotone in the ordering (e.g. a time chunk)."""
    ordering = [F.col(c) for c in order_cols]
    x = df.withColumn("_tk_chunk", chunk)
    w1 = Window.partitionBy(*keys, "_tk_chunk").orderBy(*ordering)
    cand = x.withColumn("_tk_r", F.row_number().over(w1)).where(F.col("_tk_r") <= k)
    # chunks before the one holding the k-th row are complete; a group's
    # candidates are at most k per chunk, so keep only its first k chunks
    wc = Window.partitionBy(*keys).orderBy("_tk_chunk")
    firsts = (cand.groupBy(*keys, "_tk_chunk").agg(F.count(F.lit(1)).alias("_tk_n"))
              .withColumn("_tk_before", F.coalesce(F.sum("_tk_n").over(
                  wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .where(F.col("_tk_before") < k).select(*keys, "_tk_chunk"))
    cand = cand.join(firsts, [*keys, "_tk_chunk"], "left_semi")
    w2 = Window.partitionBy(*keys).orderBy(*ordering)
    return (cand.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
            .drop("_tk_chunk", "_tk_r"))
