"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the keys are sorted by
range: a source is cut into key ranges of about ROWS_PER_RANGE documents, so a
hot source spreads over as many tasks as it needs. Prefix sums of the sizes run
inside the ranges, the sums of whole ranges are added from a small table, and
each source is cut at its exact budget. A budget above the source's size repeats
it: whole epochs first, then the cut one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, WORD, n_words, salted, written

#: Few enough for a window to hold in memory, with their texts.
ROWS_PER_RANGE = 4_000
MAX_EPOCHS = 3


def targets(totals: list[tuple], weights: list[float], max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Targets of sources (name, size) under ``weights`` that share the sum of
    all sizes. A target stops at ``max_epochs`` times its source's size; what is
    above goes to the others by weight, until none is above."""
    total = sum(n for _, n in totals)
    capped: set[int] = set()
    while True:
        open_ = [i for i in range(len(totals)) if i not in capped]
        rest = total - sum(max_epochs * totals[i][1] for i in capped)
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * rest > max_epochs * totals[i][1] * w]
        if not over:
            return [float(max_epochs * totals[i][1]) if i in capped
                    else (weights[i] * rest / w if rest else 0.0) for i in range(len(totals))]
        capped.update(over)


def random_key(id_col: Column, text: Column | None = None, seed: int = 0) -> Column:
    """A key in [0, 2^60) that looks random and depends on the document alone: on its
    id or, without one, on its ``text``."""
    unnamed = F.lit("null")
    if text is not None:
        unnamed = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))
    parts = [F.lit(str(seed)), F.coalesce(id_col.cast("string"), unnamed)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights: dict | None = None, cycle=(1, 2, 3),
                max_epochs: int = MAX_EPOCHS, seed: int = 0,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document a mix to target weights takes.

    ``weights`` names a weight per source; without it the sources, by code
    point and null last, weigh ``cycle`` in turn. The driver holds one row per
    source (name and size), never one per document.

    One row per input row: (id_col, source, size, source_size, target, taken,
    epochs, cut) and the columns in ``keep``. ``taken`` = epochs * size + cut,
    where ``cut`` words come from the last, incomplete epoch (0 <= cut <= size);
    the taken words of a source sum to floor(target). Order within a source:
    key, then id, then size, then a hash of the text; repeated rows are neighbours
    there and are cut one after the other. Rows without an id get their key from the
    text, so many of them are no hot range. Null and empty texts have size 0 and are taken 0 times;
    null sources are a source of their own; an empty table gives an empty
    result.
    """
    sized = written(docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
        random_key(F.col(id_col), F.col(text_col).cast("string"), seed).alias("key"),
        F.xxhash64(F.col(text_col)).alias("tie"),
        F.struct(*[F.col(c) for c in keep]).alias("kept") if keep else F.lit(None).cast("string").alias("kept")),
        "mix-sizes")
    spark = docs.sparkSession
    rows = [(r.source, r.size, r.n) for r in
            sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    w = [cycle[i % len(cycle)] if weights is None else weights.get(r[0], 0)
         for i, r in enumerate(rows)]
    t = targets([r[:2] for r in rows], w, max_epochs)
    plan = spark.createDataFrame(
        [(r[0] is None, r[0] or "", int(r[1]), float(x), -(-r[2] // ROWS_PER_RANGE))
         for r, x in zip(rows, t, strict=True)],
        "no_source boolean, name string, source_size long, target double, ranges long")

    placed = (salted(sized.withColumn("no_source", F.col("source").isNull())
                     .withColumn("name", F.coalesce("source", F.lit(""))),
                     plan, ["no_source", "name"])
              .withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("ranges"))))
    in_range = W.partitionBy("no_source", "name", "range")
    local = placed.withColumn("before", F.sum("size").over(
        in_range.orderBy("key", "id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)))
    # One row per source and key range: the words in the ranges before it.
    ranges = (placed.groupBy("no_source", "name", "range").agg(F.sum("size").alias("words"))
              .withColumn("offset", F.sum("words").over(
                  W.partitionBy("no_source", "name").orderBy("range")
                  .rowsBetween(W.unboundedPreceding, -1))))
    start = F.coalesce("offset", F.lit(0)) + F.coalesce("before", F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    out = (local.join(ranges.drop("words"), ["no_source", "name", "range"])
           .withColumn("epochs", F.when(F.col("size") > 0, epochs).otherwise(0).cast("long"))
           .withColumn("cut", cut.cast("long")))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target",
                      (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"),
                      "epochs", "cut", *[F.col(f"kept.`{c}`").alias(c) for c in keep
                                         if c not in (id_col, "source")])


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, white space kept."""
    pieces = F.regexp_extract_all(text, F.lit(f"([{SPACE}]*{WORD})"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")
