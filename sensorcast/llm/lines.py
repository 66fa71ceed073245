"""Line dedup: later copies of repeated runs of lines are deleted.

The documents are sequences of line IDs. Distributed prefix doubling ranks the
suffixes of all sequences by their first 1, 2, 4, ... lines: the rank of a
suffix at one depth is the place of its pair of ranks at the depth before, in
sorted order. Suffixes of equal rank are the intervals of the suffix array whose
longest common prefix has at least that many lines; the place that comes first
in an interval stays, the others are later copies. A suffix that is alone in its
interval cannot lie in a longer one and leaves the computation.

The rank of the first and of the last 2^k lines of a run name its content, if it has
2^k to 2^(k+1) - 1 lines. A longest repeated run is the union of its shortest parts
with enough characters, so only these are compared, and no depth beyond the longest of
them is ranked.

Only DataFrame functions; every depth is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, salted, written

#: A repeated run is deleted if its lines have at least so many characters.
MIN_CHARS = 60

_DOC = ["k1", "k2"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Order (null ids last) and a 128-bit key of id and text."""
    i, t = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = F.coalesce(i.cast("string"), F.lit(""))
    return [F.coalesce(i, F.lit(2**63 - 1)).alias("ord"), F.xxhash64(known, t).alias("k1"),
            F.xxhash64(F.lit(1), t, known).alias("k2")]


def _ranked(rows: DataFrame, by: list[str], depth: int) -> DataFrame:
    """``rows`` (place, by and more) that share their value of ``by`` with another
    place, with the rank of that value."""
    place = F.struct("ord", *_DOC, "seq")
    groups = (rows.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last"))
              .where(F.col("first") != F.col("last"))
              .orderBy(*by)                                  # the order of the suffixes
              .select(*by, F.monotonically_increasing_id().alias("rank")))
    groups = written(groups, f"lines-groups-{depth}")
    return written(salted(rows, groups, by, salts=8).drop(*by), f"lines-ranked-{depth}")


def _islands(level: DataFrame, min_chars: int) -> DataFrame:
    """The repeated lines that lie between others (``isle``) with ``min_chars``
    characters in all; a run that is repeated lies in one island at each of its places."""
    isles = level.withColumn("isle", F.col("seq") - F.row_number().over(W.partitionBy(*_DOC).orderBy("seq")))
    total = F.sum("chars").over(W.partitionBy(*_DOC, "isle"))
    return written(isles.withColumn("total", total).where(F.col("total") >= min_chars).drop("total"),
                   "lines-islands")


def _shortest(isles: DataFrame, min_chars: int) -> DataFrame:
    """(ord, k1, k2, seq, n): runs of n lines from seq on with ``min_chars`` characters
    that have fewer without their last, or without their first line."""
    isle = W.partitionBy(*_DOC, "isle")
    end = F.sum("chars").over(isle.orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    rows = isles.withColumn("end", end).withColumn("begin", F.col("end") - F.col("chars"))
    # a worded line has a character, so both sums grow from line to line
    ahead = isle.orderBy("begin").rangeBetween(0, min_chars - 1)
    back = isle.orderBy("end").rangeBetween(1 - min_chars, 0)
    rows = written(rows.select("ord", *_DOC, "seq", "chars", F.count("*").over(ahead).alias("n"),
                               F.sum("chars").over(ahead).alias("sum"), F.count("*").over(back).alias("n2"),
                               F.sum("chars").over(back).alias("sum2")), "lines-shortest")
    first = rows.where(F.col("sum") >= min_chars).select("ord", *_DOC, "seq", "n")
    # without the last line too few: the run is among the others already
    last = (rows.where(F.col("sum2") - F.col("chars") >= min_chars)
            .select("ord", *_DOC, (F.col("seq") - F.col("n2") + 1).alias("seq"), F.col("n2").alias("n")))
    return first.union(last)


def _later_runs(runs: DataFrame, level: DataFrame, depth: int) -> DataFrame:
    """(k1, k2, seq): lines of the runs of depth to 2 * depth - 1 lines that have an
    earlier copy."""
    here = runs.where((F.col("n") >= depth) & (F.col("n") < 2 * depth))
    first = level.select(*_DOC, "seq", F.col("rank").alias("rank1"))
    last = level.select(*_DOC, F.col("seq").alias("tail"), F.col("rank").alias("rank2"))
    pairs = written(here.join(first, [*_DOC, "seq"]).withColumn("tail", F.col("seq") + F.col("n") - depth)
                    .join(last, [*_DOC, "tail"])
                    .select("ord", *_DOC, "seq", "n", "rank1", "rank2"), f"lines-runs-{depth}")
    place = F.struct("ord", *_DOC, "seq")
    by = ["n", "rank1", "rank2"]
    groups = (pairs.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last"))
              .where(F.col("first") != F.col("last")).drop("last"))
    return (salted(pairs, groups, by, salts=8).where(place != F.col("first"))
            .select(*_DOC, F.explode(F.sequence("seq", F.col("seq") + F.col("n") - 1)).alias("seq")))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, seqs): per document which of its worded lines (from 0) are deleted."""
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    rows = (docs.where(F.col(text_col).isNotNull())
            .select(*_keyed(docs, id_col, text_col),
                    F.posexplode(F.filter(lines, _worded)).alias("seq", "line"))
            .select("ord", *_DOC, F.col("seq").cast("long"), F.xxhash64("line").alias("id1"),
                    F.hash("line").alias("id2"), F.length("line").cast("long").alias("chars")))
    # rows that repeat id and text are one document
    level = _ranked(rows, ["id1", "id2"], 1).dropDuplicates([*_DOC, "seq"])
    level = _islands(level, min_chars)
    runs = written(_shortest(level, min_chars), "lines-runs")
    longest = runs.agg(F.max("n")).first()[0] or 0
    depth, gone = 1, _later_runs(runs, level, 1)
    while 2 * depth <= longest:
        after = level.select(*_DOC, (F.col("seq") - depth).alias("seq"), F.col("rank").alias("rank2"))
        pairs = (level.join(after, [*_DOC, "seq"])
                 .select("ord", *_DOC, "seq", F.col("rank").alias("rank1"), "rank2"))
        depth *= 2
        level = _ranked(pairs, ["rank1", "rank2"], depth)
        gone = gone.union(_later_runs(runs, level, depth))
    return gone.distinct().groupBy(*_DOC).agg(F.collect_list("seq").alias("seqs"))


def _worded(line: Column) -> Column:
    return line.rlike(f"[^{SPACE}]")


def _without(text: Column, seqs: Column) -> Column:
    """A text without the worded lines of the given numbers."""
    def bound(array, f):          # the array is a lambda variable, so it is computed once
        return F.transform(F.array(array), f)[0]

    def cut(lines):
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        gone = bound(F.filter(numbers, lambda i: _worded(F.get(lines, i))),
                     lambda worded: F.transform(seqs, lambda s: F.get(worded, s.cast("int"))))
        return F.array_join(F.transform(F.array_except(numbers, gone), lambda i: F.get(lines, i)), "\n")

    return bound(F.split(text, "\n", -1), cut)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document without the later copies of repeated line runs.

    Lines end at ``\\n``; those without a character other than white space stay
    where they are and are passed over. A run of any number of consecutive lines with
    ``min_chars`` or more characters in all is a later copy if the same lines also
    start at an earlier place: in a document with a smaller id, of equal
    ids in that with the smaller key, or further up in the same document; its
    lines are deleted. One row per input row: (id_col, n_lines, n_removed,
    kept_text) and the columns in ``keep``. A null text has 0 lines and stays
    null, an empty one has one line; null ids come last; rows that repeat both id
    and text are one document and treated alike; an empty table gives an empty
    result.
    """
    text = F.col(text_col).cast("string")
    gone = written(repeated_lines(docs, id_col, text_col, min_chars), "lines-gone")
    keep = tuple(c for c in keep if c not in (id_col, "n_lines", "n_removed", "kept_text"))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *_keyed(docs, id_col, text_col)[1:],
                       F.struct(*keep).alias("kept") if keep else F.lit(None).cast("string").alias("kept"))
    out = rows.join(gone, _DOC, "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce(F.size("seqs"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("seqs").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("seqs"))).alias("kept_text"),
        *[F.col(f"kept.`{c}`").alias(c) for c in keep])
