"""What several operators of this package share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# White space between words, and the letters that are lower-cased.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Paths of the tables written inside the innermost ``recorded`` block.
_record: list[list[str]] = []


@contextmanager
def recorded():
    """A list that gets the path of every scratch table written in the block."""
    _record.append([])
    try:
        yield _record[-1]
    finally:
        _record.pop()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: what follows
    starts from files that every executor sees, not from lineage."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    if _record:
        _record[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text; null and empty texts have none.

    Runs of white space become one space, so the spaces left over count the
    words; no array of words is built."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))
    spaces = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(squeezed == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def known_small(df: DataFrame) -> bool:
    """Whether Spark plans ``df`` at a size that it would broadcast."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def salted(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
           salts: int = 16) -> DataFrame:
    """Equi join whose left side may have a hot key and whose right side has one
    small row per key: the left rows of a key are dealt over ``salts`` tasks
    and the right rows are repeated for each. A right side that Spark knows to be
    small is broadcast as it is: its repeated rows would be planned at the same size."""
    if any(c.lower() == "_salt" for c in left.columns + right.columns):
        raise ValueError("_salt is a reserved column name")
    if known_small(right):
        return left.join(right, on, how)
    rest = [c for c in left.columns if c not in on] or on
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)))
    return (spread.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"),
                                                                       F.lit(salts - 1).cast("long")))),
                        [*on, "_salt"], how).drop("_salt"))
