"""URL filters: host-suffix and path-prefix expressions, matched by hash.

Every url is expanded into (host suffix, path prefix) expressions. Expressions
and rules meet in an equi join on a short prefix of their SHA-256; the full
digests are then compared, and the longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, salted

#: Hex digits of the digest that the join key keeps (32 bits).
KEY_DIGITS = 8


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased; empty for null and for a url without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _labels(host: Column) -> Column:
    """Number of a host's labels, empty ones included."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id",
                url_col: str = "url", default: str = "allow", salts: int = 16) -> DataFrame:
    """Verdict of every url under ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains if the url's path starts with the
    rule's path; the rule with the longest host + path wins, of equally long
    ones that with the longer host, then ``block`` before ``allow``. Without a
    fitting rule the verdict is ``default`` and ``rule`` is null.

    One row per input row: (id_col, host, path, rule, verdict). Repeated rows
    give repeated results, null urls have empty host and path, null ids stay
    null, an empty table gives an empty result. Rules with a null host or path
    are ignored, a rule given twice counts once.
    """
    rules = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
             .select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"),
                     F.col("verdict").alias("r_verdict"))
             .withColumn("digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256))
             .groupBy("r_host", "r_path", "digest")
             .agg(F.max("r_verdict").alias("r_verdict"))
             .withColumn("key", F.substring("digest", 1, KEY_DIGITS)))
    # Prefixes are cut where some rule ends and suffixes begin where some rule does: one
    # number per path length and label count in the rules, at most as many as the longest
    # rule has characters. A host of many labels makes no more suffixes than that.
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    labels = sorted(r[0] for r in rules.select(_labels(F.col("r_host"))).distinct().collect())

    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                        host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"),
                    lambda n: n <= F.length("path"))
    ends = F.filter(F.array(*[F.lit(n) for n in labels]).cast("array<int>"),
                    lambda n: n <= _labels(F.col("host")))
    expressions = (urls
                   .withColumn("end", F.explode_outer(ends))
                   .withColumn("suffix", F.expr("substring_index(host, '.', -end)"))
                   .withColumn("cut", F.explode_outer(cuts))
                   .withColumn("prefix", F.expr("substring(path, 1, cut)"))
                   .withColumn("full", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256))
                   .withColumn("key", F.when(F.col("cut").isNotNull() & F.col("end").isNotNull(),
                                             F.substring("full", 1, KEY_DIGITS))))
    hit = ((F.col("digest") == F.col("full")) & (F.col("r_host") == F.col("suffix"))
           & (F.col("r_path") == F.col("prefix")))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"),
                    F.length("r_host").alias("h"), F.col("r_verdict").alias("verdict"),
                    F.concat("r_host", "r_path").alias("rule"))
    best = (salted(expressions, rules, ["key"], "left", salts)
            .groupBy("row", "id", "host", "path")
            .agg(F.max(F.when(hit, rank)).alias("best")))
    return best.select(F.col("id").alias(id_col), "host", "path",
                       F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
