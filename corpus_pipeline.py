"""From documents to packed training sequences, one operator per stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns they were given; columns beyond those of ``documents`` ride along, and
``n_chars`` follows a text that a stage changes.

A stage's scratch tables are deleted when the next one begins: by then the stage's
result is written, as said above. Don't call a stage on the unwritten result of the
one before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorcast.llm.common import dropped, recorded, table, written
from sensorcast.llm.language import fit, identify
from sensorcast.llm.lines import dedup_lines
from sensorcast.llm.mixing import first_words, mix_sources
from sensorcast.llm.near import ngram_jaccard
from sensorcast.llm.packing import byte_bpe, pack

#: A text whose best language has a smaller share of its letters is rejected.
MIN_LANGUAGE_SHARE = 0.5


def _whole(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the whole row as ``doc``."""
    return docs.select(F.struct(*docs.columns).alias("doc"), *names)


def _with_text(docs: DataFrame, text: Column) -> Column:
    """The row ``doc`` with another text."""
    doc = F.col("doc").withField("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        doc = doc.withField("n_chars", F.length(text).cast(kind))
    return F.when(text.eqNullSafe(F.col("doc.text")), F.col("doc")).otherwise(doc)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; null, letterless and evenly mixed
    texts go, and all texts if no document names a language to learn from."""
    model = fit(docs)
    found = identify(_whole(docs, "doc_id", "text"), model, keep=("doc",))
    return (found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE))
            .select("doc.*"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated lines; those of which nothing
    is left go."""
    found = dedup_lines(_whole(docs, "doc_id", "text"), keep=("doc",))
    empty = (F.col("n_removed") > 0) & ~F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    return (found.where(~F.coalesce(empty, F.lit(False)))
            .select(_with_text(docs, F.col("kept_text")).alias("doc")).select("doc.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.
    Of rows that repeat id and text one stays."""
    i = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    t = F.coalesce(F.col("text"), F.lit(""))
    keyed = _whole(docs, "doc_id", "text").withColumns({
        "key1": F.xxhash64(i, t), "key2": F.xxhash64(F.lit(1), t, i)})
    groups = written(ngram_jaccard(keyed, carry=("key1", "key2")), "pipeline-near")
    stay = written(groups.where("keep").select("key1", "key2").distinct(), "pipeline-stay")
    again = written(groups.groupBy("key1", "key2").count().where("count > 1").select("key1", "key2"),
                    "pipeline-again")
    left = keyed.join(stay, ["key1", "key2"], "left_semi")
    if again.isEmpty():
        return left.select("doc.*")
    return (left.join(again, ["key1", "key2"], "left_anti")
            .unionByName(left.join(again, ["key1", "key2"], "left_semi").dropDuplicates(["key1", "key2"]))
            .select("doc.*"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once per whole epoch, and once
    more, cut after its last word taken, where the budget ends. Documents that it
    does not take go."""
    mixed = mix_sources(_whole(docs, "doc_id", "text", "source"), keep=("doc",))
    last = F.when(F.col("cut") > 0, 1).otherwise(0)
    copies = (mixed.where("taken > 0")
              .withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("epochs") + last).cast("int")))))
    cut = (F.col("copy") > F.col("epochs")) & (F.col("cut") < F.col("size"))
    text = F.when(cut, first_words(F.col("doc.text"), F.col("cut"))).otherwise(F.col("doc.text"))
    return copies.withColumn("text", text).select(
        _with_text(docs, F.col("text")).alias("doc")).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece of a document, with its ids."""
    tokenizer = byte_bpe(public_tokenizers.path("byte_bpe_50k.json"),
                         public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pack(docs, tokenizer)


_scratch: dict[str, list[str]] = {}      # of each stage's last call


def _stage(name: str, f, before: str | None):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        dropped(spark, _scratch.pop(before, []))
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        _scratch[name] = paths
        return out
    run_stage.__doc__ = f.__doc__
    return name, run_stage


STAGES = [_stage("language_id", language, None), _stage("line_dedup", line_dedup, "language_id"),
          _stage("ngram_jaccard", near_duplicates, "line_dedup"), _stage("mix_sources", mixing, "ngram_jaccard"),
          _stage("packing", packing, "mix_sources")]

# SQL has neither the language model nor the tokenizer; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next begins."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            with recorded() as paths:
                docs = written(docs, f"pipeline-{name}")
            if last:                     # the input of this stage has been read
                dropped(spark, last)
            last = paths
    return docs
