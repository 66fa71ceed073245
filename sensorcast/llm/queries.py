"""One query per operator over the driver's tables, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import table
from .conversations import prefix_trie
from .language import fit, identify
from .licenses import scan_licenses
from .lines import dedup_lines
from .mixing import mix_sources
from .near import ngram_jaccard
from .neighbours import nearest
from .odd_sketches import near_duplicates
from .packing import byte_bpe, pack
from .quality import quality_rules
from .spelling import spelling_variants
from .substrings import remove_repeats
from .url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    def add(f):
        QUERIES[name] = f
        if statement:
            SQL[name] = statement
        return f
    return add


@query("op1_mix_sources", sql.MIX)
def _mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


# The rules of the query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"),
             ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op2_url_filter", sql.URLS)
def _urls(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


@query("op3_license_scan")
def _licenses(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op8_quality_rules")
def _quality(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op9_language_id")
def _language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def tokenizer():
    import public_tokenizers as P
    return byte_bpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))


@query("op7_packing")
def _pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer(), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op10_nearest_neighbours")
def _nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_ngram_jaccard", sql.JACCARD)
def _jaccard(spark, sf_dir):
    return ngram_jaccard(table(spark, sf_dir, "documents")).drop("keep")


@query("op4_substring_dedup", sql.REPEATS)
def _repeats(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op5_line_dedup", sql.LINES)
def _lines(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op11_spelling_variants", sql.SPELLING)
def _spelling(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_minhash_near_dedup", sql.NEAR)
def _near(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op13_conversation_trie", sql.TRIE)
def _trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))
