"""Small fixtures with nulls, empty and long texts, ties and repeated rows."""

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
for p in (os.path.dirname(HERE), os.path.dirname(os.path.dirname(HERE))):
    if p not in sys.path:
        sys.path.insert(0, p)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from sensorcast.session import get_spark
    s = get_spark(cpus="*", shuffle_partitions=8)
    yield s


def documents(spark, rows, schema=SCHEMA):
    """Rows (doc_id, text[, lang[, source]]) as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None,
             None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, schema)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and then some more words follow here", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "a"),
    (4, " \t\n ", "fr", None),
    (5, LONG, "en", "b"),
    (6, "the quick brown fox jumps over the lazy dog and then some more words follow here", "en", "b"),
    (6, "the quick brown fox jumps over the lazy dog and then some more words follow here", "en", "b"),
    (None, "the quick brown fox jumps over the lazy dog and then some more words follow now", None, None),
    (8, "Ünïcödé ☃ text\nthe MIT License\n\nthe MIT License", "de", "c"),
    (9, "one two", "en", "c"),
    (10, "one two", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns named like columns of the results."""
    from pyspark.sql import functions as F
    return documents(spark, ODD).withColumns({
        "score": F.lit("x"), "row": F.lit(1), "keep": F.lit("k"), "id": F.lit("i"), "size": F.lit(-1),
        "host": F.lit("h"), "rank": F.lit(0), "n_words": F.lit("n"), "block": F.lit(3)})


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])


SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
