"""Registered queries against their SQL, and the pipeline's stages."""

from collections import Counter

import numpy as np
import pytest
from conftest import SF_MID, SF_SMALL, documents
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as C
from oracle_check import compare, duck
from sensorcast.llm import near
from sensorcast.llm.common import table, written
from sensorcast.llm.queries import QUERIES, SQL


def test_all_queries_are_registered():
    got = E.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in got) == 1
    assert "pipeline" in got


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL).toPandas(), duck(SF_SMALL).execute(SQL[name]).df())
    assert ok, msg


def test_pipeline_rows(spark):
    docs = table(spark, SF_SMALL, "documents")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert docs.columns == columns, name
        sizes.append(docs.count())
        assert docs.where("n_chars <> length(text)").isEmpty()
    assert sizes[1] > 0.95 * sizes[0] and sizes[2] <= sizes[1] and 0 < sizes[3] <= sizes[2]
    pieces = C.STAGES[-1][1](spark, docs, SF_SMALL).toPandas()
    whole = pieces.groupby("doc_id")["length"].sum()
    assert set(whole.index) == {r.doc_id for r in docs.select("doc_id").collect()}
    # no two documents that go into the mix are near copies
    left = written(C.near_duplicates(spark, written(C.line_dedup(spark, table(spark, SF_SMALL, "documents"), SF_SMALL),
                                                    "t"), SF_SMALL), "t")
    again = near.ngram_jaccard(left).collect()
    assert all(r.keep for r in again)


def test_run_equals_stages_and_agrees_with_itself(spark):
    a, b = (Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset)
                    for r in C.run(spark, SF_SMALL).collect()) for _ in range(2))
    assert a and a == b


@pytest.mark.parametrize("k", range(len(C.STAGES)))
def test_stage_odd_rows(spark, odd, empty, k):
    name, stage = C.STAGES[k]
    out = stage(spark, odd, SF_MID)
    if k + 1 < len(C.STAGES):
        assert out.columns == odd.columns
    rows = out.collect()
    assert rows or name == "language_id"
    nothing = stage(spark, empty, SF_MID)
    assert nothing.count() == 0


def test_language_stage_rejects_letterless(spark):
    docs = table(spark, SF_SMALL, "documents")
    more = documents(spark, [(10**9, "123 456 !!"), (10**9 + 1, None), (10**9 + 2, "")])
    got = C.language(spark, docs.unionByName(more), SF_SMALL)
    assert got.where(F.col("doc_id") >= 10**9).isEmpty()
    assert got.count() > 0.95 * docs.count()


def test_line_stage_deletes_repeats_of_any_length(spark):
    three, seven = ([x * n for x in "abcdefg"[:k]] for k, n in ((3, 25), (7, 14)))
    docs = documents(spark, [(1, "\n".join(["one", *three, "two"])), (2, "\n".join(["new", *three, "end"])),
                             (3, "\n".join(["x", *seven])), (4, "\n".join(["y", *seven, "z"]))])
    got = {r.doc_id: r.text for r in C.STAGES[1][1](spark, docs, SF_SMALL).collect()}
    assert got[2] == "new\nend" and got[4] == "y\nz" and len(got[1]) == 85 and got[3].count("\n") == 7


def test_near_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = documents(spark, [(5, text), (3, text + " tail"), (3, text + " tail"), (9, "own words only here now"),
                             (None, text), (7, None), (8, "")])
    got = C.near_duplicates(spark, docs, SF_SMALL).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [
        (3, text + " tail"), (7, ""), (8, ""), (9, "own words only here now")]


def test_mix_stage_repeats_and_cuts(spark):
    rows = [(i, " ".join(f"a{i}_{k}" for k in range(50)), "en", "a") for i in range(40)]
    rows += [(100 + i, " ".join(f"b{i}_{k}" for k in range(50)), "en", "b") for i in range(4)]
    got = C.mixing(spark, documents(spark, rows), SF_SMALL).collect()
    n = Counter()
    for r in got:
        n[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert n == {"a": 2200 - 600, "b": 600}
    assert {len(r.text.split()) for r in got if r.source == "b"} == {50}
    assert np.array([len(r.text.split()) for r in got]).min() > 0
