"""Operators that judge each row: licenses, quality, language, url filters."""

import re
import time
from collections import Counter

import numpy as np
import pytest
from conftest import LONG, ODD, SF_MID, SF_SMALL, documents  # noqa: F401

from sensorcast.llm import language, licenses, quality
from sensorcast.llm.common import n_words, table
from sensorcast.llm.url_filter import filter_urls
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return df.toPandas().sort_values("doc_id", na_position="last").reset_index(drop=True)


def test_n_words(spark, odd):
    got = odd.select("text", n_words(F.col("text")).alias("n")).collect()
    assert [r.n for r in got] == [len(WORD.findall(r.text or "")) for r in got]


# --- licenses -------------------------------------------------------------
def plain_scan(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(labels)))


def check_scan(docs):
    texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == docs.count()
    want = Counter((d, *plain_scan(t)) for d, t in
                   [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert want == Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    return texts


def test_licenses_against_plain_search(spark, odd):
    check_scan(table(spark, SF_MID, "documents"))
    check_scan(odd)


def test_license_phrases_may_touch(spark, empty):
    d = documents(spark, [(1, "MIT License MIT license, apache LICENSE general public license")])
    r = licenses.scan_licenses(d).first()
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (4, 0, 6, "apache,gpl,mit")
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize("text, accepted", [
    ("a b c", True), ("a b x c", True), ("a b x y c", True), ("a b x y z c", False), ("a b", False)])
def test_automaton_optional_and_replaceable(text, accepted):
    a = licenses.compile_template("t", "a b [[x]] {{0-1}} c")
    assert (a.run(iter(text.encode().split())) == 1.0) == accepted


def test_license_templates_are_found(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this "
           "Program and documents (the \"Software\"), to deal in the Software without restriction, "
           "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
           "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
           "is furnished to do so, subject to the following conditions:")
    broken = mit.replace("merge", "mangle")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(documents(spark, [
        (1, mit), (2, broken), (3, "Licensed under the Apache License, Version 2.0."),
        (4, "Licensed under CC BY-NC 4.0."), (5, "nothing here")])).collect()}
    assert got[1][0] == "mit" and got[1][1] == 1.0
    assert got[2][0] == "" and 0 < got[2][1] < 1
    assert got[3] == ("apache,apache-2.0", 1.0) and got[4] == ("cc-by-nc", 1.0) and got[5] == ("", 0.0)


def test_license_openings_are_not_whole_licenses(spark):
    fill = {r"\[\[[^\]]*\]\]": "", r"\{\{\d+-\d+\}\}": "word"}
    for label, opening in (("mit-full", "mit"), ("bsd-2-clause", "bsd"), ("bsd-3-clause", "bsd"), ("isc-full", "isc")):
        whole = licenses.TEMPLATES[label]
        for mark, words in fill.items():
            whole = re.sub(mark, words, whole)
        changed = whole.rsplit(" ", 3)[0] + " for good not evil"
        got = [r.labels.split(",") for r in licenses.scan_licenses(
            documents(spark, [(1, whole), (2, changed)])).orderBy("doc_id").collect()]
        assert got == [sorted({label, opening}), [opening]]


def test_license_scan_is_linear():
    text = ("mit license xx " * 70_000).encode()
    phrases = {b" " + k.encode() + b" ": v for k, v in licenses.PHRASES.items()}
    began = time.process_time()
    n, n_base, first, last, *_ = licenses.scan_text(text, phrases, [])
    assert (n, n_base, first, last) == (210_000, 70_000, 0, 209_997) and time.process_time() - began < 1


# --- quality --------------------------------------------------------------
def plain_quality(text):
    t = text or ""
    words = WORD.findall(t)
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    cover = set()
    for i in range(len(words) - 2):
        if tri[tuple(words[i:i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)),
            len(lines) - len(set(lines)), len(cover), failed)


def test_quality_counts_against_plain_count(spark, odd, empty):
    for docs in (table(spark, SF_MID, "documents"), odd):
        want = Counter((r.doc_id, *plain_quality(r.text)) for r in docs.select("doc_id", "text").collect())
        rows = quality.quality_rules(docs).collect()
        assert want == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                                r.n_repeat_words, r.base_failed) for r in rows)
        assert not any(r.kept for r in rows if r.base_failed)
    assert quality.quality_rules(empty).count() == 0


def test_quality_keeps_clean_and_drops_foreign_histograms(spark):
    docs = table(spark, SF_MID, "documents")
    labels = table(spark, SF_MID, "labels")
    rows = quality.quality_rules(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    clean = rows[(rows["quality"] == 1)]
    assert clean["kept"].mean() > 0.99
    odd_text = " ".join("@@## %% 12345 || <<>> 99"[i % 20:] + "##" for i in range(400))
    refs = quality.language_references(docs)
    got = quality.quality_rules(documents(spark, [(1, odd_text)]), references=refs).first()
    assert not got.kept


def test_quality_of_rare_languages(spark):
    rng = np.random.default_rng(5)

    def text(letters, n):
        return " ".join("".join(letters[j] for j in rng.integers(0, 6, 2)) for _ in range(n))
    docs = documents(spark, [(i, text("abcdef", 8000), "en") for i in range(200)]
                     + [(1000, text("абвгде", 1200), "ru"), (1001, text("กขคงจฉ", 200), "th"),
                        (1002, text("กขคงจฉ", 200), None)])
    refs = {r["lang"]: r for r in quality.language_references(docs)}
    assert sorted(refs) == ["en", "ru"]           # ru has under 0.1% of all words
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert kept[1000] and kept[1001] and not kept[1002] and all(kept[i] for i in range(200))


def test_quality_word_counts_are_exact(spark):
    # every word is far below any share of its batch
    docs = documents(spark, [(i, " ".join(f"w{j}" for j in range(i, i + 4000)), "en") for i in range(20)])
    want = Counter(w for r in docs.collect() for w in r.text.split())
    ref, = quality.language_references(docs)
    top = sorted(want.items(), key=lambda x: (-x[1], x[0].encode()))[:quality.COMMON_WORDS]
    assert list(ref["words"].items()) == [(w.encode(), n) for w, n in top]
    assert ref["word_hist"].sum() == sum(want.values())


def test_jensen_shannon_distance():
    a = np.array([1.0, 0, 3])
    assert quality.distance(a, a * 7) == 0
    assert quality.distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality.distance(a, np.zeros(3)) == 1


# --- language -------------------------------------------------------------
def best_path(scores, penalty):
    """Viterbi over all label sequences of a short text, by brute force."""
    import itertools
    n, k = scores.shape
    best = max(itertools.product(range(k), repeat=n), key=lambda p: sum(scores[i, x] for i, x in enumerate(p))
               - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False)))
    return sum(scores[i, x] for i, x in enumerate(best)) - penalty * sum(
        a != b for a, b in zip(best, best[1:], strict=False))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    texts = [rng.normal(size=(n, 3)).astype(np.float32) for n in (5, 0, 1, 6, 3)]
    for s, p in zip(texts, language.viterbi(texts, 1.0), strict=True):
        assert len(p) == len(s)
        if len(s):
            value = sum(s[i, x] for i, x in enumerate(p)) - sum(a != b for a, b in zip(p, p[1:], strict=False))
            assert value == pytest.approx(best_path(s, 1.0), abs=1e-4)


def test_language_held_out_accuracy_and_rules(spark, odd, empty):
    import zlib
    docs = table(spark, SF_MID, "documents")
    model = language.fit(docs)
    got = language.identify(docs, model, keep=("lang",)).toPandas()
    assert len(got) == docs.count()
    out = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]])
    assert (got["held_out"] == out).all()
    assert (got["lang_pred"] == got["lang"])[out].mean() > 0.97
    assert got["score"].between(0, 1).all()
    rows = language.identify(odd, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (2, 3, 4))
    assert language.identify(empty, model).count() == 0
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


def test_language_learns_every_label(spark):
    rng = np.random.default_rng(7)
    langs = [f"l{i:03d}" for i in range(230)]
    vocabulary = {x: ["".join(chr(97 + j) for j in rng.integers(0, 26, 6)) for _ in range(12)] for x in langs}
    docs = documents(spark, [(i * 230 + k, " ".join(rng.choice(vocabulary[x], 60)), x)
                             for k, x in enumerate(langs) for i in range(12)])
    model = language.fit(docs)
    assert model.langs == langs and model.scores.shape == (language.BUCKETS, len(langs))
    got = language.identify(docs, model, keep=("lang",)).where("held_out").toPandas()
    assert set(got["lang"]) == set(got["lang_pred"]) and (got["lang"] == got["lang_pred"]).mean() > 0.99


def test_language_does_not_change_with_the_number_of_labels(spark):
    rng = np.random.default_rng(8)
    rows = [(i, r.text, r.lang) for i, r in enumerate(table(spark, SF_SMALL, "documents").where("lang is not null").collect())]
    few = language.fit(documents(spark, rows))
    # 300 more labels in a script of their own
    more = [(10_000 + 8 * k + i, " ".join("".join(chr(0x10A0 + c) for c in rng.integers(0, 38, 5)) for _ in range(9)), f"x{k}")
            for k in range(300) for i in range(4)]
    many = language.fit(documents(spark, rows + more))
    assert len(many.langs) == len(few.langs) + 300
    at = [many.langs.index(x) for x in few.langs]
    assert (many.scores[:, at] == few.scores).all()
    a, b = ({r.doc_id: (r.lang_pred, r.spans) for r in language.identify(documents(spark, rows), m).collect()}
            for m in (few, many))
    assert a == b


def test_language_of_letters_in_high_planes(spark):
    model = language.fit(documents(spark, [(i, "\u6f22\u5b57 \u6587", "zh") for i in range(9)]))
    rows = language.identify(documents(spark, [(1, chr(0x30010) * 3), (2, chr(0xE0001)), (3, chr(0x1F600))]), model).collect()
    assert [r.lang_pred for r in rows] == ["zh", "und", "und"]


def test_language_is_fitted_on_whole_texts(spark):
    same = "the common opening of all " * 600                  # 3,000 words
    rows = [(i, same + own * 400, lang) for i, (own, lang) in
            enumerate([("kolo mapa ", "aa"), ("verk stig ", "bb")] * 10)]
    model = language.fit(documents(spark, rows))
    got = {r.doc_id: r.lang_pred for r in language.identify(
        documents(spark, [(1, "kolo mapa"), (2, "verk stig")]), model).collect()}
    assert got == {1: "aa", 2: "bb"}


def test_language_spans_of_mixed_text(spark):
    docs = table(spark, SF_MID, "documents")
    model = language.fit(docs)
    by = {r.lang: r.text for r in docs.where("n_chars > 1500").select("lang", "text").collect()}
    en, fr = by["en"].split()[:60], by["fr"].split()[:40]
    r = language.identify(documents(spark, [(1, " ".join(en + fr))]), model).first()
    assert r.lang_pred == "en" and 0.4 < r.score < 0.8
    assert r.spans[0].first_word == 0 and r.spans[-1].last_word == 99
    assert all(a.last_word + 1 == b.first_word for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert r.spans[-1].lang == "fr" and abs(r.spans[-1].first_word - 60) <= 3


# --- urls -----------------------------------------------------------------
def plain_verdict(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def test_urls_against_every_rule(spark):
    urls = [None, "", "no scheme.com/", "http://", "HTTP://WWW.Example.COM/en/x?q=/es/#f", "http://example.com",
            "https://example.com/en", "https://m.example.com/en/1", "http://a.net/es/", "http://net/es/?x",
            "http://xnet/es/", "http://a.b.c.www.example.com/en/", "http://example.com./en/", "x://y://z.com/",
            "http://user@example.com:80/en/", "http://ex.com/ü/é?ö", "http://ex.com/" + "a/" * 5000,
            "http://" + "a." * 20_000 + "www.example.com/en/", "http://" + "." * 300 + "/en/"]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("ex.com", "/ü", "block"), ("ex.com", "", "allow"), ("net", "/es/", "block")]
    pages = spark.createDataFrame([(i, u, "h", 5) for i, u in enumerate(urls)] + [(3, urls[4], "h", 5)],
                                  "page_id long, url string, host string, verdict int")
    r = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    got = Counter((x.page_id, x.host, x.path, x.rule, x.verdict) for x in filter_urls(pages, r).collect())
    want = Counter((i, *plain_verdict(u, rules)) for i, u in enumerate(urls)) + Counter([(3, *plain_verdict(urls[4], rules))])
    assert got == want
    assert filter_urls(pages.limit(0), r).count() == 0
    none = filter_urls(pages, r.limit(0)).collect()
    assert len(none) == len(urls) + 1 and {x.verdict for x in none} == {"allow"} and {x.rule for x in none} == {None}
