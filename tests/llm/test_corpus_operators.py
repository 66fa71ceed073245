"""Operators over the whole corpus, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ODD, SF_MID, SF_SMALL, documents
from pyspark.sql import functions as F

from sensorcast.llm import fingerprints, lines, mixing, near, neighbours, packing, substrings
from sensorcast.llm.common import table
from sensorcast.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def made_up(seed, n, vocabulary=40, size=60):
    """Documents that copy passages, lines and whole texts from each other."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(vocabulary * 20)]
    docs, pool = [], []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randint(0, size))
        kind = rng.random()
        if pool and kind < 0.25:
            w = list(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
        elif pool and kind < 0.5:
            p = rng.choice(pool)
            a = rng.randint(0, len(p))
            w = w[:20] + p[a:a + rng.randint(5, 30)] + w[20:]
        pool.append(w)
        docs.append((i * 3 % 101 + i // 101 * 101, "".join(x + rng.choice([" ", "  ", "\n"]) for x in w), "en",
                     rng.choice(["a", "a", "b", None])))
    return docs


# --- fingerprints -----------------------------------------------------------
def test_word_hashes_do_not_depend_on_place_or_piece(monkeypatch):
    text = (" ".join(f"w{i % 50}" for i in range(3000)) + " \t\n" + "z" * 500 + " end ").encode()
    whole = fingerprints.word_hashes(text)
    w = text.split()
    assert len(whole) == len(w) and len(set(whole.tolist())) == len(set(w))
    monkeypatch.setattr(fingerprints, "PIECE", 64)
    assert (fingerprints.word_hashes(text) == whole).all()
    assert len(fingerprints.word_hashes(b"")) == 0 and len(fingerprints.word_hashes(b" \n" * 100)) == 0


def test_packed_numbers():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000).astype(np.uint64))
    assert (fingerprints.unpack(fingerprints.pack(x)) == x).all()
    assert len(fingerprints.unpack(fingerprints.pack(x[:0]))) == 0


def test_shared_fingerprints_against_counting(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 7)
    rng = random.Random(4)
    sets = [sorted({rng.randrange(400) * 10**11 for _ in range(rng.randint(0, 30))}) for _ in range(60)]
    sets += [sets[0]] * 9
    df = spark.createDataFrame([(i, bytearray(np.array(s, "<u8").tobytes())) for i, s in enumerate(sets)],
                               "i long, raw binary").repartition(4)

    def extract(raw):
        a = np.frombuffer(raw, "<u8").astype(np.uint64)
        return a, len(a), 1, 2
    got = fingerprints.shared_fingerprints(df.select(F.struct("i").alias("payload"), "raw"), extract, 5).collect()
    count = Counter(x for s in sets for x in s)
    assert len(got) == len(sets)
    for r in got:
        s = sets[r.payload.i]
        assert r.n == len(s)
        shared = fingerprints.unpack(r.shared).tolist()
        assert shared == [x for x in s if count[x] > 1]
        assert np.frombuffer(r.df, "<u4").tolist() == [count[x] for x in shared]


# --- substring dedup ----------------------------------------------------------
def plain_repeats(rows, window=13):
    order = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, float("inf")), order(d))
    out = Counter()
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < order(d):
                gone |= set(range(i, i + window))
        out[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


def repeats(docs, window=13):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text)
                   for r in substrings.remove_repeats(docs, window=window).collect())


def test_substrings_against_all_windows(spark, odd, empty):
    for docs in (documents(spark, made_up(1, 150)), odd):
        assert repeats(docs) == plain_repeats(rows_of(docs))
    assert not repeats(empty)


def test_substrings_with_frequent_grams_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GRAM_WORDS", 13)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 50)
    docs = documents(spark, made_up(2, 80, vocabulary=1))
    assert repeats(docs) == plain_repeats(rows_of(docs))


def test_windows_of_frequent_grams_meet_in_no_arrow_group(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GRAM_WORDS", 60)
    plans, write = {}, substrings.written

    def record(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)
    monkeypatch.setattr(substrings, "written", record)
    # one passage in every document, each time with other words around it
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, f"{' '.join(f'a{i}x{k}' for k in range(9))} {passage} {' '.join(f'z{i}x{k}' for k in range(9))}")
            for i in range(40)]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(documents(spark, docs)).collect()}
    assert got == {i: 40 if i else 0 for i in range(40)}
    # only the pieces of other grams, of GRAM_WORDS words at most, are dealt to shards
    assert plans["sub-judged"].count("FlatMapGroupsInArrow") == 1


def test_substrings_of_long_repetitive_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE_WINDOWS", 16)
    texts = [" ".join(["spam"] * n) for n in (200, 90, 41)] + [
        "start " + " ".join(["spam"] * 120) + " end", " ".join(["ham spam"] * 70), " ".join(["spam ham"] * 70)]
    docs = documents(spark, list(enumerate(texts)))
    for words in (10_000, 100):          # in shards, and window by window
        monkeypatch.setattr(substrings, "GRAM_WORDS", words)
        assert repeats(docs) == plain_repeats(rows_of(docs))
    # no piece is longer than its bound, however long the text
    tables, write = {}, substrings.written

    def record(df, name):
        tables[name] = write(df, name)
        return tables[name]
    monkeypatch.setattr(substrings, "written", record)
    substrings.remove_repeats(docs).collect()
    assert 1 < tables["sub-pieces"].agg(F.max("n")).first()[0] <= 16


def test_fm_index_intervals():
    rng = np.random.default_rng(5)
    seq = np.append(rng.integers(1, 4, 300), 0)
    index = substrings.FMIndex(seq, 8)
    for _ in range(200):
        p = rng.integers(1, 4, rng.integers(1, 8))
        low, high = np.array([0]), np.array([len(seq)])
        for c in p[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        want = sum((seq[i:i + len(p)] == p).all() for i in range(len(seq) - len(p) + 1))
        assert max(0, high[0] - low[0]) == want


# --- line dedup ------------------------------------------------------------------
def plain_lines(rows, min_chars):
    """Every run of worded lines at its first place stays."""
    docs = {}
    for d, t in rows:
        if t is not None:
            docs[(float("inf") if d is None else d, t)] = [x for x in t.split("\n") if WORD.search(x)]
    first = {}
    runs = []
    for key, l in docs.items():
        k = 1
        while k <= len(l):
            for i in range(len(l) - k + 1):
                s = tuple(l[i:i + k])
                first[s] = min(first.get(s, (float("inf"),)), (key[0], i))
                if sum(map(len, s)) >= min_chars:
                    runs.append((key, i, s))
            k += 1
    gone = defaultdict(set)
    for key, i, s in runs:
        if first[s] < (key[0], i):
            gone[key] |= set(range(i, i + len(s)))
    out = Counter()
    for d, t in rows:
        if t is None:
            out[d, 0, 0, None] += 1
            continue
        g = gone[(float("inf") if d is None else d, t)]
        at, kept = 0, []
        for x in t.split("\n"):
            worded = bool(WORD.search(x))
            if not (worded and at in g):
                kept.append(x)
            at += worded
        out[d, len(t.split("\n")), len(g), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("min_chars", [1, 6, 25])
def test_lines_against_all_runs(spark, min_chars):
    rng = random.Random(min_chars)
    docs = [(i, "\n".join(rng.choice(["", " ", "a b", "cd", "e", "fgh ij", "x" * 9, f"own {i}"])
                          for _ in range(rng.randint(0, 25)))) for i in range(60)]
    df = documents(spark, docs)
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text)
                  for r in lines.dedup_lines(df, min_chars=min_chars).collect())
    assert got == plain_lines(docs, min_chars)


def test_lines_odd_rows(spark, odd, empty):
    got = lines.dedup_lines(odd, min_chars=5, keep=("source", "n_words")).collect()
    assert len(got) == len(ODD) and {r.n_words for r in got} == {"n"}
    left = defaultdict(list)
    for r in got:
        left[r.doc_id].append(r.kept_text)
    assert left[2] == [None] and left[3] == [""] and left[6] == ["", ""]      # a copy of 1, given twice
    assert left[8] == ["Ünïcödé ☃ text\nthe MIT License\n"] and left[10] == [""] and left[9] == ["one two"]
    assert lines.dedup_lines(empty).count() == 0


def runs_of_any_length(rows, min_chars):
    """(doc, deleted worded lines) where runs of every length count."""
    docs = {d: [x for x in t.split("\n") if WORD.search(x)] for d, t in rows}
    first, gone = {}, {d: set() for d in docs}
    for d in sorted(docs):
        for i in range(len(docs[d])):
            for k in range(1, len(docs[d]) - i + 1):
                s = tuple(docs[d][i:i + k])
                if first.setdefault(s, (d, i)) < (d, i) and sum(map(len, s)) >= min_chars:
                    gone[d] |= set(range(i, i + k))
    return gone


@pytest.mark.parametrize("min_chars", [1, 6, 25, 60])
def test_lines_maximal_runs(spark, min_chars):
    rng = random.Random(min_chars)
    docs = [(i, "\n".join(rng.choice(["", " ", "a b", "cd", "e", "fgh ij", "x" * 9, f"own {i}"])
                          for _ in range(rng.randint(0, 25)))) for i in range(50)]
    for n, size in ((3, (25,) * 3), (7, (14,) * 7), (3, (45, 45, 10)), (70, (1,) * 70)):
        block = [f"{n}{'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10]}".ljust(c, "z")[-c:] for j, c in enumerate(size)]
        for _ in range(2):
            docs.append((len(docs), "\n".join([f"before {len(docs)}", *block, f"after {len(docs)}"])))
    got = {r.doc_id: (r.n_removed, r.kept_text)
           for r in lines.dedup_lines(documents(spark, docs), min_chars=min_chars).collect()}
    gone = runs_of_any_length(docs, min_chars)
    for d, t in docs:
        worded = [x for x in t.split("\n") if WORD.search(x)]
        left = [x for k, x in enumerate(worded) if k not in gone[d]]
        assert got[d][0] == len(gone[d])
        assert [x for x in got[d][1].split("\n") if WORD.search(x)] == left


# --- Jaccard join --------------------------------------------------------------------
def plain_groups(rows, n=5, percent=80):
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    group = defaultdict(list)
    for i in range(len(rows)):
        group[find(i)].append(i)
    out = Counter()
    for members in group.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[rows[i][0], len(sets[i]), min(ids, default=None)] += 1
    return out, len(group)


@pytest.mark.parametrize("rounds", [0, 2])
def test_jaccard_against_all_pairs(spark, odd, empty, rounds, monkeypatch):
    monkeypatch.setattr(near, "HUB_ROUNDS", rounds)
    for docs in (documents(spark, made_up(7, 200, size=40)), odd):
        got = near.ngram_jaccard(docs).collect()
        want, groups = plain_groups(rows_of(docs))
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
        assert sum(r.keep for r in got) == groups
    assert near.ngram_jaccard(empty).count() == 0


def test_tiled_pairs_are_all_similar_pairs(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE_ROWS", 5)
    rng = np.random.default_rng(4)
    sizes = [int(n) for n in rng.integers(1, 60, 60)] + [4, 5, 16, 20, 25] + [40] * 20
    base = rng.integers(0, 2**47, 70).astype(np.uint64)
    sets = [base[:n] for n in sizes]     # one bucket; similarity is the ratio of the sizes
    rows = [(1, i, n, n, i // 2, near.bitmap(x).tolist()) for i, (n, x) in enumerate(zip(sizes, sets, strict=True))]
    open_ = spark.createDataFrame(rows, "token long, cid long, n long, s long, label long, bits array<long>")
    got = [(r.a, r.b) for r in near._tiled_pairs(open_, 80).collect()]
    want = {(i, j) for j in range(len(sizes)) for i in range(j)
            if i // 2 != j // 2 and 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j])}
    assert len(got) == len(set(got)) and want <= set(got)
    n_of = dict(enumerate(sizes))
    assert all(a < b and 1.3 * min(n_of[a], n_of[b]) >= max(n_of[a], n_of[b]) for a, b in got)


def test_jaccard_chain_of_near_copies(spark):
    base = [f"t{i}" for i in range(200)]
    chain = [(100 - i, " ".join(base[3 * i:] + [f"u{k}" for k in range(3 * i)])) for i in range(12)]
    got = {r.doc_id: r.component_id for r in near.ngram_jaccard(documents(spark, chain)).collect()}
    want, _ = plain_groups(chain)
    assert {(d, c) for d, _, c in want} == set(got.items())


# --- mixing -------------------------------------------------------------------------
def test_targets_share_everything():
    t = mixing.targets([("a", 100), ("b", 10), ("c", 10), ("d", 0)], [1, 2, 3, 1])
    assert t[1:] == [30.0, 30.0, 0.0] and sum(t) == pytest.approx(120)
    assert mixing.targets([("a", 0)], [1]) == [0.0] and mixing.targets([], []) == []


def test_mix_meets_targets(spark, odd, empty):
    for docs in (documents(spark, made_up(9, 300)), odd, table(spark, SF_MID, "documents")):
        got = mixing.mix_sources(docs).toPandas()
        assert len(got) == docs.count()
        assert sorted(got["size"]) == sorted(len(words(t)) for _, t in rows_of(docs))
        assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
        by = got.fillna({"source": "\uffff"}).groupby("source").agg(
            size=("size", "sum"), n=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
        assert (by["size"] == by["n"]).all()
        assert (by["taken"] == np.floor(by["target"])).all()
        again = mixing.mix_sources(docs.repartition(5)).toPandas()
        assert Counter(zip(again["size"], again["taken"], strict=True)) == Counter(zip(got["size"], got["taken"], strict=True))
    assert mixing.mix_sources(empty).count() == 0


def test_mix_deals_rows_without_an_id(spark):
    docs = documents(spark, [(None, f"a b c{i}", None, "s") for i in range(2000)])
    keys = docs.select(mixing.random_key(F.col("doc_id"), F.col("text")).alias("k"))
    assert keys.distinct().count() == 2000
    got = mixing.mix_sources(docs, weights={"s": 1}).toPandas()
    assert len(got) == 2000 and got["taken"].sum() == 6000


def test_mix_ranges_do_not_change_the_result(spark, monkeypatch):
    docs = documents(spark, made_up(10, 200))
    whole = Counter(map(tuple, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 3)
    assert Counter(map(tuple, mixing.mix_sources(docs).collect())) == whole


def test_first_words_keeps_white_space(spark):
    d = documents(spark, [(1, "  a\tb\n\nc  d ")])
    got = d.select(*[mixing.first_words(F.col("text"), F.lit(n)).alias(str(n)) for n in (1, 2, 3, 4)]).first()
    assert list(got) == ["  a", "  a\tb", "  a\tb\n\nc", "  a\tb\n\nc  d"]


# --- packing -------------------------------------------------------------------------
def check_pack(docs, pieces, window=2048):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in rows_of(docs):
        want[d, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (1,)] += 1
    pool = defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        pool[r.doc_id, r.doc_tokens].append((r.start, tuple(ids)))
    # cover every document exactly once
    for (d, ids), k in want.items():
        for _ in range(k):
            at = 0
            while at < len(ids):
                hit = next(x for x in pool[d, len(ids)] if x[0] == at and ids[at:at + len(x[1])] == x[1])
                pool[d, len(ids)].remove(hit)
                at += len(hit[1])
            assert at == len(ids)
    assert not any(pool.values())
    seqs = defaultdict(list)
    for r in pieces:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= window
    return seqs


def test_pack_round_trip(spark, odd, empty):
    for docs in (odd, table(spark, SF_SMALL, "documents"),
                 documents(spark, [(1, "a <|endoftext|> b"), (2, "русский текст 中文 ☃"), (3, "x" * 30_000)])):
        check_pack(docs, packing.pack(docs, tokenizer()).collect())
    assert packing.pack(empty, tokenizer()).count() == 0


def test_pack_depends_on_documents_alone(spark):
    """The same rows in other orders and partitions give the same pieces."""
    docs = table(spark, SF_SMALL, "documents")
    docs = docs.unionByName(docs.limit(9)).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    got = [Counter(tuple(r) for r in packing.pack(d, tokenizer(), window=256, group_windows=16).drop("ids").collect())
           for d in (docs, docs.orderBy(F.desc("text")).coalesce(1), docs.repartition(7, "source"))]
    assert got[0] and got[0] == got[1] == got[2]


def test_pack_cuts_long_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECE", 50)
    docs = documents(spark, [(k, " ".join(f"w{j}" for j in range(k * 40)), "en", "ab"[k % 2]) for k in range(12)])
    check_pack(docs, packing.pack(docs, tokenizer(), window=64, group_windows=4).collect(), 64)


def test_pack_mixture_and_groups(spark):
    docs = table(spark, SF_SMALL, "documents")
    pieces = packing.pack(docs, tokenizer(), window=256, group_windows=16).collect()
    seqs = check_pack(docs, pieces, 256)
    full = sum(sum(n for _, n in s) for s in seqs.values()) / (256 * len(seqs))
    assert full > 0.93
    # every stretch of windows has about the corpus's share of each source
    total = Counter()
    first = Counter()
    middle = sorted(seqs)[len(seqs) // 2]
    for r in pieces:
        total[r.source] += r.length
        if r.sequence_id < middle:
            first[r.source] += r.length
    for s, n in total.items():
        assert first[s] / sum(first.values()) == pytest.approx(n / sum(total.values()), abs=0.02)


def test_round_robin_fills_windows():
    rng = np.random.default_rng(2)
    q = [rng.integers(1, 900, k) for k in (50, 7, 1)]
    got = list(packing.round_robin(q, 512, 64))
    for i, x in enumerate(q):
        assert sum(n for a, _, _, n, _, _ in got if a == i) == x.sum()
    used = Counter()
    for *_, n, w, offset in got:
        assert offset == used[w]
        used[w] += n
    assert all(used[w] == 512 for w in range(max(used)))


def test_round_robin_serves_the_largest_deficit_and_skips_empty_queues():
    rng = np.random.default_rng(9)
    for window, least in ((64, 16), (512, 64), (2048, 256)):
        q = [rng.integers(1, 900, 40), np.array([], np.int64), rng.integers(1, 60, 200), rng.integers(1, 9000, 3)]
        totals = [int(x.sum()) for x in q]
        left, deficit, at, used, want, w = totals[:], [0.0] * 4, [0] * 4, [0] * 4, [], 0
        while sum(left):
            deficit = [d + t / sum(totals) * window for d, t in zip(deficit, totals, strict=True)]
            space = window
            while space and sum(left):
                i = max((k for k in range(4) if left[k]), key=lambda k: (deficit[k], -k))
                n = min(int(q[i][at[i]]) - used[i], space, max(least, int(np.ceil(deficit[i]))))
                want.append((i, at[i], used[i], n, w, window - space))
                deficit[i], left[i], space, used[i] = deficit[i] - n, left[i] - n, space - n, used[i] + n
                if used[i] == q[i][at[i]]:
                    at[i], used[i] = at[i] + 1, 0
            w += 1
        assert list(packing.round_robin(q, window, least)) == want


def test_letters_are_looked_at_only_where_a_text_has_other_than_ascii(monkeypatch):
    import re

    import public_tokenizers as P
    from tokenizers import Tokenizer

    seen, compile_ = [], re.compile

    class Spy:
        def __init__(self, pattern):
            self.pattern = compile_(pattern)

        def search(self, text):
            seen.append(text)
            return self.pattern.search(text)

    load = packing.byte_bpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    with monkeypatch.context() as m:
        m.setattr(re, "compile", lambda p, *a: Spy(p) if p.startswith("[^") else compile_(p, *a))
        encode = load()
    texts = ["plain words, 12 of them", "<|endoftext|> here", "caf\u00e9 \u00df", "\u4f60\u597d <|", "\u0bb5\u0ba3", ""]
    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [list(encode(t)) for t in texts] == [slow.encode(t, add_special_tokens=False).ids for t in texts]
    assert seen == [texts[2], texts[4]]


# --- nearest neighbours ----------------------------------------------------------------
def exact(ids, x, q, k):
    s = (x * x[q]).sum(1)
    m = np.flatnonzero(ids != ids[q])
    return [(int(ids[i]), s[i]) for i in m[np.lexsort((ids[m], -s[m]))][:k]]


def test_neighbours_recall_and_scores(spark):
    df = table(spark, SF_MID, "embeddings")
    p = df.toPandas()
    ids, x = p["vec_id"].to_numpy(), np.array(p["embedding"].tolist(), float)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, leaves=0.2).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        i = int(np.flatnonzero(ids == q)[0])
        want = exact(ids, x, i, 20)
        assert g["rank"].tolist() == list(range(1, 21))
        for v, s in zip(g["vec_id"], g["score"], strict=True):
            assert s == pytest.approx((x[ids == v][0] * x[i]).sum(), abs=1e-12)
        assert g["score"].is_monotonic_decreasing
        hit += len({v for v, _ in want} & set(g["vec_id"]))
    assert got["query_id"].nunique() == (ids % 20 == 0).sum()
    assert hit / (20 * got["query_id"].nunique()) >= 0.9


def test_neighbours_blocks_of_queries_do_not_change_the_result(spark, monkeypatch):
    df = table(spark, SF_SMALL, "embeddings")
    whole = Counter(map(tuple, neighbours.nearest(df, F.col("vec_id") % 2 == 0, leaves=0.1).collect()))
    monkeypatch.setattr(neighbours, "ASKS", 7)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    assert Counter(map(tuple, neighbours.nearest(df, F.col("vec_id") % 2 == 0, leaves=0.1).collect())) == whole


def test_neighbours_odd_vectors(spark):
    good = [(i, [float(i % 7), 1.0, float(i % 3)], i) for i in range(40)]
    odd = [(100, None, 1), (101, [0.0, 0.0, 0.0], 1), (102, [1.0, None, 2.0], 1), (103, [1.0, float("nan"), 2.0], 1),
           (120, [float("inf"), 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (105, [1.0], 1), (140, [], 1), good[20]]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, rank int")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=6).toPandas()
    ids, x = np.array([g[0] for g in good]), np.array([g[1] for g in good])
    assert set(got["query_id"]) == {0, 20}
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(zip(g["vec_id"], g["score"], strict=True)) == exact(ids, x, int(q), 6)
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, k=20).collect()
    assert len(few) == 2
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_kept_hash_matches_python(spark):
    r = substrings.remove_repeats(documents(spark, [(1, "a  b\u00e9")])).select(F.sha2("kept_text", 256)).first()[0]
    assert r == hashlib.sha256("a bé".encode()).hexdigest()
