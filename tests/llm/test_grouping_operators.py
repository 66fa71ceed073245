"""Spelling variants, odd-sketch near duplicates and the conversation trie against
brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL, documents
from pyspark.sql import functions as F

from sensorcast.llm import conversations as T
from sensorcast.llm import odd_sketches as S
from sensorcast.llm import spelling as P
from sensorcast.llm.common import recorded, table

# ------------------------------------------------------------------ spelling variants


def plain_spelling(rows, min_length=5, min_count=3):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            count[run[:k] + run[k + 1:] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in count.items() if n >= min_count and len(w) >= min_length}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    out = {}
    for w, n in words.items():
        around = [x for d in (-1, 0, 1) for x in by_size.get(len(w) + d, []) if near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = [n, len(around), form, words.get(form)]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return out


def spelling_rows(df):
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in got}


VARIANTS = ["letter"] * 30 + ["lettre"] * 9 + ["leter"] * 14 + ["letar"] * 6 + ["lletter"] * 3 + ["Été" "été" "s"] * 4 + [
    "ÉTÉétés"] * 3 + ["étéétes"] * 8 + ["abcde"] * 3 + ["abcdf"] * 3 + ["zzzzzzz" * 40] * 3 + ["zzzzzzz" * 40 + "z"] * 6


@pytest.mark.parametrize("cell,sample", [(P.CELL, P.SAMPLE), (40, 30)])
def test_spelling_against_brute_force(spark, odd, cell, sample):
    docs = documents(spark, [(k, " ".join(VARIANTS[k::7])) for k in range(7)] + [(None, "letter, LETTER"), (9, None)])
    real = table(spark, SF_SMALL, "documents").select(*docs.columns).where("doc_id < 40")
    for d in (docs.unionByName(real), odd) if cell == 40 else (docs,):
        rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
        got = spelling_rows(P.spelling_variants(d, cell_words=cell, sample=sample))
        assert got == plain_spelling(rows)
    assert got


def test_spelling_equal_vectors_are_dealt_in_blocks(spark):
    # permutations of the same letters cannot be split
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.permutation(list("abcdefg"))) for _ in range(300)})
    docs = documents(spark, [(1, " ".join(words * 4))])
    got = spelling_rows(P.spelling_variants(docs, cell_words=50, sample=40))
    assert got == plain_spelling([(1, " ".join(words * 4))])


def test_tree_reaches_every_near_vector():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 4, (800, P.DIMS)).astype(np.int16) * (rng.random((800, P.DIMS)) < 0.2)
    v = v.astype(np.int16)
    tree = P.Tree(v, *P._ALL, 8)
    for reach in (0, 1, 2, 5):
        q, leaf = tree.within(v, np.full(len(v), reach))
        found = {(a, b) for a, k in zip(q, leaf, strict=True) for b in tree.rows[k]
                 if np.abs(v[a] - v[b]).sum() <= reach}
        want = {(a, b) for a in range(len(v)) for b in np.flatnonzero(np.abs(v - v[a]).sum(axis=1) <= reach)}
        assert found == want
    again = P.Tree.load(tree.dump())
    assert (again.home(v) == tree.home(v)).all()


def test_spelling_empty(spark, empty):
    assert P.spelling_variants(empty).count() == 0
    assert P.spelling_variants(documents(spark, [(1, None), (2, "")])).count() == 0


# ------------------------------------------------------------------ odd sketches

def plain_near(rows, n=3, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return Counter((i, len(s), low.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def chain(n, step, size=120):
    """Texts of which neighbours share most words, the ends none."""
    return [" ".join(f"w{k}" for k in range(step * i, step * i + size)) for i in range(n)]


def test_near_against_brute_force(spark, odd):
    texts = chain(30, 6) + ["a b", "A  b", "b a", "one"] + [" ".join(f"v{k}" for k in range(60) if k != j) for j in range(25)]
    docs = documents(spark, [(3 * k % 101, t) for k, t in enumerate(texts)])
    for d in (docs, odd):
        rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
        got = S.near_duplicates(d).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_near(rows)
        groups = Counter(r.component_id for r in got if r.n_shingles)
        assert all(sum(r.kept for r in got if r.component_id == c and r.n_shingles) == 1 for c in groups)


def test_near_tiles_find_what_hubs_miss(spark, monkeypatch):
    monkeypatch.setattr(S, "HUB_ROUNDS", 0)
    monkeypatch.setattr(S, "TILE_LOAD", 1300)
    texts = chain(40, 6)
    docs = documents(spark, list(enumerate(texts)))
    got = S.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_near(list(enumerate(texts)))


def test_near_later_rounds_look_at_open_buckets_only(spark):
    """Joins that broadcast nothing give the same; a round's members lie in buckets that
    held several components."""
    texts = chain(8, 14) + [" ".join(f"v{k}" for k in range(90) if k != j) for j in range(20)] * 2   # the chain has no links
    docs = documents(spark, list(enumerate(texts)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with recorded() as paths:
            got = S.near_duplicates(docs).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_near(list(enumerate(texts)))
    rounds = [spark.read.parquet(x) for x in paths if "odd-members" in x]
    all_ = next(spark.read.parquet(x) for x in paths if "odd-shared" in x).count()
    assert rounds and all(x.count() < all_ for x in rounds)
    for x in rounds:
        assert x.groupBy("band").agg(F.countDistinct("label").alias("n")).where("n < 2").isEmpty()


def test_sketches_estimate_and_never_drop():
    rng = np.random.default_rng(5)
    for common, own in ((400, 0), (340, 30), (300, 60), (170, 15), (34, 3)):
        x = rng.integers(1, 2**63, common + 2 * own, dtype=np.int64).astype(np.uint64)
        a, b = x[:common + own], np.concatenate([x[:common], x[common + own:]])
        apart = S.odd_sketch(S.samples(a)) ^ S.odd_sketch(S.samples(b))
        bits = int(np.bitwise_count(apart.view(np.uint64)).sum())
        true = common / (common + 2 * own)
        assert abs(S.estimate(bits) - true) < 0.09
        if true >= 0.85:
            assert bits <= S.most_bits(85)
            assert (S.bands(S.samples(a)) == S.bands(S.samples(b))).any()


def test_near_empty(empty):
    assert S.near_duplicates(empty).count() == 0


# ------------------------------------------------------------------ conversation trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    convs = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    below = {k: [x for x in members if x[:len(k)] == k] for k in members}
    out = []
    for k, m in members.items():
        kids = [x for x in below[k] if len(x) == len(k) + 1]
        ended = ",".join(str(c) for c in sorted(c for c in m if len(whole[c]) == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids),
                    sum(all(len(y) <= len(x) for y in below[x]) for x in below[k]),
                    sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below[k] if x),
                    hashlib.sha256(ended.encode()).hexdigest()))
    return Counter(out)


def trie_rows(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens,
                    r.ends_sha256) for r in df.collect())


def talk(n, seed, words="ab", turns=12):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        c = int(c * 3 % 97) if seed else c
        for t in range(int(rng.integers(1, turns))):
            role, text = str(rng.choice(["user", "bot"])), str(rng.choice(list(words)))
            rows.append((c, t if rng.random() > 0.1 else None, None if rng.random() < 0.05 else role,
                         None if rng.random() < 0.05 else text * int(rng.integers(1, 3))))
    return rows


@pytest.mark.parametrize("span,container,block", [(64, 20_000, 256), (2, 5, 3), (3, 1, 2), (1, 4, 256)])
def test_trie_against_brute_force(spark, monkeypatch, span, container, block):
    monkeypatch.setattr(T, "BLOCK", block)
    rows = talk(60, 1) + [(None, 1, "user", "a"), (200, None, None, None), (200, 1, "é", "ünï"), (201, 5, "user", "a"),
                          *((c, t, "user", "same") for c in range(300, 330) for t in range(10))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as cls", "'b' as box", "2 as n_convs")
    assert trie_rows(T.prefix_trie(df, span=span, container=container)) == plain_trie(rows)


def test_trie_of_a_long_conversation(spark):
    rows = [(7, t, "user", f"turn {t % 9}") for t in range(400)] + [(5, t, "user", f"turn {t % 9}") for t in range(130)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert trie_rows(T.prefix_trie(df, span=16, container=1)) == plain_trie(rows)


def test_trie_empty_and_turnless(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # conversations that take more turns from an absent family than they have themselves
    rows = [(c, 0, "user", "hello") for c in range(1, 40) if c % 5]
    assert trie_rows(T.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(rows)


def test_filter_of_keys_loses_none(spark, monkeypatch):
    monkeypatch.setattr(S, "FILTER_BITS", 12)
    rows = spark.range(20_000).withColumn("k", F.col("id") * 7)
    keys = rows.where("id % 50 = 0").select("k")
    got = S._likely(rows, keys, ["k"])
    assert got.columns == ["id", "k"] and got.join(keys, "k").count() == 400 and got.count() < 4000
    assert S._likely(rows, keys.limit(0), ["k"]).count() == 0
