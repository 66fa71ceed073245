"""Language identification of mixed-language text.

Per-word scores come from character n-grams and whole words, hashed into a table
of fixed size per language. The scripts of a word narrow its candidate languages.
Over the words of a text, Viterbi with a switching penalty finds the best
sequence of languages: its runs are the labelled spans, and the language with
the most letters is the text's.
"""

import functools
import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The classifier is fitted on about so many labelled documents per language, chosen by
#: the hash of their id, and on the whole of each.
FIT_DOCS = 2000
PIECE_WORDS = 2000        # words of a text that are counted at once
BUCKETS = 1 << 16         # rows of the hashed feature table: a quarter MB for every language
SWITCH_PENALTY = 6.0      # log-probability a change of language costs
SMOOTHING = 0.5
SCRIPT_SHARE = 0.001      # a language is a candidate for a script it has this share of words in
CACHE_WORDS = 200_000     # scored words a task remembers

# First code points of the ranges that separate scripts.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3130, "hangul"),
    (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0x10000, "other"), (0x20000, "han"), (0x40000, "other")]
_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])


@functools.cache
def _is_letter() -> np.ndarray:
    """By code point; planes above the last script range hold no letters."""
    return np.array([chr(i).isalpha() for i in range(SCRIPT_RANGES[-1][0])] + [False])


def _points(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the tokens' letters, everything else 0, with a 0 after each
    token; and where each token ends. Letters are composed and lower-cased."""
    text = "\n".join(tokens) + "\n"
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    p = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    ends = np.flatnonzero(p == 10)
    table = _is_letter()
    return np.where(table[np.minimum(p, len(table) - 1)], p, 0), ends


def _features(p: np.ndarray) -> np.ndarray:
    """Buckets of the 2-, 3- and 4-gram around every code point (columns); the 0
    between words is part of the grams at a word's borders."""
    k = np.uint64(0x9E3779B97F4A7C15)
    q = np.concatenate([[0, 0], p, [0]]).astype(np.uint64) + np.uint64(1)
    two = q[1:-2] * k ^ q[2:-1]
    three = (two * k ^ two >> np.uint64(29)) * k ^ q[3:]
    # where the letter before is a border, what stands beyond it has no say
    four = (three * k ^ three >> np.uint64(31)) * k ^ np.where(q[1:-2] > 1, q[:-3], 1)
    grams = np.stack([two * np.uint64(3), three * np.uint64(5), four * np.uint64(7)], 1)
    return ((grams * k) >> np.uint64(48)).astype(np.int64)      # 16 bits: BUCKETS


def _scripts(p: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_STARTS, p, "right") - 1]


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray               # buckets x languages, log-probabilities
    scripts: np.ndarray              # scripts x languages, candidate or not

    def score(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores per language (the best is 0) and letters of every token."""
        p, ends = _points(tokens)
        starts = np.concatenate([[0], ends[:-1] + 1])
        letter = p > 0
        n = np.add.reduceat(letter.astype(np.int64), starts)
        at = np.flatnonzero(letter)
        every = np.zeros((len(p), len(self.langs)), np.float32)
        for column in _features(p)[at].T:
            every[at] += self.scores[column]
        # the script of a token's first letter narrows its languages
        may = self.scripts[_scripts(p)]
        may[~letter] = False
        first = np.minimum(np.searchsorted(at, starts), max(0, len(at) - 1))
        may = may[at[first]] if len(at) else np.zeros((len(tokens), len(self.langs)), bool)
        total = np.add.reduceat(every, starts, axis=0) / 6
        total -= total.max(1, keepdims=True)
        total = np.where(may | ~may.any(1, keepdims=True), total,
                         total.min(1, keepdims=True) - SWITCH_PENALTY)
        total -= total.max(1, keepdims=True)
        total[n == 0] = 0
        return total.astype(np.float32), n


def held_out(id_col: Column) -> Column:
    """A fifth of the documents, by the CRC-32 of the id's text; a null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Model from the documents that have a language and are not held out.

    The fitting sample is bounded (FIT_DOCS per language), every language is learned;
    its counts are summed per task before the shuffle and come to the driver language
    by language, into a table of BUCKETS numbers for each.
    """
    lang = F.col(lang_col).cast("string")
    known = docs.where(lang.isNotNull() & F.col(text_col).isNotNull()
                       & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    sizes = known.groupBy(lang.alias("lang")).count().collect()
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    # languages with fewer documents are taken whole
    shares = [x for r in sizes if r["count"] > FIT_DOCS for x in (r["lang"], FIT_DOCS / r["count"])]
    share = F.coalesce(F.create_map(*map(F.lit, shares))[lang], F.lit(1.0)) if shares else F.lit(1.0)
    # a hash of the id in [0, 1) below the language's share: a filter, no shuffle of texts
    chance = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 11) / F.lit(float(1 << 53))
    sample = known.where(chance < share).select(lang.alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = tables.setdefault(lang, np.zeros(BUCKETS, np.int64))
                s = scripts.setdefault(lang, np.zeros(len(SCRIPTS), np.int64))
                tokens = text.as_py().split()
                for k in range(0, len(tokens), PIECE_WORDS):
                    p, _ = _points(tokens[k:k + PIECE_WORDS])
                    at = np.flatnonzero(p)
                    t += np.bincount(_features(p)[at].ravel(), minlength=BUCKETS)
                    s += np.bincount(_scripts(p[at]), minlength=len(SCRIPTS))
        for lang, t in tables.items():
            at = np.flatnonzero(t)
            sc = np.flatnonzero(scripts[lang])
            yield pa.RecordBatch.from_pydict({
                "lang": [lang] * (len(at) + len(sc)),
                "item": np.concatenate([at, -1 - sc]).astype(np.int32),
                "n": np.concatenate([t[at], scripts[lang][sc]]).astype(np.int64)})

    # a language's counts are one row of two arrays, at most BUCKETS long
    rows = written(sample.mapInArrow(count, "lang string, item int, n long")
                   .groupBy("lang", "item").agg(F.sum("n").alias("n"))
                   .groupBy("lang").agg(F.collect_list(F.struct("item", "n")).alias("counts"))
                   .select("lang", "counts.item", "counts.n"), "lang-counts")
    langs = sorted(r.lang for r in rows.select("lang").collect())
    place = {lang: i for i, lang in enumerate(langs)}
    scores = np.zeros((BUCKETS, len(langs)), np.float32)
    scripts = np.zeros((len(SCRIPTS), len(langs)))
    for r in rows.toLocalIterator():
        item, n, i = np.array(r.item), np.array(r.n, float), place[r.lang]
        gram = item >= 0
        mine = np.zeros(BUCKETS)
        mine[item[gram]] = n[gram]
        scores[:, i] = np.log((mine + SMOOTHING) / (mine.sum() + SMOOTHING * BUCKETS))
        scripts[-1 - item[~gram], i] = n[~gram]
    scripts = scripts / np.maximum(1, scripts.sum(0))
    return Model(langs, scores, scripts >= SCRIPT_SHARE)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label sequences of many texts at once.

    ``scores``: one (words x languages) array per text. Texts are sorted by
    length, so step t handles the texts that still have a t-th word.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    kind = np.int16 if not scores or scores[0].shape[1] < 1 << 15 else np.int32
    out: list[np.ndarray] = [np.zeros(len(s), kind) for s in scores]
    if not len(lengths) or not lengths[0] or not scores[0].shape[1]:
        return out
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate([scores[i] for i in order])
    k = flat.shape[1]
    penalty = np.float32(penalty)
    back = np.zeros((len(flat), k), kind)       # best predecessor of each label
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    best = flat[starts[:alive[0]]].copy()
    final = np.zeros((len(lengths), k), np.float32)
    final[:alive[0]] = best
    own = np.arange(k, dtype=kind)
    for t in range(1, lengths[0]):
        n = alive[t]
        best = best[:n]
        top = best.argmax(1)
        switch = best[np.arange(n), top][:, None] - penalty
        stay = best >= switch
        at = starts[:n] + t
        back[at] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, switch) + flat[at]
        final[:n] = best
    labels = np.zeros(len(flat), kind)
    now = final.argmax(1).astype(kind)
    for t in range(lengths[0] - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        labels[at] = now[:n]
        now[:n] = back[at, now[:n]]
    for place, i in enumerate(order):
        out[i] = labels[starts[place]:starts[place] + lengths[place]]
    return out


FOUND = "lang_pred string, score double, spans array<struct<first_word:long,last_word:long,lang:string>>"
#: Texts are labelled together until they have so many words; of more than 20 languages,
#: whose scores take more room, proportionally fewer (as of the remembered words).
WORDS_AT_ONCE = 600_000


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             penalty: float = SWITCH_PENALTY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Language and spans of every whole text; only the text is looked at.

    (id_col, held_out, lang_pred, score, spans) and the columns in ``keep``
    that have other names, one row per input row. ``spans``: runs of
    white-space words (from 0, both ends included) with one language; tokens
    without letters belong to the run around them. ``lang_pred``: the language
    with the most letters (of equals the first by name), ``score`` its share of
    the letters. A null text, one without letters and any text under an empty
    model is ``und`` with score 0 and no spans. Null ids stay null, repeated
    rows give repeated results, an empty table gives an empty result.
    """
    langs = model.langs
    room = 20 / max(20, len(langs))
    keep = tuple(c for c in keep if c not in (id_col, "held_out", "lang_pred", "score", "spans"))

    span = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("lang", pa.string())]))

    @F.arrow_udf(FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[str, int] = {}       # code of a token: its row in the tables
        table = np.zeros((0, len(langs)), np.float32)
        letters = np.zeros(0, np.int64)

        def score_new():
            nonlocal table, letters
            new = list(itertools.islice(cache, len(table), None))
            if new and langs:
                t, n = model.score(new)
            else:
                t, n = np.zeros((len(new), len(langs)), np.float32), np.zeros(len(new), np.int64)
            table, letters = np.concatenate([table, t]), np.concatenate([letters, n])

        def labelled(codes):
            score_new()
            tables = [table[c] for c in codes]
            for c, lab in zip(codes, viterbi(tables, penalty), strict=True):
                n = letters[c]
                share = np.bincount(lab, weights=n, minlength=len(langs)) if len(c) else np.zeros(1)
                if not langs or not share.sum():
                    yield "und", 0.0, []
                    continue
                win = int(share.argmax())
                cuts = np.flatnonzero(np.diff(lab)) + 1
                first = np.concatenate([[0], cuts])
                last = np.concatenate([cuts, [len(lab)]]) - 1
                yield langs[win], float(share[win] / share.sum()), [
                    {"first_word": int(a), "last_word": int(z), "lang": langs[lab[a]]}
                    for a, z in zip(first, last, strict=True)]

        for b in batches:
            rows, codes, words = [], [], 0
            for text in b:
                tokens = (text.as_py() or "").split()
                codes.append(np.fromiter((cache.setdefault(x, len(cache)) for x in tokens),
                                         np.int32, len(tokens)))
                words += len(tokens)
                if words >= room * WORDS_AT_ONCE or len(cache) > room * CACHE_WORDS:
                    rows += labelled(codes)
                    codes, words = [], 0
                    if len(cache) > room * CACHE_WORDS:
                        cache.clear()
                        table, letters = table[:0], letters[:0]
            rows += labelled(codes)
            lang, score, spans = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)],
                names=["lang_pred", "score", "spans"])

    # only texts go to Python; not deterministic for Catalyst, so that it is run once
    out = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"),
                      F.struct(F.lit(0).alias("_"), *keep).alias("kept"),
                      found.asNondeterministic()(F.col(text_col).cast("string")).alias("found"))
    return out.select(F.col("id").alias(id_col), "held_out", "found.lang_pred", "found.score", "found.spans",
                      *[F.col(f"kept.`{c}`").alias(c) for c in keep])
