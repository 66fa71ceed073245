"""Quality rules: divergence of a text's histograms from those of languages.

Every language of the corpus gets two reference histograms, summed over all of
its documents: character classes and common words. A text is judged by its
Jensen-Shannon distance to the nearest language; short texts and those of a
language with too few words for a reference are left to the base rule.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import salted, written

MIN_WORDS = 50            # base rule, and guard of the histograms
REPEAT_PCT = 50           # base rule: share of words in repeated 3-word windows
COMMON_WORDS = 100        # words of a language's reference histogram
#: A language with fewer words in all is no reference; of its documents only the
#: base rule decides.
MIN_LANG_WORDS = 1000
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.50

SYMBOLS = b"#*$%&|<>"     # fixed value
#: Character class of a UTF-8 byte; a continuation byte has none (class 9).
CLASSES = ["lower", "upper", "digit", "space", "newline", "punctuation", "symbol", "control",
           "non_ascii"]
_CLASS = np.array([9 if 128 <= c < 192 else 8 if c >= 192 else 0 if 97 <= c <= 122
                   else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 4 if c == 10
                   else 3 if c in (32, 9) else 5 if c in b".,;:!?'\"()-" else 6 if c > 32 and c < 127
                   else 7 for c in range(256)], np.uint8)


def char_classes(text: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=10)[:9].astype(float)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return max(0.0, (kl(p) + kl(q)) / 2) ** 0.5


def repeated_words(codes: np.ndarray, n_codes: int) -> int:
    """Words that lie in a 3-word window found at least twice in the text."""
    if len(codes) < 4:
        return 0
    if n_codes < 2_000_000:              # three codes fit 63 bits
        tri = (codes[:-2] * n_codes + codes[1:-1]) * n_codes + codes[2:]
    else:
        _, two = np.unique(codes[:-2] * n_codes + codes[1:-1], return_inverse=True)
        tri = two * n_codes + codes[2:]
    _, at, count = np.unique(tri, return_inverse=True, return_counts=True)
    rep = count[at] > 1
    cover = np.zeros(len(codes), bool)
    for k in range(3):
        cover[k:len(codes) - 2 + k] |= rep
    return int(cover.sum())


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[dict]:
    """Reference histograms of every language, over all documents that name it.

    Batches are summed before the shuffle, and the counts of every word before
    the COMMON_WORDS most frequent of a language are taken. These, of languages
    with MIN_LANG_WORDS words or more, come to the driver.
    """
    def count(batches):
        for b in batches:
            words, classes = {}, {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                words.setdefault(lang, Counter()).update(text.split())
                classes[lang] = classes.get(lang, 0) + char_classes(text)
            rows = []
            for lang, c in words.items():
                rows.append((lang, "words", None, sum(c.values())))
                rows += [(lang, "class", k.encode(), int(n))
                         for k, n in zip(CLASSES, classes[lang], strict=True)]
                rows += [(lang, "word", w, n) for w, n in c.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            types = [pa.string(), pa.string(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             names=["lang", "kind", "item", "n"])

    sums = written(docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
                   .select(F.col(lang_col).cast("string"), F.col(text_col).cast("binary"))
                   .mapInArrow(count, "lang string, kind string, item binary, n long")
                   .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "quality-sums")
    large = sums.where((F.col("kind") == "words") & (F.col("n") >= MIN_LANG_WORDS)).select("lang")
    # salted, so that a language's words are cut to the most frequent before they meet
    top = (salted(sums, large, ["lang"]).withColumn("k", F.row_number().over(
        W.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")))
        .where(F.col("k") <= COMMON_WORDS))
    rows = top.collect()
    refs = []
    by_lang: dict[str, list] = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    for lang, mine in sorted(by_lang.items()):
        n = sum(r.n for r in mine if r.kind == "words")
        common = {bytes(r.item): r.n for r in sorted(mine, key=lambda r: r.k) if r.kind == "word"}
        classes = {bytes(r.item).decode(): r.n for r in mine if r.kind == "class"}
        refs.append({"lang": lang, "words": common,
                     "word_hist": np.array([*common.values(), max(0, n - sum(common.values()))], float),
                     "char_hist": np.array([classes.get(k, 0) for k in CLASSES], float)})
    return refs


SCHEMA = ("id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, char_distance double, word_distance double, nearest string, "
          "base_failed boolean, kept boolean")


def judge_text(text: bytes | None, refs: list[dict], base_only: bool = False) -> tuple:
    t = text or b""
    words = t.split()
    n = len(words)
    chars = len(t.decode("utf-8", "replace")) - sum(t.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    symbols = len(t) - len(t.translate(None, SYMBOLS))
    lines = [x for x in t.split(b"\n") if x.strip()]
    codes: dict[bytes, int] = {}
    seq = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    repeat = repeated_words(seq, len(codes))
    failed = n < MIN_WORDS or 100 * repeat > REPEAT_PCT * n
    d_char = d_word = nearest = None
    if n >= MIN_WORDS and refs:
        counts, hist = np.bincount(seq), char_classes(t)
        best = (9.0, None, None, None)
        for r in refs:
            own = np.array([counts[codes[w]] if w in codes else 0 for w in r["words"]], float)
            a = distance(hist, r["char_hist"])
            b = distance(np.append(own, n - own.sum()), r["word_hist"])
            best = min(best, (a + b, a, b, r["lang"]), key=lambda x: x[0])
        _, d_char, d_word, nearest = best
    kept = not failed and (base_only or nearest is None
                           or (d_char <= MAX_CHAR_DISTANCE and d_word <= MAX_WORD_DISTANCE))
    return (n, chars, symbols, len(lines) - len(set(lines)), repeat, d_char, d_word, nearest, failed, kept)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", references: list[dict] | None = None) -> DataFrame:
    """Base counts and verdict of every whole text.

    Words are runs of characters other than white space. ``n_dup_lines`` counts
    lines with a word that equal an earlier line, ``n_repeat_words`` the words
    in 3-word windows found twice or more. A text fails the base rule with
    fewer than 50 words or more than half of its words repeated; a longer one is
    dropped if its distance to the nearest language is above MAX_CHAR_DISTANCE
    or MAX_WORD_DISTANCE. Without any reference, and where the row names a language
    that has none, only the base rule decides.

    One row per input row; a null or empty text has no words and fails; null ids
    stay null; a null language only keeps the text out of the references;
    repeated rows give repeated results; an empty table gives an empty result.
    """
    refs = language_references(docs, text_col, lang_col) if references is None else references
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64()] * 6 + [pa.float64()] * 2 + [pa.string()] + [pa.bool_()] * 2

    known = {None, *(r["lang"] for r in refs)}

    def run(batches):
        for b in batches:
            rows = [judge_text(x.as_py(), refs, lang not in known)
                    for x, lang in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, types[1:], strict=True))],
                names=names)

    out = docs.select(F.col(id_col).cast("long").alias("id"),
                      F.col(text_col).cast("binary").alias("text"),
                      lang.cast("string").alias("lang")).mapInArrow(run, SCHEMA)
    return out.withColumnRenamed("id", id_col)
