"""Substring dedup: windows of words that an earlier document already has.

Windows are dealt to shards by the smallest hash of the short grams inside
them, so that equal windows meet in one shard. Only grams that several documents
hold open a shard entry. Consecutive windows with the same smallest gram form one
piece; equal pieces are kept once, with the smallest id of their documents. Of
equal texts only the first goes that way: later copies are removed as a whole.

Each shard builds a compressed FM-index over its pieces (the Burrows-Wheeler
transform of their word sequence in a wavelet matrix) and streams them against
it: backward search extends every window word by word, as long as the interval
holds more than the window itself. The windows whose matching statistic reaches
the threshold take the smallest id of their interval. The pieces of a very frequent
gram go through no shard: their windows are grouped, with partial aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted, written
from .fingerprints import gram_hashes, ranges_for, shared_fingerprints, unpack, word_hashes

WINDOW = 13
GRAM = 5                  # words of the gram that deals a window to its shard
SHARD_WORDS = 300_000   # words of the pieces in a shard
#: The windows of a gram whose different pieces have more words are grouped one by one.
GRAM_WORDS = 100_000
PIECE_WINDOWS = 4096      # windows of a piece, at most: a repetitive text is one run of them
U = np.uint64


def smallest_grams(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """48-bit hash of the smallest gram in every window of a word sequence."""
    if len(words) < window:
        return np.empty(0, U)
    g = gram_hashes(words, gram) >> U(16)
    w = window - gram + 1
    out = g[:len(g) - w + 1].copy()
    for k in range(1, w):
        np.minimum(out, g[k:len(g) - w + 1 + k], out=out)
    return out


class WaveletMatrix:
    """Rank queries over a sequence of numbers: per bit a packed bit vector and
    the number of ones before each 64-bit word of it."""

    def __init__(self, seq: np.ndarray, top: int):
        self.n = len(seq)
        self.bits, self.ones, self.zeros = [], [], []
        seq = seq.astype(np.int64)
        self.levels = max(1, int(top).bit_length())
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[:len(raw)] = raw
            words = packed.view("<u8")
            self.bits.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))
            self.zeros.append(self.n - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of the symbol's zone, its occurrences before ``at``) per query."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            for x in (low, high):
                mask = (U(1) << (x & 63).astype(U)) - U(1)
                r = self.ones[k][x >> 6] + np.bitwise_count(self.bits[k][x >> 6] & mask).astype(np.int64)
                x[:] = np.where(one, self.zeros[k] + r, x - r)
        return low, high - low


class FMIndex:
    """Over the concatenated pieces, each ended by a 0; suffixes are sorted by
    their first ``depth`` symbols, which is all that patterns of that length need."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        rank = symbols.astype(np.int64)
        length = 1
        while True:
            after = np.zeros(n, np.int64)
            after[:max(0, n - length)] = rank[length:]
            # the order beyond a piece's end does not matter: no pattern has a 0
            key = rank * (int(rank.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
            rank, length = new, 2 * length
            if length >= depth or rank.max() == n - 1:
                break
        self.suffixes = order
        self.first = np.searchsorted(np.sort(symbols), np.arange(int(symbols.max()) + 2))
        self.bwt = WaveletMatrix(symbols[order - 1], int(symbols.max()))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol put in front."""
        _, a = self.bwt.rank(symbol, low)
        _, b = self.bwt.rank(symbol, high)
        return self.first[symbol] + a, self.first[symbol] + b


def earliest_holders(pieces: list[bytes], holder: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For every window of every piece the smallest holder among all pieces of
    the shard that have it."""
    words = [p.split(b" ") for p in pieces]
    lengths = np.array([len(w) for w in words])
    codes: dict[bytes, int] = {}
    ends = np.cumsum(lengths + 1)
    symbols = np.zeros(int(ends[-1]), np.int64)
    for w, end in zip(words, ends, strict=True):
        symbols[end - 1 - len(w):end - 1] = [codes.setdefault(x, len(codes) + 1) for x in w]
    index = FMIndex(symbols, window)
    piece = np.repeat(np.arange(len(pieces)), lengths + 1)
    counts = np.maximum(0, lengths - window + 1)
    begin = np.repeat(ends - 1 - lengths, counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    best = holder[piece[begin]].copy()
    alive = np.arange(len(begin))
    low, high = index.first[symbols[begin + window - 1]], index.first[symbols[begin + window - 1] + 1]
    for k in range(window - 2, -2, -1):
        more = high - low > 1            # another place than the window's own
        alive, low, high = alive[more], low[more], high[more]
        if k >= 0 and len(alive):
            low, high = index.extend(symbols[begin[alive] + k], low, high)
    if len(alive):
        held = np.append(holder[piece[index.suffixes]], np.iinfo(np.int64).max)
        starts, which = np.unique(low, return_inverse=True)
        stops = np.zeros(len(starts), np.int64)
        stops[which] = high
        smallest = np.minimum.reduceat(held, np.stack([starts, stops], 1).ravel())[::2]
        best[alive] = smallest[which]
    return np.split(best, np.cumsum(counts)[:-1])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with an order (null ids last) and two hashes of the text; order and
    first hash are the document's key."""
    i, t = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    known = F.coalesce(t, F.lit(""))
    return docs.select(i.alias("id"), F.coalesce(i, F.lit(2**63 - 1)).alias("ord"),
                       F.xxhash64(known).alias("t1"), F.xxhash64(F.lit(1), known).alias("t2"),
                       t.cast("binary").alias("raw"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """Every document without the words that an earlier one already has.

    A window is ``window`` consecutive words (between white space, unchanged) of
    one document. Each word covered by a window whose word sequence also starts
    in a document with a smaller id is removed; windows are judged on the input.
    One row per input row: (id_col, n_words, n_removed, kept_text), the kept words
    joined by one space. Null and empty texts have no words; null ids come after
    all others and after none of their kind; rows repeating an id do not remove
    each other's words; an empty table gives an empty result.
    """
    rows = _keyed(docs, id_col, text_col)
    chars = docs.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0]

    def grams(raw):
        return np.unique(smallest_grams(word_hashes(raw), window)), 0, 0, 0

    shared = written(
        shared_fingerprints(rows.select(F.struct("ord", "t1", "t2").alias("payload"), "raw"), grams,
                            ranges_for((chars or 0) // 30))
        .where(F.length("shared") > 0).select("payload.*", "shared")
        .dropDuplicates(["ord", "t1"]), "sub-shared")
    # texts that several documents have, and the first of these
    firsts = written(rows.groupBy("t1", "t2").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
                     .where("first_ord < last_ord").drop("last_ord"), "sub-firsts")
    copies = (salted(rows.select("ord", "t1", "t2"), firsts, ["t1", "t2"]).where("ord > first_ord")
              .select("ord", "t1").distinct())
    shared = (salted(shared, firsts, ["t1", "t2"], "left")
              .where("first_ord is null or ord = first_ord").select("ord", "t1", "shared"))

    def cut(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for t1, o, raw, fps in zip(b.column("t1").to_pylist(), b.column("ord").to_pylist(), b.column("raw"),
                                       b.column("shared"), strict=True):
                raw, fps = raw.as_py(), unpack(fps.as_py())
                small = smallest_grams(word_hashes(raw), window)
                if not len(small):
                    continue
                new = np.flatnonzero(np.append(True, small[1:] != small[:-1]))
                runs = np.diff(np.append(new, len(small)))
                edge = np.concatenate([np.arange(a, a + n, PIECE_WINDOWS) for a, n in zip(new, runs, strict=True)]
                                      ) if runs.max() > PIECE_WINDOWS else new
                hit = np.isin(small[edge], fps)
                edge = np.append(edge, len(small))
                words = raw.split()
                for a, z in zip(edge[:-1][hit].tolist(), edge[1:][hit].tolist(), strict=True):
                    for c, v in zip(out, (int(small[a]), b" ".join(words[a:z + window - 1]), o, t1, a, z - a),
                                    strict=True):
                        c.append(v)
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)],
                                             names=["gram", "words", "ord", "t1", "first", "n"])

    pieces = written(rows.join(shared, ["ord", "t1"]).dropDuplicates(["ord", "t1"])
                     .mapInArrow(cut, "gram long, words binary, ord long, t1 long, first int, n int")
                     .withColumn("h", F.xxhash64("words")), "sub-pieces")
    # a piece is known by its gram and its hash
    distinct = written(pieces.groupBy("gram", "h").agg(
        F.min("ord").alias("ord"), F.count("*").alias("places"), F.first("words").alias("words"),
        (F.max("n") + window - 1).cast("long").alias("n_words")), "sub-distinct")
    per_gram = distinct.groupBy("gram").agg(F.count("*").alias("variants"), F.sum("n_words").alias("gram_words"))
    total = distinct.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    parts = distinct.join(per_gram.where("variants > 1"), "gram", "left")
    # a gram's only piece has no window that another piece of the shard could have
    only = (parts.where("variants is null").select("gram", "h", "ord", "places", F.lit(0).alias("at"),
                                                   F.array("ord").alias("holders")))
    # equal windows of a frequent gram are one row, with their smallest holder
    often = F.col("gram_words") > GRAM_WORDS
    split = F.split(F.col("words").cast("string"), " ")
    windows = F.transform(F.sequence(F.lit(1), F.size(split) - (window - 1)),
                          lambda i: F.array_join(F.slice(split, i, window), " "))
    single = (parts.where(often).select("gram", "h", "ord", "places", F.posexplode(windows).alias("at", "w"))
              .select("gram", "h", "ord", "places", "at", F.xxhash64("w").alias("w1"),
                      F.xxhash64(F.lit(1), "w").alias("w2")))
    # a window without another piece has no earlier holder and needs no row
    held = (single.groupBy("w1", "w2").agg(F.min("ord").alias("holder"), F.count("*").alias("pieces"),
                                           F.max("places").alias("most"))
            .where((F.col("pieces") > 1) | (F.col("most") > 1)).select("w1", "w2", "holder"))
    single = (salted(single, held, ["w1", "w2"])
              .select("gram", "h", "ord", "places", "at", F.array("holder").alias("holders")))
    whole = (parts.where(~often).select("gram", "h", "ord", "places", F.lit(0).alias("at"), "words",
                                        F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard")))

    def judge(t: pa.Table) -> pa.Table:
        found = earliest_holders([x.as_py() for x in t.column("words")], t.column("ord").to_numpy(), window)
        # one holder stands for all windows of a piece where they agree
        found = [x[:1] if (x == x[0]).all() else x for x in found]
        return pa.table({**{c: t.column(c) for c in ("gram", "h", "ord", "places", "at")},
                         "holders": pa.array(found, pa.list_(pa.int64()))})

    form = "gram long, h long, ord long, places long, at int, holders array<long>"
    judged = (whole.groupBy("shard").applyInArrow(judge, form).withColumn("alone", F.lit(False))
              .union(single.withColumn("alone", F.lit(True)))
              .union(only.withColumn("alone", F.lit(False))))
    # what a single document has and no earlier one removes nothing
    judged = written(judged.where((F.col("places") > 1) | F.exists("holders", lambda x: x < F.col("ord")))
                     .select("gram", "h", "at", "alone", "holders"), "sub-judged")
    # both sides are plain table scans, so Spark can split the rows of a hot piece
    gone = F.transform("holders", lambda x: x < F.col("ord"))
    starts = (pieces.select("gram", "h", "ord", "t1", "first", "n").join(judged, ["gram", "h"])
              .where(F.exists("holders", lambda x: x < F.col("ord")))
              .select("ord", "t1", F.struct(
                  (F.col("first") + F.col("at")).alias("first"),
                  # a single window of a frequent gram, or all of a piece
                  F.when(F.col("alone"), F.lit(1)).otherwise(F.col("n")).alias("n"),
                  F.when(F.size("holders") > 1, gone).alias("gone")).alias("run"))
              .groupBy("ord", "t1").agg(F.collect_list("run").alias("runs")))

    def keep(batches):
        for b in batches:
            ids, n_words, n_gone, kept = b.column("id"), [], [], []
            for raw, runs, whole_text in zip(b.column("raw"), b.column("runs"), b.column("copy").to_pylist(),
                                             strict=True):
                words = (raw.as_py() or b"").split()
                runs = runs.as_py()
                left = words
                if whole_text:
                    left = words if len(words) < window else []
                elif runs:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for r in runs:
                        at = r["first"] + (np.arange(r["n"]) if r["gone"] is None else np.flatnonzero(r["gone"]))
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    left = [w for w, g in zip(words, gone, strict=True) if not g]
                n_words.append(len(words))
                n_gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())],
                names=["id", "n_words", "n_removed", "kept_text"])

    none = starts.schema["runs"].dataType
    marks = written(starts.withColumn("copy", F.lit(False)).unionByName(
        copies.select("ord", "t1", F.lit(None).cast(none).alias("runs"), F.lit(True).alias("copy"))), "sub-marks")
    out = (rows.join(marks, ["ord", "t1"], "left").select("id", "raw", "runs", "copy")
           .mapInArrow(keep, "id long, n_words long, n_removed long, kept_text string"))
    return out.withColumnRenamed("id", id_col)
