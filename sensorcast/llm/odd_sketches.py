"""MinHash near-dedup with odd sketches.

A text is its set of word shingles. Its MinHash samples - the smallest value of the
set under each of SAMPLES hash functions - agree with those of another set in a share
that is their Jaccard similarity. The first BANDS * ROWS samples name the buckets in
which candidates meet. All samples, as pairs (function, value), are folded into a
parity bitmap, the odd sketch: the XOR of two sketches is the sketch of the samples in
which the sets differ, and its population count tells their number, the more precisely
the fewer they are. Candidates whose count rules out the similarity are dropped, the
others are compared by their full sets.

Equal sets are one class from the start. A bucket's members are compared with one hub
first, linked classes become components, and only members of different components are
compared with each other after that, in tiles of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted, written
from .fingerprints import gram_hashes, mix, pack, unpack, word_hashes
from .near import components

N, PERCENT = 3, 85
SAMPLES = 256
BITS = 1024               # of an odd sketch
#: A pair of similarity 0.85 shares no bucket with probability (1 - 0.85^4)^24 < 3e-8.
ROWS, BANDS = 4, 24
HUB_ROUNDS = 2
TILE_LOAD = 1 << 19       # shingles of members of a bucket that are compared with as many
GROUP_LOAD = 1 << 22      # shingles of the small buckets that one task looks at
FILTER_BITS = 24          # of a filter of keys: 2^18 words of 64 bits at most, however many keys
U = np.uint64

_rng = np.random.default_rng(12)
_XOR = _rng.integers(1, 2**32, SAMPLES, dtype=np.uint32)
_MUL = _rng.integers(1, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)


def shingles(text: bytes, n: int = N) -> np.ndarray:
    """The distinct hashes of a text's n-word shingles."""
    return np.unique(gram_hashes(word_hashes(text.lower()), n))


def samples(tokens: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each hash function."""
    low, tokens = np.full(SAMPLES, np.uint32(2**32 - 1)), (tokens >> U(32)).astype(np.uint32)
    for k in range(0, len(tokens), 256):
        h = tokens[k:k + 256, None] ^ _XOR
        h *= _MUL
        np.minimum(low, h.min(axis=0), out=low)
    return low.astype(U)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Bit h is set if an odd number of the pairs (function, value) hash to it."""
    at = mix(low ^ mix(np.arange(1, SAMPLES + 1, dtype=U))) % U(BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def odd_bits(differing: float) -> float:
    """Expected set bits of the XOR of two sketches with so many differing samples."""
    return BITS / 2 * (1 - math.exp(-4 * differing / BITS))


def estimate(bits: int) -> float:
    """The Jaccard similarity that a population count of the XOR stands for."""
    rest = max(1 - 2 * bits / BITS, 1e-9)
    return 1 + BITS / (4 * SAMPLES) * math.log(rest)


def most_bits(percent: int) -> int:
    """Set bits of the XOR that a pair of the given similarity exceeds with a
    probability below 1e-8 (6.5 standard deviations of the differing samples, and
    three of the bits that they hit)."""
    miss = 1 - percent / 100
    differing = SAMPLES * miss + 6.5 * math.sqrt(SAMPLES * miss * (1 - miss))
    bits = odd_bits(differing)
    return math.ceil(bits + 3 * math.sqrt(bits * (1 - bits / BITS)))


def bands(low: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=U)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            h = mix(h * U(0x9E3779B97F4A7C15) ^ low[k:BANDS * ROWS:ROWS])
    return h.astype(np.int64)


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """(id, k1, k2, n, cid, bands, sketch) of rows (id, k1, k2, raw); a text without
    words has no cid."""
    def run(batches):
        for b in batches:
            size, cid, band, sketch = [], [], [], []
            for raw in b.column("raw"):
                t = shingles(raw.as_py() or b"", n)
                size.append(len(t))
                if not len(t):
                    cid.append(None), band.append(None), sketch.append(None)
                    continue
                low = samples(t)
                cid.append(np.array([mix(t).sum(dtype=U), mix(t ^ U(0x5555)).sum(dtype=U)]).tobytes())
                band.append(bands(low))
                sketch.append(odd_sketch(low))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "k1", "k2")), pa.array(size, pa.int64()), pa.array(cid, pa.binary()),
                 pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                names=["id", "k1", "k2", "n", "cid", "bands", "sketch"])

    return rows.mapInArrow(run, "id long, k1 long, k2 long, n long, cid binary, bands array<long>, sketch array<long>")


def _full(rows: DataFrame, n: int) -> DataFrame:
    """(cid, n, fps) of rows (cid, raw): the whole sets, packed."""
    def run(batches):
        for b in batches:
            sets = [shingles(raw.as_py(), n) for raw in b.column("raw")]
            yield pa.RecordBatch.from_arrays(
                [b.column("cid"), pa.array([len(t) for t in sets], pa.int64()),
                 pa.array([pack(np.unique(t >> U(16))) for t in sets], pa.binary())], names=["cid", "n", "fps"])

    return rows.mapInArrow(run, "cid binary, n long, fps binary")


def _likely(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is one of ``keys``, and some more whose key's hash has the bit
    of another one's: a filter of bounded size, in front of the join that decides."""
    at = F.pmod(F.xxhash64(*on), F.lit(1 << FILTER_BITS))
    word, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    bits = written(keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word")
                   .agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")), "odd-filter")
    return (rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word")
            .where(F.expr("shiftright(_bits, _bit) & 1 = 1")).drop("_word", "_bit", "_bits"))


def _near_sketches(pairs: DataFrame, slim: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sizes and odd sketches let pass."""
    x, y = (slim.select(F.col("cid").alias(p), F.col("n").alias(f"{p}_n"), F.col("sketch").alias(f"{p}_s"))
            for p in "ab")
    apart = sum((F.bit_count(F.col("a_s")[i].bitwiseXOR(F.col("b_s")[i])) for i in range(BITS // 64)), F.lit(0))
    return (salted(salted(pairs, x, ["a"], salts=4), y, ["b"], salts=4)
            .where((100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
                   & (apart <= most_bits(percent))).select("a", "b"))


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    x, y = (pairs.join(full.withColumnRenamed("cid", p), p)
            .select("a", "b", F.col("n").alias(f"{p}_n"), F.col("fps").alias(f"{p}_f")) for p in "ab")

    def compare(batches):
        for t in batches:
            keep = []
            for p, q, f, g in zip(*(t.column(c) for c in ("a_n", "b_n", "a_f", "b_f")), strict=True):
                p, q = p.as_py(), q.as_py()
                common = len(np.intersect1d(unpack(f.as_py()), unpack(g.as_py()), assume_unique=True))
                keep.append(100 * common >= percent * (p + q - common))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (x.join(y, ["a", "b"]).select("a", "b", "a_n", "b_n", "a_f", "b_f")
            .mapInArrow(compare, "a binary, b binary"))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).view(U).reshape(rows, -1)


def _candidates(t: pa.Table, percent: int):
    """Chunks (p, q, lo, hi): row p and the rows q of other components in its bucket and
    tile, rows lo to hi, that size and sketch let pass; of the buckets that a pair shares,
    only the first names it."""
    rows = t.num_rows
    band, n, block, i, j = (t.column(c).to_numpy() for c in ("band", "n", "block", "i", "j"))
    label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    sketch, bands_ = _matrix(t.column("sketch"), rows), _matrix(t.column("bands"), rows)
    limit = most_bits(percent)
    cut = np.flatnonzero((np.diff(band, prepend=band[0]) != 0) | (np.diff(i, prepend=i[0]) != 0)
                         | (np.diff(j, prepend=j[0]) != 0))
    for lo, hi in zip([0, *cut], [*cut, rows], strict=True):
        right = lo + np.flatnonzero(block[lo:hi] == j[lo])
        for p in lo + np.flatnonzero(block[lo:hi] == i[lo]):
            q = right[right > p] if i[lo] == j[lo] else right
            q = q[(label[q] != label[p]) & (100 * np.minimum(n[q], n[p]) >= percent * np.maximum(n[q], n[p]))]
            q = q[np.bitwise_count(sketch[q] ^ sketch[p]).sum(axis=1, dtype=np.int64) <= limit]
            same = bands_[q] == bands_[p]
            q = q[bands_[p][same.argmax(axis=1)] == np.array(band[lo]).astype(U)]
            if len(q):
                yield p, q, lo, hi


def _common(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets as bit rows over the tokens that several of them hold, in chunks."""
    tokens, count = np.unique(np.concatenate(sets), return_counts=True)
    tokens = tokens[count > 1]
    chunks = []
    for at in range(0, len(tokens), 1 << 16):
        some = tokens[at:at + (1 << 16)]
        bits = np.zeros((len(sets), -(-len(some) // 64) * 64), np.uint8)
        for k, x in enumerate(sets):
            bits[k, np.searchsorted(some, np.intersect1d(x, some, assume_unique=True))] = 1
        chunks.append(np.packbits(bits, axis=1).view(U))
    return chunks


def _tiles(open_: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (band, cid, n, label, sketch, bands) of one bucket
    in different components; of the links of a tile only as many as connect its
    members. A first look finds the members that have candidates in a tile, so that
    only their sets are sent."""
    load = F.sum(F.col("n") + 64)
    sizes = written(open_.groupBy("band").agg(F.ceil(load / TILE_LOAD).alias("blocks"), load.alias("load")), "odd-tiles")
    total = sizes.agg(F.sum("load")).first()[0] or 0
    groups = max(1, -(-total // GROUP_LOAD))
    dealt = (salted(open_, sizes.select("band", "blocks"), ["band"])
             .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("band", "cid", "n", "label", "sketch", "bands", "block",
                     F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("band"), F.lit(groups)))
                     .otherwise(F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other"))).alias("grp")))
    order = [("band", "ascending"), ("i", "ascending"), ("j", "ascending")]

    def flag(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        busy = np.zeros(t.num_rows, bool)
        for p, q, _, _ in _candidates(t, percent):
            busy[p] = busy[q] = True
        return t.filter(pa.array(busy))

    def link(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        n, cid = t.column("n").to_numpy(), t.column("cid").to_pylist()
        root, bits = list(range(t.num_rows)), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b, end = [], [], 0
        for p, q, lo, hi in _candidates(t, percent):
            if hi != end:
                bits, end = _common([unpack(x.as_py()) for x in t.column("fps").slice(lo, hi - lo)]), hi
            both = sum((np.bitwise_count(c[q - lo] & c[p - lo]).sum(axis=1, dtype=np.int64) for c in bits),
                       np.zeros(len(q), np.int64))
            for r in q[100 * both >= percent * (n[p] + n[q] - both)]:
                x, y = find(int(p)), find(int(r))
                if x != y:
                    root[x] = y
                    a.append(min(cid[p], cid[r])), b.append(max(cid[p], cid[r]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    busy = written(dealt.groupBy("grp").applyInArrow(flag, dealt.schema), "odd-busy")
    # a member lies in few buckets, so its set needs no salt
    return busy.join(full.select("cid", "fps"), "cid").groupBy("grp").applyInArrow(link, "a binary, b binary").distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(cid, label) after further links (a, b)."""
    x, y = (labels.select(F.col("cid").alias(p), F.col("label").alias(f"l{p}")) for p in "ab")
    edges = written(salted(salted(links, x, ["a"]), y, ["b"]).where("la <> lb")
                    .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(),
                    "odd-edges")
    if edges.isEmpty():
        return labels
    top = components(edges).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return written(salted(labels, top, ["label"], "left")
                   .select("cid", F.coalesce("to", "label").alias("label")), "odd-labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n: int = N, percent: int = PERCENT) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of ``percent`` or more.

    A document's set: its distinct n-word shingles (A-Z lower-cased, words between
    white space); with fewer words the whole sequence is the one element; without
    words the set is empty and linked with nothing. One row per input row: (id_col,
    n_shingles, component_id, kept). ``component_id``: the smallest id reachable by
    links, the own one included; null only where no member has an id. ``kept`` is true
    for one row of every component, that with the smallest id (of equal ids any; a row
    without an id only if no other is there). Null texts have empty sets, rows that
    repeat an id are documents of their own, other columns are ignored, an empty table
    gives an empty result. Sets are told apart by 128-bit hashes, shingles of a
    candidate pair by 48-bit ones; every bucket and every candidate is looked at.
    """
    i, t = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    known = F.coalesce(i.cast("string"), F.lit(""))
    rows = docs.select(i.alias("id"), F.xxhash64(known, t).alias("k1"), F.xxhash64(F.lit(1), t, known).alias("k2"),
                       t.cast("binary").alias("raw"))
    sets = written(_sets(rows, n).withColumn("row", F.monotonically_increasing_id()), "odd-sets")
    held = sets.where("cid is not null")

    # Buckets with several classes of equal sets.
    post = held.select("cid", F.explode("bands").alias("band"))
    shared = written(post.groupBy("band").agg(F.min("cid").alias("hub"), F.max("cid").alias("hi"))
                     .where("hub <> hi").select("band", "hub"), "odd-buckets")
    post = written(salted(_likely(post, shared, ["band"]), shared, ["band"], salts=4).distinct(), "odd-shared")
    suspects = written(post.select("cid").distinct(), "odd-suspects")
    some = _likely(held, suspects, ["cid"])
    # inner joins: Spark would push a semi join below the filter
    slim = written(some.select("cid", "n", "sketch", "bands").join(suspects, "cid")
                   .groupBy("cid").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "bands")]), "odd-slim")
    # any row of a class stands for it: all of them hold the same set
    chosen = written(some.groupBy("cid").agg(F.min(F.struct("k1", "k2")).alias("k")).join(suspects, "cid")
                     .select("cid", "k.*"), "odd-chosen")
    texts = _likely(rows.select("k1", "k2", "raw"), chosen, ["k1", "k2"])
    # rows that repeat id and text have the same keys: one is left where the join has put them
    full = written(_full(texts.join(chosen, ["k1", "k2"]).groupBy("k1", "k2")
                         .agg(F.first("cid").alias("cid"), F.first("raw").alias("raw")).select("cid", "raw"), n), "odd-full")

    labels = suspects.select("cid", F.col("cid").alias("label"))
    seen = None
    for turn in range(HUB_ROUNDS + 1):
        if turn == 0:
            # every class is its own component, and the smallest of a bucket is its hub
            members = post.select("band", "cid", F.col("cid").alias("label"), "hub", F.col("hub").alias("hub_label"))
            post = post.select("band", "cid")
        else:
            members = post.join(labels, "cid")
            chance = F.struct(F.xxhash64("cid", F.lit(turn)).alias("chance"),
                              F.col("cid").alias("hub"), F.col("label").alias("hub_label"))
            mixed = written(members.groupBy("band")
                            .agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(chance).alias("h"))
                            .where("lo <> hi").select("band", "h.hub", "h.hub_label"), "odd-mixed")
            if mixed.isEmpty():
                break
            # a bucket with one component keeps it: only the others are looked at from here on
            members = written(salted(_likely(members, mixed, ["band"]), mixed, ["band"], salts=4), "odd-members")
            post = members.select("band", "cid")
        if turn < HUB_ROUNDS:
            met = (members.where("label <> hub_label")
                   .select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct())
            if seen is not None:
                met = met.join(seen, ["a", "b"], "left_anti")
            met = written(met, "odd-met")
            seen = met if seen is None else seen.union(met)
            pairs = _near_sketches(met, slim, percent)
        else:
            open_ = members.select("band", "cid", "label").join(slim, "cid")
            labels = _joined(labels, written(_tiles(written(open_, "odd-open"), full, percent), "odd-links"))
            break
        links = _verified(written(pairs, "odd-pairs"), full, percent)
        labels = _joined(labels, written(links, "odd-links"))

    # From classes back to rows; a class without candidates is its own component.
    own = sets.select("row", "id", "n", "cid")
    known = own.where("cid is not null")
    grouped = written(salted(known, labels.where("label <> cid"), ["cid"], "left")
                      .select("row", "id", "n", F.coalesce("label", "cid").alias("label")), "odd-rows")
    best = grouped.groupBy("label").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best"))
    named = (salted(grouped, best, ["label"])
             .select("id", "n", F.col("best.id").alias("component_id"),
                     (F.col("row") == F.col("best.row")).alias("kept")))
    alone = own.where("cid is null").select("id", "n", F.col("id").alias("component_id"),
                                            F.lit(True).alias("kept"))
    return named.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                                     "component_id", "kept")
