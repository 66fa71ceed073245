"""N-gram Jaccard join by multiple-global-order filtering.

Texts are sets of word shingles. In any global order of the shingles, two sets
with a Jaccard similarity of at least t share one of the first
n - ceil(t * n) + 1 shingles of each. Candidates must share such a prefix
shingle in every one of several orders; only those that pass all are verified.

All orders put the shingles that a single set holds first: they cannot be
shared, so a set with too many of them drops out before any pair is formed. The
first order goes on by rarity, the others by hash.

Equal sets are one class from the start. Pairs are formed in rounds: in each
bucket of a prefix shingle the members are compared with one hub, linked sets
become components, and pairs inside a component need no comparison any more; a
last round forms all pairs of a bucket that lie in different components, so that
no link is lost.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted, written
from .fingerprints import gram_hashes, mix, ranges_for, shared_fingerprints, unpack, word_hashes

N, PERCENT = 5, 80
HUB_ROUNDS = 2
ORDERS = 3                # one by rarity and two by hash
TILE_ROWS = 2048          # sets of a bucket that are compared with as many at once, or a few more
BITMAP = 16               # 64-bit words of a set's bitmap
U = np.uint64


def shingle_set(text: bytes, n: int = N) -> tuple[np.ndarray, int, int, int]:
    """(fingerprints, set size, and two hashes of the whole set) of a text."""
    h = np.unique(gram_hashes(word_hashes(text.lower()), n))
    with np.errstate(over="ignore"):
        a, b = mix(h).sum(dtype=U), mix(h ^ U(0x5555)).sum(dtype=U)
    return np.unique(h >> U(16)), len(h), int(a.astype(np.int64)), int(b.astype(np.int64))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bit h(t) is set for every token t: a bit that only one of two sets has
    stands for a token that the other lacks."""
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[(mix(tokens ^ U(0xB17)) % U(64 * BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _at_most(x: str, y: str):
    """Upper bound of the intersection: the shared tokens of either set less its
    bits that the other set has not."""
    def less(a, b):
        gone = sum((F.bit_count(F.col(f"{a}_bits")[i].bitwiseAND(F.bitwise_not(F.col(f"{b}_bits")[i])))
                    for i in range(BITMAP)), F.lit(0))
        return F.col(f"{a}_s") - gone
    return F.least(less(x, y), less(y, x))


def _tiled_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets of one bucket in different components that their bitmaps
    let pass. Sets whose sizes can be similar lie in the same size class or in two
    neighbouring ones, so only these meet; a large class is cut into blocks, and a task
    compares one block with another."""
    # a little wider than the largest ratio of sizes, so that rounding separates no pair
    step = 1.001 * max(math.log(100 / percent), 1e-3)
    rows = open_.withColumn("level", F.floor(F.log("n") / step))
    # classes of more than one block, as seen from themselves and from their neighbours
    large = written(rows.groupBy("token", "level").agg(F.ceil(F.count("*") / TILE_ROWS).cast("long").alias("blocks"))
                    .where("blocks > 1"), "near-blocks")
    for name, up in (("own", 0), ("above", 1), ("below", -1)):
        rows = (salted(rows, large.select("token", (F.col("level") - up).alias("level"), F.col("blocks").alias(name)),
                       ["token", "level"], "left").withColumn(name, F.coalesce(name, F.lit(1))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("own")))

    def side(p: str, place: str, other: str, neighbour: str) -> DataFrame:
        """Every set once for each block that it meets: of its own class (up = 0), and
        of the class above (x) or below (y), up = 1."""
        def met(up: int, blocks: str):
            return F.transform(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1),
                               lambda k: F.struct(F.lit(up).alias("up"), k.alias(other)))
        low = F.col("level") - (F.col("meet.up") if p == "y" else F.lit(0))
        return (rows.withColumn("meet", F.explode(F.concat(met(0, "own"), met(1, neighbour))))
                .select("token", low.alias("low"), "meet.up", F.col("block").alias(place), f"meet.{other}",
                        *[F.col(c).alias(f"{p}_{c}") for c in ("cid", "n", "s", "label", "bits")]))

    x, y = side("x", "i", "j", "above"), side("y", "j", "i", "below")
    bound = _at_most("x", "y")
    same = [x[c] == y[c] for c in ("token", "low", "up", "i", "j")]
    return (x.join(y, functools.reduce(operator.and_, same)
                   & ((x["up"] == 1) | (F.col("x_cid") < F.col("y_cid"))) & (F.col("x_label") != F.col("y_label"))
                   & (100 * bound >= percent * (F.col("x_n") + F.col("y_n") - bound)))
            .select(F.least("x_cid", "y_cid").alias("a"), F.greatest("x_cid", "y_cid").alias("b")))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the remaining orders and the exact comparison."""
    cols = ["cid", "n", "shared", *[f"order{i}" for i in range(1, ORDERS)]]
    left = sets.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    right = sets.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    both = (pairs.join(left, pairs["a"] == F.col("a_cid")).join(right, pairs["b"] == F.col("b_cid")))
    for i in range(1, ORDERS):
        both = both.where(F.arrays_overlap(f"a_order{i}", f"b_order{i}"))
    common = F.size(F.array_intersect("a_shared", "b_shared"))
    return (both.withColumn("common", common)
            .where(100 * F.col("common") >= percent * (F.col("a_n") + F.col("b_n") - F.col("common")))
            .select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): the smallest node that can
    be reached. Smallest neighbour labels and pointer jumping, each round
    written to the shared folder."""
    both = written(edges.union(edges.select(F.col("b"), F.col("a"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                     .select("node", F.least("node", "m").alias("label")), "cc-labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("hop"),
                                                F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("hop"), F.col("label").alias("far"))
        new = written(salted(step, jump, ["hop"]).select("node", F.least("hop", "far").alias("label"), "old"),
                      "cc-labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links; ``labels`` (node, label) of all nodes."""
    l1, l2 = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    edges = (links.join(l1, "a").join(l2, "b").where("la <> lb")
             .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    top = components(edges).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return written(salted(labels, top, ["label"], "left")
                   .select("node", F.coalesce("to", "label").alias("label")), "near-labels")


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  n: int = N, percent: int = PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of ``percent`` or more.

    A document's set: its distinct n-word shingles (A-Z lower-cased, words
    between white space); with fewer words the whole sequence is the one
    element; without words the set is empty and linked with nothing. One row per
    input row: (id_col, n_shingles, component_id, keep) and the columns in
    ``carry``, whose names must differ from these. ``component_id``: the
    smallest id reachable by links, the own one included; null only where no
    member has an id. ``keep`` is true for one row of every component, that with
    the smallest id (of equal ones any). Null texts have empty sets; rows
    repeating an id are documents of their own; an empty table gives an empty
    result.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("id"),
                                F.struct(F.lit(0).alias("_"), *carry).alias("carried")).alias("payload"),
                       text.cast("binary").alias("raw"))
    chars = docs.agg(F.sum(F.length(text))).first()[0]
    words = (chars or 0) // 6

    def extract(raw):
        return shingle_set(raw, n)

    marked = shared_fingerprints(rows, extract, ranges_for(words))
    full = F.length("shared") / 6 * 100 >= F.lit(percent) * F.col("n")
    marked = written(marked.select(
        F.monotonically_increasing_id().alias("row"), F.col("payload.id").alias("id"),
        F.col("payload.carried").alias("carried"), "n", "a", "b", F.when(full & (F.col("n") > 0), F.col("shared")).alias("shared")), "near-marked")
    suspects = marked.where("shared is not null")

    # Classes of equal sets; once more, shared means shared with another class.
    classes = written(suspects.groupBy("n", "a", "b").agg(F.first("shared").alias("raw"))
                      .select(F.struct("n", "a", "b").alias("payload"), "raw"), "near-classes")
    entries = classes.agg(F.sum(F.length("raw") / 6).cast("long")).first()[0]

    def again(raw):
        return unpack(raw), 0, 0, 0

    def prefixes(batches):
        for b in batches:
            out = []
            for cls, fps, df in zip(b.column("payload").to_pylist(), b.column("shared"), b.column("df"), strict=True):
                size, t = cls["n"], unpack(fps.as_py())
                d = np.frombuffer(df.as_py(), "<u4")
                need = -(-percent * size // 100)
                first = size - need + 1 - (size - len(t))     # prefix places left for shared ones
                if first <= 0:
                    continue
                orders = [np.lexsort((t, d))] + [np.argsort(mix(t + U(k * 0x9E37))) for k in range(1, ORDERS)]
                out.append((cls["a"], size, len(t), t.astype(np.int64), bitmap(t),
                            *(t[o[:first]].astype(np.int64) for o in orders)))
            cols = list(zip(*out, strict=True)) or [[]] * (5 + ORDERS)
            types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * (2 + ORDERS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    names = ["cid", "n", "s", "shared", "bits", *[f"order{i}" for i in range(ORDERS)]]
    sets = written(
        shared_fingerprints(classes, again, ranges_for(entries)).select("payload", "shared", "df")
        .mapInArrow(prefixes, "cid long, n long, s long, shared array<long>, bits array<long>, "
                    + ", ".join(f"order{i} array<long>" for i in range(ORDERS))), "near-sets")
    postings = written(sets.select("cid", "n", "s", F.explode("order0").alias("token")), "near-postings")

    labels = sets.select(F.col("cid").alias("node"), F.col("cid").alias("label"))
    seen = None
    # an upper bound of the intersection is the smaller number of shared shingles
    possible = "100 * least({0}s, {1}s) >= " + str(percent) + " * ({0}n + {1}n - least({0}s, {1}s))"
    for turn in range(HUB_ROUNDS + 1):
        members = postings.join(labels.withColumnRenamed("node", "cid"), "cid")
        # buckets that still hold several components
        mixed = (members.groupBy("token")
                 .agg(F.min("label").alias("low"), F.max("label").alias("high"),
                      F.max(F.struct((F.col("s") / F.col("n") if turn == 0 else F.lit(0.0)).alias("central"),
                                     F.xxhash64("cid", F.lit(turn)).alias("chance"), F.col("cid").alias("h_cid"),
                                     F.col("n").alias("h_n"), F.col("s").alias("h_s"),
                                     F.col("label").alias("h_label"))).alias("hub"))
                 .where("low <> high").select("token", "hub.*"))
        if turn < HUB_ROUNDS:
            met = (salted(members, mixed, ["token"]).where("label <> h_label")
                   .where(possible.format("", "h_"))
                   .select(F.least("cid", "h_cid").alias("a"), F.greatest("cid", "h_cid").alias("b")))
        else:
            open_ = salted(members, mixed.select("token"), ["token"]).join(sets.select("cid", "bits"), "cid")
            met = _tiled_pairs(written(open_, "near-open"), percent)
        pairs = met.distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        seen = pairs if seen is None else seen.union(pairs)
        links = written(_links(pairs, sets, percent), "near-links")
        labels = _merged(labels, links)

    # From classes back to rows; sets with empty or unshared parts stand alone.
    grouped = written(salted(suspects.select("row", "id", "carried", "n", "a"), labels.withColumnRenamed("node", "a"), ["a"], "left")
                      .select("row", "id", "carried", "n", F.coalesce("label", "a").alias("label")), "near-rows")
    best = grouped.groupBy("label").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best"))
    named = (salted(grouped, best, ["label"])
             .select("id", "carried", "n", F.col("best.id").alias("component_id"),
                     (F.col("row") == F.col("best.row")).alias("keep")))
    alone = marked.where("shared is null").select("id", "carried", "n", F.col("id").alias("component_id"),
                                                  F.lit(True).alias("keep"))
    return named.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                                     "component_id", "keep",
                                     *[F.col(f"carried.`{c}`").alias(c) for c in carry])
