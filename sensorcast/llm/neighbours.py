"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are grown on a bounded sample; every vector is then routed down every
tree to a leaf. A query walks all trees with one shared priority queue, ordered by
the sum of squared distances to the split planes passed on the wrong side, until
it has its share of the leaves. Leaves (in spans of neighbouring ones, large spans in
blocks) and their queries meet in an equi join, and the candidates are ranked
exactly, on the original vectors.

Largest inner product is turned into nearest neighbour by one more component that
gives all vectors the same norm (the largest one).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import salted, written

TREES = 12
#: The trees are grown on at most so many vectors, those with the smallest hash.
SAMPLE = 20_000
LEAF = 48                 # sample vectors in a leaf, at most
LEAVES = 0.05             # share of the leaves of all trees that a query looks into,
LEAST_LEAVES = 64         # and so many more
SPAN = 16                 # neighbouring leaves of a tree that are compared together
BLOCK = 4096              # vectors of a span that one task compares at once,
ASKS = 4096               # with at most so many queries or a few more
WALKS = 32                # tasks that look for the leaves of the queries, at least


@dataclass
class Tree:
    normals: np.ndarray   # inner nodes x dimensions
    offsets: np.ndarray
    left: np.ndarray      # child: an inner node, or -1 - leaf
    right: np.ndarray
    leaves: int

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row."""
        node = np.zeros(len(x), np.int64) if len(self.left) else np.full(len(x), -1)
        while (go := node >= 0).any():
            at = node[go]
            side = (x[go] * self.normals[at]).sum(1) > self.offsets[at]
            node[go] = np.where(side, self.right[at], self.left[at])
        return -1 - node


def grow(sample: np.ndarray, seed: int, leaf: int = LEAF) -> Tree:
    """Split by the plane halfway between two random vectors, moved to the median,
    until a cell has at most ``leaf`` vectors or they are all alike."""
    rng = np.random.default_rng(seed)
    normals, offsets, left, right = [], [], [], []
    leaves = 0

    def build(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(5):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                normal = a - b
                if not normal.any():
                    continue
                side = sample[rows] @ normal
                cut = float(np.median(side))
                high = side > cut
                if high.any() and not high.all():
                    me = len(left)
                    normals.append(normal / np.linalg.norm(normal))
                    offsets.append(cut / np.linalg.norm(normal))
                    left.append(0)
                    right.append(0)
                    left[me] = build(rows[~high])
                    right[me] = build(rows[high])
                    return me
        leaves += 1
        return -leaves

    root = build(np.arange(len(sample)))
    assert root <= 0
    dim = sample.shape[1] if sample.ndim == 2 else 0
    return Tree(np.array(normals).reshape(-1, dim), np.array(offsets), np.array(left, np.int64),
                np.array(right, np.int64), leaves)


def search(trees: list[Tree], query: np.ndarray, n_leaves: int) -> list[tuple[int, int]]:
    """(tree, leaf) pairs in order of one priority queue over all trees."""
    margins = [t.normals @ query - t.offsets for t in trees]
    heap = [(0.0, i, 0 if len(t.left) else -1) for i, t in enumerate(trees)]
    heapq.heapify(heap)
    found = []
    while heap and len(found) < n_leaves:
        worst, i, node = heapq.heappop(heap)
        t, m = trees[i], margins[i]
        while node >= 0:
            d = float(m[node])
            near, far = (t.right[node], t.left[node]) if d > 0 else (t.left[node], t.right[node])
            heapq.heappush(heap, (worst + d * d, i, int(far)))
            node = int(near)
        found.append((i, -1 - node))
    return found


def _scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows get equal sums."""
    return (vectors * query).sum(1)


def _valid(vector):
    return (vector.isNotNull() & (F.size(vector) > 0)
            & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vector, lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding", trees: int = TREES, leaves: float = LEAVES,
            sample: int = SAMPLE, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """The ``k`` rows with the largest inner product for every query row.

    ``is_query``: a condition on the input's columns. One row per neighbour:
    (query_id, rank from 1, id_col, score); ties go to the smaller id, a query's
    own id is not its neighbour. Equal vectors are indexed once and stand for the
    smallest ``k + 1`` of their ids, so a vector that a third of the rows share
    costs no more than another. Vectors that are null, zero or hold a null or a
    non-finite component take no part, nor do rows without an id or those whose
    length differs from the most frequent one; repeated rows count once; an empty
    table gives an empty result. With fewer than ``k`` candidates found in its
    leaves a query goes on to further leaves, up to all of them. One comparison holds
    about BLOCK vectors and ASKS queries, however many share a region.
    """
    spark = vectors.sparkSession
    rows = (vectors.where(F.col(id_col).isNotNull() & is_query.isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"),
                    F.col(vector_col).alias("v")).where(_valid(F.col("v"))))
    kind = rows.schema["v"].dataType.simpleString()      # kept as it is in the shuffles
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out_type = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()),
                             T.StructField(id_col, T.LongType()), T.StructField("score", T.DoubleType())])
    if dims is None:
        return spark.createDataFrame([], out_type)
    rows = rows.where(F.size("v") == dims.d)
    # equal vectors: one index entry with the smallest ids (a bounded list)
    top = W.partitionBy("h", "v").orderBy("id")
    entries = written(
        rows.select("id", F.xxhash64("v").alias("h"), "v").distinct()
        .withColumn("i", F.row_number().over(top)).where(F.col("i") <= k + 1)
        .groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), "ann-entries")
    largest = entries.agg(F.max("norm2")).first()[0]

    def lifted(x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, largest - (x * x).sum(1)))
        return np.concatenate([x, rest[:, None]], 1)

    picked = entries.select("h", "v").orderBy(F.xxhash64("h"), "h").limit(sample).toPandas()
    fitted = lifted(np.array(picked["v"].tolist(), float))
    grown = [grow(fitted, seed + i, leaf) for i in range(trees)]
    n_leaves = LEAST_LEAVES + round(leaves * sum(t.leaves for t in grown))
    forest = spark.sparkContext.broadcast(grown)      # bounded by the sample

    def matrix(column) -> np.ndarray:
        flat = column.flatten() if hasattr(column, "flatten") else column
        return np.asarray(flat, float).reshape(len(column), -1)

    def route(batches):
        for b in batches:
            x = matrix(b.column("v"))
            up = lifted(x)
            for i, t in enumerate(forest.value):
                at = t.route(up)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(x), pa.int32()), pa.array(at, pa.int64()), b.column("ids"), b.column("v")],
                    names=["tree", "leaf", "ids", "v"])

    placed = entries.select("ids", "v").mapInArrow(
        route, f"tree int, leaf long, ids array<long>, v {kind}")
    placed = placed.withColumn("block_of", F.xxhash64("ids"))
    members = written(placed, "ann-leaves")
    members = members.withColumn("span", F.floor(F.col("leaf") / SPAN).cast("long"))
    sizes = (members.groupBy("tree", "span").count()
             .withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("long")))

    def walk(batches):
        for b in batches:
            x = matrix(b.column("v"))
            up = lifted(x)
            for i in range(len(x)):
                spans: dict = {}
                for t, f in search(forest.value, up[i], n_leaves):
                    spans.setdefault((t, f // SPAN), []).append(f)
                k_ = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("id")[i].as_py()] * k_, pa.int64()),
                     pa.array([t for t, _ in spans], pa.int32()), pa.array([g for _, g in spans], pa.int64()),
                     pa.array(list(spans.values()), pa.list_(pa.int64())),
                     pa.array([b.column("v")[i].as_py()] * k_, b.schema.field("v").type)],
                    names=["query_id", "tree", "span", "leaves", "qv"])

    parts = max(WALKS, spark.sparkContext.defaultParallelism)
    queries = rows.where("q").select("id", "v").distinct()
    asks = written(queries.repartition(parts, "id").mapInArrow(
        walk, f"query_id long, tree int, span long, leaves array<long>, qv {kind}"), "ann-asks")
    # A span that many queries ask for is compared in blocks of queries, too.
    busy = asks.groupBy("tree", "span").agg(F.ceil(F.count("*") / ASKS).cast("long").alias("turns"))
    places = written(sizes.join(busy, ["tree", "span"]).select("tree", "span", "blocks", "turns"), "ann-places")
    turn_of = F.xxhash64("query_id", F.lit("turn"))
    asked = (salted(asks, places.select("tree", "span", "blocks", "turns"), ["tree", "span"])
             .withColumn("turn", F.pmod(turn_of, F.col("turns")))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .drop("blocks", "turns"))
    blocks = (salted(members, places, ["tree", "span"])
              .withColumn("block", F.pmod("block_of", "blocks"))
              .withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
              .select("tree", "span", "block", "turn", "leaf", "ids", "v"))
    names = [f.name for f in out_type if f.name != "rank"]

    def rank(asks: pd.DataFrame, leaf_rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asks) and len(leaf_rows):
            v = np.array(leaf_rows["v"].tolist(), float)
            ids = leaf_rows["ids"].tolist()
            first = np.array([x[0] for x in ids])
            leaf_of = leaf_rows["leaf"].to_numpy()
            for q, qv, leaves_ in zip(asks["query_id"], asks["qv"], asks["leaves"], strict=True):
                mine = np.flatnonzero(np.isin(leaf_of, leaves_))
                if not len(mine):
                    continue
                s = _scores(v[mine], np.asarray(qv, float))
                best = np.flatnonzero(s >= np.partition(s, -k - 1)[-k - 1]) if len(s) > k else np.arange(len(s))
                best = best[np.lexsort((first[mine[best]], -s[best]))][:k + 1]
                near = [(-s[j], i) for j in best for i in ids[mine[j]] if i != q]
                found += [(q, i, -s_) for s_, i in sorted(near)[:k]]
        return pd.DataFrame(found, columns=names)

    place = ["tree", "span", "block", "turn"]
    ranked = (asked.groupBy(*place).cogroup(blocks.groupBy(*place))
              .applyInPandas(rank, f"query_id long, `{id_col}` long, score double"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    found = (ranked.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
             .select("query_id", F.col("rank").cast("int"), id_col, "score"))
    found = written(found, "ann-found")

    # Queries whose leaves held too few candidates look at every entry, in blocks.
    want = min(k, entries.agg(F.sum(F.size("ids"))).first()[0] - 1)
    few = (queries.join(found.groupBy(F.col("query_id").alias("id")).count(), "id", "left")
           .where(F.coalesce("count", F.lit(0)) < want).select(F.col("id").alias("query_id"), F.col("v").alias("qv")))
    few = written(few, "ann-few")
    if few.isEmpty():
        return found
    n_blocks = max(1, -(-entries.count() // BLOCK))
    n_turns = max(1, -(-few.count() // ASKS))

    def every_of(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    one = [F.lit(0).alias("tree"), F.lit(0).cast("long").alias("span")]
    every = (few.select("query_id", *one, F.array(F.lit(0).cast("long")).alias("leaves"), "qv",
                        F.pmod(turn_of, F.lit(n_turns)).alias("turn"), every_of(n_blocks).alias("block"))
             .groupBy(*place)
             .cogroup(entries.select(*one, F.pmod(F.xxhash64("ids"), F.lit(n_blocks)).alias("block"),
                                     every_of(n_turns).alias("turn"), F.lit(0).cast("long").alias("leaf"),
                                     "ids", "v").groupBy(*place))
             .applyInPandas(rank, f"query_id long, `{id_col}` long, score double")
             .distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
             .select("query_id", F.col("rank").cast("int"), id_col, "score"))
    return found.join(few, "query_id", "left_anti").unionByName(every)
