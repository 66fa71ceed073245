"""Spelling variants: words one edit apart, found with k-d trees over letter counts.

A word's vector counts its letters. One edit moves it by at most 2 in the L1 norm (one,
if a letter comes or goes), so the near words of a word lie within distance 2 among the
words of its own length and within distance 1 among those one letter longer. For each
length a k-d tree splits the words: its top is grown in Spark, a few levels at a time
from a sample of every cell that still holds too many words, until a cell fits a task;
its bottom is built in the task. A search goes down with what is left of the distance
and prunes every box that is farther away; the words that are left are compared letter
by letter.

Every search counts and ranks inside its task, so what leaves it is one row per word
and cell, not one per pair.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, salted, written

#: A run of letters, and the share of runs that lose a letter.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
DROP = 97
MIN_LENGTH, MIN_COUNT = 5, 3
DIMS = 32                 # a to z, and the other letters by code point
CELL = 131_072            # words of a cell; every further one is searched by most words
ASKS = 32_768             # searches that a task runs in a cell
SAMPLE = 8_192            # words of a cell from which its next splits are chosen
LEAF = 8                  # words below which the tree of a task ends
SEARCHES = 1_024          # run down a tree at once

_DIM = np.array([(c - 97) if 97 <= c < 123 else 26 + c % (DIMS - 26) for c in range(256)])


def letters(words) -> np.ndarray:
    """Words of one length as a matrix of code points, all below 256."""
    words = list(words)
    return np.array(words, f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1).astype(np.uint8)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts, at most 255 each (a smaller distance prunes less, never more)."""
    at = _DIM[codes] + np.arange(len(codes))[:, None] * DIMS
    return np.minimum(np.bincount(at.ravel(), minlength=len(codes) * DIMS), 255).reshape(-1, DIMS).astype(np.int16)


class Tree:
    """A k-d tree as arrays: splitting dimension (-1: a leaf), threshold (left: at
    most it), children, and the box's old bounds in that dimension."""

    def __init__(self, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, leaf: int):
        self.lo, self.hi = lo, hi
        dim, at, left, right, a, b, self.rows = [], [], [], [], [], [], []
        todo = [(np.arange(len(v)), lo, hi, -1, 0)]
        while todo:
            rows, lo, hi, parent, side = todo.pop()
            me = len(dim)
            if parent >= 0:
                (right if side else left)[parent] = me
            x = v[rows]
            mean = np.floor(x.mean(axis=0)).astype(np.int64) if len(rows) else np.zeros(DIMS, np.int64)
            share = (x <= mean).mean(axis=0) if len(rows) > leaf else np.ones(DIMS)
            d = int(np.abs(share - 0.5).argmin())
            split = 0 < share[d] < 1
            dim.append(d if split else -1)
            at.append(int(mean[d])), left.append(-1), right.append(-1)
            a.append(int(lo[d])), b.append(int(hi[d])), self.rows.append(None if split else rows)
            if split:
                low = x[:, d] <= mean[d]
                cut, rest = hi.copy(), lo.copy()
                cut[d], rest[d] = mean[d], mean[d] + 1
                todo += [(rows[low], lo, cut, me, 0), (rows[~low], rest, hi, me, 1)]
        self.dim, self.at, self.left, self.right, self.a, self.b = (
            np.array(x, np.int32) for x in (dim, at, left, right, a, b))

    def dump(self) -> bytes:
        head = np.concatenate([self.lo, self.hi]).astype("<i4")
        return head.tobytes() + np.stack([self.dim, self.at, self.left, self.right, self.a, self.b]).astype("<i4").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        t, x = cls.__new__(cls), np.frombuffer(raw, "<i4")
        t.lo, t.hi = x[:DIMS], x[DIMS:2 * DIMS]
        t.dim, t.at, t.left, t.right, t.a, t.b = x[2 * DIMS:].reshape(6, -1)
        return t

    def home(self, v: np.ndarray) -> np.ndarray:
        """The leaf that each vector lies in."""
        node = np.zeros(len(v), np.int64)
        while (inner := self.dim[node] >= 0).any():
            k, n = np.flatnonzero(inner), node[inner]
            node[k] = np.where(v[k, self.dim[n]] <= self.at[n], self.left[n], self.right[n])
        return node

    def within(self, v: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (vector, leaf) whose box is at most ``reach`` away in the L1 norm."""
        far = np.maximum(self.lo - v, 0).sum(axis=1) + np.maximum(v - self.hi, 0).sum(axis=1)
        q = np.flatnonzero(far <= reach)
        node, left_ = np.zeros(len(q), np.int64), reach[q] - far[q]
        done = [(q[:0], node[:0])]
        while len(q):
            d = self.dim[node]
            end = d < 0
            done.append((q[end], node[end]))
            q, node, left_, d = q[~end], node[~end], left_[~end], d[~end]
            x, t = v[q, d].astype(np.int64), self.at[node]
            lo, hi = self.a[node], self.b[node]
            paid = np.maximum(lo - x, 0) + np.maximum(x - hi, 0)
            low = left_ + paid - np.maximum(lo - x, 0) - np.maximum(x - t, 0)
            high = left_ + paid - np.maximum(t + 1 - x, 0) - np.maximum(x - hi, 0)
            go_l, go_r = low >= 0, high >= 0
            q, node, left_ = (np.concatenate(z) for z in (
                (q[go_l], q[go_r]), (self.left[node][go_l], self.right[node][go_r]), (low[go_l], high[go_r])))
        return tuple(np.concatenate(z) for z in zip(*done, strict=True))


_ALL = np.zeros(DIMS, np.int64), np.full(DIMS, 255, np.int64)


def near_pairs(long: np.ndarray, short: np.ndarray, tree: Tree):
    """Chunks (i, j) of places of ``short`` and of ``long``, words one edit apart; both
    of one length, or ``long`` one letter longer. ``tree`` holds the vectors of ``long``."""
    same = long.shape[1] == short.shape[1]
    reach, sizes = 2 if same else 1, np.array([0 if r is None else len(r) for r in tree.rows])
    flat = np.concatenate([r for r in tree.rows if r is not None])
    begin = np.zeros(len(sizes), np.int64)
    leaves = [k for k, r in enumerate(tree.rows) if r is not None]
    begin[leaves] = np.cumsum([0, *sizes[leaves]])[:-1]
    for at in range(0, len(short), SEARCHES):
        w = short[at:at + SEARCHES]
        q, leaf = tree.within(vectors(w), np.full(len(w), reach))
        n = sizes[leaf]
        first = np.cumsum(n) - n
        x = flat[np.repeat(begin[leaf] - first, n) + np.arange(n.sum())]
        q = np.repeat(q, n)
        a, b = w[q], long[x]
        if same:
            good = (a != b).sum(axis=1) == 1
        else:
            # letters that agree from the front and from the back
            front = np.cumprod(a == b[:, :-1], axis=1).sum(axis=1)
            back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            good = front + back >= a.shape[1]
        yield q[good] + at, x[good]


# ------------------------------------------------------------------ the words

def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts after the deletions of the contract."""
    runs = F.regexp_extract_all(ascii_lower(F.col(text_col).cast("string")), F.lit(f"({RUN})"), F.lit(1))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    run, size = F.col("run"), F.length("run")
    h = F.crc32(F.concat(F.col("name"), F.lit(":"), run).cast("binary"))
    at = (F.col("h") % size).cast("int")
    word = F.when(F.col("h") % DROP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, size))
                  ).otherwise(run)
    # a run only gets shorter
    return (docs.select(name.alias("name"), F.explode(runs).alias("run")).where(size >= min_length)
            .withColumn("h", h).select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _grow(cells: DataFrame) -> DataFrame:
    """(cell, tree) of sampled words (cell, word, lo, hi, leaves): splits of a cell
    into about so many."""
    def build(t: pa.Table) -> pa.Table:
        words = sorted(t.column("word").to_pylist())
        leaves = t.column("leaves")[0].as_py()
        lo, hi = (np.frombuffer(t.column(c)[0].as_py(), "<i4").astype(np.int64) for c in ("lo", "hi"))
        tree = Tree(vectors(letters(words)), lo, hi, max(1, -(-len(words) // leaves)))
        return pa.table({"cell": t.column("cell").slice(0, 1), "tree": pa.array([tree.dump()], pa.binary())})

    return cells.groupBy("cell").applyInArrow(build, "cell string, tree binary")


def _descend(rows: DataFrame, trees: DataFrame, search: bool) -> DataFrame:
    """Rows (cell, word, reach, ...) of cells with a tree, in the leaves where they lie
    or, for ``search``, may have near words."""
    cols = [c for c in rows.columns if c != "cell"]

    def run(batches):
        for b in batches:
            t = b.to_pandas()
            t["size"] = t["word"].str.len()
            out = []
            for (cell, raw, _), g in t.groupby(["cell", "tree", "size"], sort=False):
                tree, v = Tree.load(raw), vectors(letters(g["word"]))
                if search:
                    q, leaf = tree.within(v, g["reach"].to_numpy())
                    g = g.iloc[q]
                else:
                    leaf = tree.home(v)
                out.append(g.assign(cell=[f"{cell}.{k}" for k in leaf]))
            if out:
                yield pa.RecordBatch.from_pandas(pd.concat(out)[["cell", *cols]], preserve_index=False)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("cell", *cols).schema)
    return salted(rows, trees, ["cell"]).select("cell", *cols, "tree").mapInArrow(run, schema)


def _boxes(trees: DataFrame) -> DataFrame:
    """(cell, lo, hi) of the leaves of trees (cell, tree)."""
    def run(batches):
        for b in batches:
            cells, los, his = [], [], []
            for cell, raw in zip(b.column("cell").to_pylist(), b.column("tree"), strict=True):
                t = Tree.load(raw.as_py())
                todo = [(0, t.lo, t.hi)]
                while todo:
                    k, lo, hi = todo.pop()
                    if t.dim[k] < 0:
                        cells.append(f"{cell}.{k}"), los.append(lo.astype("<i4").tobytes())
                        his.append(hi.astype("<i4").tobytes())
                        continue
                    cut, rest = hi.copy(), lo.copy()
                    cut[t.dim[k]], rest[t.dim[k]] = t.at[k], t.at[k] + 1
                    todo += [(t.left[k], lo, cut), (t.right[k], rest, hi)]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array(los, pa.binary()),
                                              pa.array(his, pa.binary())], names=["cell", "lo", "hi"])

    return trees.mapInArrow(run, "cell string, lo binary, hi binary")


def near_words(words: DataFrame, cell_words: int = CELL, sample: int = SAMPLE, asks_each: int = ASKS) -> DataFrame:
    """(word, n_near, n, form): per word with a near one their number, and of the most
    frequent (of equal ones the smallest) its count and itself."""
    start = F.length("word").cast("string")
    index = written(words.select(start.alias("cell"), "word", "n"), "spell-words")
    # a word looks among those of its length and among those one letter longer
    asks = written(index.select(
        "word", "n", F.explode(F.array(F.lit(2), F.lit(1))).alias("reach"))
        .withColumn("cell", (F.length("word") + 2 - F.col("reach")).cast("string")), "spell-asks")
    lo, hi = (x.astype("<i4").tobytes() for x in _ALL)
    boxes = index.select("cell").distinct().select("cell", F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    done_index, done_asks = [], []
    while True:
        sizes = written(index.groupBy("cell").agg(F.count("*").alias("size"), F.sum(F.length("word")).alias("letters"))
                        .withColumn("cells", F.ceil(F.greatest(F.col("size"), F.col("letters") / 64) / cell_words)),
                        "spell-sizes")
        asks = salted(asks, sizes.select("cell"), ["cell"])       # others find nothing
        large = written(sizes.where("cells > 1").join(boxes, "cell"), "spell-large")
        if large.isEmpty():
            break
        rate = F.col("size") * F.pmod(F.xxhash64("word", "cell"), F.lit(1 << 20)) < sample * (1 << 20)
        trees = written(_grow(salted(index, large, ["cell"]).where(rate).select(
            "cell", "word", "lo", "hi", F.least(2 * F.col("cells"), F.lit(64)).alias("leaves"))), "spell-trees")
        # cells of equal vectors stay as they are
        trees = trees.where(F.length("tree") > 4 * (2 * DIMS + 6))
        names = trees.select("cell")
        done_index.append(index.join(names, "cell", "left_anti"))
        done_asks.append(asks.join(names, "cell", "left_anti"))
        if trees.isEmpty():
            index, asks = index.limit(0), asks.limit(0)
            break
        index = written(_descend(index.select("cell", "word", "n"), trees, False), "spell-index")
        asks = written(_descend(asks.select("cell", "word", "n", "reach"), trees, True), "spell-asks")
        boxes = written(_boxes(trees), "spell-boxes")
    index = reduce(DataFrame.unionByName, [*done_index, index])
    asks = reduce(DataFrame.unionByName, [*done_asks, asks])
    return _searched(index, asks, cell_words, asks_each)


def _searched(index: DataFrame, asks: DataFrame, cell_words: int, asks_each: int) -> DataFrame:
    """Searches in cells; a cell of too many words or searches is dealt in blocks."""
    both = written(index.withColumn("reach", F.lit(0)).unionByName(asks), "spell-cells")
    number = F.greatest(F.count("*"), F.ceil(F.sum(F.length("word")) / 64))
    each = F.when(F.col("held"), F.lit(cell_words)).otherwise(F.lit(asks_each))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / each)).cast("long")
    sizes = both.groupBy("cell", (F.col("reach") == 0).alias("held")).agg(number.alias("rows")).withColumn("parts", parts)
    sizes = written(sizes.groupBy("cell").agg(
        F.coalesce(F.max(F.when(F.col("held"), F.col("parts"))), F.lit(1)).alias("held_parts"),
        F.coalesce(F.max(F.when(~F.col("held"), F.col("parts"))), F.lit(0)).alias("ask_parts"))
        .where("ask_parts > 0"), "spell-parts")
    held = F.col("reach") == 0
    own = F.pmod(F.xxhash64("word", F.lit(7)), F.when(held, F.col("held_parts")).otherwise(F.col("ask_parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(held, F.col("ask_parts")).otherwise(F.col("held_parts")) - 1))
    dealt = (salted(both, sizes, ["cell"]).withColumn("own", own).withColumn("other", other)
             .select("cell", F.when(held, F.col("own")).otherwise(F.col("other")).alias("i"),
                     F.when(held, F.col("other")).otherwise(F.col("own")).alias("j"), "word", "n", "reach"))

    def look(t: pa.Table) -> pa.Table:
        t = t.to_pandas().sort_values("word", kind="stable").reset_index(drop=True)   # by code point
        x = t[t["reach"] == 0].reset_index()
        out = []
        if len(x):
            codes = letters(x["word"])
            tree = Tree(vectors(codes), *_ALL, LEAF)
            for reach in (2, 1):
                q = t[t["reach"] == reach].reset_index()
                # with a reach of 1 the words are one letter shorter
                if not len(q):
                    continue
                for i, j in near_pairs(codes, letters(q["word"]), tree):
                    out.append((q["index"].to_numpy()[i], x["index"].to_numpy()[j]))
                    if reach == 1:
                        out.append(out[-1][::-1])
        a, b = (np.concatenate([np.empty(0, np.int64), *(p[k] for p in out)]) for k in range(2))
        if not len(a):
            return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()),
                             "n": pa.array([], pa.int64()), "form": pa.array([], pa.string())})
        word, n = t["word"].to_numpy(), t["n"].to_numpy()
        a = np.unique(word, return_inverse=True)[1][a]        # a word asks once per reach
        name = np.unique(word)
        order = np.lexsort((b, -n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        return pa.table({"word": pa.array(name[a[first]], pa.string()),
                         "n_near": pa.array(np.diff(np.append(first, len(a))), pa.int64()),
                         "n": pa.array(n[b[first]], pa.int64()), "form": pa.array(word[b[first]], pa.string())})

    found = dealt.groupBy("cell", "i", "j").applyInArrow(look, "word string, n_near long, n long, form string")
    best = F.min(F.struct((-F.col("n")).alias("less"), "form")).alias("best")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
            .select("word", "n_near", (-F.col("best.less")).alias("n"), F.col("best.form").alias("form")))


def _roots(words: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: pointers to forms, doubled each round. A
    form is at least twice as frequent, so chains are short."""
    at = written(words.where("form is not null").select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = written(salted(at, jump, ["root"], "left")
                      .select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")),
                      "spell-roots")
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                      cell_words: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """Words of a corpus with their spelling variants.

    Words are the maximal runs of Latin letters, A-Z lower-cased; of runs whose
    ``crc32('<id>:<run>')`` DROP divides, the letter at crc32 % length is deleted. Kept
    are those of ``min_length`` letters that occur ``min_count`` times. One row per
    word: (word, n, n_near, form, form_n, root). ``n_near``: words one insertion,
    deletion or replacement apart; ``form``: the most frequent of them (of equal ones
    the first by code point) if it is at least twice as frequent as the word; ``root``:
    where forms lead to in the end, the word itself without a form. Null and empty
    texts have no words, a null id counts as an empty string, repeated rows count
    again, other columns are ignored, an empty table gives an empty result. All words
    are searched; ``sample`` only chooses where cells are split.
    """
    words = written(word_counts(docs, id_col, text_col, min_length, min_count), "spell-counts")
    near = near_words(words, cell_words, sample)
    good = F.col("f_n") >= 2 * F.col("n")
    found = written(words.join(near.withColumnRenamed("n", "f_n"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("form")).alias("form"), F.when(good, F.col("f_n")).alias("form_n")), "spell-found")
    return found.join(_roots(found), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
