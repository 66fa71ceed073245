"""Conversation prefix trie by burst tries.

A conversation is a sequence of turn ids (hashes of role and text). Its ids are cut
into pieces of SPAN turns; a piece hangs under the trie head that the pieces before it
spell. The pieces under a head - equal ones once, with the number of their
conversations - are the suffixes in the head's container. A container of more than
CONTAINER suffixes is burst: its suffixes move to containers one turn deeper, by their
next turn id, and each of these is a node of the trie. The containers that are left fit
a task, which sorts the suffixes and sweeps over them: neighbours that agree in their
first d ids share the nodes down to depth d.

A node is named by its smallest member and its depth. So the nodes of a conversation
that it is the smallest member of are the end of its path, and a sum over a subtree is
the sum, over the members of its top, of what the nodes named by them weigh - less what
the top's namesake has above it. Sums over subtrees are thus sums over members, and the
containers are swept once more for them; no pass runs level by level.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import salted, written

#: Conversations that share a head, and the largest number of turns plus one.
FAMILY, HEADS = 5, 9
SPAN = 64                 # turns of a piece
CONTAINER = 2_000         # different suffixes that are sorted and swept at once
SHARD = 20_000            # suffixes that a task holds, in many containers
BLOCK = 256               # conversation ids that are joined before a node's are hashed

_EMPTY = hashlib.sha256(b"").hexdigest()


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, tid, bytes): turns in order, from 1. The rows are sorted by range,
    so a long conversation lies in several tasks; each numbers its own."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("tid"),
        F.octet_length(text).cast("long").alias("bytes")).where("conv is not null")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("tid")]

    def number(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            seq = []
            for c in b.column("conv").to_pylist():
                last, seen = c, seen + 1 if c == last else 1
                seq.append(seen)
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), pa.array([part] * len(seq), pa.int64()), pa.array(seq, pa.int64()),
                 b.column("tid"), b.column("bytes")], names=["conv", "part", "seq", "tid", "bytes"])

    numbered = written(turns.repartitionByRange(*order).sortWithinPartitions(*order)
                       .mapInArrow(number, "conv long, part long, seq long, tid string, bytes long"), "trie-turns")
    # only a task's first conversation can have begun before: one row per task at most
    ahead = (numbered.groupBy("conv", "part").agg(F.max("seq").alias("n"))
             .withColumn("ahead", F.sum("n").over(W.partitionBy("conv").orderBy("part")
                                                  .rowsBetween(W.unboundedPreceding, -1)))
             .where("ahead is not null").select("conv", "part", "ahead"))
    return (numbered.join(F.broadcast(written(ahead, "trie-ahead")), ["conv", "part"], "left")
            .select("conv", (F.col("seq") + F.coalesce("ahead", F.lit(0))).alias("pos"), "tid", "bytes"))


def heads_of(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, tid, bytes) of the rebuilt conversations and (conv, length) of all,
    turnless ones too."""
    convs = written(turns.groupBy("conv").agg(F.max("pos").alias("n"))
                    .withColumn("h", heads_of(F.col("conv")))
                    .withColumn("base", F.col("conv") - F.col("conv") % FAMILY), "trie-convs")
    of_base = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    lengths = written(
        convs.join(of_base, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
        .select("conv", "base", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
                (F.col("h") - F.col("taken")).alias("gap")), "trie-lengths")
    first = turns.where(F.col("pos") < HEADS).withColumnRenamed("conv", "base")
    from_base = (first.join(lengths.where("taken > 0").select("base", "conv", "taken"), "base")
                 .where(F.col("pos") <= F.col("taken")).select("conv", "pos", "tid", "bytes"))
    own = turns.where(F.col("pos") > heads_of(F.col("conv")))
    own = salted(own, lengths.where("gap > 0").select("conv", "gap"), ["conv"], "left")
    own = own.select("conv", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "tid", "bytes")
    return from_base.union(own), lengths.select("conv", "length")


def _pieces(turns: DataFrame, lengths: DataFrame, span: int) -> DataFrame:
    """(conv, k, head, ids, bytes): turns k * span + 1 on; a conversation whose length
    is a multiple of ``span`` ends with an empty piece. ``head`` names the pieces before."""
    at = F.col("pos") - 1
    cut = (turns.groupBy("conv", F.floor(at / span).alias("k"))
           .agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "bytes"))).alias("t"))
           .select("conv", "k", F.col("t.tid").alias("ids"), F.col("t.bytes").alias("bytes")))
    none = lengths.where(F.col("length") % span == 0).select(
        "conv", (F.col("length") / span).cast("long").alias("k"),
        F.array().cast("array<string>").alias("ids"), F.array().cast("array<long>").alias("bytes"))
    cut = written(cut.union(none).withColumn("spelled", F.md5(F.array_join("ids", ""))), "trie-cut")
    # a head depends on pieces that are known by their place, so they may be summed up
    before = W.partitionBy("conv").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    long = cut.join(lengths.where(F.col("length") >= span).select("conv"), "conv", "left_semi")
    head = [F.bit_xor(F.xxhash64("k", "spelled", F.lit(s))).over(before).cast("string") for s in (1, 2)]
    later = long.select("conv", "k", F.concat_ws(":", *head).alias("head")).where("k > 0")
    return (cut.join(later, ["conv", "k"], "left")
            .withColumn("head", F.coalesce("head", F.lit("")))
            .withColumn("cls", F.md5(F.concat_ws("/", F.col("k").cast("string"), "head", "spelled"))))


def _burst(suffixes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Containers of at most ``limit`` suffixes, and of those that were burst: the nodes
    (box, conv_id, depth, parent, n_convs, bytes), which class lies below which node
    (cls, box), and the classes that end at a node (cls, conv_id, depth)."""
    nodes, below, ends = [], [], []
    open_ = written(suffixes, "trie-open")
    while True:
        large = written(open_.groupBy("box").agg(F.count("*").alias("size"), F.min("m").alias("top"))
                        .where(F.col("size") > limit).select("box", "top"), "trie-large")
        if large.isEmpty():
            break
        marked = written(salted(open_, large, ["box"], "left"), "trie-marked")
        hot = marked.where("top is not null")
        ends.append(hot.where(F.size("ids") == 0).select("cls", F.col("top").alias("conv_id"), "depth"))
        moved = hot.where(F.size("ids") > 0).select(
            "cls", F.md5(F.concat("box", F.get("ids", F.lit(0)))).alias("box"), (F.col("depth") + 1).alias("depth"),
            F.slice("ids", F.lit(2), F.size("ids")).alias("ids"), F.get("bytes", F.lit(0)).alias("size"),
            F.slice("bytes", F.lit(2), F.size("bytes")).alias("bytes"), "n", "m", "top")
        moved = written(moved, "trie-moved")
        nodes.append(written(moved.groupBy("box").agg(
            F.min("m").alias("conv_id"), F.first("depth").alias("depth"), F.first("top").alias("parent"),
            F.sum("n").alias("n_convs"), F.first("size").alias("bytes")), "trie-burst"))
        below.append(moved.select("cls", "box"))
        open_ = written(marked.where("top is null").drop("top")
                        .unionByName(moved.drop("top", "size")), "trie-open")
    spark = open_.sparkSession
    empty = [spark.createDataFrame([], s) for s in (
        "box string, conv_id long, depth long, parent long, n_convs long, bytes long", "cls string, box string",
        "cls string, conv_id long, depth long")]

    def all_of(parts, none):
        for p in parts:
            none = none.unionByName(p)
        return none

    return open_, *(all_of(p, e) for p, e in zip((nodes, below, ends), empty, strict=True))


_NODE = "conv_id long, depth long, parent long, n_convs long, bytes long, weight long, leaves long, cls string"


def _sweep(rows: list[tuple], base: int) -> list[tuple]:
    """Nodes of one container, from its sorted suffixes (ids, cls, bytes, n, m, weight,
    leaves), and the classes that end at a node (last value, without a parent)."""
    top = min(r[4] for r in rows)
    out: list[tuple] = []
    path: list[list] = []              # the open nodes: m, n, weight, leaves, bytes, classes that end there
    closed: list[tuple] = []           # children before their parents

    def close(depth: int) -> None:
        while len(path) > depth:
            m, n, weight, leaves, _, _ = node = path.pop()
            closed.append((len(path) + 1, *node))
            if path:
                up = path[-1]
                up[:4] = min(up[0], m), up[1] + n, up[2] + weight, up[3] + leaves
        if not path:
            names = {0: top}           # read backwards, a parent is named before its children
            for d, m, n, weight, leaves, size, done in reversed(closed):
                names[d] = m
                out.append((m, base + d, names[d - 1], n, size, weight, leaves, None))
                out.extend((m, base + d, None, None, None, None, None, c) for c in done)
            closed.clear()

    before: list = []
    for ids, cls, sizes, n, m, weight, leaves in rows:
        same = 0
        while same < min(len(before), len(ids)) and before[same] == ids[same]:
            same += 1
        close(same)
        for k in range(same, len(ids)):
            path.append([m, 0, 0, 0, sizes[k], []])
        if ids:
            last = path[-1]
            last[:4] = min(last[0], m), last[1] + n, last[2] + weight, last[3] + leaves
            last[5].append(cls)
        else:
            out.append((top, base, None, None, None, None, None, cls))
        before = ids
    close(0)
    return out


def _swept(suffixes: DataFrame, shards: int) -> DataFrame:
    """The nodes of containers (box, cls, depth, ids, bytes, n, m, weight, leaves), and
    the classes that end at a node (with ``cls``, and no parent). A shard holds many
    containers, each of them whole."""
    def run(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in (
            "box", "ids", "cls", "bytes", "n", "m", "weight", "leaves", "depth")), strict=True))
        rows.sort(key=lambda r: r[:3])
        out, at = [], 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k][0] != rows[at][0]:
                out += _sweep([r[1:8] for r in rows[at:k]], rows[at][8])
                at = k
        cols = list(zip(*out, strict=True)) or [()] * 8
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.string())],
                                    names=[f.split()[0] for f in _NODE.split(", ")])

    return (suffixes.withColumn("shard", F.pmod(F.xxhash64("box"), F.lit(shards)))
            .groupBy("shard").applyInArrow(run, _NODE))


def _hashed(last: DataFrame) -> DataFrame:
    """(cls, sha): the hash of the comma-joined ids of the conversations (conv, cls).
    Ids are joined in blocks first; the blocks of a class in more than one are hashed
    one after the other, of which a task holds one batch."""
    blocks = written(last.groupBy("cls", F.floor(F.col("conv") / BLOCK).alias("block"))
                     .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")),
                                                   lambda c: c.cast("string")), ",").alias("ids")), "trie-blocks")
    spread = blocks.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
    spread = written(spread, "trie-spread")
    one = blocks.join(spread, "cls", "left_anti").select("cls", F.sha2("ids", 256).alias("sha"))

    def run(batches):
        cls, h = None, None
        for b in batches:
            done = []
            for c, ids in zip(b.column("cls").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if c != cls:
                    if cls is not None:
                        done.append((cls, h.hexdigest()))
                    cls, h = c, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)],
                                             names=["cls", "sha"])
        if cls is not None:
            yield pa.RecordBatch.from_arrays([pa.array([cls]), pa.array([h.hexdigest()])], names=["cls", "sha"])

    many = (blocks.join(spread, "cls", "left_semi").repartition("cls").sortWithinPartitions("cls", "block")
            .select("cls", "ids").mapInArrow(run, "cls string, sha string"))
    return one.union(many)


def prefix_trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text", span: int = SPAN,
                container: int = CONTAINER) -> DataFrame:
    """The trie of the rebuilt conversations' turn sequences.

    Turns are ordered by ``turn`` (null first), equal ones by the MD5 of role and text;
    a null role or text is empty, rows without a conversation id belong to none.
    Conversation c is rebuilt from the first h turns of c - c % 5 and its own after its
    first h, h = crc32(c) % 9. One row per node, that is distinct sequence of first
    turns, the empty one included: (conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256), ``conv_id`` the smallest
    conversation that begins with it. ``saved_tokens``: over its subtree, the UTF-8
    bytes of each node's last text for every member but one. Repeated rows are turns of
    their own, other columns are ignored, an empty table gives an empty result. Turn
    sequences are told apart by 128-bit hashes.
    """
    turns, lengths = rebuilt(_turns(rows, conv_col, turn_col, role_col, text_col))
    pieces = written(_pieces(turns, lengths, span), "trie-pieces")
    classes = written(pieces.groupBy("cls").agg(
        F.first("k").alias("k"), F.first("head").alias("head"), F.first("ids").alias("ids"),
        F.first("bytes").alias("bytes"), F.count("*").alias("n"), F.min("conv").alias("m")), "trie-classes")
    open_, burst, below, ends = _burst(classes.select(
        "cls", F.md5(F.concat_ws("/", F.col("k").cast("string"), "head")).alias("box"),
        (F.col("k") * span).alias("depth"), "ids", "bytes", "n", "m"), container)
    shards = max(8, -(-classes.count() // SHARD))
    no = F.lit(0).cast("long")
    first = written(_swept(open_.withColumns({"weight": no, "leaves": no}), shards), "trie-swept")

    columns = ["conv_id", "depth", "parent", "n_convs", "bytes"]
    root = written(classes.where("k = 0").groupBy("k").agg(F.min("m").alias("conv_id"), F.sum("n").alias("n_convs"))
                   .select("conv_id", F.col("k").alias("depth"), F.lit(None).cast("long").alias("parent"),
                           "n_convs", no.alias("bytes")), "trie-root")
    nodes = first.where("cls is null").select(*columns).unionByName(burst.select(*columns)).unionByName(root)
    children = (nodes.where("parent is not null")
                .groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
                .agg(F.count("*").alias("n_children")))
    nodes = written(nodes.join(children, ["conv_id", "depth"], "left")
                    .select(*columns, F.coalesce("n_children", no).alias("n_children"),
                            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), "trie-nodes")

    # What the nodes named by a conversation weigh, summed over the members of a class.
    weigh = [F.sum(c).alias(c) for c in ("weight", "leaves")]
    own = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.sum("saved").alias("weight"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"))
    weights = written(pieces.select("conv", "cls").join(own, "conv").groupBy("cls").agg(*weigh), "trie-weights")
    weighed = {c: F.coalesce(c, no) for c in ("weight", "leaves")}
    sums = (_swept(open_.join(weights, "cls", "left").withColumns(weighed), shards).where("cls is null")
            .select("conv_id", "depth", "weight", "leaves"))
    at_burst = below.join(weights, "cls").groupBy("box").agg(*weigh)
    sums = sums.unionByName(burst.select("box", "conv_id", "depth").join(at_burst, "box", "left")
                            .withColumns(weighed).drop("box"))
    total = (classes.where("k = 0").select("cls", F.col("m").alias("conv_id")).join(weights, "cls", "left")
             .agg(F.min("conv_id").alias("conv_id"), *weigh).withColumns(weighed))
    sums = sums.unionByName(total.where("conv_id is not null").select("conv_id", no.alias("depth"), "weight", "leaves"))

    # What lies above a node on the path of the conversation that names it.
    step = F.floor(F.col("depth") / span)
    in_step = W.partitionBy("conv_id", "step").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    stepped = nodes.withColumn("step", step)
    earlier = (stepped.groupBy("conv_id", "step").agg(F.sum("saved").alias("s")).withColumn(
        "earlier", F.sum("s").over(W.partitionBy("conv_id").orderBy("step").rowsBetween(W.unboundedPreceding, -1)))
        .where("earlier is not null").select("conv_id", "step", "earlier"))
    above = (stepped.withColumn("near", F.sum("saved").over(in_step)).join(earlier, ["conv_id", "step"], "left")
             .withColumn("above", F.coalesce("near", no) + F.coalesce("earlier", no)))

    last = pieces.where(F.size("ids") < span).select("conv", "cls")
    ends = first.where("cls is not null").select("cls", "conv_id", "depth").unionByName(ends)
    # the end of a class of whole conversations; a full piece goes on below
    at_end = ends.join(_hashed(last), "cls").select("conv_id", "depth", "sha")
    return (above.join(sums, ["conv_id", "depth"]).join(at_end, ["conv_id", "depth"], "left")
            .select(F.col("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                    F.col("leaves").alias("n_leaves"),
                    (F.col("weight") - F.col("above")).alias("saved_tokens"),
                    F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256")))
