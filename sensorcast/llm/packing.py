"""Packing: mixture-controlled sequences by deficit round-robin.

The tokenized documents of a source, long ones in pieces, form its queue in the order
of a hash of id, text and piece, so that it depends on the documents alone. The queues
are dealt to groups of windows in proportion to their lengths: group g holds the tokens
of a source between floor(total * g / groups) and floor(total * (g + 1) / groups), so
every group has the target mixture, whatever a source's size, and what rounding
leaves over carries to the next group. Where a document lies follows from the lengths
of the hash ranges before its own and, inside a range, from its group: a group gets
whole ranges and cuts them at its borders. Inside a group, a deficit round-robin
fills window after window: each window credits every source with its share of
the window, the source with the largest deficit is served next, and deficits
carry to the next window.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import salted, written

WINDOW = 2048
END_ID = 1                # fixed value: the id that ends a document
GROUP_WINDOWS = 1024      # windows a task packs at once (2 M tokens)
GROUP_RANGES = 32         # hash ranges of about a group's tokens; border ranges go to two groups
PIECE = 1 << 15           # tokens of a document that stay together in its queue
#: A served source gets at least so many tokens, so that a document is not torn
#: into a shred per window; what it gets early is a negative deficit.
LEAST_PIECE = 256
#: The rank file gives the same ids faster; it is used for texts whose letters
#: both libraries class alike.
_ODD = "[^\\x00-\\u024F\\u2010-\\u2027]"


def byte_bpe(json_path: str, ranks_path: str | None = None) -> Callable[[], Callable[[list[str]], list]]:
    """A tokenizer as (function that loads) a function of texts to id lists.

    Ids are those of ``tokenizers`` without added special tokens. With the same
    vocabulary as a rank file, texts of plain Latin letters without the
    special token's string are encoded by ``tiktoken``.
    """
    def load():
        import base64
        import os
        import re

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        slow = Tokenizer.from_file(json_path)
        fast = None
        if ranks_path:
            from public_tokenizers import PATTERN
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        odd = re.compile(_ODD)

        def encode(text: str) -> list[int]:
            if fast is None or "<|" in text or not text.isascii() and odd.search(text):
                return slow.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)
        return encode
    return load


def tokenized(docs: DataFrame, tokenizer, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, key, id, total, begin, n, ids): the pieces of every document's ids with
    the end id, and a hash of the document and the piece."""
    def run(batches):
        encode = tokenizer()
        for b in batches:
            rows: list[tuple] = []
            for row in zip(b.column("source").to_pylist(), b.column("key").to_pylist(), b.column("id").to_pylist(),
                           b.column("text"), strict=True):
                x = np.array([*encode(row[3].as_py() or ""), END_ID], np.uint32)
                kind = "<u2" if x.max() < 65536 else "<u4"
                for k in range(0, len(x), PIECE):
                    part = x[k:k + PIECE]
                    key = ((row[1] ^ k * 0x9E3779B97F4A7C15) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1) >> 4
                    rows.append((row[0], key, row[2], len(x), k, len(part), part.astype(kind).tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 5, pa.binary()), strict=True)],
                names=["source", "key", "id", "total", "begin", "n", "ids"])

    i, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    key = F.xxhash64(F.coalesce(i.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return (docs.select(i.alias("id"), text.alias("text"), F.col(source_col).cast("string").alias("source"), key.alias("key"))
            .mapInArrow(run, "source string, key long, id long, total long, begin long, n long, ids binary"))


def round_robin(lengths: list[np.ndarray], window: int = WINDOW,
                least: int = LEAST_PIECE) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Deal the documents of several queues to windows.

    Yields (queue, document, start in it, length, window, offset). Every window
    but the last is full; a window credits queue q with its share of the
    tokens, a served queue pays what it gets.
    """
    totals = np.array([float(x.sum()) for x in lengths])
    left = [int(x.sum()) for x in lengths]
    rest = sum(left)
    share = totals / totals.sum() * window
    deficit = np.where(totals > 0, 0.0, -np.inf)     # a queue that is empty is never the largest
    queues = [x.tolist() for x in lengths]
    at = [0] * len(lengths)              # document at the head of each queue
    used = [0] * len(lengths)            # tokens of it that are gone
    w = 0
    while rest:
        deficit += share
        space = window
        while space and rest:
            q = int(deficit.argmax())
            have = queues[q][at[q]] - used[q]
            n = min(have, space, max(least, math.ceil(deficit[q])))
            yield q, at[q], used[q], n, w, window - space
            left[q] -= n
            deficit[q] = deficit[q] - n if left[q] else -np.inf
            rest -= n
            space -= n
            used[q] += n
            if n == have:
                at[q], used[q] = at[q] + 1, 0
        w += 1


PIECES = ("id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, source string, ids binary")


def pack(docs: DataFrame, tokenizer, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", window: int = WINDOW, group_windows: int = GROUP_WINDOWS,
         with_ids: bool = True) -> DataFrame:
    """Sequences of at most ``window`` tokens that all have the corpus's mixture.

    One row per piece: (id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, source, ids). ``ids``: the piece's ids as little-endian
    unsigned 32-bit numbers, null unless ``with_ids``. Every id of a document
    (its text's ids, then the end id) lies in exactly one piece; in a sequence
    the offsets are gapless from 0, and all sequences but the last one or two of
    a group are full. A null text counts as empty and gives one piece with the end
    id; null sources are a queue of their own, null ids stay null, repeated rows
    are documents of their own, a long document is cut over as many sequences
    and groups as it needs, an empty table gives an empty result.
    """
    tok = written(tokenized(docs, tokenizer, id_col, text_col, source_col), "pack-tokens")
    tok = tok.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"),
                     *[c for c in tok.columns if c != "source"])
    name = ["no_source", "name"]
    # written, so that their sizes are known: small ones are broadcast and no ids are shuffled
    sources = written(tok.groupBy(*name).agg(F.sum("n").alias("tokens"))
                      .withColumn("ranges", F.ceil(F.col("tokens") * GROUP_RANGES / (window * group_windows))),
                      "pack-sources")
    n_sources, total = sources.agg(F.count("*"), F.sum("tokens")).first()
    groups = max(1, -(-(total or 0) // (window * group_windows)))
    stride = group_windows + 2 + (n_sources or 0) // window
    ranged = (salted(tok, sources, name, salts=4)
              .withColumn("range", F.expr("cast(cast(key as decimal(20,0)) * ranges div 1152921504606846976 as long)")))
    # One row per source and hash range: where its tokens begin in the source's queue.
    queue = (ranged.groupBy(*name, "range", "tokens").agg(F.sum("n").alias("held"))
             .withColumn("ahead", F.coalesce(F.sum("held").over(
                 W.partitionBy(*name).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    group_of = lambda t: F.expr(
        f"cast((cast({t} + 1 as decimal(20,0)) * cast({groups} as decimal(18,0)) - 1) div cast(tokens as decimal(20,0)) as long)")
    queue = written(queue.select(*name, "range", "ahead", F.sequence(group_of("ahead"), group_of("ahead + held - 1"))
                                 .alias("grps")), "pack-queues")
    dealt = (salted(ranged, queue, [*name, "range"], salts=4)
             .select(F.explode("grps").alias("grp"), *name, "tokens", "ahead", "key", "id", "begin", "total", "n", "ids"))

    def fill(t: pa.Table) -> pa.Table:
        grp = t.column("grp")[0].as_py()
        order = pc.sort_indices(t.drop_columns(["ids"]), [(c, "ascending") for c in (*name, "ahead", "key", "id", "begin")])
        ids, t = t.column("ids"), t.drop_columns(["ids"]).take(order)
        order, n, begin = order.to_pylist(), t.column("n").to_numpy(), t.column("begin").to_numpy()
        own, sums, cut = t.column("id").to_pylist(), t.column("total").to_pylist(), []
        label = [(a, b) for a, b in zip(t.column("no_source").to_pylist(), t.column("name").to_pylist(), strict=True)]
        ahead, tokens = t.column("ahead").to_numpy(), t.column("tokens").to_numpy()
        new = np.flatnonzero([k == 0 or label[k] != label[k - 1] or ahead[k] != ahead[k - 1] for k in range(len(n))])
        before = np.cumsum(n) - n
        first = before - np.repeat(before[new], np.diff([*new, len(n)])) + ahead
        queues: dict = {}
        for k, name_ in enumerate(label):
            lo, hi = int(tokens[k]) * grp // groups, int(tokens[k]) * (grp + 1) // groups
            a, z = max(0, lo - int(first[k])), min(int(n[k]), hi - int(first[k]))
            if a < z:
                raw = ids[order[k]].as_buffer()
                raw = np.frombuffer(raw, "<u2" if raw.size == 2 * n[k] else "<u4")
                queues.setdefault(name_, []).append((k, a, raw[a:z]))
        rows = []
        lists = [queues[k] for k in sorted(queues)]
        names = [None if k[0] else k[1] for k in sorted(queues)]
        for q, i, at, m, w, offset in round_robin([np.array([len(x[2]) for x in d]) for d in lists], window):
            k, a, x = lists[q][i]
            part = x[at:at + m].astype("<u4")
            rows.append((own[k], int(begin[k]) + a + at, m, zlib.crc32(part), sums[k], grp * stride + w, offset,
                         names[q], part.tobytes() if with_ids else None))
        cols = list(zip(*rows, strict=True)) or [()] * 9
        types = [pa.int64()] * 7 + [pa.string(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)],
                                    names=[c.split()[0] for c in PIECES.split(", ")])

    return dealt.groupBy("grp").applyInArrow(fill, PIECES).withColumnRenamed("id", id_col)
