"""Word and shingle hashes of texts, and which of a corpus's fingerprints several
rows share.

``shared_fingerprints`` tells every row which of its fingerprints also occur in
another row. A task sorts the fingerprints of many rows at once and sends each
of them once per block, packed by hash range; a range answers the blocks whose
fingerprints others hold as well. A fingerprint that a third of all rows hold
costs one entry per block, not one per row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
_K1, _K2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
_BASE = 0x100000001B3 * 0x5851F42D4C957F2D % 2**64 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.int64).astype(U)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
PIECE = 1 << 20           # bytes hashed at once, more only for a longer word


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(32)) * _K1
    h = (h ^ h >> U(29)) * _K2
    return h ^ h >> U(32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_pow = {"up": _powers(_BASE, 4096), "down": _powers(_BASE_INV, 4096)}


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words (runs of bytes other than white space) begin and end."""
    space = np.ones(len(text) + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def _hash_piece(text: bytes) -> np.ndarray:
    if len(text) + 1 > len(_pow["up"]):
        n = 1 << (len(text) + 1).bit_length()
        _pow["up"], _pow["down"] = _powers(_BASE, n), _powers(_BASE_INV, n)
    start, end = word_bounds(text)
    sums = np.zeros(len(text) + 1, U)
    np.cumsum(_BYTE[np.frombuffer(text, np.uint8)] * _pow["up"][:len(text)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _pow["down"][start] ^ (end - start).astype(U) * _K2)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text."""
    if len(text) <= PIECE:
        return _hash_piece(text)
    _, ends = word_bounds(text)
    out, at = [], 0
    while at < len(text):
        k = np.searchsorted(ends, at + PIECE, "right") - 1
        end = int(ends[k]) if k >= 0 and ends[k] > at else int(ends[min(k + 1, len(ends) - 1)]) if len(ends) else len(text)
        if end <= at:
            break
        out.append(_hash_piece(text[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, U)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words; with fewer words, one of all."""
    if not len(words):
        return words
    n_of = min(n, len(words))
    h = np.full(len(words) - n_of + 1, U(n_of))
    for k in range(n_of):
        h = (h * _K1) ^ words[k:len(words) - n_of + 1 + k]
        h ^= h >> U(31)
    return mix(h)


# ---------------------------------------------------------------------------
BITS = 48                 # of a fingerprint
BLOCK_ENTRIES = 400_000
BLOCK_ROWS = 20_000
MANY = 0xFFFF             # in place of a row: several rows of the block hold it
RANGE_ENTRIES = 400_000


def pack(values: np.ndarray) -> bytes:
    """Ascending 48-bit numbers as byte planes of their differences."""
    d = np.diff(values, prepend=U(0)).astype("<u8")
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(6, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :6] = planes.T
    return np.cumsum(d.reshape(-1).view("<u8"), dtype=U)


Extract = Callable[[bytes], tuple[np.ndarray, int, int, int]]


def shared_fingerprints(rows: DataFrame, extract: Extract, ranges: int) -> DataFrame:
    """``rows``: (payload, raw binary). ``extract`` turns a raw value into its
    ascending distinct 48-bit fingerprints and three numbers to keep.

    Gives (payload, n, a, b, shared, df), one row per input row: the numbers,
    the packed ascending fingerprints that another row holds as well, and the
    number of rows that hold each, as little-endian unsigned 32-bit numbers.
    ``ranges`` should put about RANGE_ENTRIES fingerprints into each.
    """
    payload = rows.schema["payload"].dataType.simpleString()
    width = (1 << BITS) // ranges + 1
    none = lambda t, n: pa.nulls(n, t)

    def send(batches):
        part, block = TaskContext.get().partitionId(), 0
        kind = None

        def flush(held, kept):
            nonlocal block
            name = part << 24 | block
            place = int(mix(np.array([name], U))[0] % U(ranges))     # names are multiples of the number of ranges
            block += 1
            lengths = [len(x[0]) for x in held]
            every = np.concatenate([x[0] for x in held])
            row = np.repeat(np.arange(len(held), dtype=np.uint16), lengths)
            order = np.argsort(every, kind="stable")
            every, row = every[order], row[order]
            new = np.ones(len(every), bool)
            new[1:] = every[1:] != every[:-1]
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(every))).astype("<u4")
            one, who = every[at], np.where(count == 1, row[at], MANY).astype("<u2")
            many = np.repeat(count, count) > 1
            bounds = np.searchsorted(one, np.arange(ranges + 1, dtype=U) * U(width))
            used = [r for r in range(ranges) if bounds[r + 1] > bounds[r]]
            cut = [slice(bounds[r], bounds[r + 1]) for r in used]
            # what the block holds more than once goes straight to its answer
            out = {"range": [*used, place], "block": [name] * (len(used) + 1),
                   "kind": [0] * len(used) + [1],
                   "fps": [*(pack(one[c]) for c in cut), pack(every[many])],
                   "who": [*(who[c].tobytes() for c in cut), row[many].astype("<u2").tobytes()],
                   "df": [*(count[c][who[c] == MANY].tobytes() for c in cut), b""]}
            blobs = pa.RecordBatch.from_arrays(
                [pa.array(out["range"], pa.int32()), pa.array(out["block"], pa.int64()),
                 pa.array(out["kind"], pa.int32()), pa.array(out["fps"], pa.binary()),
                 pa.array(out["who"], pa.binary()), pa.array(out["df"], pa.binary()),
                 none(pa.int32(), len(cut) + 1), none(kind, len(cut) + 1),
                 *(none(pa.int64(), len(cut) + 1) for _ in "nab")], names=names)
            k = len(held)
            own = pa.RecordBatch.from_arrays(
                [pa.array([place] * k, pa.int32()), pa.array([name] * k, pa.int64()),
                 pa.array([2] * k, pa.int32()), *(none(pa.binary(), k) for _ in range(3)),
                 pa.array(range(k), pa.int32()), pa.concat_arrays(kept),
                 *(pa.array([x[i] for x in held], pa.int64()) for i in (1, 2, 3))], names=names)
            yield blobs
            yield own

        names = ["range", "block", "kind", "fps", "who", "df", "row", "payload", "n", "a", "b"]
        held, kept, entries = [], [], 0
        for b in batches:
            kind = b.column("payload").type
            first = 0
            for i, raw in enumerate(b.column("raw")):
                held.append(extract(raw.as_py() or b""))
                entries += len(held[-1][0])
                if entries >= BLOCK_ENTRIES or len(held) >= BLOCK_ROWS:
                    kept.append(b.column("payload").slice(first, i + 1 - first))
                    yield from flush(held, kept)
                    held, kept, entries, first = [], [], 0, i + 1
            if first < b.num_rows:
                kept.append(b.column("payload").slice(first))
        if held:
            yield from flush(held, kept)

    sent = (f"range int, block long, kind int, fps binary, who binary, df binary, row int, "
            f"payload {payload}, n long, a long, b long")

    def answer(t: pa.Table) -> pa.Table:
        kinds = t.column("kind").to_numpy()
        asks = t.filter(pa.array(kinds == 0))
        rest = t.filter(pa.array(kinds != 0))
        fps = [unpack(x.as_py()) for x in asks.column("fps")]
        if not fps:
            return rest.drop_columns(["range"])
        blocks = asks.column("block").to_numpy()
        who = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in asks.column("who")])
        local = np.ones(len(who), np.int64)
        local[who == MANY] = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in asks.column("df")])
        src = np.repeat(np.arange(len(fps)), [len(x) for x in fps])
        every = np.concatenate(fps)
        order = np.argsort(every, kind="stable")
        s = every[order]
        at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        df = np.add.reduceat(local[order], at)
        per = np.repeat(df, np.diff(np.append(at, len(s))))
        back = np.empty(len(s), np.int64)
        back[order] = per
        hit = back > 1
        got = {"block": [], "fps": [], "who": [], "df": []}
        ends = np.cumsum([len(x) for x in fps])
        for i, x in enumerate(fps):
            a, z = ends[i] - len(x), ends[i]
            h = hit[a:z]
            if h.any():
                got["block"].append(int(blocks[i]))
                got["fps"].append(pack(x[h]))
                got["who"].append(who[a:z][h].tobytes())
                got["df"].append(back[a:z][h].astype("<u4").tobytes())
        k = len(got["block"])
        replies = pa.table({
            "block": pa.array(got["block"], pa.int64()), "kind": pa.array([3] * k, pa.int32()),
            "fps": pa.array(got["fps"], pa.binary()), "who": pa.array(got["who"], pa.binary()),
            "df": pa.array(got["df"], pa.binary()), "row": none(pa.int32(), k),
            "payload": none(t.schema.field("payload").type, k),
            "n": none(pa.int64(), k), "a": none(pa.int64(), k), "b": none(pa.int64(), k)})
        rest = rest.drop_columns(["range"])
        return pa.concat_tables([rest.cast(replies.schema), replies])

    def collect(t: pa.Table) -> pa.Table:
        kinds = t.column("kind").to_numpy()
        own = t.filter(pa.array(kinds == 2)).sort_by("row")
        parts: list[tuple] = []
        replies = t.filter(pa.array(kinds == 3))
        known_fp, known_df = [np.empty(0, U)], [np.empty(0, np.int64)]
        for f, w, d in zip(replies.column("fps"), replies.column("who"), replies.column("df"), strict=True):
            f, w, d = unpack(f.as_py()), np.frombuffer(w.as_py(), "<u2"), np.frombuffer(d.as_py(), "<u4")
            one = w != MANY
            parts.append((f[one], w[one], d[one].astype(np.int64)))
            known_fp.append(f[~one])
            known_df.append(d[~one].astype(np.int64))
        fp, df = np.concatenate(known_fp), np.concatenate(known_df)
        order = np.argsort(fp)
        fp, df = fp[order], df[order]
        for x in t.filter(pa.array(kinds == 1)).to_pylist():
            f = unpack(x["fps"])
            parts.append((f, np.frombuffer(x["who"], "<u2"), df[np.searchsorted(fp, f)] if len(f) else df[:0]))
        f, w, d = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, U) for i in range(3))
        order = np.lexsort((f, w))
        f, w, d = f[order], w[order], d[order].astype("<u4")
        k = own.num_rows
        cut = np.searchsorted(w, np.arange(k + 1))
        return pa.table({
            "payload": own.column("payload"), "n": own.column("n"), "a": own.column("a"), "b": own.column("b"),
            "shared": pa.array([pack(f[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
            "df": pa.array([d[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    return (rows.select("payload", "raw").mapInArrow(send, sent)
            .groupBy("range").applyInArrow(answer, sent.partition(", ")[2])
            .groupBy("block").applyInArrow(
                collect, f"payload {payload}, n long, a long, b long, shared binary, df binary"))


def ranges_for(entries: int | None) -> int:
    """Hash ranges for so many fingerprints; a few at least, for as many tasks."""
    return max(32, math.ceil((entries or 0) / RANGE_ENTRIES))
