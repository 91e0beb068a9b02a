"""Shared parts of the substring operators: flat text chunks, names of strings, and bucketed exchanges.

Rows are dealt to chunks by a hash of doc_id and text; a chunk is a few MB of whole texts that one Python
call holds as one flat byte buffer. What chunks must learn from each other travels as packed arrays, one
row per (chunk, bucket) that has anything in it, so there are never more rows than keys, and they are built
and read without a loop over buckets; a key that is hot within a chunk is sent once.

Names are 64-bit hashes. Eight bytes are taken as they are and scrambled by a bijection, names of longer
strings come from non-linear mixing of the names of their parts, so no two strings have equal names by their
structure; words of more than 64 bytes are named by BLAKE2b. Where equality decides a result, two names of
independent seeds are compared, 128 bits in all: among 10**13 strings a false match is expected 1e-13 times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobath.llm.shared import text_bytes

CHUNK_BYTES = 8 << 20
PART_BYTES = 64 << 20
BLOCK_BYTES = 256 << 10
LONG_WORD = 64
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Odd multipliers and offsets drawn once, one row a seed.
_ODD, _ADD = np.random.default_rng(20240229).integers(0, 2**63, (2, 4), dtype=np.uint64) * U(2) + U(1)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def chunked_docs(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """(doc_id, text, _t, chunk) dealt by chunk; the bytes of text; and the number of partitions.

    The exchange is the same expression wherever it is used, so Spark writes it once and reuses it. Rows
    without text are spread by their place in the input, as all of them may share one doc_id or none.
    """
    total = text_bytes(docs)
    n = max(1, -(-total // chunk_bytes))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    spread = F.when(F.coalesce(F.octet_length("text"), F.lit(0)) > 0, F.xxhash64("doc_id", "text")).otherwise(F.monotonically_increasing_id())
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_t"), F.pmod(spread, F.lit(n)).alias("chunk")).repartition(parts, "chunk"), total, parts


class Flat:
    """The rows of a chunk in order of doc_id (null last) and text hash, as one byte buffer, worked on in blocks."""

    def __init__(self, table: pa.Table, block: int = BLOCK_BYTES):
        self.block = block
        table = table.select(["doc_id", "text", "_t"]).sort_by([("doc_id", "ascending"), ("_t", "ascending")])
        self.ids = table["doc_id"]
        self.bytes, sizes = unpacked(table["text"])
        self.n = len(sizes)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])

    def order_ids(self) -> np.ndarray:
        return np.array([2**63 - 1 if x is None else x for x in self.ids.to_pylist()], np.int64)

    def blocks(self):
        """Places [a, b) of the buffer of about a block: whole documents, or a piece of a longer one."""
        a, n = 0, len(self.bytes)
        while a < n:
            ahead = int(self.offsets[np.searchsorted(self.offsets, a + self.block, "right") - 1])
            end = int(self.offsets[np.searchsorted(self.offsets, a, "right")])
            b = ahead if ahead > a else min(end, a + self.block)
            yield a, b
            a = b

    def word_blocks(self):
        """Places [a, b) of about a block that cut no word, and the document ends inside."""
        a, n = 0, len(self.bytes)
        while a < n:
            b = min(n, a + self.block)
            end = int(self.offsets[np.searchsorted(self.offsets, b, "left")]) if b < n else n
            while b < end:
                found = np.flatnonzero(SPACE[self.bytes[b : min(end, b + self.block)]])
                b += int(found[0]) if len(found) else min(self.block, end - b)
                if len(found):
                    break
            lo, hi = np.searchsorted(self.offsets, [a, b], "right")
            yield a, b, self.offsets[lo:hi]
            a = b

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many places of each document are set."""
        out = np.zeros(self.n, np.int64)
        full = np.flatnonzero(np.diff(self.offsets))
        if len(full):
            out[full] = np.add.reduceat(mask.view(np.uint8), self.offsets[full], dtype=np.int64)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection in which every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def pair(x: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
    """The name of a pair of names."""
    out = x * _ODD[seed]
    out += y
    out ^= out >> U(32)
    out *= U(0xD6E8FEB86659FD93)
    out ^= out >> U(32)
    return out


def limbs(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as an integer; zeros follow the end."""
    n = len(raw)
    each = -(-n // 8)
    padded = np.zeros(8 * each + 8, np.uint8)
    padded[:n] = raw
    out = np.empty(8 * each, U)
    for k in range(8):
        out[k::8] = padded[k : k + 8 * each].view("<u8")
    return out[:n]


def base_names(raw: np.ndarray, length: int) -> np.ndarray:
    """Names of the strings of up to eight bytes at every place."""
    return mix(limbs(raw) & _MASK[length])


def lengthen(names: np.ndarray, have: int, want: int, seed: int = 0) -> np.ndarray:
    """Names of the runs of ``want`` values at every place, from those of ``have`` values, by doubling."""
    while have < want:
        step = min(have, want - have)
        names = pair(names[: max(0, len(names) - step)], names[step:], seed)
        have += step
    return names


def string_names(scrambled: np.ndarray, limb: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """Names of the byte strings [start, end), each of eight bytes or more; scrambled = mix(limb)."""
    length = end - start
    out = mix(length.astype(U) ^ _ADD[seed])
    least = int(length.min()) if len(length) else 0
    for k in range(0, int(length.max()) - 7 if len(length) else 0, 8):
        if k + 8 <= least:
            out = pair(out, scrambled[start + k], seed)
        else:
            at = np.flatnonzero(length >= k + 8)
            out[at] = pair(out[at], scrambled[start[at] + k], seed)
    return pair(out, scrambled[end - 8], seed)


def word_names(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """Names of the words [start, end) by each seed."""
    limb, length = limbs(raw), end - start
    out = [pair(mix((limb[start] & _MASK[np.minimum(length, 8)]) ^ _ADD[s]), length.astype(U), s) for s in seeds]
    for k in range(8, LONG_WORD, 8):
        at = np.flatnonzero(length > k)
        if not len(at):
            break
        more = limb[start[at] + k] & _MASK[np.minimum(length[at] - k, 8)]
        for j, s in enumerate(seeds):
            out[j][at] = pair(out[j][at], mix(more ^ _ADD[s]), s)
    for i in np.flatnonzero(length > LONG_WORD):
        digest = np.frombuffer(hashlib.blake2b(raw[start[i] : end[i]], digest_size=32).digest(), U)
        for j, s in enumerate(seeds):
            out[j][i] = digest[s]
    return out


def words(raw: np.ndarray, inner: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer whose documents end at ``inner``; apart: which bytes separate words."""
    w = ~apart[raw]
    before, after = np.empty(len(w), bool), np.empty(len(w), bool)
    before[:1], before[1:] = False, w[:-1]
    after[-1:], after[:-1] = False, w[1:]
    inner = inner[(inner > 0) & (inner < len(w))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


def first_index(key: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct key in order of first occurrence: its first index and count; and each element's rank among these.

    With ``other``, keys are equal only if both are.
    """
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    firsts = order[starts]
    if other is not None and (other[order] != other[firsts][group]).any():
        return first_index(np.unique(np.stack([key, other], axis=1), axis=0, return_inverse=True)[1].reshape(-1))
    counts = np.diff(np.r_[starts, len(s)])
    rank = np.empty(len(firsts), np.int64)
    by_place = np.argsort(firsts, kind="stable")
    rank[by_place] = np.arange(len(firsts))
    of = np.empty(len(s), np.int64)
    of[order] = rank[group]
    return firsts[by_place], counts[by_place], of


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.subtract.at(depth, ends, 1)
    np.cumsum(depth, out=depth)
    return depth[:n] > 0


def _ends(ends: np.ndarray, width: int) -> pa.Buffer:
    """Where the values of a binary column end; OverflowError where they do not fit, as with texts of some 268 MB."""
    if ends[-1] * width >= 2**31:
        raise OverflowError("a text is too long: what one chunk tells the others must stay under 2 GB")
    return pa.py_buffer((ends * width).astype(np.int32))


# Packed rows. A column's kind says how a group's items are stored: raw items, or ascending places as 32-bit steps.


def packed(chunk: int, bucket: np.ndarray, raw: dict[str, np.ndarray], places: dict[str, np.ndarray], schema: pa.Schema) -> pa.Table:
    """One row per bucket that occurs, with the items of each column in their order; places ascend within a bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    ends = np.r_[cuts, len(b)]
    columns = {"chunk": pa.array(np.full(len(cuts), chunk, np.int64)), "bucket": pa.array(b[cuts].astype(np.int64))}
    for name, x in places.items():
        p = x[order].astype(np.int64)
        steps = np.diff(p, prepend=0)
        steps[cuts] = p[cuts]
        raw = {**raw, name: steps.astype(np.int32)}
    for name in schema.names[2:]:
        if name not in raw:
            columns[name] = pa.nulls(len(cuts), pa.binary())
            continue
        x = np.ascontiguousarray(raw[name] if name in places else raw[name][order])
        width = x.dtype.itemsize * (x.shape[1] if x.ndim == 2 else 1)
        columns[name] = pa.Array.from_buffers(pa.binary(), len(cuts), [None, _ends(ends, width), pa.py_buffer(x.tobytes())])
    return pa.table(columns, schema=schema)


def unpacked(column: pa.ChunkedArray, dtype=np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """All items of a column, and the number in each row; null rows have none."""
    a = column.cast(pa.large_binary()).combine_chunks()
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    if not len(a):
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw.view(dtype) if dtype != np.uint8 and len(raw) else raw.astype(dtype, copy=False), np.diff(offsets) // np.dtype(dtype).itemsize


def unpacked_places(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` stored as places, and the number in each row."""
    steps, n = unpacked(column, np.int32)
    total = np.cumsum(steps, dtype=np.int64)
    before = np.r_[0, total][np.cumsum(n) - n]
    return total - np.repeat(before, n), n


def rows_like(group: pa.Table, n: np.ndarray, raw: dict[str, np.ndarray], schema: pa.Schema) -> pa.Table:
    """The rows of a group with other columns; n items a row."""
    columns = {"chunk": group["chunk"].combine_chunks(), "bucket": group["bucket"].combine_chunks()}
    ends = np.r_[0, np.cumsum(n)]
    for name in schema.names[2:]:
        if name in raw:
            x = np.ascontiguousarray(raw[name])
            columns[name] = pa.Array.from_buffers(pa.binary(), len(n), [None, _ends(ends, x.dtype.itemsize), pa.py_buffer(x.tobytes())])
        else:
            columns[name] = pa.nulls(len(n), pa.binary())
    return pa.table(columns, schema=schema)


def steps_of(kept: np.ndarray, places: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept places of each row as steps, and their numbers."""
    row = np.repeat(np.arange(len(n)), n)[kept]
    p = places[kept]
    steps = np.diff(p, prepend=0)
    new = np.flatnonzero(np.diff(row, prepend=-1))
    steps[new] = p[new]
    return steps.astype(np.int32), np.bincount(row, minlength=len(n))
