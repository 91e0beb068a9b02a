"""Suffix-array dedup over bytes by distributed prefix doubling.

Ranks name the strings of length 25, 50, 100 and 200 at a position; the rank at twice the length is the
name of the pair (rank at i, rank at i + length). Equal strings have equal ranks, so only equality is
needed of the order, and ranks are 64-bit names of pairs instead of places in a sorted list: every
round then needs one exchange, where dense ranks need a sort and a way back for all positions.

Rounds, each an exchange in which sorted ranks tell repeated from unique:

1. Length 100, at synchronising positions: the leftmost smallest rank among the 101 positions that a
   200-byte string offers. Equal strings synchronise at the same place, so a string whose rank there
   is unique is unique and leaves. The strings that share a synchronising position form a stretch;
   stretches that are equal as a whole repeat as a whole, which settles the inside of copies.
2. Length 200: where different stretches share a rank, one of each is looked at string by string.

A byte goes if a string over it repeats. Strings and stretches count as equal if both their rank and a second
name agree, which another seed makes from the bytes themselves. Text is shuffled once and read by three passes;
a document that is longer than a block is worked on in pieces that overlap by a string, and a stretch cut so is
two stretches, which round 2 sorts out. A text that is so long that its keys exceed 2 GB (some 268 MB) is an OverflowError.

Nulls: a null text is empty. doc_id only orders rows inside a chunk; identical rows, with equal or null
doc_id too, are different places, so their long strings repeat. Empty tables give empty results;
columns other than doc_id and text play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isobath.llm import spans as S
from isobath.llm.shared import table

LENGTH = 200
BYTES_A_BUCKET = 32 << 20
AGAIN, LOOK = 1, 2


class _Block:
    """Ranks of the strings that start at the places [a, b) of a chunk; positions count from a."""

    def __init__(self, flat: S.Flat, a: int, b: int, length: int):
        half, self.lo = length // 2, a
        raw = flat.bytes[a : b + length - 1]
        d = np.arange(np.searchsorted(flat.offsets, a, "right") - 1, np.searchsorted(flat.offsets, b, "left"))
        begin = np.maximum(flat.offsets[d], a)
        room = np.maximum(np.minimum(flat.offsets[d + 1] - length + 1, b) - begin, 0)
        self.start = np.repeat(begin - a - (np.cumsum(room) - room), room) + np.arange(room.sum())
        if not len(self.start):
            return
        self.limb = S.limbs(raw)
        self.base = S.mix(self.limb)
        short = length // 8
        rank = S.lengthen(self.base[: max(0, len(raw) - 7)], 8, short) if short >= 8 else S.base_names(raw, short)[: len(raw) - short + 1]
        self.rank = rank = S.lengthen(rank, short, half)
        # leftmost smallest over start .. start + half: 32 bits of rank, then the position
        span = half + 1
        key = (rank & S.U(0xFFFFFFFF00000000)) | np.arange(len(rank), dtype=np.uint64)
        full = -(-len(key) // span) * span
        grid = np.full(full, np.iinfo(np.uint64).max, np.uint64)
        grid[: len(key)] = key
        grid = grid.reshape(-1, span)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(back[self.start], ahead[self.start + half])
        self.sync = (least & S.U(0xFFFFFFFF)).astype(np.int64)

    def stretches(self, length: int):
        """First and last string of each stretch, rank at its synchronising position, and second name of the whole."""
        new = np.ones(len(self.start), bool)
        new[1:] = (self.sync[1:] != self.sync[:-1]) | (self.start[1:] != self.start[:-1] + 1)
        i = np.flatnonzero(new)
        lo, hi, sync = self.start[i], self.start[np.r_[i[1:] - 1, len(new) - 1]], self.sync[i]
        whole = S.pair(S.string_names(self.base, self.limb, lo, hi + length), (sync - lo).astype(np.uint64), 1)
        return lo, hi, self.rank[sync], whole

    def strings(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the full strings at some positions, and their second names."""
        return S.pair(self.rank[at], self.rank[at + length // 2]), S.string_names(self.base, self.limb, at, at + length)


def dedup_bytes(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = S.CHUNK_BYTES, block_bytes: int = S.BLOCK_BYTES, bytes_a_bucket: int = BYTES_A_BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    if length % 8 or length >= 2**31:
        raise ValueError("length must be a multiple of 8")
    dealt, total, parts = S.chunked_docs(docs, chunk_bytes)
    buckets = max(8, total // bytes_a_bucket)
    out = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), *[(c, pa.binary()) for c in "abcd"]])
    ddl = "chunk long, bucket long, a binary, b binary, c binary, d binary"

    def stretches(flat: S.Flat):
        """All stretches of a chunk (places in the chunk), and the distinct ones: first index, count, rank of each."""
        parts = [[np.zeros(0, t)] for t in (np.int64, np.int64, S.U, S.U)]
        for a, b in flat.blocks():
            block = _Block(flat, a, b, length)
            if len(block.start):
                lo, hi, rank, whole = block.stretches(length)
                for p, x in zip(parts, (lo + a, hi + a, rank, whole), strict=True):
                    p.append(x)
        lo, hi, rank, whole = map(np.concatenate, parts)
        first, count, of = S.first_index(whole, rank)
        return lo, hi, rank, whole, first, count, of

    def bucket_of(rank: np.ndarray) -> np.ndarray:
        return (S.mix(rank) % S.U(buckets)).astype(np.int64)

    def round1(group: pa.Table) -> pa.Table:
        _, _, rank, whole, first, count, _ = stretches(S.Flat(group, block_bytes))
        return S.packed(group["chunk"][0].as_py(), bucket_of(rank[first]), {"a": rank[first], "b": whole[first], "c": (count > 1).astype(np.uint8)}, {}, out)

    def sorted1(group: pa.Table) -> pa.Table:
        """c: AGAIN if the stretch repeats as a whole; LOOK if it is its kind's first, and others share its rank."""
        rank, n = S.unpacked(group["a"], np.uint64)
        whole, many = S.unpacked(group["b"], np.uint64)[0], S.unpacked(group["c"])[0].astype(np.int64)
        row = np.repeat(group["chunk"].to_numpy(), n)
        order = np.lexsort((row, whole, rank))
        r, h = rank[order], whole[order]
        new_rank, new_kind = np.ones(len(r), bool), np.ones(len(r), bool)
        new_rank[1:] = r[1:] != r[:-1]
        new_kind[1:] = new_rank[1:] | (h[1:] != h[:-1])
        kind, of_rank = np.cumsum(new_kind) - 1, np.cumsum(new_rank) - 1
        times = np.bincount(kind, weights=many[order] + 1)[kind]
        kinds = np.bincount(of_rank, weights=new_kind)[of_rank]
        told = np.empty(len(r), np.uint8)
        told[order] = AGAIN * (times > 1) + LOOK * (new_kind & (kinds > 1))
        return S.rows_like(group, n, {"c": told}, out)

    def round2(group: pa.Table, flags: pa.Table) -> pa.Table:
        if not group.num_rows:
            return out.empty_table()
        chunk, flat = group["chunk"][0].as_py(), S.Flat(group, block_bytes)
        lo, hi, rank, _, first, count, of = stretches(flat)
        told = np.zeros(len(first), np.uint8)
        told[np.argsort(bucket_of(rank[first]), kind="stable")] = S.unpacked(flags.sort_by("bucket")["c"])[0]
        again, look = (count > 1) | (told & AGAIN > 0), told & LOOK > 0
        chosen, both = first[look], first[look & again]
        want = S.covered(lo[chosen], hi[chosen] + 1, len(flat.bytes))
        twice = S.covered(lo[both], hi[both] + 1, len(flat.bytes))
        at, keys, others = [np.zeros(0, np.int64)], [np.zeros(0, S.U)], [np.zeros(0, S.U)]
        for a, b in flat.blocks():
            i = np.flatnonzero(want[a:b])
            if len(i):
                key, other = _Block(flat, a, b, length).strings(i, length)
                at.append(i + a)
                keys.append(key)
                others.append(other)
        at, key, other = map(np.concatenate, (at, keys, others))
        first2, count2, of2 = S.first_index(key, other)
        known = count2 > 1
        known[of2[twice[at]]] = True
        stay = again[of]
        same = lambda x: np.full(len(x), -1 - chunk, np.int64)
        gone, kept = at[known[of2]], lo[stay]
        mine = S.packed(chunk, same(gone), {}, {"b": gone}, out), S.packed(chunk, same(kept), {"d": (hi - lo)[stay].astype(np.int32)}, {"c": kept}, out)
        bucket = (other[first2] % S.U(buckets)).astype(np.int64)
        return pa.concat_tables([*mine, S.packed(chunk, bucket, {"a": key[first2], "c": other[first2], "d": known.astype(np.uint8)}, {"b": at[first2]}, out)])

    def sorted2(group: pa.Table) -> pa.Table:
        """b: places of strings that another chunk holds too."""
        if group["bucket"][0].as_py() < 0:
            return group.select(out.names).cast(out)
        key, n = S.unpacked(group["a"], np.uint64)
        other, known = S.unpacked(group["c"], np.uint64)[0], S.unpacked(group["d"])[0].astype(bool)
        _, count, of = S.first_index(key, other)
        places, _ = S.unpacked_places(group["b"])
        steps, left = S.steps_of((count[of] > 1) & ~known, places, n)
        return S.rows_like(group, left, {"b": steps}, out)

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def remove(group: pa.Table, flags: pa.Table) -> pa.Table:
        if not group.num_rows:
            return result.empty_table()
        flat = S.Flat(group, block_bytes)
        at, _ = S.unpacked_places(flags["b"])
        lo, _ = S.unpacked_places(flags["c"])
        more, _ = S.unpacked(flags["d"], np.int32)
        gone = S.covered(np.r_[at, lo], np.r_[at + length, lo + more + length], len(flat.bytes))
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = flat.offsets[(flat.offsets > 0) & (flat.offsets < len(gone))]
        begins[inner] = gone[inner]
        n, n_gone = np.diff(flat.offsets), flat.per_doc(gone)
        data, cut = flat.bytes[~gone].tobytes(), np.r_[0, np.cumsum(n - n_gone)]
        texts = [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table([flat.ids.combine_chunks().cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(flat.per_doc(begins), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array(texts, pa.binary())], schema=result)

    def together(flags: DataFrame, f, schema: str) -> DataFrame:
        return dealt.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(f, schema)

    def by_bucket(rows: DataFrame, f) -> DataFrame:
        return rows.repartition(parts, "bucket").groupBy("bucket").applyInArrow(f, ddl)

    first = by_bucket(dealt.groupBy("chunk").applyInArrow(round1, ddl), sorted1)
    second = by_bucket(together(first, round2, ddl), sorted2)
    return together(second, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_dedup(spark, sf_dir):
    return dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
