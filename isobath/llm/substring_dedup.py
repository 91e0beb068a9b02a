"""Substring dedup over words with difference-cover anchors.

A window is ``window`` consecutive words of one document. The word positions of a document whose
number modulo 7 lies in the difference cover {0, 1, 3} carry anchors of window - 6 words: for any two
equal windows some shift below 7 puts both on the cover, so they share an aligned anchor. Hashes of
anchors that occur once in the corpus rule out all windows over them; each remaining window is then
extended to its full length, and the first place of its word sequence stays.

Three passes over text that is shuffled once: anchors out (40 bits beside the bucket; a false match costs one
more window to look at), candidate windows out (two independent 64-bit names and their documents), removal in.
A window's place is (doc_id, start). Windows count as equal if both names are.

Nulls: a null text has no words; a null doc_id counts as the largest. Rows with equal doc_id are taken in a
fixed order that their texts decide; identical rows are separate, so the later one loses its windows. Empty
tables give empty results; columns other than doc_id and text play no part in the result. A document is held
whole by one task, in some 12 bytes a byte; one that is longer than a chunk is a chunk's
main part, and one so long that its keys exceed 2 GB is an OverflowError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isobath.llm import spans as S
from isobath.llm.shared import table

WINDOW = 20
PERIOD = 7
COVER = (0, 1, 3)
ANCHORS_A_BUCKET = 2_000_000
MASK40 = S.U((1 << 40) - 1)


class _Words:
    """Words of a chunk: where they are and their names; positions count over the whole chunk."""

    def __init__(self, flat: S.Flat, seeds: tuple[int, ...] = ()):
        starts, ends, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [[np.zeros(0, S.U)] for _ in seeds]
        for a, b, inner in flat.word_blocks():
            raw = flat.bytes[a:b]
            s, e = S.words(raw, inner - a)
            for own, more in zip(names, S.word_names(raw, s, e, seeds) if seeds else [], strict=True):
                own.append(more)
            starts.append(s + a)
            ends.append(e + a)
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)
        self.names = {s: np.concatenate(x) for s, x in zip(seeds, names, strict=True)}
        self.n = len(self.starts)
        self.doc = np.searchsorted(flat.offsets, self.starts, "right") - 1
        self.per_doc = np.bincount(self.doc, minlength=flat.n)[: flat.n]
        self.first = np.r_[0, np.cumsum(self.per_doc)]
        self.number = np.arange(self.n) - self.first[self.doc]

    def fits(self, length: int) -> np.ndarray:
        """Positions at which a run of so many words fits into its document."""
        return np.flatnonzero(self.number + length <= self.per_doc[self.doc])

    def runs(self, length: int, seed: int) -> np.ndarray:
        return S.lengthen(self.names[seed], 1, length, seed)


def _anchors(w: _Words, window: int, buckets: int):
    """Positions of cover anchors, and their distinct keys: rank of each position, count, bucket, key."""
    length = window - PERIOD + 1
    at = w.fits(length)
    at = at[np.isin(w.number[at] % PERIOD, COVER)]
    key = w.runs(length, 0)[at]
    first, count, of = S.first_index(key)
    return at, of, count, ((key[first] >> S.U(40)) % S.U(buckets)).astype(np.int64), key[first] & MASK40


def dedup_substrings(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = S.CHUNK_BYTES, block_bytes: int = S.BLOCK_BYTES, anchors_a_bucket: int = ANCHORS_A_BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the remaining words joined by one space)."""
    if window <= PERIOD:
        raise ValueError(f"window must be longer than {PERIOD} words")
    dealt, total, parts = S.chunked_docs(docs, chunk_bytes)
    buckets = max(8, total // 14 // anchors_a_bucket)
    out = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), *[(c, pa.binary()) for c in "abcd"]])
    ddl = "chunk long, bucket long, a binary, b binary, c binary, d binary"

    def emit_anchors(group: pa.Table) -> pa.Table:
        _, _, _, bucket, key = _anchors(_Words(S.Flat(group, block_bytes), (0,)), window, buckets)
        return S.packed(group["chunk"][0].as_py(), bucket, {"a": key.view(np.uint8).reshape(-1, 8)[:, :5]}, {}, out)

    def repeated(group: pa.Table) -> pa.Table:
        """a: for each key sent, whether another chunk sent it too."""
        sent, n = S.unpacked(group["a"])
        key = np.zeros((len(sent) // 5, 8), np.uint8)
        key[:, :5] = sent.reshape(-1, 5)
        _, count, of = S.first_index(key.reshape(-1).view(np.uint64))
        return S.rows_like(group, n // 5, {"a": (count[of] > 1).astype(np.uint8)}, out)

    def emit_windows(group: pa.Table, flags: pa.Table) -> pa.Table:
        if not group.num_rows:
            return out.empty_table()
        chunk, flat = group["chunk"][0].as_py(), S.Flat(group, block_bytes)
        w = _Words(flat, (0, 1))
        at, of, count, bucket, _ = _anchors(w, window, buckets)
        shared = count > 1
        shared[np.argsort(bucket, kind="stable")] |= S.unpacked(flags.sort_by("bucket")["a"])[0].astype(bool)
        hit = at[shared[of]]
        lo = np.maximum(hit - PERIOD + 1, w.first[w.doc[hit]])
        may = S.covered(lo, hit + 1, w.n)
        may[w.number + window > w.per_doc[w.doc]] = False
        start = np.flatnonzero(may)
        key, other = (w.runs(window, s)[start] for s in (0, 1))
        first, _, _ = S.first_index(key, other)
        later = np.ones(len(start), bool)
        later[first] = False
        mine = S.packed(chunk, np.full(int(later.sum()), -1 - chunk, np.int64), {}, {"d": start[later]}, out)
        start, key, other = start[first], key[first], other[first]
        owner = flat.order_ids()[w.doc[start]] if len(start) else np.zeros(0, np.int64)
        sent = S.packed(chunk, (other % S.U(buckets)).astype(np.int64), {"a": key, "b": other, "c": owner}, {"d": start}, out)
        return pa.concat_tables([mine, sent])

    def not_first(group: pa.Table) -> pa.Table:
        """d: of the windows sent, those that occur earlier."""
        if group["bucket"][0].as_py() < 0:
            return group.select(out.names).cast(out)
        key, n = S.unpacked(group["a"], np.uint64)
        other, owner = S.unpacked(group["b"], np.uint64)[0], S.unpacked(group["c"], np.int64)[0]
        row = np.repeat(group["chunk"].to_numpy(), n)
        order = np.lexsort((row, owner, other, key))
        new = np.ones(len(key), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1])
        later = np.empty(len(key), bool)
        later[order] = ~new
        places, _ = S.unpacked_places(group["d"])
        steps, left = S.steps_of(later, places, n)
        return S.rows_like(group, left, {"d": steps}, out)

    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def remove(group: pa.Table, flags: pa.Table) -> pa.Table:
        if not group.num_rows:
            return result.empty_table()
        flat = S.Flat(group, block_bytes)
        w = _Words(flat)
        start, _ = S.unpacked_places(flags["d"])
        kept = ~S.covered(start, start + window, w.n)
        n_kept = np.bincount(w.doc[kept], minlength=flat.n)[: flat.n]
        at = np.flatnonzero(kept)
        stays = S.covered(w.starts[at], w.ends[at], len(flat.bytes))
        doc = w.doc[at]
        gap = w.starts[at[1:][doc[1:] == doc[:-1]]] - 1
        raw = flat.bytes.copy()
        raw[gap] = 0x20
        stays[gap] = True
        data, cut = raw[stays].tobytes(), np.r_[0, np.cumsum(flat.per_doc(stays))]
        texts = [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table([flat.ids.combine_chunks().cast(pa.int64()), pa.array(w.per_doc, pa.int64()), pa.array(w.per_doc - n_kept, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array([x.decode() for x in texts])], schema=result)

    def together(flags: DataFrame, f, schema: str) -> DataFrame:
        return dealt.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(f, schema)

    def by_bucket(rows: DataFrame, f) -> DataFrame:
        return rows.repartition(parts, "bucket").groupBy("bucket").applyInArrow(f, ddl)

    shared = by_bucket(dealt.groupBy("chunk").applyInArrow(emit_anchors, ddl), repeated)
    places = by_bucket(together(shared, emit_windows, ddl), not_first)
    return together(places, remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op1_substring_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
