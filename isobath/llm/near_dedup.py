"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds its distinct word shingles (lower-cased A-Z; with fewer words, the whole
sequence as one; without words, nothing). Rows with equal word sequences are collapsed first, by a 128-bit
BLAKE2b digest of the sequence. Bands of a MinHash signature propose pairs; a pair's signatures are compared
batch by batch, and it is dropped once the posterior probability that its similarity reaches the threshold
falls under ``miss``; survivors are decided on their full sets of shingles, read from the texts and compared
word by word, not by hashes.

Only components are returned, so a pair inside a known component needs no look. Each round links every
member of a bucket to one hub of that bucket, joins components, and drops buckets whose members are all
connected. The first hub is the member that meets the most others in all its buckets, which in a group
of edited copies is their original; further hubs, if asked for, are drawn. Large groups are settled in a linear number
of pairs. The members of buckets that still hold several components are joined exactly, by the rarest
shingles of their sets (prefix and position filters), so no link between candidates is lost and no
bucket is capped. At the threshold the bands
miss a pair with probability (1 - t**rows)**bands, 3e-6 with 32 bands of 5 rows at 0.8.

Nulls and empty texts: n_shingles 0, linked with nothing. A row without doc_id is linked with nothing
and has a null component. Rows with equal doc_id are each judged by their own set; where they stand for
different sets, these share their links. Ties do not arise, as a component is named by its smallest
doc_id. A text of any length is taken whole, by one task at some 100 bytes a word. Extra columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobath.llm import spans as S
from isobath.llm.components import connected
from isobath.llm.shared import discard, materialise, table

THRESHOLD = (80, 100)
BANDS, ROWS = 32, 5
BATCH = 32
MISS = 1e-6
HUB_ROUNDS = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER = LOWER.tobytes()
VERIFY_BYTES = 1 << 20
_HASHES = np.random.default_rng(808).integers(0, 2**63, (2, 1024), dtype=np.uint64) * S.U(2) + S.U(1)


def shingle_names(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the distinct shingles of each document, sorted by document; and the offsets of the documents."""
    return _shingles(*_words(raw, offsets), width)[:2]


def _words(raw: np.ndarray, offsets: np.ndarray):
    """The lower-cased bytes, starts and ends of the words, and each document's first word (with a final total)."""
    raw = LOWER[raw]
    s, e = S.words(raw, offsets)
    return raw, s, e, np.searchsorted(s, offsets)


def _shingles(raw, s, e, first, width: int):
    n_docs, per_doc = len(first) - 1, np.diff(first)
    w = S.word_names(raw, s, e)[0]
    doc = np.repeat(np.arange(n_docs), per_doc)
    at = np.flatnonzero(np.arange(len(s)) - first[doc] + width <= per_doc[doc])
    short = np.flatnonzero((per_doc > 0) & (per_doc < width))
    whole = S.mix(per_doc[short].astype(np.uint64))
    for j in range(width - 1):
        more = per_doc[short] > j
        whole[more] = S.pair(whole[more], w[first[short[more]] + j], 1)
    names = np.concatenate([S.lengthen(w, 1, width)[at], whole])
    owner = np.concatenate([doc[at], short])
    order = np.lexsort((names, owner))
    names, owner = names[order], owner[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    names, owner = names[new], owner[new]
    return names, np.searchsorted(owner, np.arange(n_docs + 1))


def sequences(raw, s, e, first) -> list[bytes]:
    """The words of each document joined by one space."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    gap = e[:-1][doc[1:] == doc[:-1]]
    stays = S.covered(s, e, len(raw))
    stays[gap] = True
    raw = raw.copy()
    raw[gap] = 0x20
    data = raw[stays].tobytes()
    size = np.bincount(doc, weights=e - s, minlength=len(first) - 1).astype(np.int64) + np.maximum(np.diff(first) - 1, 0)
    cut = np.r_[0, np.cumsum(size)]
    return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def exact_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted codes; codes of one call are equal if and only if the words are."""
    split = [(t or b"").translate(_LOWER).split() for t in texts]
    ids: dict[bytes, int] = {}
    n = np.array([len(ws) for ws in split], np.int64)
    flat = np.fromiter((ids.setdefault(w, len(ids) + 1) for ws in split for w in ws), np.int64, int(n.sum()))
    first = np.r_[0, np.cumsum(n)]
    doc = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(flat)) - first[doc]
    code = flat
    for j in range(1, width):
        ahead = np.zeros_like(flat)
        ahead[: max(0, len(flat) - j)] = flat[j:]
        ahead[number + j >= n[doc]] = 0
        code = (np.unique(code, return_inverse=True)[1].reshape(-1) if j > 1 else code) * (len(ids) + 1) + ahead
    keep = (number + width <= n[doc]) | ((number == 0) & (n[doc] < width))
    at = np.flatnonzero(keep)
    bounds = np.searchsorted(doc[at], np.arange(len(n) + 1))
    return [np.unique(code[at[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def signatures(names: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """(documents, n) MinHashes cut to 16 bits; documents with an empty set get zeros."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, n), np.uint16)
    if len(full):
        for k in range(n):
            h = names * _HASHES[0, k]
            h += _HASHES[1, k]
            h >>= S.U(32)
            out[full, k] = S.mix(np.minimum.reduceat(h.astype(np.uint32), offsets[full]).astype(np.uint64)).astype(np.uint16)
    return out


def needed_agreements(n: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """After each batch of k hashes, the agreements below which P(similarity >= threshold | agreements) < miss.

    The prior is uniform, so the posterior is Beta(m + 1, k - m + 1), whose upper tail is a binomial sum.
    """
    out = []
    for k in range(batch, n + 1, batch):
        def tail(m: int, k: int = k) -> float:
            return sum(math.comb(k + 1, j) * threshold**j * (1 - threshold) ** (k + 1 - j) for j in range(m + 1))

        out.append((k, next((m for m in range(k + 1) if tail(m) >= miss), k + 1)))
    return out


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(texts: pa.Array, most: int = S.BLOCK_BYTES):
    raw, offsets = _flat(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def sketch(docs: DataFrame, width: int, n_hashes: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the word sequence; null without words) and the signature as binary."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])

    def run(batches):
        for batch in batches:
            for a, b, raw, offsets in _slices(batch.column(1)):
                found = _words(raw, offsets)
                names, of = _shingles(*found, width)
                sig = signatures(names, of, n_hashes)
                digests = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in sequences(*found)]
                yield pa.record_batch([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(np.diff(of), pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def _prune(pairs: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Of a, b, sig_a, sig_b the pairs (a, b) that pass every batch of the sequential test."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, -1) for c in ("sig_a", "sig_b"))
            alive, agree, at = np.arange(n), np.zeros(n, np.int64), 0
            for k, least in bounds:
                agree[alive] += (left[alive, at:k] == right[alive, at:k]).sum(axis=1)
                alive, at = alive[agree[alive] >= least], k
            yield pa.record_batch([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive))], names=["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """Of the pairs (a, b) those with whole * intersection >= part * union, on their full sets of words."""

    def run(batches):
        for batch in batches:
            ids = [batch.column(c).to_numpy() for c in ("a", "b")]
            sides = [batch.column(f"text_{c}").cast(pa.large_binary()) for c in "ab"]
            sizes = np.cumsum(sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False) for t in sides))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + VERIFY_BYTES)))
                sets = exact_sets([x for t in sides for x in t.slice(at, end - at).to_pylist()], width)
                good = []
                for i, (p, q) in enumerate(zip(sets[: end - at], sets[end - at :], strict=True)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if both and whole * both >= part * (len(p) + len(q) - both):
                        good.append(at + i)
                at = end
                yield pa.record_batch([pa.array(c[good], pa.int64()) for c in ids], names=["a", "b"])

    a, b = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _cross_pairs(left: DataFrame, texts: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """Pairs (a, b) of different components c among the members left, that can reach the threshold.

    Shingles are ordered by how many members hold them, those that one component holds alone first. Sets of
    n and m with an overlap of t or more share a shingle that is among the first n - t + 1 of one and the
    first m - t + 1 of the other. Edits bring rare shingles, which fill these places, so edited copies do not
    meet at what all copies share. For each shingle only the members outside its most frequent component
    look for partners, so a large component that is connected already does not meet itself.
    """

    def emit(batches):
        for batch in batches:
            for a, _, raw, offsets in _slices(batch.column("text"), 64 << 10):
                names, of = shingle_names(raw, offsets, width)
                row = pa.array(np.repeat(np.arange(len(of) - 1) + a, np.diff(of)))
                yield pa.record_batch([batch.column("rep").take(row), batch.column("c").take(row), pa.array(names.view(np.int64))], names=["rep", "c", "name"])

    held = texts.withColumnRenamed("doc_id", "rep").join(left.select("rep", "c").distinct(), "rep")
    rows = materialise(held.select("rep", "c", "text").mapInArrow(emit, "rep long, c long, name long"), "shingles")
    across = rows.groupBy("name").agg(F.count("*").alias("holders"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("name", "holders")
    order = Window.partitionBy("rep").orderBy(F.col("holders").asc_nulls_first(), "name")
    placed = rows.join(across, "name", "left").withColumn("at", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("rep")))
    # the least overlap with any partner: t >= part * n / whole, as the partner is at least that large
    prefix = materialise(placed.filter(F.col("holders").isNotNull() & (whole * (F.col("n") - F.col("at") + 1) >= part * F.col("n"))).select("name", "rep", "c", "at", "n"), "prefix")
    each = prefix.groupBy("name", "c").agg(F.count("*").alias("k")).groupBy("name").agg(F.max_by("c", "k").alias("most"), F.count("*").alias("kinds")).filter("kinds > 1").select("name", "most")
    here = prefix.join(each, "name")
    other = here.select("name", *[F.col(x).alias(f"{x}2") for x in ("rep", "c", "at", "n")])
    # an overlap of t needs (part + whole) t >= part (n + m)
    able = [(part + whole) * (F.col(x) - F.col(y) + 1) >= part * (F.col("n") + F.col("n2")) for x, y in (("n", "at"), ("n2", "at2"))]
    found = here.filter(F.col("c") != F.col("most")).drop("most").join(other, (here["name"] == other["name"]) & (F.col("c") != F.col("c2")) & able[0] & able[1])
    return found.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 2, threshold=THRESHOLD, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    n = bands * rows
    bounds = needed_agreements(n, BATCH, threshold[0] / threshold[1], miss)
    sketches = materialise(sketch(docs, width, n), "sketch")
    real = sketches.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    reps = materialise(real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "sequences")

    def keys(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(batch.num_rows, bands, rows).astype(np.uint64)
            out = np.full((batch.num_rows, bands), 7, np.uint64) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                out = S.pair(out, sig[:, :, r])
            yield pa.record_batch([pa.array(out.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), bands))], names=["key", "rep"])

    # buckets of two and more, and for each member how many it meets in all its buckets
    banded = materialise(reps.select("rep", "signature").mapInArrow(keys, "key long, rep long"), "bands")
    sizes = banded.groupBy("key").agg(F.count("*").alias("meets")).filter("meets > 1")
    shared = materialise(banded.join(sizes, "key"), "shared")
    degrees = shared.groupBy("rep").agg(F.sum("meets").alias("degree"))
    members = materialise(shared.drop("meets").join(degrees, "rep"), "members")
    discard(banded)
    texts = materialise(docs.select("doc_id", "text").join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    discard(shared)
    sig = lambda x: reps.select(F.col("rep").alias(x), F.col("signature").alias(f"sig_{x}"))

    links, component, tried, spent = None, None, None, [members, texts]
    for step in range(hub_rounds + 1):
        now = members.withColumn("c", F.col("rep")) if component is None else members.join(component, "rep", "left").withColumn("c", F.coalesce("c", "rep"))
        rank = F.struct(-F.col("degree"), "rep") if step == 0 else F.struct(F.xxhash64("rep", F.lit(step)), "rep")
        mixed = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min_by(F.struct("rep", "c"), rank).alias("hub")).filter("lo < hi")
        if step < hub_rounds:
            met = now.join(mixed.select("key", "hub"), "key").filter(F.col("c") != F.col("hub.c"))
            pairs = met.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"))
        else:
            pairs = _cross_pairs(now.join(mixed.select("key"), "key", "left_semi"), texts, width, *threshold)
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        spent.append(pairs)
        if step and pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        close = materialise(_prune(pairs.join(sig("a"), "a").join(sig("b"), "b"), bounds), "close")
        found = materialise(_verify(close, texts, width, *threshold), "links")
        spent += [close, found]
        links = found if links is None else links.unionByName(found)
        if component is not None:
            spent.append(component)
        component = connected(links).withColumnsRenamed({"node": "rep", "component": "c"})
    for made in spent:
        discard(made)
    by_sequence = reps.join(component, "rep", "left").select("digest", F.coalesce("c", "rep").alias("component_id"))
    joined = sketches.select("doc_id", "n_shingles", "digest").join(by_sequence, "digest", "left")
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, **options) -> DataFrame:
    """docs without those that are not the smallest doc_id of their component; rows without doc_id stay."""
    gone = near_duplicates(docs, width, **options).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op8_near_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).withColumn("kept", F.col("doc_id") == F.col("component_id"))
