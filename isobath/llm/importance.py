"""Importance resampling towards a target distribution.

A text's features are its runs of 1 to 3 words, hashed into buckets. A bucket's gain is the log-ratio of its share in
the target to its share in the corpus; a document's weight is the sum of the gains of its features, and its score adds
Gumbel noise that its doc_id draws. The documents of highest score are a sample without replacement by weight.

1. Every task counts the buckets of its own documents in one array; the tasks' arrays are added by bucket. Both the
   counts and the gains are ``buckets`` numbers, whatever the corpus holds.
2. A second pass looks every feature up in the array of gains. What is kept of a document are some numbers.
3. Scores are integers: an exact histogram over them, dealt by ranges, and the sums of its suffixes say how many
   documents stand above each score. The score at which the sample is full is the cutoff; above it and at it a
   document's rank is its score's offset and its place by doc_id among those of its score. The driver sees one sum a
   range.

CRC-32 is linear: the sum of a text and a word after it follows from the sums of both and the word's length, so runs
of words are never put together. Words of more than ``LONG`` bytes are summed by zlib.

Nulls: a null text has no words, weight 0, and is never drawn, as is a text of fewer than ``least_words`` words; a
null doc_id draws as "null" and counts as the largest among ties. Rows with equal doc_id are ranked one by one, by
their number of features where they tie. A text of any length is taken whole. An empty target gives every bucket the
gain of an empty count; empty documents give an empty table. Columns other than doc_id and text play no part; those
named in ``keep`` are returned too, under names that must not clash with the outputs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm import near_dedup as N
from isobath.llm import spans as S
from isobath.llm.shared import materialise, table

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = (5, 100)
SEED = 42
LONG = 62
BLOCK_WORDS = 1 << 18

# Bytes that separate words: ASCII but for digits and letters.
_APART = np.zeros(256, bool)
_APART[:128] = [not chr(c).isalnum() for c in range(128)]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _shifts(most: int) -> np.ndarray:
    """(most + 1, 4, 256): what each byte of a CRC-32 becomes when so many zero bytes follow."""
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for k in range(most):
        out[k + 1] = _CRC[out[k] & 0xFF] ^ (out[k] >> 8)
    return out


_SHIFT = _shifts(LONG + 1)


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 of a string and n zero bytes after it, but for the final inversion's share, which cancels in sums."""
    flat, at = _SHIFT.reshape(-1), n.astype(np.int64) * 1024
    out = flat[at + (crc & 0xFF)]
    for k in (1, 2, 3):
        out ^= flat[at + 256 * k + ((crc >> (8 * k)) & 0xFF)]
    return out


_SPACED = _shifted(np.full(LONG + 1, zlib.crc32(b" "), np.uint32), np.arange(LONG + 1))


class _Runs:
    """CRC-32 sums of the runs of 1 to 3 words that begin at each word of a block; valid[k]: there is a run of k + 1 words."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n: int):
        length = end - start
        short = np.minimum(length, LONG)
        one = np.full(len(start), 0xFFFFFFFF, np.uint32)
        live, t = np.arange(len(start)), 0
        while len(live):
            crc = one[live]
            one[live] = _CRC[(crc ^ raw[start[live] + t]) & 0xFF] ^ (crc >> 8)
            t += 1
            live = live[short[live] > t]
        one ^= np.uint32(0xFFFFFFFF)
        wide = np.flatnonzero(length > LONG)
        text = {int(i): raw[start[i] : end[i]].tobytes() for i in wide}
        for i, w in text.items():
            one[i] = zlib.crc32(w)
        spaced = _SPACED[short] ^ one
        self.sums, self.valid, last = [one[:n]], [np.ones(n, bool)], one
        for k in (1, 2):
            m = len(start) - k
            longer = _shifted(last[:m], short[k:] + 1) ^ spaced[k:]
            for i, w in text.items():
                if i >= k:
                    longer[i - k] = zlib.crc32(b" " + w, int(last[i - k]))
            last = longer
            ok = np.zeros(n, bool)
            ok[: min(n, m)] = (doc[k:] == doc[:m])[:n]
            self.sums.append(np.concatenate([longer, np.zeros(k, np.uint32)])[:n])
            self.valid.append(ok)


def _blocks(raw: np.ndarray, offsets: np.ndarray):
    """The runs of words of a slice of texts, block by block: first and last word, their documents, and _Runs; then the words a text has."""
    raw = N.LOWER[raw]
    start, end = S.words(raw, offsets[1:], _APART)
    doc = np.searchsorted(offsets, start, "right") - 1
    for a in range(0, len(start), BLOCK_WORDS):
        b = min(len(start), a + BLOCK_WORDS)
        c = min(len(start), b + 2)
        yield doc[a:b], _Runs(raw, start[a:c], end[a:c], doc[a:c], b - a)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; every task adds up its own first."""

    def run(batches):
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, offsets in N._slices(batch.column(0)):
                for _, runs in _blocks(raw, offsets):
                    for crc, ok in zip(runs.sums, runs.valid, strict=True):
                        found += np.bincount(crc[ok] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(found)
        yield pa.record_batch([pa.array(at), pa.array(found[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(corpus, target, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs with n_words, n_features and weight instead of its last column, the text."""
    kept = list(docs.schema)[:-1]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = sent.value
        for batch in batches:
            sums = [[np.zeros(0, np.int64)] for _ in range(3)]
            for _, _, raw, offsets in N._slices(batch.column(batch.num_columns - 1)):
                n = len(offsets) - 1
                own = np.zeros((3, n), np.int64)
                for doc, runs in _blocks(raw, offsets):
                    each = np.zeros((2, len(doc)), np.int64)
                    for crc, ok in zip(runs.sums, runs.valid, strict=True):
                        each[0] += ok
                        each[1] += np.where(ok, gain[crc % np.uint32(len(gain))], 0)
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    own[0] += np.bincount(doc, minlength=n)
                    own[1:, doc[first]] += np.add.reduceat(each, first, axis=1)
                for column, x in zip(sums, own, strict=True):
                    column.append(x)
            yield pa.record_batch([*batch.columns[:-1], *[pa.array(np.concatenate(x)) for x in sums]], names=schema.names)

    return docs.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, drawn by doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, may: Column, most: Iterable[int]) -> DataFrame:
    """scored with rank: 1, 2, 3.. by score down, then doc_id, for the first of the rows that may be drawn.

    ``most`` is numerator and denominator of the share that is drawn.
    """
    some = scored.filter(may)
    counts = some.groupBy("score").agg(F.count("*").alias("n"))
    ranges = materialise(counts.repartitionByRange(F.desc("score")).withColumn("range", F.spark_partition_id()), "histogram")
    sums = sorted(ranges.groupBy("range").agg(F.sum("n").alias("n")).collect())
    part, whole = most
    k = part * sum(r.n for r in sums) // whole
    undrawn = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select("*", undrawn)
    above, before = [], 0
    for r in sums:
        above.append((r.range, before))
        before += r.n
    inside = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = scored.sparkSession.createDataFrame(above, "range int, above long")
    offsets = ranges.join(F.broadcast(starts), "range").select("score", (F.sum("n").over(inside) - F.col("n") + F.col("above")).alias("offset")).filter(F.col("offset") < k)
    offsets = materialise(offsets, "offsets")
    cutoff = offsets.agg(F.min("score")).first()[0]
    drawn = may & (F.col("score") >= cutoff)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features"))
    rank = F.col("offset") + place
    first = scored.filter(drawn).join(offsets, "score").withColumn("rank", F.when(rank <= k, rank))
    return first.select(*scored.columns, "rank").unionByName(scored.filter(~drawn).select("*", undrawn))


def resample(docs: DataFrame, target: DataFrame, share=SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if it is not drawn) of every row of docs, and the columns of keep."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weigh(docs.select("doc_id", *keep, F.col("text").alias("words")), gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(materialise(scored, "scored"), F.col("n_words") >= least_words, share).drop("n_words")


def op12_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
