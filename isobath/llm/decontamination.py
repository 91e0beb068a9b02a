"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document if the document holds at least 80 % of the item's distinct five-word
shingles (lower-cased A-Z; an item or document with fewer words has its whole sequence as one shingle).
Items are partitioned by the size of their sets, in powers of two. An item's sketch is its k smallest
shingle hashes; k comes from the partition's upper size so that an item that is contained must show one
of its k in the document: the document may lack at most k - 1 shingles. Probing every shingle of a whole
document against the sketches thus misses nothing, however long the document, where signatures of whole
documents would drown a short item. Documents that are too small for an item skip it. Candidates are
decided on their exact shingles, word by word.

The corpus is scanned once. What is broadcast is a Bloom filter of the sketches' hashes, of 64 bits a hash and
at most ``most_bits``, however large the benchmark is; a fuller one only lets more rows through to the join of
hashes and sketches, which decides. Documents that show a hash are written once with their hashes; their texts
meet the texts of their candidates, ``ITEMS`` in a row at most.

Nulls and empty texts contain nothing and are contained in nothing. Items with equal id but different
texts are each searched; a match counts once per (doc_id, item_id), with the larger share. Repeated rows
of documents are each searched and reported once per doc_id. Extra columns play no part in the search and pass
through ``decontaminate`` untouched, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm import near_dedup as N
from isobath.llm import spans as S
from isobath.llm.shared import WORD, materialise, shielded, table

WIDTH = 5
SHARE = (80, 100)
BLOCK_BITS, MOST_BITS, BITS_A_KEY, PROBES = 1 << 15, 1 << 29, 64, 6
# A candidate meets so many items' texts in one row.
ITEMS = 64
_WORD = re.compile(WORD.encode())
_LOWER = bytes(N.LOWER)


def exact_shingles(text: str | None, width: int = WIDTH) -> set:
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def least_shared(n: int, share=SHARE) -> int:
    return -(-n * share[0] // share[1])


def sketch_length(n: int, share=SHARE) -> int:
    """Sketch of a set of n: enough for the largest set of its partition [2**c, 2**(c + 1))."""
    top = 2 ** int(n).bit_length() - 1
    return min(n, max(m - least_shared(m, share) + 1 for m in range((top + 1) // 2, top + 1)))


_ITEM = "item long, n_item long, least long, needed long, key long"


def _sketches(batches, width: int, share):
    """The sketch of each item, a row a hash, with how many of them a document that contains the item must show."""
    for batch in batches:
        for a, _, raw, offsets in N._slices(batch.column("text")):
            names, of = N.shingle_names(raw, offsets, width)
            out = [[np.zeros(0, np.int64)] for _ in range(5)]
            for i in range(len(of) - 1):
                own = names[of[i] : of[i + 1]]
                if n := len(own):
                    own = own[np.argsort(S.mix(own))][: sketch_length(n, share)]
                    least = least_shared(n, share)
                    for column, x in zip(out, (batch.column("item")[a + i].as_py(), n, least, len(own) - (n - least)), strict=False):
                        column.append(np.full(len(own), x))
                    out[4].append(own.view(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], names=["item", "n_item", "least", "needed", "key"])


def _places(keys: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Where a probe of a Bloom filter looks for each key."""
    low, step = keys & S.U(0xFFFFFFFF), (keys >> S.U(32)) | S.U(1)
    return ((low + S.U(probe) * step) & S.U(bits - 1)).astype(np.int64)


def _bloom_filter(keys: DataFrame, n: int, most_bits: int) -> tuple[int, bytes]:
    """How many bits, and the filter: built in blocks on the executors, at most most_bits in all."""
    bits = max(BLOCK_BITS, min(most_bits, 1 << (BITS_A_KEY * max(n, 1) - 1).bit_length()))

    def places(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([_places(own, k, bits) for k in range(PROBES)]))
            yield pa.record_batch([pa.array(at), pa.array(at // BLOCK_BITS)], names=["place", "block"])

    def build(group: pa.Table) -> pa.Table:
        on = np.zeros(BLOCK_BITS, np.uint8)
        on[group["place"].to_numpy() % BLOCK_BITS] = 1
        return pa.table({"block": group["block"].slice(0, 1), "bits": pa.array([np.packbits(on).tobytes()])})

    filled = bytearray(bits // 8)
    blocks = keys.mapInArrow(places, "place long, block long").distinct().groupBy("block").applyInArrow(build, "block long, bits binary")
    for r in blocks.toLocalIterator():
        filled[r.block * BLOCK_BITS // 8 : (r.block + 1) * BLOCK_BITS // 8] = r.bits
    return bits, bytes(filled)


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, share=SHARE, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, item_id, n_item (shingles of the item), n_shared, for every item found in a document."""
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").rlike(WORD)).distinct()
    wanted = materialise(wanted.withColumn("item", F.monotonically_increasing_id()), "items")
    sketches = materialise(wanted.select("item", "text").mapInArrow(lambda batches: _sketches(batches, width, share), _ITEM), "sketches")
    bits, filled = _bloom_filter(sketches.select("key"), sketches.count(), most_bits)
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def probe(batches):
        filled = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for a, _, raw, offsets in N._slices(batch.column("text")):
                names, of = N.shingle_names(raw, offsets, width)
                hit = np.arange(len(names))
                for k in range(PROBES):
                    at = _places(names[hit], k, bits)
                    hit = hit[(filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
                doc = np.searchsorted(of, hit, "right") - 1
                shown, first = np.unique(doc, return_index=True)
                keys = pa.ListArray.from_arrays(pa.array(np.r_[first, len(hit)].astype(np.int32)), pa.array(names[hit].view(np.int64)))
                rows = pa.array(shown + a)
                yield pa.record_batch([batch.column("doc_id").take(rows), batch.column("text").take(rows), pa.array(np.diff(of)[shown]), keys], names=["doc_id", "text", "n_doc", "keys"])

    given = docs.select("doc_id", "text").filter(F.col("text").rlike(WORD))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in given.schema] + [T.StructField("n_doc", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    suspects = materialise(given.mapInArrow(probe, schema).withColumn("row", F.monotonically_increasing_id()), "suspects")
    shows = suspects.select("row", "n_doc", F.explode("keys").alias("key")).join(sketches, "key").filter("n_doc >= least")
    candidates = shows.groupBy("row", "item").agg(F.count("*").alias("n"), F.first("needed").alias("needed")).filter("n >= needed").select("row", "item")
    numbered = candidates.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("row").orderBy("item")) - 1) / ITEMS))
    texts = numbered.join(wanted, "item").groupBy("row", "part").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))

    def decide(batches):
        for batch in batches:
            out = [[], [], [], []]
            for k in range(batch.num_rows):
                own = exact_shingles(batch.column("text")[k].as_py(), width)
                for item in batch.column("items")[k].as_py():
                    wants = exact_shingles(item["text"], width)
                    n = len(wants & own)
                    if n >= least_shared(len(wants), share):
                        for column, x in zip(out, (k, item["item_id"], len(wants), n), strict=True):
                            column.append(x)
            yield pa.record_batch([batch.column("doc_id").take(pa.array(out[0], pa.int64())), *[pa.array(x, pa.int64()) for x in out[1:]]], names=["doc_id", "item_id", "n_item", "n_shared"])

    schema = T.StructType([T.StructField("doc_id", given.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("item_id", "n_item", "n_shared")]])
    found = suspects.select("row", "doc_id", "text").join(texts, "row").select("doc_id", "text", "items").mapInArrow(decide, schema)
    best = F.max_by(F.struct("n_item", "n_shared"), F.struct(F.col("n_shared") / F.col("n_item"), -F.col("n_item"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_item", "best.n_shared")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those in which an item is found; a row is told by a SHA-256 of doc_id and text, so a null doc_id is no key."""
    hidden, back = shielded(docs)
    column = lambda c: F.col(hidden[docs.columns.index(c)])
    given = docs.toDF(*hidden)
    key = F.unhex(F.sha2(F.concat(F.coalesce(column("doc_id").cast("string"), F.lit("null")), F.lit("\n"), F.coalesce(column("text"), F.lit(""))), 256))
    keyed = given.withColumn("key", key)
    leaks = contained_items(keyed.select(F.col("key").alias("doc_id"), column("text").alias("text")), items, **options).select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(leaks, "key", "left_anti").select(*back)


def op9_decontamination(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def _sets_sql(name: str, id_: str, source: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
{name}_w AS (SELECT {id_}, regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{WORD}') AS ws FROM {source} WHERE text IS NOT NULL),
{name}_i AS (SELECT {id_}, ws, unnest(range(greatest(len(ws) - {WIDTH - 1}, 1))) AS i FROM {name}_w WHERE len(ws) > 0),
{name} AS (SELECT DISTINCT {id_}, array_to_string(ws[i + 1:i + {WIDTH}], ' ') AS sh FROM {name}_i)"""


ORACLE = f"""
WITH {_sets_sql('d', 'doc_id', 'documents')}, {_sets_sql('q', 'item_id', 'benchmark')},
sizes AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN q USING (sh) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, CAST(n_shared AS BIGINT) AS n_shared
FROM shared JOIN sizes USING (item_id) WHERE {SHARE[1]} * n_shared >= {SHARE[0]} * n_item
"""
