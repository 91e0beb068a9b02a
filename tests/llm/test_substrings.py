import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from isobath.llm import queries
from isobath.llm import spans as S
from isobath.llm.substring_dedup import _Words, dedup_substrings
from isobath.llm.suffix_dedup import dedup_bytes
from tests.llm import cases


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def brute_words(rows, window=20):
    seen, out = set(), {}
    for i, t, *_ in order(rows):
        words = cases.WORD.findall(t or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def brute_bytes(rows, length=200):
    count = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] = count.get(b[s : s + length], 0) + 1
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [8 << 20, 4000])
def test_words_against_brute_force(spark, chunk):
    rows = cases.unique(cases.documents())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in dedup_substrings(spark.createDataFrame(rows, cases.SCHEMA), chunk_bytes=chunk).collect()}
    assert got == brute_words(rows)


def test_words_repeated_rows_and_nulls(spark):
    rows = cases.documents()
    got = dedup_substrings(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    assert len(got) == len(rows)
    # of identical rows the later ones lose every word that a window covers
    twin = [r for r in got if r.doc_id == rows[3][0]]
    assert sorted(r.n_removed for r in twin)[1:] == [twin[0].n_words if twin[0].n_words >= 20 else 0] * (len(twin) - 1)
    assert [r.kept for r in got if r.doc_id == 2000] == [""]


@pytest.mark.parametrize("chunk", [8 << 20, 4000])
def test_bytes_against_brute_force(spark, chunk):
    rows = cases.documents()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_bytes(spark.createDataFrame(rows, cases.SCHEMA), chunk_bytes=chunk).collect()), key=str)
    assert got == sorted(brute_bytes(rows), key=str)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], cases.SCHEMA)
    assert dedup_substrings(empty).collect() == [] and dedup_bytes(empty).collect() == []
    nothing = spark.createDataFrame([(1, None, None, None, None, None, None, None)], cases.SCHEMA)
    assert [(r.n_words, r.kept) for r in dedup_substrings(nothing).collect()] == [(0, "")]
    assert [(r.n_bytes, r.n_spans) for r in dedup_bytes(nothing).collect()] == [(0, 0)]


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_that_differ_by_structure_only(spark, size):
    """Thue-Morse words and their complements, which polynomial hashes modulo 2**64 confuse."""
    words = [f"w{k}" for k in range(19)]
    rows = [(1, " ".join([*words, thue_morse(size)])), (2, " ".join([*words, thue_morse(size, "b", "a")])), (3, " ".join([*words, thue_morse(size)]))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_words(rows) and [got[i][1] for i in (1, 2, 3)] == [0, 0, 20]


@pytest.mark.parametrize("size", [200, 256, 512, 600])
def test_strings_that_differ_by_structure_only(spark, size):
    t, u = thue_morse(size), thue_morse(size, "b", "a")
    rows = [(1, t[:size]), (2, u), (3, "x" + thue_morse(2048)[600 : 600 + size]), (4, "z" * 300 + u + "q" * 199)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=1000).collect())
    assert got == sorted(brute_bytes(rows))


def test_blocks_and_names():
    """Blocks far smaller than a document, a word longer than a block: no place is lost, no word cut, equal words have one name."""
    rng = random.Random(6)
    word = "".join(rng.choice("abc") for _ in range(5000))
    texts = [" ".join(cases.sentence(rng, 900)), " ".join([*cases.sentence(rng, 50), word, "aé", word]), word, "", None, "a a\0 a"]
    flat = S.Flat(pa.table({"doc_id": list(range(len(texts))), "text": texts, "_t": [0] * len(texts)}), 700)
    cut = list(flat.blocks())
    assert [0, *[b for _, b in cut]] == [*[a for a, _ in cut], len(flat.bytes)] and max(b - a for a, b in cut) <= 700
    w, raw = _Words(flat, (0, 1)), flat.bytes.tobytes()
    found = [raw[s:e] for s, e in zip(w.starts, w.ends, strict=True)]
    assert found == [x.encode() for t in texts for x in (t or "").split(" ") if x]
    assert w.per_doc.tolist() == [len(cases.WORD.findall(t or "")) for t in texts]
    names = {}
    for i, x in enumerate(found):
        names.setdefault(x, set()).add((int(w.names[0][i]), int(w.names[1][i])))
    assert all(len(n) == 1 for n in names.values()) and len(set().union(*names.values())) == len(names)


def test_packed_rows_follow_the_keys():
    """However many buckets there are, a chunk sends no more rows than keys; what is packed comes back."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
    rng = np.random.default_rng(1)
    for n, buckets in ((0, 5), (1, 5), (1000, 7), (1000, 10**9)):
        bucket, key, place = rng.integers(0, buckets, n), rng.integers(0, 2**63, n).astype(np.uint64), np.sort(rng.integers(0, 10**8, n))
        t = S.packed(3, bucket, {"a": key}, {"b": place}, schema)
        assert t.num_rows == len(set(bucket.tolist())) <= n
        order = np.argsort(bucket, kind="stable")
        assert (S.unpacked(t["a"], np.uint64)[0] == key[order]).all() and (S.unpacked_places(t["b"])[0] == place[order]).all()
    key, other = np.array([5, 5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64)
    first, count, of = S.first_index(key, other)
    assert (first.tolist(), count.tolist(), of.tolist()) == ([0, 1, 3], [2, 2, 1], [0, 1, 0, 2, 1])


def test_long_texts_are_worked_on_in_pieces(spark):
    rng = random.Random(6)
    long = cases.sentence(rng, 3000)
    word = "".join(rng.choice("abc") for _ in range(3000))
    rows = [(1, " ".join(long)), (2, " ".join(long[500:1100] + [word] + long[100:300] + [word])), (3, " ".join([*long[990:1020], word, *long[:25]])), (4, word), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (700, 5000):
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in dedup_substrings(docs, block_bytes=block, anchors_a_bucket=1).collect()} == brute_words(rows)
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_bytes(docs, block_bytes=block, bytes_a_bucket=100).collect()) == sorted(brute_bytes(rows))


def test_a_text_of_fifty_megabytes(spark):
    n = 6_600_000
    words = [f"{k * 7919 % 100_000_007:x}" for k in range(n)]
    text, piece = " ".join(words), " ".join(words[2_000_000:2_000_100])
    assert len(text) > 50_000_000
    docs = spark.createDataFrame([(1, text), (2, piece)], "doc_id long, text string")
    assert {(r.doc_id, r.n_words, r.n_removed) for r in dedup_substrings(docs).drop("kept").collect()} == {(1, n, 0), (2, 100, 100)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in dedup_bytes(docs).drop("kept").collect()}
    assert got == {1: (len(text), len(piece), 1), 2: (len(piece), len(piece), 1)}


def test_hot_and_missing_ids(spark):
    """All rows without an id, all with one id, rows without text: they spread over chunks, and every row comes back."""
    rng = random.Random(9)
    texts = [" ".join(cases.sentence(rng, 60)) for _ in range(40)]
    for ids in ([None] * 80, [7] * 80):
        rows = list(zip(ids, texts + texts[:20] + [None] * 20, strict=True))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert S.chunked_docs(docs, 1000)[0].select("chunk").distinct().count() > 5
        got = dedup_substrings(docs, chunk_bytes=1000).collect()
        assert sorted((r.n_words, r.n_removed) for r in got) == sorted([(60, 0)] * 40 + [(60, 60)] * 20 + [(0, 0)] * 20)
        got = dedup_bytes(docs, chunk_bytes=1000).collect()
        assert sum(r.n_removed == r.n_bytes > 0 for r in got) == 40 and sum(r.n_bytes == 0 for r in got) == 20 and len(got) == 80


def test_queries_return_the_contract_columns(spark, tmp_path):
    rows = cases.unique(cases.documents(5))
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    one = queries.QUERIES["op1_substring_dedup"](spark, str(tmp_path))
    assert one.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in one.collect()} == {i: x[:3] for i, x in brute_words(rows).items()}
    two = queries.QUERIES["op2_suffix_dedup"](spark, str(tmp_path))
    assert two.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r[:5]) for r in two.collect()) == sorted(brute_bytes(rows))


def test_packed_rows_refuse_what_does_not_fit():
    with pytest.raises(OverflowError):
        S._ends(np.array([0, 2**28]), 8)
    assert np.frombuffer(S._ends(np.array([0, 2**28 - 1]), 8), np.int32).tolist() == [0, 2**31 - 8]
