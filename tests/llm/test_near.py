import random

import numpy as np
import pyarrow as pa
import pytest

from isobath.llm import near_dedup as N
from isobath.llm import queries
from isobath.llm.components import connected
from tests.llm import cases


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(spark, width):
    rows = cases.unique(cases.documents(2))
    assert found(N.near_duplicates(spark.createDataFrame(rows, cases.SCHEMA), width)) == cases.components(rows, width)


def test_large_group_of_edited_copies(spark):
    """Copies that link only through their original, copies that link with nothing, and chains."""
    rng = random.Random(5)
    base = cases.sentence(rng, 200)
    texts = [base] + [cases.edited(rng, base, rng.choice([0.02, 0.04, 0.05, 0.06, 0.08])) for _ in range(150)]
    chain = [cases.sentence(rng, 100)]
    for _ in range(12):
        nxt = list(chain[-1])
        nxt[rng.randrange(100)] = f"y{rng.randrange(10**9)}"
        nxt[rng.randrange(100)] = f"y{rng.randrange(10**9)}"
        chain.append(nxt)
    rows = [(i, " ".join(t)) for i, t in enumerate(rng.sample(texts + chain, len(texts + chain)))]
    got = found(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == cases.components(rows, 2)


def test_awkward_rows(spark):
    rows = cases.documents(2)
    got = N.near_duplicates(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id in (2000, 2001, 2002)} == {i: (0, i) for i in (2000, 2001, 2002)}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert N.near_duplicates(spark.createDataFrame([], cases.SCHEMA)).collect() == []
    kept = N.keep_one(spark.createDataFrame(rows, cases.SCHEMA))
    assert kept.columns == [c.split()[0] for c in cases.SCHEMA.split(", ")]


def test_sets_that_differ_by_structure_only(spark):
    """Thue-Morse words and their complements have different names; so have words with zero bytes behind."""
    word = lambda n, a, b: "".join(b if bin(i).count("1") % 2 else a for i in range(n))
    rows = [(k, t) for k, t in enumerate([f(n) for n in (1024, 2048, 4096) for f in (lambda n: word(n, "a", "b"), lambda n: word(n, "b", "a"))] + ["a", "a\0", "a\0\0", "a \0a", "\0 aa"])]
    got = found(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {k: (1, k) for k, _ in rows} == cases.components(rows, 2)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_exact_sets_and_sequences(width):
    rng = random.Random(width)
    texts = [None, "", " ", "One", "one", "one two", "ONE  two\n", *[" ".join(rng.choice("abcAB") for _ in range(rng.randrange(12))) for _ in range(60)]]
    raw = [None if t is None else t.encode() for t in texts]
    sets, want = N.exact_sets(raw, width), [cases.shingles(t, width) for t in texts]
    for p, x in zip(sets, want, strict=True):
        assert len(p) == len(x)
        for q, y in zip(sets, want, strict=True):
            assert len(np.intersect1d(p, q)) == len(x & y)
    flat, offsets = N._flat(pa.array(texts, pa.string()))
    words = [cases.WORD.findall((t or "").translate(cases.LOWER)) for t in texts]
    assert N.sequences(*N._words(flat, offsets)) == [" ".join(w).encode() for w in words]
    names, of = N.shingle_names(flat, offsets, width)
    assert np.diff(of).tolist() == [len(x) for x in want]


def test_query_returns_the_contract_columns(spark, tmp_path):
    rows = cases.unique(cases.documents(7))
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op8_near_dedup"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == {i: (n, c, i == c) for i, (n, c) in cases.components(rows, 2).items()}


def test_posterior_bounds():
    bounds = N.needed_agreements(160, 32, 0.8, 1e-6)
    assert [k for k, _ in bounds] == [32, 64, 96, 128, 160]
    assert all(0 < least < 0.8 * k for k, least in bounds)
    # a pair at the threshold agrees in 0.8 k places and is far above every bound
    assert all(0.8 * k - least > 2.5 * (k * 0.16) ** 0.5 for k, least in bounds)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in link and link[0] != link[1] for link in links)}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
