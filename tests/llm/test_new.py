"""Periodic runs, importance resampling and URL filters against plain versions and SQL."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.llm import importance, periodic_runs, queries, url_filter
from tests.llm import cases
from tests.llm.test_tables import sql

NAMES = [c.split()[0] for c in cases.SCHEMA.split(", ")]


def plain_runs(words, least=24):
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            begin = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > begin and i + p - begin >= max(least, 3 * p):
                found.setdefault((begin, i + p - begin), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, arrange=False):
    words = cases.WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if arrange and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *four, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(left))


def repetitive_documents():
    rng = random.Random(5)
    rows = [r[:2] for r in cases.documents(6) if r[0] != 2005] + [(2005, " ".join(cases.sentence(rng, 1500)))]
    for k in range(40):
        words = cases.sentence(rng, rng.randrange(200), 9)
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(words) + 1), rng.randrange(1, 30)
            piece = cases.sentence(rng, p, 3)
            words[at:at] = (piece * 12)[: rng.randrange(20, 9 * p + 40)]
        rows.append((7000 + k, " ".join(words)))
    rows += [(7100, "ab " * 1200), (7101, "x\u2003y é " * 24), (7102, ("word " * 7 + "w" * 4000 + " ") * 9)]
    return rows


def test_periodic_runs_against_brute_force(spark):
    rows = repetitive_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = periodic_runs.collapse_runs(docs).collect()
    shown = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(str(tuple(r[c] for c in shown)) for r in out) == sorted(str(plain_row(*r)) for r in rows)
    for r in out:
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256
        assert [tuple(x) for x in r.runs] == plain_runs(cases.WORD.findall(r.text or "")) and r.n_words == len(cases.WORD.findall(r.text or ""))
    assert sum(r.n_runs > 1 for r in out) > 5


def test_periodic_runs_query(spark, tmp_path):
    rows = repetitive_documents()
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(plain_row(*r, arrange=True)) for r in rows)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_runs", "start", "length", "period", "exponent_milli"], "bigint") | dict.fromkeys(["runs_sha256", "collapsed_sha256"], "string")


@pytest.mark.parametrize("least", [3, 7, 24])
def test_runs_on_small_alphabets(least):
    rng = random.Random(least)
    for _ in range(60):
        texts = [[rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(70))] for _ in range(3)]
        got = periodic_runs.runs_of(np.array(sum(texts, []), np.int64), np.repeat(np.arange(3), [len(t) for t in texts]), least)
        before = [0, len(texts[0]), len(texts[0]) + len(texts[1])]
        assert [tuple(r) for r in got.tolist()] == [(k, s + before[k], n, p) for k, t in enumerate(texts) for s, n, p in plain_runs(t, least)]


def test_runs_of_long_texts():
    n = 1_000_000
    for period in (1, 999):
        words = np.arange(n) % period
        assert periodic_runs.runs_of(words, np.zeros(n, np.int64)).tolist() == [[0, 0, n, period]]
    names = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    assert not periodic_runs.repetitive(names, np.zeros(n, np.int64)).any()


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(cases.LOWER))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(x.encode()) % 10_000 for x in runs]


def plain_resample(rows, bench):
    corpus, target = [0] * 10_000, [0] * 10_000
    for texts, counts in (([t for _, t in rows], corpus), (bench, target)):
        for t in texts:
            for b in plain_features(t)[1]:
                counts[b] += 1
    size, wanted = sum(corpus), sum(target)
    gain = [math.floor(1000 * math.log((t + 1) * (size + 10_000) / ((s + 1) * (wanted + 10_000)))) for s, t in zip(corpus, target, strict=True)]
    out, able = [], []
    for i, t in rows:
        n, features = plain_features(t)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(features), weight, score, None])
        if n >= 20:
            able.append((-score, i is None, i or 0, len(features), len(out) - 1))
    for rank, (*_, at) in enumerate(sorted(able)[: 5 * len(able) // 100], 1):
        out[at][4] = rank
    return out


def test_importance_query_against_plain_version(spark, tmp_path):
    rng = random.Random(9)
    rows = [r[:2] for r in cases.documents(7, 300)] + [(8000 + k, " ".join(cases.sentence(rng, 30, 12))) for k in range(300)]
    rows += [(i, "Target words Of some kind " * 6) for i in [9000] * 40 + [9001, None]]  # ties and repeated rows
    rows += [(9100, "x" * 70 + " " + "é" * 200 + " a b " + "y" * 63 + " " + "z" * 62 + " c"), (9101, "q" * 300_000 + " r"), (9102, " ".join(cases.sentence(rng, 300_000, 50_000)))]
    bench = ["target words of some kind in here", None, "", "w1 w2 w3"]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.QUERIES["op12_importance_resampling"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in got.dtypes} == {"bigint"}
    have = sorted(map(str, map(list, got.collect())))
    assert have == sorted(map(str, plain_resample(rows, bench)))
    assert sum("None]" not in r for r in have) > 20


def test_importance_edges(spark):
    rows = [r[:2] for r in cases.documents(7)]
    docs, none = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert sorted(map(str, map(list, importance.resample(docs, none).collect()))) == sorted(map(str, plain_resample(rows, [])))
    assert importance.resample(docs.limit(0), docs).collect() == []
    few = importance.resample(docs, docs, keep=("text",), share=(1, 2)).filter("rank is not null").collect()
    assert sorted(r["rank"] for r in few) == list(range(1, len(few) + 1)) and {(r.doc_id, r.text) for r in few} <= set(rows) and len(few) > 10
    assert importance.resample(docs, docs, share=(0, 1)).filter("rank is not null").count() == 0


def test_ranks_span_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(40), 1) for i in range(3000)]
    out = importance.ranked(spark.createDataFrame(rows, "doc_id long, score long, n_features long").repartition(7), F.col("doc_id") % 3 != 0, (1, 3)).collect()
    able = sorted((-s, i) for i, s, _ in rows if i % 3)
    want = {i: k for k, (_, i) in enumerate(able[: len(able) // 3], 1)}
    assert {r.doc_id: r["rank"] for r in out} == {i: want.get(i) for i, *_ in rows}


def urls():
    rng = random.Random(3)
    hosts = ["org", "example.org", "a.Example.ORG", "badexample.org", "com", "x.com", "xcom", "casino.net", "CASINO-a.org", "m.spam.net", "cheap-pills.de", "cheap-plls.de", "", "é.net", "u:p@h.net:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x.exe", "/en/2", "/fr/a", "/de/b\nc", "/x/y.exe", "/casino/", "/x.org/es/", "//"]
    made = [f"{s}{h}{p}{t}" for s in ("http://", "x://y://", "") for h in hosts for p in paths for t in ("", "?a=/es/", "#/es/")]
    return rng.sample(made, len(made)) + [None, "", "://", "http://a.net/" + "b" * 200_000 + ".exe", "http://" + "c" * 100_000 + ".spam.net/", "http://a.org/" + "d/" * 90_000]


def test_url_filters_against_sql(spark, tmp_path):
    rows = list(enumerate(urls())) + [(5, urls()[5]), (None, "http://org/")]
    spark.createDataFrame([(i, u, "<p>", "clash") for i, u in rows], "page_id long, url string, html string, verdict string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op13_url_filters"](spark, str(tmp_path))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = sql("SELECT page_id, host, path, rule, verdict FROM (" + url_filter.ORACLE + ")", pages=(rows, "page_id long, url string"))
    norm = lambda rs: sorted(str(tuple(None if x is None or x != x else x for x in r)) for r in rs)
    have = got.collect()
    assert norm(have) == norm(want)
    assert {(r.rule is None, r.verdict) for r in have} == {(True, "allow"), (True, "block"), (False, "allow"), (False, "block")}


def plain_glob(glob):
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + b".*".decode(), i + 2
            continue
        if glob[i] == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
        i += 1
    return re.compile(out, re.S)


def test_automaton_against_regular_expressions():
    rng = random.Random(4)
    alphabet = "ab/.*?"
    for count in (1, 3, 60):  # of one word of state and of several
        rules = [url_filter.Rule("".join(rng.choice(["a", "b", "/", ".", "*", "**", "?", "\\*", "\\?"]) for _ in range(rng.randrange(9))), rng.choice(["allow", "block"]), str(k), rng.randrange(3)) for k in range(count)]
        automaton = url_filter.Automaton(rules)
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(300)] + ["a" * 3000 + "/b", "ab/" * 2000]
        offsets = np.append(0, np.cumsum([len(t) for t in texts]))
        got = automaton.decide(np.frombuffer("".join(texts).encode(), np.uint8), offsets)
        for t, g in zip(texts, got, strict=True):
            fits = [r for r in rules if plain_glob(r.glob).fullmatch(t)]
            best = min(fits, key=lambda r: (-r.weight, r.verdict != "block", rules.index(r)), default=None)
            assert (automaton.rules[g] if g >= 0 else None) == best
    with pytest.raises(ValueError):
        url_filter.Automaton([url_filter.Rule("x" * 300_000, "block")])


def test_new_operators_pass_columns_through(spark):
    rows = cases.documents(2)
    docs = spark.createDataFrame(rows, cases.SCHEMA).select("*", F.lit("mine").alias("n_runs"), F.lit("mine").alias("given_0"), F.lit("mine").alias("runs"))
    out = periodic_runs.collapse_runs(docs)
    assert set(NAMES) | {"given_0"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
    assert sorted(str(r[:6]) for r in out.select(NAMES).collect()) == sorted(str(r[:6]) for r in docs.select(NAMES).collect())
    pages = spark.createDataFrame([(1, "http://org/", "mine", "mine")], "page_id long, url string, host string, given_1 string")
    r = url_filter.judge(pages, url_filter.RULES).first()
    assert (r.page_id, r.url, r.given_1, r.host, r.rule, r.verdict) == (1, "http://org/", "mine", "org", "org/", "allow")
    assert url_filter.judge(pages.limit(0), url_filter.RULES).collect() == [] and periodic_runs.collapse_runs(docs.limit(0)).collect() == []
