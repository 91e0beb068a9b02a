"""The pipeline against plain versions of its stages, on awkward documents."""

import random

import duckdb
import pandas as pd

import corpus_pipeline
from isobath.llm import language_id, line_dedup, mixing
from tests.llm import cases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_plain_versions(spark, tmp_path):
    rng = random.Random(12)
    bench = [(k, " ".join(cases.sentence(rng, 25))) for k in range(3)]
    # one row an id: where ids decide, results are told by id; nulls and repeats have tests of their own
    rows = [r[:5] for r in cases.unique(cases.documents(9))]
    rows += [(7000 + k, " ".join(cases.sentence(rng, 60)) + " " + t, "en", "a", None) for k, t in bench]
    copy = " ".join(cases.sentence(rng, 200)).split()
    rows += [(8000 + k, " ".join(copy[:k] + ["changed"] + copy[k + 1 :]), "de", "b", 1) for k in range(5)]
    path = f"{tmp_path}/sf"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")] + ["copy"] * (name == "mixing")
        seen.append([tuple(r) for r in docs.collect()])
    told, cleaned, alone, clean, mixed = seen

    # language: texts without a letter go, texts that are labelled well stay as they are
    silent = {2000, 2001, 2002, 2007}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = language_id.train(docs)
    judged = language_id.identify(docs, model, language_id.calibrate(docs, model)).collect()
    assert {r.doc_id for r in judged if r.lang_pred == "und"} == silent
    want = {r.doc_id for r in judged if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE and not r.foreign}
    assert set(told) == {r for r in rows if r[0] in want} and len(told) == len(want)

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r[0], r[1]) for r in told], columns=["doc_id", "text"]))
    want = {i: (t, n) for i, t, n in con.execute(f"WITH {line_dedup.cleaned_sql()} SELECT doc_id, text, n_removed FROM cleaned").fetchall()}
    before = {r[0]: r for r in told}
    assert any(n for _, n in want.values())
    assert {r[0]: r for r in cleaned} == {i: (i, t, *before[i][2:4], len(t) if n else before[i][4]) for i, (t, n) in want.items() if not n or t.strip(" \t\n\v\f\r")}

    groups = cases.components(cleaned, 5)
    assert {r[0] for r in alone} == {i for i, (_, c) in groups.items() if c == i} and set(alone) <= set(cleaned)
    assert sum(8000 <= r[0] < 8100 for r in alone) == 1

    sets = {k: cases.shingles(t, 5) for k, t in bench}
    leaks = {r for r in alone if any(100 * len(s & cases.shingles(r[1], 5)) >= 80 * len(s) for s in sets.values())}
    assert {r[0] for r in leaks} == {7000, 7001, 7002}
    assert sorted(map(str, clean)) == sorted(map(str, set(alone) - leaks))

    con.register("kept", pd.DataFrame([(r[0], r[1], r[3]) for r in clean], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    copies = con.execute(mixing.mix_sql("kept") + "SELECT doc_id, text, CAST(copies AS BIGINT) FROM mixed").fetchall()
    want_mix = sorted(str((None if pd.isna(i) else int(i), t, k)) for i, t, n in copies for k in range(n))
    assert sorted(str((r[0], r[1], r[5])) for r in mixed) == want_mix
    assert corpus_pipeline.run(spark, path).count() == len(mixed)


def test_language_stage_rejects_foreign_and_gibberish(spark):
    rng = random.Random(3)
    parts = {"en": "the of and ing tion er an wh ou th re", "de": "der die und sch ung ein keit ich be ge", "fr": "le la des que eau ment é è aux tre ou", "es": "el los ción por que mente ado rr ñ as"}
    word = lambda lang: "".join(rng.choice(parts[lang].split()) for _ in range(rng.randrange(1, 4)))
    langs = [rng.choice(list(parts)) for _ in range(900)]
    clean = [(i, " ".join(word(lang) for _ in range(int(2 ** rng.uniform(0, 10)))), lang, "a", None) for i, lang in enumerate(langs)]
    odd = ["Pan Tadeusz wrócił do domu i zobaczył, że wszystko było tak samo jak dawniej, kiedy był jeszcze dzieckiem.", "Это русский текст, который не похож ни на один из выученных языков.", "Tämä on suomenkielinen teksti, jota malli ei ole koskaan nähnyt eikä tunne."]
    odd += [" ".join("".join(rng.choice("qxzjkvwpbfy") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in (12, 40, 900)]
    rows = clean + [(9000 + k, text, "en", "a", None) for k, text in enumerate(odd)]
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert not [i for i in kept if i >= 9000]
    assert len(kept) >= 0.995 * len(clean)
