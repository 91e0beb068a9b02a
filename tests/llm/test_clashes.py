"""Columns of the input that are named like internal ones or outputs: values pass through, results stay the same."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isobath.llm import audio, chat, decontamination, language_id, line_dedup, mixing, near_dedup, warc
from isobath.llm import spans as S
from isobath.llm.substring_dedup import dedup_substrings
from isobath.llm.suffix_dedup import dedup_bytes
from tests.llm import cases

#: Names that operators use inside or add, in several spellings.
NAMES = """chunks gone d t _d _t ks h c k n stay cleaned lines marked _s _h _c _p _b _null n_lines n_removed n_chunks_removed size source_size target copies copy
of_source rank weight before lighter part reach level free key _key row item items n_doc keys given_0 given_1 given_5 extra_0 extra_1 _text letter lang_pred score foreign
u f digest signature rep component_id n_shingles chunk bucket seq msg kind position raw media n_bytes payload sha1 id block doc_id_ text_a""".split()
BASE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [r[:5] for r in cases.documents(11, 30)]
    plain = spark.createDataFrame(rows, BASE).cache()
    return plain, plain.select("*", *[F.concat(F.lit(f"mine {n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES]).cache()


def passes(got, without, replaced=(), added=()):
    """Extra columns hold what they held, and all others what they hold without the extra ones."""
    assert got.columns == [*corpus_pipeline.COLUMNS, *[n for n in NAMES if n not in replaced], *[a for a in added]]
    rows = [r.asDict() for r in got.collect()]
    assert rows
    for r in rows:
        own = "-" if r["doc_id"] is None else r["doc_id"]
        assert all(r[n] == f"mine {n} {own}" for n in NAMES if n not in replaced)
    shared = [c for c in without.columns if c in got.columns and c not in NAMES or c in replaced]
    assert sorted(str([r[c] for c in shared]) for r in rows) == sorted(str([r[c] for c in shared]) for r in without.collect())


def test_line_dedup(tables):
    plain, clash = tables
    out = ("n_lines", "n_removed", "n_chunks_removed")
    passes(line_dedup.dedup_lines(clash), line_dedup.dedup_lines(plain), out, out)


def test_mixing(tables):
    plain, clash = tables
    out = ("size", "source_size", "target", "copies")
    passes(mixing.rates(clash), mixing.rates(plain), out, out)
    passes(mixing.mix(clash), mixing.mix(plain).drop("copy"))


def test_decontamination(spark, tables):
    plain, clash = tables
    long = max((r.text for r in plain.collect() if r.text), key=len)
    bench = spark.createDataFrame([(1, " ".join(long.split()[50:90]), "x")], "item_id long, text string, item string")
    assert decontamination.decontaminate(plain, bench).count() < plain.count()
    passes(decontamination.decontaminate(clash, bench), decontamination.decontaminate(plain, bench))


def test_language_id(tables):
    plain, clash = tables
    model = language_id.train(plain)
    usual = language_id.calibrate(plain, model)
    out = ("lang_pred", "score", "foreign")
    passes(language_id.identify(clash, model, usual), language_id.identify(plain, model, usual), out, out)
    passes(language_id.identify(clash, None), language_id.identify(plain, None), out[:2], out[:2])


def test_near_dedup(tables):
    plain, clash = tables
    passes(near_dedup.keep_one(clash), near_dedup.keep_one(plain))


def test_operators_that_return_columns_of_their_own(spark, tables):
    plain, clash = tables
    for run in (dedup_substrings, dedup_bytes, near_dedup.near_duplicates, lambda d: audio.features(audio.encode(d))):
        assert sorted(map(str, run(clash).collect())) == sorted(map(str, run(plain).collect()))
    rows = [(1, 1, None, 0, "user", "a"), (1, 2, "delta", 0, "user", "b")]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg long, role string, text string")
    extra = [F.lit("mine").alias(n) for n in ("at", "reset", "restarted", "position", "piece", "start", "n", "head", "body", "loss", "formatted")]
    assert chat.format_chats(events.select("*", *extra)).collect() == chat.format_chats(events).collect()
    pages = spark.createDataFrame([(1, "u", "h" * 1200), (2, "u", "h" * 1200)], "page_id long, url string, html string")
    extra = [F.lit("mine").alias(n) for n in ("payload", "n", "sha1", "id", "latest", "times", "copies", "record")]
    assert sorted(map(str, warc.decisions(pages.select("*", *extra)).collect())) == sorted(map(str, warc.decisions(pages).collect()))


def test_pipeline_stages(spark, tables, tmp_path):
    plain, clash = tables
    spark.createDataFrame([(1, " ".join(cases.sentence(random.Random(1), 30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        without = stage(spark, plain, str(tmp_path))
        passes(stage(spark, clash, str(tmp_path)), without.select(*corpus_pipeline.COLUMNS))
        assert without.columns == [*corpus_pipeline.COLUMNS, *(["copy"] if name == "mixing" else [])]
        assert stage(spark, clash.limit(0), str(tmp_path)).collect() == []


def test_shared_folder_comes_from_the_session(spark, tmp_path, monkeypatch):
    from isobath.llm import shared

    before = spark.conf.get("spark.checkpoint.dir", None)
    own = shared.shared_dir(spark)
    assert own == shared.shared_dir(spark) and spark.conf.get("spark.checkpoint.dir", None) == before and own == (before or own)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *_, real=type(spark.conf).get: f"file://{tmp_path}/set/" if key == "spark.checkpoint.dir" else real(self, key, *_))
    assert shared.shared_dir(spark) == f"file://{tmp_path}/set"
    with shared.scratch(spark):
        made = shared.materialise(spark.range(3), "x")
        assert made.count() == 3 and len(list((tmp_path / "set").glob("scratch-*/x-*"))) == 1
    assert not list((tmp_path / "set").glob("scratch-*"))


def test_flat_rows_keep_their_order():
    import pyarrow as pa

    flat = S.Flat(pa.table({"doc_id": [5, None, 2, 5], "text": ["b", "z", None, "a"], "_t": [2, 1, 1, 1]}))
    assert flat.ids.to_pylist() == [2, 5, 5, None] and flat.bytes.tobytes() == b"abz" and flat.offsets.tolist() == [0, 0, 1, 2, 3]
