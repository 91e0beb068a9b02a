"""One text of 1.6 MB among short ones: every operator takes it whole."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from isobath.llm import audio, chat, decontamination, importance, language_id, line_dedup, mixing, near_dedup, periodic_runs, warc
from tests.llm import cases
from tests.llm.test_new import plain_features

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(21)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    return "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10))


@pytest.fixture(scope="module")
def docs(spark, long_text):
    words = long_text.split()
    near = " ".join([*words[:100_000], "changed", *words[100_001:]])
    rows = [(1, long_text), (2, near), (3, "a short one"), *[(10 + k, f"short text number {k} of the small ones") for k in range(20)]]
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", "a", len(t)) for i, t in rows], SCHEMA).cache()


def test_documents_of_any_length(spark, docs, long_text):
    words = long_text.split()
    near = {r.doc_id: r for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert near[1].n_shingles > 199_000 and near[2].component_id == near[1].component_id == 1 and near[3].component_id == 3
    bench = spark.createDataFrame([(7, " ".join(words[-40:])), (8, " ".join(words[150_000:150_030]))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs, bench).collect()} == {(i, k) for i in (1, 2) for k in (7, 8)}
    cleaned = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert cleaned[1].text == long_text and cleaned[1].n_lines == 20_000 and cleaned[2].n_removed == 0
    assert {r.doc_id: r.size for r in mixing.rates(docs).collect()}[1] == 200_000
    model = language_id.train(docs)
    told = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert told[1].lang_pred in ("en", "de") and 0 <= told[1].score <= 1
    runs = {r.doc_id: r for r in periodic_runs.collapse_runs(docs).collect()}
    assert runs[1].n_words == 200_000 and runs[1].n_runs == 0 and runs[1].collapsed == " ".join(words)
    held = {r.doc_id: r for r in importance.resample(docs, bench).collect()}
    assert held[1].n_features == len(plain_features(long_text)[1])


def test_media_archives_and_chats_of_any_length(spark, docs, long_text, tmp_path):
    raw = long_text.encode()
    heard = {r.doc_id: r for r in audio.features(audio.encode(docs.filter("doc_id in (1, 3)"))).collect()}
    payload = raw + b"\0" * (-len(raw) % 64)
    assert (heard[1].payload_sha256, heard[1].tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    warc.write_archives(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html")), f"{tmp_path}/w")
    back = {r.id.split(":")[2]: r for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert bytes(back["1"].payload) == raw and back["1"].error is None and len(back) == docs.count()
    log = spark.createDataFrame([(1, 0, "user", "hi [INST]"), (1, 1, "assistant", long_text), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.as_events(log)).select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("under")).collect()
    got = {r.conv_id: r for r in out}
    assert [t["text"] for t in got[1].turns] == ["hi [INST]", long_text] and got[1].under == long_text
