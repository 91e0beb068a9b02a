"""WARC archives, audio and language identification: round trips, plain formulas and held-out accuracy."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.llm import audio, language_id, warc
from tests.llm import cases

PAGES = "page_id long, url string, html string, payload_bytes string"


def pages():
    rng = random.Random(4)
    big = "".join(rng.choice("abc é\r\n") for _ in range(90_000)) + "WARC/1.1\r\n\r\n"
    same = "x" * 1500
    return [(1, "http://a/", same), (7, "http://b/ c", same), (3, None, same), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (8, "u", ""), (9, "u", big), (2, "u", big), (10, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n" * 3)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


def test_archives_round_trip(spark, tmp_path):
    rows = pages()
    warc.write_archives(frame(spark, rows + [rows[0]]), f"{tmp_path}/w", segment=4096)
    got = {r.id: r for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert len(got) == len(rows) + 1 and not any(r.error for r in got.values())
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= warc.REVISIT:
            last[h] = max(i, last.get(h, i))
    for i, _, h in rows:
        raw = (h or "").encode()
        r = got[warc.page_urn(i, raw)]
        of = last.get(h, i)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if of == i else ("revisit", warc.page_urn(of, raw)))
        assert of != i or bytes(r.payload) == raw


def test_broken_segments(spark, tmp_path):
    parts = warc.records("urn:page:5:x", "u", b"y" * 30_000, None, 4096)
    assert len(parts) > 3

    def read(some):
        with gzip.open(tmp_path / "x.gz", "wb") as f:
            f.write(b"".join(p + warc.SEP for p in some))
        return warc.read_archives(spark, str(tmp_path / "x.gz")).collect()[0]

    assert read(parts[::-1]).error is None
    assert read(parts[:2] + parts[3:]).error == "missing segment"
    assert read(parts[:-1]).error == "missing segment"
    assert read(parts[:1] + [parts[1].replace(b"yy", b"yz", 1)] + parts[2:]).error == "wrong digest"
    assert read(parts + parts[1:2]).error is None
    assert read(parts + [parts[1].replace(b"yy", b"yz", 1)]).error == "conflicting segments"
    assert read([parts[0].replace(b"\r\n2000\r\n", b"\r\n2001\r\n", 1)] + parts[1:]).error is not None


def test_a_record_for_each_row(spark, tmp_path, monkeypatch):
    """Equal pages and payloads under several urls, and more equal rows than a task writes at once."""
    monkeypatch.setattr(warc, "COPIES", 3)
    same = "z" * 2000
    rows = [(1, "http://b/", same), (1, "http://a/", same), (2, "http://c/", same), (1, "http://a/", same), (5, "u", "short"), (5, "u", "other"), *[(None, "n", "tiny")] * 8]
    warc.write_archives(frame(spark, rows), f"{tmp_path}/w")
    records = warc.read_records(spark, f"{tmp_path}/w").collect()
    assert len(records) == len(rows) == len({r.id for r in records})
    assert sorted(r.uri for r in records) == sorted(u for _, u, _ in rows)
    got = warc.read_archives(spark, f"{tmp_path}/w").collect()
    of = {r.id for r in got if r.record_type == "response"}
    assert not any(r.error for r in got) and {r.refers_to for r in got if r.record_type == "revisit"} == {warc.page_urn(2, same.encode())} <= of
    assert sorted(r.uri for r in got if r.record_type == "revisit") == ["http://a/", "http://a/", "http://b/"]


def test_archives_of_nothing(spark, tmp_path):
    warc.write_archives(frame(spark, []), f"{tmp_path}/w")
    assert warc.read_archives(spark, f"{tmp_path}/w").collect() == []


@pytest.mark.parametrize("n", [0, 1, 8191, 8192, 8193, 20_000])
def test_chunked_framing(n):
    payload = random.Random(n).randbytes(n)
    assert warc.unframe(warc.frame(payload)) == payload


def test_audio_of_awkward_texts(spark):
    rows = cases.documents(5)
    out = audio.features(audio.encode(spark.createDataFrame(rows, cases.SCHEMA))).collect()
    assert len(out) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append((t or "").encode())
    for r in out:
        options = []
        for raw in texts[r.doc_id]:
            payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
            options.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in options
        assert r.media_bytes == r.payload_bytes + 44 and r.error is None
        t = audio.read_tensors(bytes(r.tensors))
        assert t["log_mel"].type.shape == [audio.CLIP, audio.MELS] and len(t) == -(-r.n_frames // audio.CLIP)
    assert len({r.feature for r in out if texts[r.doc_id] == texts[rows[3][0]]}) == 1
    assert audio.features(audio.encode(spark.createDataFrame([], cases.SCHEMA))).collect() == []


def test_broken_media(spark):
    df = spark.createDataFrame([(1, 1, bytearray(b"RIFFxxxx")), (2, 1, None), (3, 1, bytearray(audio.to_wave(b"a" * 64)[:-9]))], "doc_id long, n_bytes long, media binary")
    assert all(r.error and r.feature is None for r in audio.features(df).collect())


def test_resampler_keeps_a_tone_and_stops_aliases():
    for rate, target in ((16_000, 8_000), (11_025, 8_000), (8_000, 16_000)):
        t = np.arange(rate)
        make = lambda f, t=t, rate=rate: (128 + 100 * np.sin(2 * np.pi * f * t / rate)).round().astype(np.uint8)
        r = audio.Resampler(rate, target)
        y = r(make(440.0), 0, r.length(rate))
        want = 100 / 128 * np.sin(2 * np.pi * 440.0 * np.arange(len(y)) / target)
        assert np.abs(y - want)[100:-100].max() < 0.02
        whole = np.concatenate([r(make(440.0), a, min(a + 777, len(y))) for a in range(0, len(y), 777)])
        assert np.allclose(whole, y)
    r = audio.Resampler(16_000, 8_000)
    high = (128 + 100 * np.sin(2 * np.pi * 7000 * np.arange(16_000) / 16_000)).round().astype(np.uint8)
    assert np.abs(r(high, 0, 8000))[100:-100].max() < 0.03


def test_mel_and_segments():
    t = np.arange(16_000) / 16_000
    loud = (128 + 110 * np.sin(2 * np.pi * 1000 * t)).round().astype(np.uint8)
    quiet = np.full(16_000, 128, np.uint8)
    mel, level = audio.log_mel(np.concatenate([quiet, loud, quiet]), 16_000)
    found = audio.segments(level) * audio.HOP / audio.TARGET
    assert len(found) == 1 and abs(found[0, 0] - 1.0) < 0.05 and abs(found[0, 1] - 2.0) < 0.05
    centre = np.argmax(audio.mel_filters(audio.TARGET), axis=0)
    assert abs(centre[mel[len(mel) // 2].argmax()] * audio.TARGET / audio.FRAME - 1000) < 150


def test_language_accuracy_on_rows_held_out(spark):
    words = {"en": "the of and with that thing are was", "de": "der die und nicht ein mit sch ung", "fr": "le la les des que dans une eau", "es": "el los que por con una como ción"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(8, 60))), lang) for i in range(800) for lang in [rng.choice(list(words))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert set(model.families) == {"germanic", "romance"}
    out = {r.doc_id: r for r in language_id.identify(docs, model).withColumn("out", language_id.held_out(F.col("doc_id"))).collect()}
    held = [i for i, r in out.items() if r.out]
    assert 120 < len(held) < 280 and {i for i in out if zlib.crc32(str(i).encode()) % 4 == 2} == set(held)
    assert sum(out[i].lang_pred == rows[i][2] for i in held) >= 0.98 * len(held)
    assert all(0.0 <= r.score <= 1.0 for r in out.values())


def test_language_of_awkward_rows(spark):
    rows = cases.documents(6)
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    out = language_id.identify(docs, language_id.train(docs)).collect()
    assert len(out) == len(rows)
    assert {r.lang_pred for r in out if r.doc_id in (2000, 2001, 2002, 2007)} == {"und"} and all(r.score == 0 for r in out if r.lang_pred == "und")
    assert {r.lang_pred for r in out} <= {"und", "en", "de"}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.train(unlabelled) is None
    assert {r.lang_pred for r in language_id.identify(unlabelled, None).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), None).collect() == []


def test_broken_records_report_no_stated_values(spark, tmp_path):
    parts = warc.records("urn:page:5:x", "u", b"y" * 30_000, None, 4096)
    for name, some in (("missing", parts[:-1]), ("wrong", [parts[0], parts[1].replace(b"yy", b"yz", 1), *parts[2:]])):
        with gzip.open(tmp_path / f"{name}.gz", "wb") as f:
            f.write(b"".join(p + warc.SEP for p in some))
        (r,) = warc.read_archives(spark, str(tmp_path / f"{name}.gz")).collect()
        assert r.error and r.payload is None and r.payload_bytes is None and r.payload_digest is None
