"""Language identification and audio features against plain versions, in loops, dictionaries and direct sums."""

import cmath
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.llm import audio, chat, language_id, queries
from tests.llm import cases

BITS = language_id.BITS
WORDS = {"en": "the of and with that thing are was", "de": "der die und nicht ein mit sch über", "fr": "le la les des que dans une été", "es": "el los que por con una como ción", "fi": "ja on ei se että kun hän"}


def plain_counts(text):
    raw = text.encode()
    folded = []
    for i, c in enumerate(raw):
        if 65 <= c <= 90:
            c += 32
        elif c < 128 and not 97 <= c <= 122:
            c = 32
        elif i and raw[i - 1] == 0xC3 and 0x80 <= c <= 0x9E:
            c += 32
        folded.append(c)
    folded.append(32)
    out, two, one = {}, 32, 32
    for c in folded:
        if one != 32 or c != 32:
            slot = (((two << 16 | one << 8 | c) * 2654435761) % 2**32) >> (32 - BITS)
            out[slot] = out.get(slot, 0) + 1
        two, one = one, c
    return out


def unit(counts):
    size = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(n) / size for k, n in counts.items()} if size else {}


def plain_svm(xs, ys):
    w, mean, step = {}, {}, 0
    order = np.random.default_rng(11)
    weight = {y: 0.5 / max(sum(v == y for v in ys), 1) * len(ys) for y in (1, -1)}
    dot = lambda x: sum(v * w.get(k, 0.0) for k, v in x.items()) + w.get("bias", 0.0)
    for epoch in range(language_id.EPOCHS):
        for batch in np.array_split(order.permutation(len(ys)), max(1, len(ys) // 16)):
            step += 1
            rate = 1.0 / (language_id.LAMBDA * (step + 1000))
            out = [i for i in batch if ys[i] * dot(xs[i]) < 1]
            for k in w:
                w[k] *= 1 - rate * language_id.LAMBDA
            for i in out:
                for k, v in [*xs[i].items(), ("bias", 1.0)]:
                    w[k] = w.get(k, 0.0) + rate * ys[i] * weight[ys[i]] * v / len(batch)
            shrink = min(1.0, 1.0 / math.sqrt(language_id.LAMBDA) / max(math.sqrt(sum(v * v for v in w.values())), 1e-12))
            for k in w:
                w[k] *= shrink
        if epoch >= language_id.EPOCHS // 2:
            for k, v in w.items():
                mean[k] = mean.get(k, 0.0) + v
    return {k: v / (language_id.EPOCHS - language_id.EPOCHS // 2) for k, v in mean.items()}


def plain_model(rows):
    """rows of (text, lang) in the order of the sample."""
    families, shares, log, machines = {}, {}, {}, {}
    counted = [(plain_counts(t), lang) for t, lang in rows]
    for lang in sorted({lang for _, lang in rows}):
        families.setdefault(language_id.FAMILY_OF.get(lang, lang), []).append(lang)
        total = {}
        for c, of in counted:
            if of == lang:
                for k, n in c.items():
                    total[k] = total.get(k, 0) + n
        shares[lang] = {k: n / sum(total.values()) for k, n in total.items()}
    for family, own in families.items():
        log[family] = lambda k, own=own: math.log(sum(shares[lang].get(k, 0.0) for lang in own) / len(own) * 0.999 + 0.001 / 2**BITS)
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                some = [(unit(c), 1 if lang == a else -1) for c, lang in counted if lang in (a, b)]
                machines[a, b] = plain_svm([x for x, _ in some], [y for _, y in some])
    return families, log, machines


def plain_predict(model, text):
    families, log, machines = model
    c = plain_counts(text)
    total = max(sum(c.values()), 1)
    score = {f: sum(n * log[f](k) for k, n in c.items()) * min(1.0, language_id.WEIGHT / total) for f in families}
    top = max(score.values())
    post = {f: math.exp(s - top) for f, s in score.items()}
    family = max(post, key=post.get)
    posterior = post[family] / sum(post.values())
    own, x = families[family], unit(c)
    wins, sure = {lang: 0 for lang in own}, {lang: 0.0 for lang in own}
    for (a, b), w in machines.items():
        if a in own:
            margin = 2 * (sum(v * w.get(k, 0.0) for k, v in x.items()) + w.get("bias", 0.0))
            p = 1 / (1 + math.exp(-max(-50, min(50, margin))))
            wins[a if p >= 0.5 else b] += 1
            sure[a] += p
            sure[b] += 1 - p
    lang = max(own, key=lambda o: wins[o] + sure[o] / (len(own) + 1))
    return lang, posterior * (sure[lang] / (len(own) - 1) if len(own) > 1 else 1.0)


def test_language_id_against_loops_and_dictionaries(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(260):
        lang = rng.choice(list(WORDS))
        mixed = WORDS[lang].split() * 3 + WORDS[rng.choice(list(WORDS))].split()
        rows.append((i, " ".join(rng.choice(mixed) for _ in range(rng.choice([1, 2, 5, 30, 300]))).capitalize() + rng.choice(["", "!", " 12", " É"]), lang, "s", 1))
    rows += [(900, None, "en", "s", 1), (901, "", "de", "s", 1), (902, "12 …", "de", "s", 1), (None, "the thing that was", None, "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    drawn = spark.createDataFrame(rows, schema).withColumn("u", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))).collect()
    sample = [(r.text, r.lang) for r in sorted(drawn, key=lambda r: (r.lang or "", r.u)) if r.lang and any(c.isalpha() for c in r.text or "") and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    assert max(sum(lang == x for _, lang in sample) for x in WORDS) <= language_id.PER_LANG
    model = plain_model(sample)
    out = queries.QUERIES["op3_language_id"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if any(c.isalpha() for c in text or ""):
            lang, score = plain_predict(model, text)
            assert got[i].lang_pred == lang and abs(got[i].score - score) < 2e-3, (text, got[i], lang, score)
        else:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    counts = language_id.features(*[np.frombuffer(b"ABC", np.uint8), np.array([0, 3])])
    assert {int(k): int(counts[0, k]) for k in np.flatnonzero(counts[0])} == plain_counts("ABC")


def test_training_counts_are_not_clipped_and_rows_are_bounded(spark, monkeypatch):
    rows = [(1, "ab " * 70_000, "en"), (3, "xy zz", "en"), (4, "der die und", "de"), (5, "was ist das", "de"), (7, "solo", "qq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(language_id, "Model", lambda counts, langs: seen.update(most=counts.max(), langs=langs))
    language_id.train(docs)
    assert seen["most"] >= 70_000 and set(seen["langs"]) == {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    langs = set(seen["langs"])
    language_id.train(docs, sample=1)  # one row of each language at least
    assert sorted(seen["langs"]) == sorted(langs)


def test_every_language_is_learned(spark):
    """700 languages, most of a row or two; and a language without held-out texts is judged as well."""
    rng = random.Random(12)
    words = {k: [f"{''.join(rng.choice('abcdefghijklmnopqrstuvwxyz') for _ in range(5))}" for _ in range(6)] for k in range(700)}
    rows = [(i, " ".join(rng.choices(words[i % 700], k=30)), f"l{i % 700:03d}") for i in range(2800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = language_id.train(docs)
    learned = {lang for own in model.families.values() for lang in own}
    assert learned == {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2} and len(learned) > 690
    found = language_id.identify(docs, model).collect()
    own = {r.doc_id: r.lang_pred for r in found}
    assert sum(own[i] == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2 and lang in learned) > 0.95 * sum(zlib.crc32(str(i).encode()) % 4 == 2 and lang in learned for i, _, lang in rows)
    usual = language_id.calibrate(docs, model)
    assert set(usual) == learned


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    """Rows beyond any sample's size count in the trigrams, in the machines and in the calibration."""
    rng = random.Random(5)
    rows = [(i, f"{' '.join(rng.choices(WORDS[lang].split(), k=12))} mark{chr(97 + i % 26) * 3}", lang) for i, lang in enumerate(rng.choices(["en", "de", "fr"], [8, 3, 1], k=900))] + [(5000, "zyx", None), (5001, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    used = [(t.encode(), x) for i, t, x in rows if t and x and zlib.crc32(str(i).encode()) % 4 != 2]
    counts = language_id.features(np.frombuffer(b"".join(t for t, _ in used), np.uint8), np.cumsum([0] + [len(t) for t, _ in used])).astype(np.float32)
    whole = language_id.Model(counts, [x for _, x in used])
    for name, value in (("PER_LANG", 40), ("LEAST", 12), ("SAMPLE", 60)):
        monkeypatch.setattr(language_id, name, value)
    seen = []
    monkeypatch.setattr(language_id, "_pairs", lambda langs, of=language_id._pairs: seen.append(of(langs)) or seen[-1])
    model = language_id.learn(docs)
    assert model.families == whole.families and seen == [[("de", "en")]]
    assert all(np.allclose(model.trigrams[x], whole.trigrams[x]) for x in ("en", "de", "fr"))
    a, b = model.machines["de", "en"], whole.machines["de", "en"]
    assert a.shape == b.shape and a @ b > 0.8 * np.sqrt((a @ a) * (b @ b))
    assert language_id.learn(docs.repartition(7)).machines["de", "en"].tolist() == pytest.approx(a.tolist())
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert sum(found[i].lang_pred == x for i, _, x in rows[:900]) > 890
    out = [(t.encode(), x) for i, t, x in rows if t and x and zlib.crc32(str(i).encode()) % 4 == 2]
    counts = language_id.features(np.frombuffer(b"".join(t for t, _ in out), np.uint8), np.cumsum([0] + [len(t) for t, _ in out]))
    told, _ = model.predict(counts)
    mean, _ = model.likelihood(counts, told)
    usual = language_id.calibrate(docs, model)
    for x in ("en", "de", "fr"):
        assert abs(usual[x][0] - np.median([m for m, y, (_, z) in zip(mean, told, out, strict=True) if x == y == z])) <= 1e-4
    assert language_id.learn(docs.limit(0)) is None and language_id.calibrate(docs.limit(0), model) == {}


def test_memory_follows_bytes_not_rows():
    """Ten thousand short texts in one batch are counted a few at a time; the filter of the probe stays packed."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    model = language_id.Model(rng.integers(0, 5, (4, 1 << BITS)).astype(np.float32), ["en", "de", "fr", "es"])
    texts = pa.array(["abcde"] * 10_000)
    tracemalloc.start()
    told = []
    for *_, raw, offsets in language_id._few(texts):
        told += model.predict(language_id.features(raw, offsets))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(told) == 10_000 and len(set(told)) == 1 and peak < 100e6


def plain_resample(x, rate, target, n):
    """n outputs; beyond the last sample the filter rings out."""
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    widest = max(up, down)
    reach = audio.HALF * widest

    def tap(k):
        window = 0.54 + 0.46 * math.cos(math.pi * k / reach)
        return (1.0 if k == 0 else math.sin(math.pi * k / widest) / (math.pi * k / widest)) * window * up / widest

    out = []
    for m in range(n):
        near = range(max(0, (m * down - reach) // up), min(len(x), (m * down + reach) // up + 1))
        out.append(sum((x[i] - 128) / 128 * tap(m * down - i * up) for i in near if abs(m * down - i * up) <= reach))
    return out


def plain_log_mel(x, rate):
    frames = max(1, -(-(-(-len(x) * audio.TARGET // rate) - audio.FRAME) // audio.HOP) + 1)
    y = plain_resample(x, rate, audio.TARGET, (frames - 1) * audio.HOP + audio.FRAME)
    hertz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top = 2595 * math.log10(1 + audio.TARGET / 2 / 700)
    edges = [hertz(top * i / (audio.MELS + 1)) for i in range(audio.MELS + 2)]
    mel, level = [], []
    for f in range(frames):
        cut = y[f * audio.HOP : f * audio.HOP + audio.FRAME]
        windowed = [v * (0.5 - 0.5 * math.cos(2 * math.pi * i / audio.FRAME)) for i, v in enumerate(cut)]
        power = []
        for k in range(audio.FRAME // 2 + 1):
            power.append(abs(sum(v * cmath.exp(-2j * math.pi * k * i / audio.FRAME) for i, v in enumerate(windowed))) ** 2)
        row = []
        for a, b, c in zip(edges, edges[1:], edges[2:], strict=False):
            total = 0.0
            for k, p in enumerate(power):
                h = k * audio.TARGET / audio.FRAME
                total += p * max(0.0, min((h - a) / (b - a), (c - h) / (c - b)))
            row.append(math.log(total + 1e-6))
        mel.append(row)
        level.append(10 * math.log10(sum(v * v for v in cut) / audio.FRAME + 1e-10))
    return mel, level


def plain_segments(level):
    peak, out, start = max(level), [], None
    for i, v in enumerate([*level, -math.inf]):
        if v >= peak + audio.LOW_DB:
            start = i if start is None else start
        elif start is not None:
            if any(u >= peak + audio.HIGH_DB for u in level[start:i]):
                out.append((start, i))
            start = None
    return out


@pytest.mark.parametrize("rate", [11_025, 16_000, 8_000])
def test_log_mel_and_segments_against_direct_sums(rate):
    rng = random.Random(rate)
    assert audio.Resampler(11_025, 8_000).up > 2
    for text in (b"\0" * 64, b"a" * 640, bytes(rng.randrange(256) for _ in range(1472)), ("Ein Satz mit Wörtern. " * 40 + "zzz" * 200).encode()[:1600]):
        x = np.frombuffer(text, np.uint8)
        mel, level = audio.log_mel(x, rate)
        want_mel, want_level = plain_log_mel(text, rate)
        assert mel.shape == (len(want_mel), audio.MELS)
        assert np.allclose(mel, want_mel, atol=2e-4) and np.allclose(level, want_level, atol=1e-4)
        assert audio.segments(level).tolist() == [list(s) for s in plain_segments(level.tolist())]


def test_audio_query_and_feature(spark, tmp_path):
    rows = [(1, "Some words. " * 300), (2, None), (3, ""), (4, "é" * 700), (1, "Some words. " * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op7_audio_features"](spark, str(tmp_path))
    contract = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert out.columns[:8] == contract and len(out.collect()) == len(rows)
    for r in out.collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        media = audio.to_wave(payload)
        assert tuple(r[c] for c in contract[1:7]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert audio.from_wave(media) == (audio.RATE, payload)
        clips = audio.read_tensors(bytes(r.tensors))
        mel = np.concatenate([np.array(x) for x in clips["log_mel"].combine_chunks().to_numpy_ndarray()])[: r.n_frames]
        want, level = audio.log_mel(np.frombuffer(payload, np.uint8))
        spans = plain_segments(level.tolist())
        assert (mel == want).all() and r.n_segments == len(spans)
        assert [(s.start, s.end) for s in r.segments] == [(a * audio.HOP / audio.TARGET, ((b - 1) * audio.HOP + audio.FRAME) / audio.TARGET) for a, b in spans]
        active = [any(a < (k + 1) * audio.CLIP and b > k * audio.CLIP for a, b in spans) for k in range(len(clips))]
        assert clips["active"].to_pylist() == active and clips["start"].to_pylist() == [k * audio.CLIP * audio.HOP / audio.TARGET for k in range(len(clips))]
        digest = hashlib.sha256(np.round(mel * 64).astype("<i2").tobytes() + np.array(spans, "<i8").tobytes()).hexdigest()
        assert r.feature == f"frames={r.n_frames} segments={len(spans)} mel={digest}"


def test_warc_query_returns_every_row(spark, tmp_path):
    same, odd = "x" * 1500, "y" * 40_000
    rows = [(1, "u", same), (7, "v", same), (None, "w", same), (None, "w", same), (3, "u", "short"), (4, "u", "short"), (5, None, None), (6, "u", odd), (6, "u2", odd), (6, "u", "other " * 300), (None, "a", odd + "z"), (None, "b", odd + "z"), (8, "u", same)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op6_warc"](spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        ids = [j for j, _, x in rows if x == h and j is not None]
        of = max(ids, default=None) if len(raw) >= 1000 else i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if of == i else "revisit", None if of == i else of))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_chat_query_has_its_own_conversation(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes\\"), (None, 0, "assistant", "no id"), (2, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.QUERIES["op10_chat_formatting"](spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {-1: (2, f"user\n{said}\nassistant\n{said}\n", said), 1: (2, "user\nhi\nassistant\nyes\\\n", "yes\\"), None: (1, "assistant\nno id\n", "no id"), 2: (1, "\n\n", "")}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == {c: (n, sha(t), len(u), sha(u)) for c, (n, t, u) in want.items()}
    assert got[2].formatted_chars == len(chat.TURN + "\n" + chat.END)
