"""Line dedup, mixing, decontamination and chat formatting, against SQL or plain versions."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from isobath.llm import chat, decontamination, line_dedup, mixing
from tests.llm import cases

NAMES = [c.split()[0] for c in cases.SCHEMA.split(", ")]


def sql(text, **tables):
    import pandas as pd

    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        names, kinds = zip(*[c.split() for c in schema.split(", ")], strict=True)
        frame = pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype="Int64" if kinds[k] == "long" else object) for k, n in enumerate(names)})
        con.register(name, frame)
    return con.execute(text).fetchall()


def test_line_dedup_against_sql(spark):
    rows = [r for r in cases.unique(cases.documents(3)) if r[1] is not None]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, cases.SCHEMA))
    have = {(r.doc_id, r.n_lines, r.n_removed, r.n_chunks_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()}
    want = set(sql(line_dedup.ORACLE, documents=([r[:2] for r in rows], "doc_id long, text string")))
    assert have == want
    assert any(r[3] for r in have)
    assert set(NAMES) < set(got.columns)


def test_line_dedup_awkward_rows(spark):
    rows = cases.documents(3)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2000].text is None and by[2001].text == "" and by[2000].n_lines == 0
    twins = [r for r in got if r.doc_id == rows[3][0]]
    assert len({r.text for r in twins}) == 1
    assert line_dedup.dedup_lines(spark.createDataFrame([], cases.SCHEMA)).collect() == []


def test_chunks_resist_shifts(spark):
    rng = random.Random(1)
    lines = [" ".join(cases.sentence(rng, 5)) for _ in range(60)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["new line"] + lines))], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed > 45


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_against_sql(spark, seed):
    rows = cases.unique(cases.documents(seed))
    out = mixing.rates(spark.createDataFrame(rows, cases.SCHEMA))
    have = {(r.doc_id, r.size, r.source_size, r.target, r.size * r.copies) for r in out.collect()}
    assert have == set(sql(mixing.ORACLE, documents=([(r[0], r[1], r[3]) for r in rows], "doc_id long, text string, source string")))


def test_mixing_shares(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 5 if i % 3 else 0}") for i in range(4000)]
    out = mixing.rates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total, by = sum(r.size for r in out), {}
    for r in out:
        by.setdefault(r.source, [0, r.source_size, r.target])[0] += r.size * r.copies
    assert abs(sum(t for _, _, t in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(target <= 2 * size + 1e-9 and abs(taken - target) < 0.1 * target for taken, size, target in by.values())
    assert max(r.copies for r in out) <= 2
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert mixed.count() == sum(r.copies for r in out)


def test_mixing_empty_and_wordless(spark):
    assert mixing.rates(spark.createDataFrame([], cases.SCHEMA)).collect() == []
    rows = [(1, None, "a"), (2, " ", None)]
    assert [(r.size, r.copies, r.target) for r in mixing.rates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()] == [(0, 0, 0.0)] * 2


def items(rng):
    long = [" ".join(cases.sentence(rng, n)) for n in (5, 9, 15, 30, 59)]
    return [(k, t) for k, t in enumerate(long)] + [(90, None), (91, ""), (92, "two words")]


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    bench = items(rng)
    rows = cases.unique(cases.documents(4))
    for k, (_, t) in enumerate(bench[:5]):
        words = cases.sentence(rng, 3000)
        piece = t.upper().replace("É", "é").split()
        words[1000:1000] = piece
        rows.append((5000 + k, " ".join(words), *rows[0][2:]))
        rows.append((5100 + k, " ".join(words[:1000] + piece[: max(1, int(len(piece) * 0.7))] + words[1000:1100]), *rows[0][2:]))
    rows.append((5200, "Two words", *rows[0][2:]))
    want = set()
    for i, t, *_ in rows:
        own = cases.shingles(t, 5)
        for k, b in bench:
            s = cases.shingles(b, 5)
            if s and 100 * len(s & own) >= 80 * len(s):
                want.add((i, k, len(s), len(s & own)))
    docs, bench_df = spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(bench, "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_BITS", 256)
    monkeypatch.setattr(decontamination, "ITEMS", 2)
    for bits in (decontamination.MOST_BITS, 256):  # the smaller filter is full and lets all through
        assert {tuple(r) for r in decontamination.contained_items(docs, bench_df, most_bits=bits).collect()} == want
    assert {(5000 + k, k) for k in range(5)} <= {(i, k) for i, k, *_ in want}
    left = decontamination.decontaminate(docs, bench_df)
    assert left.count() == len(rows) - len({i for i, *_ in want}) and left.columns == docs.columns
    assert decontamination.contained_items(docs.limit(0), bench_df).collect() == []
    assert decontamination.contained_items(docs, bench_df.limit(0)).collect() == []


def conversations():
    rng = random.Random(2)
    bits = ["</s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>", "\\", "\\e", "\\l", "\\k", "\n", "hi", "é", "<<SYS>>", "<", "["]
    rows = [(c, t, role, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    return rows + [(50, 0, "user", None), (50, 1, None, "x"), (50, 1, "assistant", ""), (51, None, "assistant", "no turn"), (None, 0, "assistant", "no id"), (52, 0, "odd\nrole<s>", "t"), (53, 0, "assistant", "long " * 20000)]


def test_chat_round_trip_and_mask(spark):
    rows = conversations()
    out = chat.format_chats(chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: r for r in out.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("under")).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "") for r in rows if r[0] == c))
        said = [(t[3], t[5]) for t in turns]
        assert [(t["role"], t["text"]) for t in got[c].turns] == said
        assert got[c].under == "".join(t for role, t in said if role == "assistant")
        inside = got[c].formatted
        for mark in (chat.TURN, chat.END):
            assert inside.count(mark) == len(said)
        assert not any(x in inside for x in chat.CONTROL if x not in (chat.TURN, chat.END))


def test_chat_fold(spark):
    log = [
        (1, 1, "message", 0, "user", "question"), (1, 2, "message", 1, "assistant", "fi"), (1, 3, "delta", 1, "assistant", "rst"), (1, 4, "message", 2, "user", "more"), (1, 5, "regenerate", 1, "assistant", "sec"), (1, 6, "delta", 1, "assistant", "ond"),
        (1, 7, "edit", 0, "user", "better question"), (1, 8, "delta", 0, "user", "?"), (2, 1, "delta", 0, "assistant", "streamed"), (2, 2, "delta", 0, "assistant", " only"), (3, 1, None, 0, "user", None),
    ]
    out = chat.fold(spark.createDataFrame(random.Random(1).sample(log, len(log)), "conv_id long, seq long, kind string, msg long, role string, text string"))
    assert {(r.conv_id, r.position, r.role, r.text) for r in out.collect()} == {(1, 0, "user", "better question?"), (1, 1, "assistant", "second"), (2, 0, "assistant", "streamed only"), (3, 0, "user", "")}
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, seq long, kind string, msg long, role string, text string")).collect() == []
