"""Small tables with awkward rows, and plain versions of the operators."""

from __future__ import annotations

import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string, chunks string"


def sentence(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, rate):
    return [f"x{rng.randrange(10**9)}" if rng.random() < rate else w for w in words]


def documents(seed=1, n=60):
    """Shared passages, near and exact copies, long and empty texts, nulls and repeated rows; clashing extra columns."""
    rng = random.Random(seed)
    passage, base = sentence(rng, 45), sentence(rng, 150)
    rows = []
    for i in range(n):
        words = sentence(rng, rng.choice([1, 3, 12, 40, 90]))
        if i % 4 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randrange(5) : 45 - rng.randrange(5)]
        if i % 5 == 1:
            words = edited(rng, base, rng.choice([0.0, 0.02, 0.05, 0.08]))
        lines, at = [], 0
        while at < len(words):
            step = rng.choice([3, 6, 9])
            lines.append(" ".join(words[at : at + step]))
            at += step
        rows.append((i * 3, "\n".join(lines).capitalize()))
    common = "Terms of use\napply to this text\nand to all others\nwithout end\nsee the page"
    rows += [(1001 + k, f"{common}\n{' '.join(sentence(rng, 9))}\n{common}") for k in range(6)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n "), (2003, "aaaa " * 300), (2004, "a" * 900), (2005, " ".join(sentence(rng, 9000))), (2006, rows[4][1]), (2007, "…!?"), (None, "a row without an id " * 8)]
    rows += [rows[3], rows[3], (rows[2][0], "another text under an id that is taken " * 7)]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["b", "a", "ä", None]), None if t is None else len(t), "clash", "clash", "clash") for i, t in rows]


def unique(rows):
    """One row per id, ids not null: where ids decide, results are told by id."""
    return list({r[0]: r for r in rows if r[0] is not None}.values())


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} - {()}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(rows, width, part=80, whole=100):
    sets = {r[0]: shingles(r[1], width) for r in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i in sorted(sets):
        for j in sorted({j for x in sets[i] for j in holders[x] if j > i}):
            both = len(sets[i] & sets[j])
            if whole * both >= part * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}
