"""Periodic runs of words, found on a harmonic grid of longest common extensions.

A run is a stretch of words of smallest period q (words q apart are identical) that no neighbour extends, of length
max(``least``, 3 q) or more. For every period p and every j, the words at j p and (j + 1) p are compared: their longest
common extension forward and backward tells the stretch of period p around them. A run of three periods holds a j
from which at least p words agree forward, so a grid of n / p places finds all runs of period p, n log n in all.

Extensions come in constant time from the suffix array of the words, its array of common prefixes and range minima;
backward ones from those of the reversed words. The suffix array is made by prefix doubling that sorts only suffixes
not yet told apart; two neighbours that part in a round get their common prefix from a range minimum over the rounds
before. A stretch that is found with several periods has the smallest of them: three periods fit, so the smallest
divides them all.

All runs lie in places that some ``least - least // 3`` consecutive words cover which occur again in the same text:
shift a run by its period. Names of such word sequences, equal if the words are, sort these places out first. Only
they, each as a text of its own, enter the suffix array; in most texts there are none. Words are compared as such.

A document is worked on by one task and nothing is shuffled. Besides the text, a word takes about 60 bytes, and a word
in repetitive places about 150.

Nulls: a null text has no words; doc_id is only carried along, whether null or repeated, and equal rows get equal
results. Columns named like an output are replaced; all others pass through, whatever their names. An empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm import near_dedup as N
from isobath.llm import spans as S
from isobath.llm.shared import shielded, table

LEAST = 24
REPEATS = 3
BLOCK = 16
GRID_BLOCK = 1 << 18
TEXT_BLOCK = 1 << 18


class Minima:
    """Range minima: running minima within blocks, and a table of powers of two over the blocks' minima."""

    def __init__(self, values: np.ndarray):
        n = -(-max(len(values), 1) // BLOCK) * BLOCK
        grid = np.full(n, np.iinfo(np.int32).max, np.int32)
        grid[: len(values)] = values
        self.values = grid
        grid = grid.reshape(-1, BLOCK)
        self.up = np.minimum.accumulate(grid, axis=1).reshape(-1)
        self.down = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
        self.levels, step = [self.up[BLOCK - 1 :: BLOCK]], 1
        while 2 * step <= len(self.levels[0]):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - step], last[step:]))
            step *= 2

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest value in each [lo, hi]."""
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.down[lo], self.up[hi])
        near = np.flatnonzero(a == b)
        if len(near):
            l, h = lo[near], hi[near]
            least = self.values[l]
            for _ in range(1, int((h - l).max()) + 1):
                l = np.minimum(l + 1, h)
                np.minimum(least, self.values[l], out=least)
            out[near] = least
        far = np.flatnonzero(b - a > 1)
        if len(far):
            a, b = a[far] + 1, b[far]
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = level == k
                both = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - (1 << k)])
                out[far[at]] = np.minimum(out[far[at]], both)
        return out


class Extensions:
    """Longest common extensions within texts: suffix array by doubling, common prefixes of neighbours, range minima."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        """words and text are one integer a place; texts are numbered 0, 1, 2.. in order, and extensions do not leave a text."""
        n = len(words)
        key = text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        prefix = np.where(new, 0, np.iinfo(np.int32).max).astype(np.int32)
        del key, ordered
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        last = np.append(np.flatnonzero(np.diff(text)), n - 1)[text]  # where each place's text ends
        k = 1
        while True:
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, n))
            many = size > 1
            slots = np.repeat(start[many] - (np.cumsum(size[many]) - size[many]), size[many]) + np.arange(size[many].sum())
            if not len(slots):
                break
            place = order[slots]
            inside = place + k <= last[place]
            ahead = np.where(inside, rank[np.minimum(place + k, n - 1)] + 1, 0)
            by = np.argsort(rank[place] * (n + 1) + ahead, kind="stable")
            place, ahead = place[by], ahead[by]
            order[slots] = place
            group = rank[place]
            apart = np.flatnonzero((group[1:] == group[:-1]) & (ahead[1:] != ahead[:-1])) + 1
            # neighbours that part now agree in k words, and then as far as what follows does
            a, b = ahead[apart - 1] - 1, ahead[apart] - 1
            more = np.zeros(len(apart), np.int64)
            both = np.flatnonzero(a >= 0)
            if len(both):
                known = Minima(prefix)
                more[both] = known.least(a[both] + 1, b[both])
            prefix[slots[apart]] = k + more
            new[slots[apart]] = True
            rank[place] = np.maximum.accumulate(np.where(new[slots], slots, 0))
            k *= 2
        self.rank = rank
        self.minima = Minima(prefix)

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from the places i and j on; i and j differ and lie in one text."""
        a, b = self.rank[i], self.rank[j]
        return self.minima.least(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def runs_of(words: np.ndarray, text: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(text, start, length, period) of all runs, by text, start and period; start counts over all texts."""
    n = len(words)
    if not n:
        return np.zeros((0, 4), np.int64)
    ids, first, size = np.unique(text, return_index=True, return_counts=True)
    most = size // REPEATS
    owner = np.repeat(np.arange(len(ids)), most)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = np.append(0, np.cumsum((size[owner] - 1) // period))
    forward = Extensions(words, np.repeat(np.arange(len(ids)), size))
    found = [np.zeros((4, 0), np.int64)]
    lo = 0
    while lo < len(owner):
        hi = max(lo + 1, int(np.searchsorted(pairs, pairs[lo] + GRID_BLOCK, "right")) - 1)
        count = np.diff(pairs[lo : hi + 1])
        which = np.repeat(np.arange(lo, hi), count)
        j = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        p = period[which]
        i = first[owner[which]] + j * p
        ahead = np.zeros(len(i), np.int64)
        same = np.flatnonzero(words[i] == words[i + p])
        ahead[same] = forward.at(i[same], i[same] + p[same])
        # of the places of the grid in one stretch the first will do
        far = ahead >= p
        far[1:] &= ~(far[:-1] & (which[1:] == which[:-1]))
        found.append(np.stack([owner[which[far]], i[far], p[far], ahead[far]]))
        lo = hi
    own, i, p, ahead = np.concatenate(found, axis=1)
    del forward
    back = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > first[own])
    if len(inner):
        a, b = i[inner] - 1, i[inner] + p[inner] - 1
        same = words[a] == words[b]
        inner, a, b = inner[same], a[same], b[same]
    if len(inner):
        turned = Extensions(words[::-1], np.repeat(np.arange(len(ids)), size[::-1]))
        back[inner] = turned.at(n - 1 - b, n - 1 - a)
    start, length = i - back, back + ahead + p
    ok = length >= np.maximum(least, REPEATS * p)
    rows = np.unique(np.stack([own, start, length, p], axis=1)[ok], axis=0)
    # one stretch: the smallest of its periods
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[keep]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1]))]
    rows[:, 0] = ids[rows[:, 0]]
    return rows


def _word_ids(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal integers for equal words."""
    offsets = np.append(0, np.cumsum(end - start))
    where = np.repeat(start - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[where])])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def repetitive(names: np.ndarray, doc: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which words are covered by a sequence of words that occurs again in their text; every run lies in such places."""
    span = least - least // REPEATS
    n = len(names)
    at = np.flatnonzero(doc[: max(0, n - span + 1)] == doc[span - 1 :])
    if not len(at):
        return np.zeros(n, bool)
    key = S.pair(S.lengthen(names, 1, span)[at], doc[at].astype(np.uint64))
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    return S.covered(at[again], at[again] + span, n)


_OUT = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed", "runs"]
_RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_KINDS = dict.fromkeys(_OUT, T.LongType()) | {c: T.StringType() for c in _OUT[6:9]} | {"runs": _RUNS}


def _greatest(runs: np.ndarray) -> int:
    """The row (start, length, period) of greatest length / period; of equal ones the first."""
    best = 0
    for i in range(1, len(runs)):
        if int(runs[i, 1]) * int(runs[best, 2]) > int(runs[best, 1]) * int(runs[i, 2]):
            best = i
    return best


def _collapsed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[str, str]:
    """Digest and text of words joined by one space."""
    digest, out = hashlib.sha256(), []
    for a in range(0, len(start), TEXT_BLOCK):
        s, size = start[a : a + TEXT_BLOCK], end[a : a + TEXT_BLOCK] - start[a : a + TEXT_BLOCK] + 1
        ends = np.cumsum(size)
        text = raw[np.minimum(np.repeat(s - (ends - size), size) + np.arange(ends[-1]), len(raw) - 1)]
        text[ends - 1] = 0x20
        piece = text.tobytes() if a + TEXT_BLOCK < len(start) else text[:-1].tobytes()
        digest.update(piece)
        out.append(piece)
    return digest.hexdigest(), b"".join(out).decode()


def collapse_runs(docs: DataFrame, least: int = LEAST, rearranged: Callable[[int | None, int], np.ndarray | None] | None = None, columns: tuple[str, ...] = tuple(_OUT), carry: tuple[str, ...] | None = None) -> DataFrame:
    """docs, or the columns named in ``carry``, with n_words, n_runs, the run of greatest exponent, all runs, and the text of which repetitions are dropped.

    ``rearranged`` takes doc_id and number of words and may return the numbers of the words to read instead.
    """
    hidden, back = shielded(docs)
    returned = [c not in columns and (carry is None or c in carry) for c in docs.columns]
    back = [x for x, r in zip(back, returned, strict=True) if r]
    doc_id, text = (hidden[docs.columns.index(c)] for c in ("doc_id", "text"))
    carried = [h for h, r in zip(hidden, returned, strict=True) if r]
    given = docs.toDF(*hidden).select(*carried, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([f for f in given.schema if f.name in carried] + [T.StructField(c, _KINDS[c]) for c in columns])
    kinds = {c: pa.int64() for c in _OUT[:6]} | {c: pa.string() for c in _OUT[6:9]} | {"runs": pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))}

    def rows_of(ids: list, raw: np.ndarray, offsets: np.ndarray):
        start, end = S.words(raw, offsets[1:])
        doc = np.searchsorted(offsets, start, "right") - 1
        first = np.searchsorted(doc, np.arange(len(ids) + 1))
        if rearranged is not None:
            for k, i in enumerate(ids):
                order = rearranged(i, int(first[k + 1] - first[k]))
                if order is not None:
                    at = slice(first[k], first[k + 1])
                    start[at], end[at] = start[at][order], end[at][order]
        names = S.word_names(raw, start, end)[0] if len(start) else np.zeros(0, np.uint64)
        inside = np.flatnonzero(repetitive(names, doc, least))
        parted = (np.diff(inside, prepend=-2) != 1) | (np.diff(doc[inside], prepend=-1) != 0)
        found = runs_of(_word_ids(raw, start[inside], end[inside]), np.cumsum(parted), least) if len(inside) else np.zeros((0, 4), np.int64)
        begin, length, period = inside[found[:, 1]] if len(found) else found[:, 1], found[:, 2], found[:, 3]
        gone = S.covered(begin + period, begin + length, len(start))
        of = np.searchsorted(begin, first)
        for k in range(len(ids)):
            runs = np.stack([begin, length, period], axis=1)[of[k] : of[k + 1]] - [first[k], 0, 0]
            kept = np.flatnonzero(~gone[first[k] : first[k + 1]]) + first[k]
            best = [int(x) for x in runs[_greatest(runs)]] if len(runs) else None
            digest, left = _collapsed(raw, start[kept], end[kept])
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
            four = [*best, 1000 * best[1] // best[2]] if best else [None] * 4
            yield dict(zip(_OUT, (int(first[k + 1] - first[k]), len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), digest, left, [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()]), strict=True))

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.num_columns - 2)
            for a, b, raw, offsets in N._slices(batch.column(batch.num_columns - 1)):
                rows = list(rows_of(ids.slice(a, b - a).to_pylist(), raw, offsets))
                some = batch.slice(a, b - a)
                yield pa.record_batch([*some.columns[:-2], *[pa.array([r[c] for r in rows], kinds[c]) for c in columns]], names=schema.names)

    return given.mapInArrow(run, schema).select(*back, *columns)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of words of the query: one document in ten, told by the CRC-32 of its doc_id, repeats a stretch up to its end."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def op11_periodic_runs(spark, sf_dir):
    shown = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return collapse_runs(table(spark, sf_dir, "documents"), rearranged=planted, columns=shown, carry=("doc_id",))
