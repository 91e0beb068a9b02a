"""Filtering and smoothing of long series by associative scan.

A step of the scalar state-space model x' = a x + q noise, y = x + r noise is an element (A, b, C, e, J), and elements
compose: what a stretch of a series does to the state before it is again an element. So a series is cut into chunks by
time, each chunk is composed on its own, the chunks' elements are composed in order, and every chunk is run once more
from the state that enters it. A series of any length is thus worked on by many tasks, and many short ones share a task.
Within an Arrow batch all series step at once: a segmented scan takes as many vectorised rounds as the logarithm of the
longest stretch in it. Smoothing runs backwards over the filtered rows with elements (E, g, L), by the same code.

Series begin at their first reading, which sets the state (y, r). Rows without series, t or y are left out; of rows with
one t the order is that of y. Chunks of one series meet in one task as an element each, read as a stream.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
OUTPUT = "series long, t long, mean double, variance double"
ROW, STATE, BEGIN = 0, 1, 2


def compose_filter(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Elements (A, b, C, e, J) of i and then j; a column an element."""
    a, b, c, e, p = i
    a2, b2, c2, e2, p2 = j
    over = 1.0 / (1.0 + c * p2)
    return np.stack([a2 * a * over, a2 * over * (b + c * e2) + b2, a2 * a2 * c * over + c2, a * over * (e2 - p2 * b) + e, a * a * p2 * over + p])


def compose_smooth(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Elements (E, g, L) of i, the later in time, and then j, the earlier."""
    return np.stack([j[0] * i[0], j[0] * i[1] + j[1], j[0] * j[0] * i[2] + j[2]])


def segmented(elements: np.ndarray, begins: np.ndarray, compose: Callable) -> np.ndarray:
    """Inclusive scan of the columns, anew where begins is set."""
    out, n = elements.copy(), elements.shape[1]
    place = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    step = 1
    while step <= place.max(initial=0):
        at = np.flatnonzero(place >= step)
        out[:, at] = compose(out[:, at - step], out[:, at])
        step *= 2
    return out


def _streamed(batches, keys: list[str], make: Callable, compose: Callable):
    """Batches of sorted rows with the scan over each run of equal keys, which may go on from batch to batch."""
    carried, last, before = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys])
        kind = batch.column("kind").to_numpy()
        begins = np.ones(batch.num_rows, bool)
        begins[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        goes_on = last is not None and bool((key[:, 0] == last).all())
        follows = np.append(before if goes_on else ROW, kind[:-1])
        follows[begins & (np.arange(len(begins)) > 0)] = ROW
        elements = make(batch, kind, follows)
        if goes_on:
            elements[:, :1] = compose(carried, elements[:, :1])
        found = segmented(elements, begins, compose)
        carried, last, before = found[:, -1:], key[:, -1], kind[-1]
        yield batch, key, kind, begins, found


def _totals(n: int, make: Callable, compose: Callable):
    """The element of each (series, chunk)."""

    def run(batches):
        held = None
        for _, key, _, begins, found in _streamed(batches, ["series", "chunk"], make, compose):
            ends = np.append(np.flatnonzero(begins)[1:] - 1, key.shape[1] - 1)
            rows = np.vstack([key[:, ends].astype(float), found[:, ends]])
            if held is not None and (held[:2] != rows[:2, :1]).any():
                yield _record(held, n)
            yield _record(rows[:, :-1], n)
            held = rows[:, -1:]
        if held is not None:
            yield _record(held, n)

    return run


def _record(rows: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array(rows[0].astype(np.int64)), pa.array(rows[1].astype(np.int64)), *[pa.array(x) for x in rows[2:]]], names=["series", "chunk", *[f"e{k}" for k in range(n)]])


def _scanned(rows: DataFrame, begin: DataFrame | None, n: int, make: Callable, compose: Callable, out: Callable, schema: str, backwards: bool) -> DataFrame:
    """rows (series, chunk, t, ..) through three passes; begin marks where each series starts, in the same columns."""
    order = (lambda c: F.col(c).desc()) if backwards else F.col
    marked = rows.withColumn("kind", F.lit(ROW))
    marked = marked if begin is None else marked.unionByName(begin.withColumn("kind", F.lit(BEGIN)), allowMissingColumns=True)
    by_chunk = lambda df: df.repartition("series", "chunk").sortWithinPartitions("series", "chunk", F.col("kind") != STATE, order("t"), F.col("kind").desc(), order("y"))
    names = [f"e{k}" for k in range(n)]
    ddl = ", ".join(["series long", "chunk long", *[f"{x} double" for x in names]])
    totals = by_chunk(marked).mapInArrow(_totals(n, make, compose), ddl)

    def entering(batches):
        """What enters each chunk but the first of a series."""
        last = None
        stored = lambda batch, kind, follows: np.stack([batch.column(x).to_numpy() for x in names])
        for batch, key, _, begins, found in _streamed(batches, ["series"], stored, compose):
            chunk = batch.column("chunk").to_numpy()
            before = np.hstack([np.full((n, 1), np.nan) if last is None else last[1], found[:, :-1]])
            first = begins.copy()
            first[0] = last is None or last[0] != key[0, 0]
            yield _record(np.vstack([key[0].astype(float), chunk.astype(float), before])[:, ~first], n)
            last = key[0, -1], found[:, -1:]

    ordered = totals.withColumn("kind", F.lit(ROW)).repartition("series").sortWithinPartitions("series", order("chunk"))
    states = ordered.mapInArrow(entering, ddl).withColumn("kind", F.lit(STATE))
    every = marked.unionByName(states, allowMissingColumns=True)

    def run(batches):
        for batch, _, kind, _, found in _streamed(batches, ["series", "chunk"], make, compose):
            own = np.flatnonzero(kind == ROW)
            yield out(batch.take(pa.array(own)), found[:, own])

    return by_chunk(every).mapInArrow(run, schema)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float)


def _stored(batch: pa.RecordBatch, elements: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The elements, but for those that a row holds itself."""
    if "e0" in batch.schema.names and (at := kind == STATE).any():
        elements[:, at] = np.stack([_column(batch, f"e{k}") for k in range(len(elements))])[:, at]
    return elements


def kalman_filter(traces: DataFrame, a: float = 1.0, q: float = 1.0, r: float = 1.0, chunk: int = CHUNK) -> DataFrame:
    """(series, t, y) to the filtered mean and variance of every row; chunks are ``chunk`` units of t long."""
    s = q + r
    gain = q / s

    def make(batch, kind, follows):
        y = np.nan_to_num(_column(batch, "y"))
        one = np.ones(len(y))
        e = np.stack([(1 - gain) * a * one, gain * y, (1 - gain) * q * one, a * y / s, a * a / s * one])
        start = follows == BEGIN  # the first reading sets the state
        e[:, start] = np.stack([0 * y, y, r * one, 0 * y, 0 * y])[:, start]
        e[:, kind == BEGIN] = np.array([[1.0], [0.0], [0.0], [0.0], [0.0]])  # leaves all as it is
        return _stored(batch, e, kind)

    def out(batch, found):
        return pa.record_batch([batch.column("series"), batch.column("t"), pa.array(found[1]), pa.array(found[2])], names=["series", "t", "mean", "variance"])

    rows = traces.select(F.col("series").cast("long"), F.col("t").cast("long"), F.col("y").cast("double")).dropna()
    rows = rows.withColumn("chunk", F.floor(F.col("t") / chunk))
    begin = rows.groupBy("series").agg(F.min("t").alias("t")).select("series", F.floor(F.col("t") / chunk).alias("chunk"), "t")
    return _scanned(rows, begin, 5, make, compose_filter, out, OUTPUT, False)


def kalman_smooth(filtered: DataFrame, a: float = 1.0, q: float = 1.0, chunk: int = CHUNK) -> DataFrame:
    """(series, t, mean, variance) as filtered to the smoothed ones: what all readings say about each row."""

    def make(batch, kind, follows):
        m, p = np.nan_to_num(_column(batch, "y")), np.nan_to_num(_column(batch, "variance"))
        e = p * a / (a * a * p + q)
        out = np.stack([e, m - e * a * m, p - e * a * p])
        last = follows == BEGIN  # the last row is as it was filtered
        out[:, last] = np.stack([0 * m, m, p])[:, last]
        out[:, kind == BEGIN] = np.array([[1.0], [0.0], [0.0]])
        return _stored(batch, out, kind)

    def out(batch, found):
        return pa.record_batch([batch.column("series"), batch.column("t"), pa.array(found[1]), pa.array(found[2])], names=["series", "t", "mean", "variance"])

    rows = filtered.select("series", "t", F.col("mean").alias("y"), "variance", F.floor(F.col("t") / chunk).alias("chunk"))
    begin = rows.groupBy("series").agg(F.max("t").alias("t")).select("series", F.floor(F.col("t") / chunk).alias("chunk"), "t")
    return _scanned(rows, begin, 3, make, compose_smooth, out, OUTPUT, True)
