"""Sparse linear systems by elimination of blocks, for operators whose numbering keeps neighbours near (chains, strips, bands).

Nodes are dealt to ranges of their numbers. A task takes a block with all its edges as one dense matrix of bounded size and
eliminates the nodes that no other block touches; what stays is a matrix on the block's rim. Neighbouring blocks are taken
together as a group, and so on until nothing is left outside; then values go down the same way. So an edge moves once, a
block's rim twice a level, and no step runs over the whole table. What is left over is worked out on the edges
themselves and solved for again if it is too large.

Rims must stay small: ``solve`` says None where a group would exceed its bound, or where a block's elimination fails, and
the caller iterates instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from isobath.sources.storage import Store

#: Unknowns of a group at most, entries of a block at most.
FRONT, ENTRIES = 1_024, 500_000
BLOCK = "b long, nodes binary, f binary, ri binary, ci binary, v binary, er binary, ec binary, ev binary, ir binary, ic binary, bad long, rim long, size double"
RIM = "b long, nodes binary, s binary, f binary, er binary, ec binary, ev binary, ir binary, ic binary"
KNOWN = "b long, ids binary, x binary"
STATE = "b long, nodes binary, x binary, f binary, left double"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [pa.field(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]
    plain = [[x.tobytes() if isinstance(x, np.ndarray) else x for x in column] for column in zip(*rows, strict=True)] or [[]] * len(fields)
    return pa.table([pa.array(c, f.type) for c, f in zip(plain, fields, strict=True)], pa.schema(fields))


class _Row:
    """The arrays of a row; numbers of nodes are int64, places in a block int32, values of the system's kind."""

    def __init__(self, table: pa.Table | pa.RecordBatch, at: int, kind: type):
        self.table, self.at, self.kind = table, at, kind

    def __getattr__(self, name: str):
        value = self.table.column(name)[self.at]
        if not pa.types.is_binary(value.type):
            return value.as_py()
        dtype = np.int32 if name in ("ri", "ci") else np.int64 if name in ("nodes", "ids", "er", "ec", "ir", "ic") else self.kind
        return np.frombuffer(value.as_buffer() or b"", dtype)


def _places(nodes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted are among the sorted nodes, and whether they are."""
    at = np.minimum(np.searchsorted(nodes, wanted), max(len(nodes) - 1, 0))
    return at, nodes[at] == wanted if len(nodes) else np.zeros(len(wanted), bool)


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a x = b; not numbers if a is singular."""
    if not len(a):
        return b
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.full_like(b, np.nan)


def _rim(b: int, nodes: np.ndarray, a: np.ndarray, f: np.ndarray, edges: tuple) -> tuple:
    """The row of what is left of a group's system when the nodes without outer edges are eliminated."""
    er, ec, ev, ir, ic = edges
    outer = np.isin(nodes, np.concatenate([er, ic]))
    o, i = np.flatnonzero(outer), np.flatnonzero(~outer)
    if not len(o):
        return (b, nodes[o], a[:0, :0], f[o], er, ec, ev, ir, ic)
    made = _solved(a[np.ix_(i, i)], np.hstack([a[np.ix_(i, o)], f[i, None]]))
    left = np.hstack([a[np.ix_(o, o)], f[o, None]]) - a[np.ix_(o, i)] @ made
    return (b, nodes[o], np.ascontiguousarray(left[:, :-1]), np.ascontiguousarray(left[:, -1]), er, ec, ev, ir, ic)


def _filled(nodes: np.ndarray, a: np.ndarray, f: np.ndarray, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The values of all nodes of a group, those among ids being known."""
    at, known = _places(ids, nodes)
    out = np.zeros(len(nodes), f.dtype)
    out[known] = x[at[known]]
    i = np.flatnonzero(~known)
    out[i] = _solved(a[np.ix_(i, i)], f[i] - a[np.ix_(i, np.flatnonzero(known))] @ out[known])
    return out


class Fronts:
    """An operator in blocks of 2**bits numbers from ``low`` on."""

    def __init__(self, low: int, bits: int, kind: type):
        self.low, self.bits, self.kind = low, bits, kind

    def block(self, node: Column) -> Column:
        return F.shiftright(node.cast("long") - F.lit(self.low).cast("long"), self.bits)

    def packed(self, entries: DataFrame) -> DataFrame:
        """entries (b, rhs, r, c, v[, v_i]) to a row a block: its edges, its right-hand side, edges that cross its border."""
        low, bits, kind = self.low, self.bits, self.kind

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            b = key[0].as_py()
            rhs, r, c = (rows.column(n).to_numpy() for n in ("rhs", "r", "c"))
            v = rows.column("v").to_numpy().astype(kind)
            if kind is complex:
                v += 1j * rows.column("v_i").to_numpy()
            rhs = rhs.astype(bool)
            own, near = ~rhs & ((r - low) >> bits == b), (c - low) >> bits == b
            nodes = np.unique(r[own])
            if not len(nodes):
                return _table(BLOCK, [])
            (ra, has), (ca, met) = _places(nodes, r), _places(nodes, c)
            f = np.zeros(len(nodes), kind)
            np.add.at(f, ra[rhs & has], v[rhs & has])
            inner, out, into = own & near & met, own & ~near, ~rhs & ~own & met
            diagonal = np.zeros(len(nodes), kind)
            np.add.at(diagonal, ra[inner & (r == c)], v[inner & (r == c)])
            rim = len(np.unique(np.concatenate([r[out], c[into]])))
            arrays = ra[inner].astype(np.int32), ca[inner].astype(np.int32), v[inner], r[out], c[out], v[out], r[into], c[into]
            return _table(BLOCK, [(b, nodes, f, *arrays, int((diagonal == 0).sum()), rim, float((np.abs(f) ** 2).sum()))])

        return entries.groupBy("b").applyInArrow(run, BLOCK)

    @staticmethod
    def dense(row: _Row) -> np.ndarray:
        a = np.zeros((len(row.nodes),) * 2, row.kind)
        np.add.at(a, (row.ri, row.ci), row.v)
        return a

    def up(self, blocks: DataFrame) -> DataFrame:
        """What is left of each block on its rim."""
        kind, dense = self.kind, self.dense

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = _Row(batch, k, kind)
                    yield from _table(RIM, [_rim(row.b, row.nodes, dense(row), row.f, (row.er, row.ec, row.ev, row.ir, row.ic))]).to_batches()

        return blocks.mapInArrow(run, RIM)

    def _joined(self, rows: pa.Table, b: int, level: int):
        """Rows of neighbours as one system: (rows, nodes, matrix, right-hand side, outer edges); level counts halvings from blocks."""
        parts = [_Row(rows, k, self.kind) for k in np.argsort(rows.column("b").to_numpy())]
        nodes, f, er, ec, ev, ir, ic = (np.concatenate([getattr(p, n) for p in parts]) for n in ("nodes", "f", "er", "ec", "ev", "ir", "ic"))
        a, start = np.zeros((len(nodes),) * 2, self.kind), 0
        for p in parts:
            n = len(p.nodes)
            a[start : start + n, start : start + n] = p.s.reshape(n, n)
            start += n
        (r, _), (c, met) = _places(nodes, er), _places(nodes, ec)
        near, far = ((x - self.low) >> self.bits + level == b for x in (ec, ir))
        here = near & met
        np.add.at(a, (r[here], c[here]), ev[here])
        return parts, nodes, a, f, (er[~near], ec[~near], ev[~near], ir[~far], ic[~far])

    def merged(self, rims: DataFrame, jump: int, level: int) -> DataFrame:
        """What is left of each group of 2**jump neighbours on its rim."""
        joined = self._joined

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            b = key[0].as_py()
            _, nodes, a, f, edges = joined(rows, b, level)
            return _table(RIM, [_rim(b, nodes, a, f, edges)])

        return self._shifted(rims, jump).groupBy("g").applyInArrow(run, RIM)

    @staticmethod
    def _shifted(rims: DataFrame, jump: int) -> DataFrame:
        return rims.withColumn("g", F.shiftright("b", jump))

    def down(self, rims: DataFrame, jump: int, level: int, known: DataFrame | None) -> DataFrame:
        """For each row of rims the values of its rim and of its outer neighbours; known has the same of the groups."""
        kind, joined = self.kind, self._joined
        nothing = np.zeros(0, np.int64), np.zeros(0, kind)

        def made(b: int, rows: pa.Table, ids: np.ndarray, x: np.ndarray) -> pa.Table:
            if not rows.num_rows:
                return _table(KNOWN, [])
            parts, nodes, a, f, _ = joined(rows, b, level)
            found = _filled(nodes, a, f, ids, x)
            every, first = np.unique(np.concatenate([nodes, ids]), return_index=True)
            values, out = np.concatenate([found, x])[first], []
            for p in parts:
                wanted = np.union1d(p.nodes, p.ec)
                at, met = _places(every, wanted)
                out.append((p.b, wanted[met], values[at[met]]))
            return _table(KNOWN, out)

        groups = self._shifted(rims, jump).groupBy("g")
        if known is None:
            return groups.applyInArrow(lambda key, rows: made(key[0].as_py(), rows, *nothing), KNOWN)

        def run(key: tuple, rows: pa.Table, given: pa.Table) -> pa.Table:
            row = _Row(given, 0, kind) if given.num_rows else None
            return made(key[0].as_py(), rows, *((row.ids, row.x) if row else nothing))

        return groups.cogroup(known.groupBy("b")).applyInArrow(run, KNOWN)

    def filled(self, blocks: DataFrame, known: DataFrame | None) -> DataFrame:
        """The values of each block's nodes, added to those so far, and what its own edges leave of its right-hand side."""
        kind, dense = self.kind, self.dense

        def made(block: _Row, ids: np.ndarray, x: np.ndarray) -> tuple:
            nodes, f = block.nodes, block.f
            a, outer = dense(block), np.isin(nodes, np.concatenate([block.er, block.ic]))
            kept = np.isin(ids, nodes[outer])
            found = _filled(nodes, a, f, ids[kept], x[kept])
            left = f - a @ found
            at, met = _places(ids, block.ec)
            np.subtract.at(left, _places(nodes, block.er[met])[0], block.ev[met] * x[at[met]])
            before = block.x
            return (block.b, nodes, found + before if len(before) else found, left, float((np.abs(left) ** 2).sum()))

        nothing = np.zeros(0, np.int64), np.zeros(0, kind)
        if known is None:

            def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k in range(batch.num_rows):
                        yield from _table(STATE, [made(_Row(batch, k, kind), *nothing)]).to_batches()

            return blocks.mapInArrow(alone, STATE)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _table(STATE, [])
            row = _Row(right, 0, kind) if right.num_rows else None
            return _table(STATE, [made(_Row(left, 0, kind), *((row.ids, row.x) if row else nothing))])

        return blocks.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(run, STATE)

    def rows(self, state: DataFrame, node: str) -> DataFrame:
        """(node, u[, u_i]) of packed values."""
        kind = self.kind
        wide = kind is complex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = _Row(batch, k, kind)
                    x = row.x if len(row.x) else np.zeros(len(row.nodes), kind)
                    yield pa.record_batch([pa.array(row.nodes), *([pa.array(x.real), pa.array(x.imag)] if wide else [pa.array(x)])], ["node", *(["u", "u_i"] if wide else ["u"])])

        out = state.select("nodes", "x").mapInArrow(run, "node long, u double" + ", u_i double" * wide)
        return out.withColumn("node", F.col("node").cast(node))


def solve(store: Store, coo: DataFrame, rhs: DataFrame, tolerance: float, most: int, front: int = FRONT) -> tuple[DataFrame, int, float] | None:
    """(table (node, u[, u_i]), passes, what is left over the right-hand side), or None if groups of ``front`` unknowns do not hold the operator.

    coo is (r, c, v[, v_i]), rhs (node, f[, f_i]), both complex or neither. ArithmeticError if ``most`` passes do not reach the tolerance.
    """
    wide, node = "v_i" in coo.columns, coo.schema["r"].dataType
    if not isinstance(node, (ByteType, ShortType, IntegerType, LongType)):
        return None
    bits = max(1, front // 2).bit_length() - 1
    ends = coo.agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count_if(F.col("r").isNull()).alias("nulls")).first()
    if ends.nulls or ends.low is None or max(abs(ends.low), abs(ends.high)) >= 1 << 61:
        return None
    here = Fronts(ends.low, bits, complex if wide else float)
    levels = (ends.high - ends.low >> bits).bit_length()
    values = ["v", *["v_i"] * wide]
    edges = coo.select(F.lit(False).alias("rhs"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in values])
    edges = edges.filter(F.col("c").between(ends.low, ends.high))
    edges = edges.withColumn("b", F.explode(F.array_distinct(F.array(here.block(F.col("r")), here.block(F.col("c"))))))
    if (edges.groupBy("b").count().agg(F.max("count").alias("n")).first().n or 0) > ENTRIES:
        return None
    given = rhs.filter(F.col("node").between(ends.low, ends.high)).groupBy("node").agg(*[F.coalesce(F.sum(x).cast("double"), F.lit(0.0)).alias(y) for x, y in zip(("f", "f_i"), values, strict=False)])
    given = given.select(F.lit(True).alias("rhs"), F.col("node").cast("long").alias("r"), F.col("node").cast("long").alias("c"), *values, here.block(F.col("node")).alias("b"))
    blocks = store(here.packed(edges.unionByName(given)))
    seen = blocks.agg(F.sum("bad").alias("bad"), F.max("rim").alias("rim"), F.sum("size").alias("size")).first()
    if seen.bad:
        raise ValueError(f"{seen.bad} rows without a diagonal")
    if 2 * (seen.rim or 0) > front:
        return None
    size = left = seen.size or 0.0
    operator, step = blocks.drop("bad", "rim", "size"), 0
    state = operator.withColumn("x", F.lit(None).cast("binary"))
    now = state
    while left > tolerance * tolerance * size:
        if step == most:
            raise ArithmeticError(f"{most} steps leave {math.sqrt(left / size):.1e} of the right-hand side")
        step += 1
        known, rims, level, rim = None, [], 0, seen.rim
        while rim:
            table = store(here.up(state) if not rims else here.merged(rims[-1][0], rims[-1][1], level))
            rim = table.agg(F.max(F.octet_length("nodes")).alias("n")).first().n // 8
            if rim:
                jump = min(levels - level, int(math.log2(front // rim)) if front >= rim else 0)
                if jump < 1:
                    return None
                rims.append((table, jump, level + jump))
                level += jump
                if level == levels:  # nothing is outside the next groups
                    break
        for table, jump, to in reversed(rims):
            known = store(here.down(table, jump, to, known))
        now = store(here.filled(state, known))
        found = now.agg(F.sum("left").alias("left")).first().left
        if found is None or not found < 0.25 * left:
            return None
        left = found
        state = operator.drop("f").join(now.select("b", "x", "f"), "b")
    return here.rows(now, node.simpleString()), step, math.sqrt(left / size) if size else 0.0
