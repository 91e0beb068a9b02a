"""Sums over all pairs of places whose displacements repeat.

A kernel depends on the displacement alone. Where stations and cells lie on grids, regular or not, a block has far fewer
displacements than pairs: each is worked out once, and what cells weigh is a matrix product. Only equal differences are
taken together, so the sums are those of the pairs but for the order of adding.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

import numpy as np

from isobath.functions import potential

#: Nanoseconds of a kernel's value, of a term of a matrix product and of an array operation's start, by which ways are compared.
VALUE, PRODUCT, CALL = 8.0, 0.2, 1_000.0
#: Places of a grid a row at most, pairs of values of an axis, numbers of a table at once, the same where layers stay apart, sums of a table at once.
SPARSE, VALUES, TABLE, LAYERED, SUMS = 8, 1 << 22, 1 << 16, 1 << 14, 1 << 24


def axes(places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct values of each axis and which of them each place has."""
    return [np.unique(places[:, a], return_inverse=True) for a in range(3)]


class Lattice:
    """Stations and cells by the distinct values of their axes; ``dense`` if grids of them are little larger than the rows."""

    def __init__(self, xyz: np.ndarray, cells: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.s, self.si = zip(*axes(xyz), strict=True)
        self.c, self.ci = zip(*(known or axes(cells)), strict=True)
        self.dense = bool(np.isfinite(xyz).all() and np.isfinite(cells).all()) and all(math.prod(map(len, v)) <= SPARSE * len(rows) for v, rows in ((self.s, xyz), (self.c, cells))) and all(len(s) * len(c) <= VALUES for s, c in zip(self.s, self.c, strict=True))
        self.pairs = len(xyz) * len(cells)
        if self.dense:
            found = [np.unique(s[:, None] - c[None], return_inverse=True) for s, c in zip(self.s, self.c, strict=True)]
            self.d, self.di = [d for d, _ in found], [at.reshape(len(s), len(c)) for (_, at), s, c in zip(found, self.s, self.c, strict=True)]

    def _sizes(self, way: tuple[int, int, int]) -> tuple[int, ...]:
        p, q, c = way
        return len(self.s[p]), len(self.s[q]), len(self.s[c]), len(self.c[p]), len(self.c[q]), len(self.c[c]), len(self.d[p]), len(self.d[q])

    def cheapest(self) -> tuple[int, int, int] | None:
        """Axes (p, q, c): p's displacements one by one, a table of q's by c's, summed over c; None if pairs are cheaper."""

        def cost(way):
            sp, sq, sc, cp, cq, cc, dp, dq = self._sizes(way)
            if dq * cq * min(sp, cp) > SUMS:
                return math.inf
            return sc * (VALUE * dp * dq * cc + PRODUCT * dq * (cc + 3) * sp * cp * cq + sp * cp * cq * (CALL + sq))

        if not self.dense:
            return None
        best = min(permutations(range(3)), key=cost)
        return best if cost(best) < VALUE * self.pairs else None

    def _displacements(self, way, u: float, rows: slice, level: float, columns: slice) -> list[np.ndarray]:
        p, q, c = way
        d: list = [None] * 3
        d[p], d[q], d[c] = np.full((1, 1), u), self.d[q][rows, None], (level - self.c[c][columns])[None]
        return d

    def masses(self, way: tuple[int, int, int], mass: np.ndarray) -> np.ndarray:
        """What lies at each place of the cells' grid, axes in the order of way."""
        out = np.zeros([len(self.c[a]) for a in way])
        np.add.at(out, tuple(self.ci[a] for a in way), mass)
        return out

    def sums(self, way: tuple[int, int, int], volume: float, kernels: list[tuple[Callable, np.ndarray]]) -> list[np.ndarray]:
        """For each (kernel, mass of the cells) the sum over the cells, per station."""
        p, q, c = way
        sp, sq, sc, _, cq, cc, _, dq = self._sizes(way)
        masses = [self.masses(way, m) for _, m in kernels]
        out = [np.zeros((sc, sp, sq)) for _ in kernels]
        step = max(1, TABLE // cc)
        for j, level in enumerate(self.s[c]):
            for u, value in enumerate(self.d[p]):
                a, b = np.nonzero(self.di[p] == u)
                weights = [m[b].reshape(-1, cc) for m in masses]
                made = [np.empty((len(b) * cq, dq)) for _ in kernels]
                for k in range(0, dq, step):
                    d = self._displacements(way, value, slice(k, k + step), level, slice(None))
                    r = potential.distance(d)
                    for g, w, (kernel, _) in zip(made, weights, kernels, strict=True):
                        g[:, k : k + step] = w @ np.broadcast_to(kernel(d, r, volume), r.shape).T
                for total, g in zip(out, made, strict=True):
                    for n, row in enumerate(a):
                        for e in range(cq):
                            total[j, row] += g[n * cq + e][self.di[q][:, e]]
        return [t[self.si[c], self.si[p], self.si[q]] for t in out]

    def layered(self, owners: list[np.ndarray | None]) -> tuple[int, int, int] | None:
        """The cheapest way whose last axis tells the layer (owners has the layer of each of its values); None if pairs are cheaper."""
        best, found = VALUE * self.pairs, None
        for way in permutations(range(3)) if self.dense else ():
            sp, sq, sc, cp, cq, cc, dp, dq = self._sizes(way)
            cost = sc * (VALUE * dp * dq * cc + sp * cp * cq * (CALL + sq * cc))
            if cost < best and owners[way[2]] is not None:
                best, found = cost, way
        return found

    def layer_sums(self, way: tuple[int, int, int], owner: np.ndarray, count: np.ndarray, n: int, volume: float, kernel: Callable) -> np.ndarray:
        """(stations, n) sums of the kernel over each layer's cells, of which count tells how many lie at each place.

        Where each place has one cell, the sums along the second axis serve all cells of the first.
        """
        p, q, c = way
        sp, sq, sc, _, cq, cc, _, dq = self._sizes(way)
        out = np.zeros((len(self.si[0]), n))
        single, step = len(np.unique(owner)) == len(owner), max(1, LAYERED // dq)
        full, ends = (count == 1).all((0, 1)), [(at[0], bool((np.diff(at) == 1).all()), at) for at in self.di[q].T]
        for every, columns in ((True, np.flatnonzero(full)), (False, np.flatnonzero(~full))):
            for k in range(0, len(columns), step):
                here = columns[k : k + step]
                made = np.zeros((sc, sp, sq, len(here)))
                for j, level in enumerate(self.s[c]):
                    for u, value in enumerate(self.d[p]):
                        d = self._displacements(way, value, slice(None), level, here)
                        r = potential.distance(d)
                        table = np.broadcast_to(kernel(d, r, volume), r.shape)
                        rows = [table[start : start + sq] if even else table[at] for start, even, at in ends]
                        if every:
                            total = sum(rows[1:], rows[0].copy())
                        for a, b in zip(*np.nonzero(self.di[p] == u), strict=True):
                            if every:
                                made[j, a] += total
                            else:
                                for e in range(cq):
                                    made[j, a] += rows[e] * count[b, e, here]
                found = made[self.si[c], self.si[p], self.si[q]]
                if single:
                    out[:, owner[here]] = found
                else:
                    np.add.at(out, (slice(None), owner[here]), found)
        return out


class Layered:
    """Cells of one volume in n layers, for many blocks of stations: axes, layers of their values and counts are found once."""

    def __init__(self, cells: np.ndarray, volume: float, layer: np.ndarray, n: int):
        self.cells, self.volume, self.n, self.axes, self.counts = cells, volume, n, axes(cells), {}
        self.owners = []
        for values, at in self.axes:
            owner = np.empty(len(values), np.int64)
            owner[at] = layer
            self.owners.append(owner if (owner[at] == layer).all() else None)

    def sums(self, xyz: np.ndarray, kernel: Callable) -> np.ndarray | None:
        """(stations, n) sums of the kernel over the cells of each layer; None if pairs are cheaper."""
        grid = Lattice(xyz, self.cells, self.axes)
        way = grid.layered(self.owners)
        if way is None:
            return None
        if way not in self.counts:
            self.counts[way] = grid.masses(way, np.ones(len(self.cells)))
        return grid.layer_sums(way, self.owners[way[2]], self.counts[way], self.n, self.volume, kernel)
