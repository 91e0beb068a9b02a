"""All-pairs kernels, tiles and rays over stations and cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobath.functions import potential
from isobath.operators import search
from isobath.operators.lattice import Lattice, Layered
from isobath.operators.skeleton import DRAWN, reduced, skeleton


def pairs(stations: DataFrame, cells: DataFrame) -> DataFrame:
    """Every station with every cell: dx, dy, dz (station minus cell) and r.

    The product is the operator's meaning; no side is hinted, so the planner broadcasts one only below
    its size limit, and the sums over it are pre-aggregated in the join's own stage. Rows with a null coordinate
    have no place and are left out.
    """
    stations, cells = (t.dropna(subset=["x", "y", "z"]) for t in (stations, cells))
    s = stations.select("obs_id", *[F.col(c).alias(f"s{c}") for c in "xyz"])
    d = [F.col(f"s{c}") - F.col(c) for c in "xyz"]
    made = s.crossJoin(cells).withColumns({f"d{c}": v for c, v in zip("xyz", d, strict=True)}).drop("sx", "sy", "sz")
    return made.withColumn("r", potential.distance([F.col(f"d{c}") for c in "xyz"]))


#: Stations and cells of a block of the product, at most; stations and cells of the tile that is worked on at once.
STATIONS, CELLS, FEW_CELLS = 16_384, 32_768, 2_048
TILE = (32, 2_048)


def block_sums(xyz: np.ndarray, cells: np.ndarray, volume: np.ndarray, parts: list[tuple[Callable, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each (kernel, property, rows that count): sums over the cells of kernel times property, per station of xyz.

    Cells of one volume on a grid are summed by their displacements, others pair by pair.
    """
    counted = np.logical_or.reduce([counts for _, _, counts in parts])
    if counted.any() and (volume[counted] == volume[counted][0]).all():
        grid = Lattice(xyz, cells[counted])
        way = grid.cheapest()
        if way is not None:
            return grid.sums(way, volume[counted][0], [(kernel, np.where(counts, prop, 0.0)[counted]) for kernel, prop, counts in parts])
    out = [np.zeros(len(xyz)) for _ in parts]
    for c in range(0, len(cells), TILE[1]):
        here = slice(c, c + TILE[1])
        x, v = cells[here], volume[here]
        masses = [np.where(counts[here], prop[here], 0.0) for _, prop, counts in parts]
        for s in range(0, len(xyz), TILE[0]):
            d = [xyz[s : s + TILE[0], a, None] - x[None, :, a] for a in range(3)]
            r = potential.distance(d)
            for total, mass, (kernel, _, _) in zip(out, masses, parts, strict=True):
                total[s : s + TILE[0]] += kernel(d, r, v) @ mass
    return out


def ranged(table: DataFrame, blocks: int, name: str, *order: str) -> DataFrame:
    """The table with the number of its block, blocks being ranges of about the same size."""
    if blocks == 1:
        return table.withColumn(name, F.lit(0))
    return table.repartitionByRange(blocks, *order).withColumn(name, F.spark_partition_id())


def forward(stations: DataFrame, cells: DataFrame, kernels: dict[str, tuple[Callable, str]], count: str | None = None) -> DataFrame:
    """Sums over the cells of kernel(d, r, volume) times a property, per station; one pass for all kernels.

    ``count`` names a column for the number of cells. The product is the operator's meaning. Stations and cells are dealt to blocks,
    every two blocks meet by equality as one group of bounded size, which numpy sums up in tiles, and the blocks' sums are
    added up by station. Blocks are ranges of places, so that displacements within a block repeat if they do at all. Rows with a null coordinate have no place and are left out; products with null count for nothing.
    """
    stations, cells = (t.dropna(subset=["x", "y", "z"]) for t in (stations, cells))
    props = sorted({p for _, p in kernels.values()})
    there = [F.col(c).cast("double").alias(c) for c in "xyz"]
    s = stations.select("obs_id", *there)
    c = cells.select(*there, F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("volume"), *[F.coalesce(F.col(p).cast("double"), F.lit(0.0)).alias(f"p{k}") for k, p in enumerate(props)], *[(F.col("volume").isNotNull() & F.col(p).isNotNull()).alias(f"ok{k}") for k, p in enumerate(props)], F.xxhash64(*[F.col(n) for n in cells.columns]).alias("deal"))
    cores = stations.sparkSession.sparkContext.defaultParallelism
    n_stations, n_cells = s.count(), c.count()
    rows = max(1, math.ceil(n_stations / STATIONS))
    columns = max(1, math.ceil(n_cells / min(CELLS, max(FEW_CELLS, n_cells * rows // (4 * cores)))))
    s, c = ranged(s, rows, "sb", "z", "y", "x", "obs_id"), ranged(c, columns, "cb", "z", "y", "x", "deal").drop("deal")
    s = s.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    c = c.withColumn("sb", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    spread = min(4 * rows * columns, 16 * cores)
    s, c = (t.repartition(spread, "sb", "cb") for t in (s, c))
    obs = stations.schema["obs_id"].dataType.simpleString()
    names = [f"s{k}" for k in range(len(kernels))]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = lambda t, n: t.column(n).to_numpy()
        xyz, at = (np.stack([numbers(t, a) for a in "xyz"], 1) for t in (left, right))
        parts = [(kernel, numbers(right, f"p{props.index(p)}"), numbers(right, f"ok{props.index(p)}").astype(bool)) for kernel, p in kernels.values()]
        sums = block_sums(xyz, at, numbers(right, "volume"), parts) if len(at) else []
        made = [pa.array(x) if counts.any() else pa.nulls(len(xyz), pa.float64()) for x, (_, _, counts) in zip(sums, parts, strict=True)] if len(at) else [pa.nulls(len(xyz), pa.float64())] * len(parts)
        return pa.table([left.column("obs_id"), *made, pa.array(np.full(len(xyz), len(at)))], ["obs_id", *names, "cells"])

    met = s.groupBy("sb", "cb").cogroup(c.groupBy("sb", "cb")).applyInArrow(meet, ", ".join([f"obs_id {obs}", *[f"{n} double" for n in names], "cells long"]))
    made = met.groupBy("obs_id").agg(*[F.sum(n).alias(k) for n, k in zip(names, kernels, strict=True)], F.sum("cells").alias("_cells"))
    made = made.filter("_cells > 0")
    return made.withColumnRenamed("_cells", count) if count else made.drop("_cells")


#: Layers of a block of the information, stations of a panel of one task's, layers whose sums travel as one row, stations of a group.
LAYERS, PANEL, SLAB, READINGS = 2_048, 1_024, 64, 1 << 20
_SUMS = "a int, b int, slab int, i binary, j binary, oki binary, okj binary, sums binary"


def layer_sums(cells: np.ndarray, volume: np.ndarray, layer: np.ndarray, n: int, kernel: Callable) -> Callable[[np.ndarray], np.ndarray]:
    """Of stations the (stations, n) sums of the kernel over the cells of each layer; cells of one volume on a grid by their displacements."""
    grid = Layered(cells, volume[0], layer, n) if len(cells) and (volume == volume[0]).all() else None
    order = np.argsort(layer, kind="stable")
    ends = np.searchsorted(layer[order], np.arange(n + 1))

    def of(xyz: np.ndarray) -> np.ndarray:
        found = grid.sums(xyz, kernel) if grid else None
        if found is not None:
            return found
        out = np.zeros((len(xyz), n))
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if a < b:
                at = order[a:b]
                (out[:, k],) = block_sums(xyz, cells[at], volume[at], [(kernel, np.ones(b - a), np.ones(b - a, bool))])
        return out

    return of


def information(stations: DataFrame, cells: DataFrame, kernel: Callable, layer: str, noise: float, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(i, j, lambda): over all readings obs_id the sum of h_i h_j / noise, h_i the sum of kernel(d, r, volume) over the cells of layer i.

    The result has a row for every two layers. Layers are dealt to blocks and a group is two blocks with all stations, whose h are made
    panel by panel and multiplied as matrices, so no pair of station and cell or of layers is a row, a group holds a matrix of two
    blocks, and no sums travel. Only where the groups are fewer than the cores or stations are very many are these dealt to ranges of places,
    rows of one obs_id together, and the ranges' sums added up. Rows with a null coordinate, obs_id or layer are left out; a layer without any volume has a null lambda.

    ``store`` writes a table and reads it again. With it, several blocks are first looked through, each once: where the h of many layers
    are sums of those of a few (``skeleton``, to 1e-14 of their length, measured on all stations), only these few are multiplied,
    and the others' products follow from theirs. Where they are not, all are multiplied.
    """
    there = [F.col(c).cast("double").alias(c) for c in "xyz"]
    s = stations.dropna(subset=["obs_id"]).dropna(subset=["x", "y", "z"]).select("obs_id", *there)
    c = cells.dropna(subset=["x", "y", "z", layer]).select(*there, F.col("volume").cast("double").alias("volume"), F.col(layer).cast("long").alias("layer"))
    n_stations, n_layers = s.count(), c.select("layer").distinct().count()
    if store and n_layers > LAYERS and n_stations:
        blocks = math.ceil(n_layers / LAYERS)
        ends = c.select("layer").distinct().agg(F.percentile_approx("layer", [k / blocks for k in range(1, blocks)], 10_000)).first()[0]
        own = lambda name: F.size(F.filter(F.array(*map(F.lit, ends)), lambda x: x < F.col(name)))
        chosen = store(_chosen(s, c.withColumn("a", own("layer")), n_stations, blocks, kernel))
        few = chosen.agg(F.sum(F.size("chosen"))).first()[0]
        if 2 * few <= n_layers:
            kept = c.join(chosen.select(F.explode("chosen").alias("layer")), "layer", "left_semi")
            among = _told(_products(s, kept, n_stations, few, kernel), 1.0).withColumns({"a": own("i"), "b": own("j")}).filter("a <= b")
            return _told(_spread(among, chosen, blocks), noise)
    return _told(_products(s, c, n_stations, n_layers, kernel), noise)


def _dealt(s: DataFrame, n_stations: int, groups: int) -> tuple[DataFrame, int]:
    """Stations with the number sb of their range, and the number of ranges, for as many groups of all stations."""
    cores = s.sparkSession.sparkContext.defaultParallelism
    rows = max(1, math.ceil(n_stations / READINGS), min(math.ceil(3 * cores / groups), math.ceil(n_stations / PANEL)))
    if rows > 1:
        s = s.withColumn("place", F.min(F.struct("z", "y", "x")).over(Window.partitionBy("obs_id")))
    return ranged(s, rows, "sb", "place", "obs_id").select("obs_id", *"xyz", "sb"), rows


def _spreading(groups: int, t: DataFrame, *keys: str) -> DataFrame:
    return t.repartition(min(8 * groups, 64 * t.sparkSession.sparkContext.defaultParallelism), *keys)


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _places(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(n).to_numpy() for n in "xyz"], 1)


def _side(right: pa.Table, here: np.ndarray, kernel: Callable) -> tuple[np.ndarray, np.ndarray, Callable]:
    """Layers of the rows here, whether each has a volume, and their sums at stations."""
    layers, volume = right.column("layer").to_numpy(), right.column("volume").fill_null(0.0).to_numpy()
    ids = np.unique(layers[here])
    take = here & right.column("volume").is_valid().to_numpy()
    index = np.searchsorted(ids, layers[take])
    return ids, np.isin(np.arange(len(ids)), index), layer_sums(_places(right)[take], volume[take], index, len(ids), kernel)


def _panels(left: pa.Table, sides: list[tuple[np.ndarray, np.ndarray, Callable]]) -> Iterator[list[np.ndarray]]:
    """The h of PANEL readings after the other, a matrix a side."""
    xyz = _places(left)
    order = np.lexsort(xyz.T)
    codes = left.column("obs_id").combine_chunks().take(pa.array(order)).dictionary_encode().indices.to_numpy()
    order, codes = order[np.argsort(codes, kind="stable")], np.sort(codes)
    xyz = xyz[order]
    ends = np.searchsorted(codes, np.arange(0, codes[-1] + 1 + PANEL, PANEL))
    for first, (start, end) in zip(range(0, codes[-1] + 1, PANEL), zip(ends[:-1], ends[1:], strict=True), strict=True):
        panels = []
        for ids, _, of in sides:
            h = np.zeros((int(codes[end - 1]) + 1 - first, len(ids)))
            for k in range(start, end, PANEL):
                to = min(end, k + PANEL)
                part = of(xyz[k:to])
                if len(np.unique(codes[k:to])) == to - k:
                    h[codes[k:to] - first] += part
                else:
                    np.add.at(h, codes[k:to] - first, part)
            panels.append(h)
        yield panels


def _slabs(a: int, b: int, left: tuple, right: tuple, sums: Callable[[slice, int], np.ndarray]) -> pa.Table:
    """Rows of SLAB layers each with those of the other block, of one block with those that follow."""
    made: dict[str, list] = {n: [] for n in ("a", "b", "slab", "i", "j", "oki", "okj", "sums")}
    (i, oki), (j, okj) = left, right
    for k in range(0, len(i), SLAB):
        here, start = slice(k, k + SLAB), k if a == b else 0
        for n, value in zip(made, (a, b, k, i[here].tobytes(), j[start:].tobytes(), oki[here].tobytes(), okj[start:].tobytes(), sums(here, start).tobytes()), strict=True):
            made[n].append(value)
    kinds = [pa.int32()] * 3 + [pa.binary()] * 5
    return pa.table([pa.array(v, t) for v, t in zip(made.values(), kinds, strict=True)], list(made))


def _products(s: DataFrame, c: DataFrame, n_stations: int, n_layers: int, kernel: Callable) -> DataFrame:
    """Slabs of the sums of h_i h_j over all readings."""
    blocks = max(1, math.ceil(n_layers / LAYERS))
    n_pairs = blocks * (blocks + 1) // 2
    s, rows = _dealt(s, n_stations, n_pairs)
    s = s.withColumn("a", _every(blocks)).withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(blocks - 1))))
    c = c.withColumn("own", F.pmod(F.xxhash64("layer"), F.lit(blocks)).cast("int")).withColumn("other", _every(blocks)).withColumn("sb", _every(rows))
    c = c.select(*"xyz", "volume", "layer", "own", "sb", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    keys = ["sb", "a", "b"]
    s, c = (_spreading(rows * n_pairs, t, *keys) for t in (s, c))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        _, a, b = (k.as_py() for k in key)
        if not len(left) or not len(right):
            return _slabs(a, b, (np.empty(0), np.empty(0)), (np.empty(0), np.empty(0)), lambda here, start: np.empty(0))
        own = right.column("own").to_numpy()
        sides = [_side(right, own == block, kernel) for block in dict.fromkeys((a, b))]
        total = np.zeros((len(sides[0][0]), len(sides[-1][0])))
        for panels in _panels(left, sides):
            total += panels[0].T @ panels[-1]
        return _slabs(a, b, sides[0][:2], sides[-1][:2], lambda here, start: total[here, start:])

    def added(slabs: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), float) for x in slabs.column("sums"))
        return slabs.slice(0, 1).set_column(7, "sums", pa.array([total.tobytes()], pa.binary()))

    met = s.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(meet, _SUMS)
    return met.groupBy("a", "b", "slab").applyInArrow(added, _SUMS) if rows > 1 else met


def _told(slabs: DataFrame, noise: float) -> DataFrame:
    """(i, j, lambda) of slabs, both orders of two layers."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                a, b = batch.column("a")[k], batch.column("b")[k]
                i, j, oki, okj, total = (np.frombuffer(batch.column(n)[k].as_buffer(), t) for n, t in (("i", np.int64), ("j", np.int64), ("oki", bool), ("okj", bool), ("sums", float)))
                total, ok = total.reshape(len(i), len(j)) / noise, oki[:, None] & okj[None]
                mirrored = slice(len(i) if a == b else 0, None)
                for left, right, v, good in ((np.repeat(i, len(j)), np.tile(j, len(i)), total, ok), (np.tile(j[mirrored], len(i)), np.repeat(i, len(j[mirrored])), total[:, mirrored], ok[:, mirrored])):
                    yield pa.record_batch([left, right, pa.array(v.ravel(), mask=~good.ravel())], ["i", "j", "lambda"])

    return slabs.mapInArrow(told, "i long, j long, lambda double")


def _chosen(s: DataFrame, c: DataFrame, n_stations: int, blocks: int, kernel: Callable) -> DataFrame:
    """Of each block of layers those chosen whose h make up all others', and the weights."""
    s, rows = _dealt(s, n_stations, blocks)
    s, c = (_spreading(rows * blocks, t, "sb", "a") for t in (s.withColumn("a", _every(blocks)), c.withColumn("sb", _every(rows))))

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        made: list[list] = [[], [], [], []]
        if len(left) and len(right):
            side = _side(right, np.ones(len(right), bool), kernel)
            rows: list[np.ndarray] | None = []
            for (h,) in _panels(left, [side]):
                h = h if len(h) < DRAWN else reduced(h)
                rows = None if h is None else [*rows, h]
                if rows and sum(map(len, rows)) > PANEL:
                    rows = [reduced(np.concatenate(rows))]
                if rows is None or rows[0] is None:
                    rows = None
                    break
            value = (key[1].as_py(), side[0].tobytes(), side[1].tobytes(), None if rows is None else np.concatenate(rows).tobytes())
            made = [[v] for v in value]
        return pa.table([pa.array(v, t) for v, t in zip(made, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["a", "ids", "ok", "rows"])

    def choose(found: pa.Table) -> pa.Table:
        ids = np.frombuffer(found.column("ids")[0].as_buffer(), np.int64)
        at, weights = np.arange(len(ids)), np.eye(len(ids))
        if not found.column("rows").null_count:
            rows = np.concatenate([np.frombuffer(x.as_buffer()).reshape(-1, len(ids)) for x in found.column("rows")])
            rows = rows if 2 * len(rows) < len(ids) else reduced(rows)
            if rows is not None and np.isfinite(rows).all():
                at, weights = skeleton(rows)
        return found.slice(0, 1).select(["a", "ids", "ok"]).append_column("chosen", pa.array([ids[at]], pa.list_(pa.int64()))).append_column("weights", pa.array([weights.tobytes()], pa.binary()))

    met = s.groupBy("sb", "a").cogroup(c.groupBy("sb", "a")).applyInArrow(look, "a int, ids binary, ok binary, rows binary")
    return met.groupBy("a").applyInArrow(choose, "a int, ids binary, ok binary, chosen array<long>, weights binary")


def _spread(among: DataFrame, chosen: DataFrame, blocks: int) -> DataFrame:
    """Slabs of the sums of all layers from those among the chosen."""
    two = chosen.withColumn("other", _every(blocks)).withColumnRenamed("a", "own").withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other")
    among, two = (_spreading(blocks * (blocks + 1) // 2, t, "a", "b") for t in (among, two))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (k.as_py() for k in key)
        sides = {}
        for k in range(len(right)):
            ids, ok, weights = (np.frombuffer(right.column(n)[k].as_buffer(), t) for n, t in (("ids", np.int64), ("ok", bool), ("weights", float)))
            few = np.array(right.column("chosen")[k].as_py(), np.int64)
            sides[right.column("own")[k].as_py()] = ids, ok, weights.reshape(len(few), len(ids)), np.argsort(few), np.sort(few)
        if a not in sides or b not in sides:
            return _slabs(a, b, (np.empty(0), np.empty(0)), (np.empty(0), np.empty(0)), lambda here, start: np.empty(0))
        (*i, over_i, rank_i, few_i), (*j, over_j, rank_j, few_j) = sides[a], sides[b]
        sums = np.zeros((len(few_i), len(few_j)))
        at = [rank[np.searchsorted(few, left.column(n).to_numpy())] for n, rank, few in (("i", rank_i, few_i), ("j", rank_j, few_j))]
        sums[tuple(at)] = left.column("lambda").to_numpy()
        half = over_i.T @ sums
        return _slabs(a, b, i, j, lambda here, start: half[here] @ over_j[:, start:])

    return among.groupBy("a", "b").cogroup(two.groupBy("a", "b")).applyInArrow(meet, _SUMS)


def depth_weights(cells: DataFrame, z0: float, nu: float = 3.0, eps: float | None = None) -> DataFrame:
    """cells with weight (abs(z - z0) + eps)^(-nu/2) over its maximum; eps is half the least spacing of levels."""
    levels = cells.select(F.round("z", 6).alias("level")).distinct().withColumn("gap", F.lead("level").over(Window.partitionBy(F.lit(1)).orderBy("level")) - F.col("level"))
    half = levels.agg(F.coalesce(0.5 * F.min("gap"), F.lit(0.5)).alias("eps"))
    base = cells.crossJoin(F.broadcast(half)) if eps is None else cells.withColumn("eps", F.lit(eps))
    raw = base.withColumn("w", F.pow(F.abs(F.col("z") - z0) + F.col("eps"), -nu / 2.0))
    top = raw.agg(F.max("w").alias("top"))
    return raw.crossJoin(F.broadcast(top)).withColumn("weight", F.col("w") / F.col("top")).drop("w", "top", "eps")


def near(left: DataFrame, right: DataFrame, radius: float, axes: str = "xyz", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b, distance) of cell ids within a distance, with columns of the right; boxes of the radius' size meet by equality.

    A box is repeated for its neighbours. The planner takes the repeated rows for no more than the table itself and
    would send them to all machines by way of the driver, so the join is by sorting.
    """
    box = [F.floor(F.col(c) / radius).alias(f"b{c}") for c in axes]
    own = left.select(F.col("cell_id").alias("a"), *[F.col(c).alias(f"a{c}") for c in axes], *box)
    other = right.select(F.col("cell_id").alias("b"), *[F.col(c).alias(f"o{c}") for c in axes], *box, *[F.col(c).alias(f"_{c}") for c in keep])
    for c in axes:
        own = own.withColumn(f"b{c}", F.explode(F.array(*[F.col(f"b{c}") + k for k in (-1, 0, 1)])))
    square = sum(((F.col(f"a{c}") - F.col(f"o{c}")) * (F.col(f"a{c}") - F.col(f"o{c}")) for c in axes), F.lit(0.0))
    met = own.join(other.hint("merge"), [f"b{c}" for c in axes]).withColumn("distance", F.sqrt(square)).filter(F.col("distance") <= radius)
    return met.select("a", "b", "distance", *[F.col(f"_{c}").alias(c) for c in keep])


def tiles(cells: DataFrame, radius: float, value: str) -> DataFrame:
    """A tile per cell: its members' number and mean."""
    members = near(cells, cells.withColumn("v", F.col(value)), radius, keep=("v",))
    return members.groupBy(F.col("a").alias("tile")).agg(F.count("*").alias("members"), F.avg("v").alias("mean"))


def nearest(points: DataFrame, cells: DataFrame) -> DataFrame:
    """For each station the nearest cell, the smaller id of ties; by a tree of boxes."""
    return search.nearest(points, cells).drop("rank")


def top_tiles(points: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """The k nearest cells of each station, ranked; by a tree of boxes."""
    return search.nearest(points, cells, k)


def prior(cells: DataFrame, sd: float = 1.0) -> DataFrame:
    """(i, mean, variance) of an independent Gaussian belief about each cell."""
    return cells.select(F.col("cell_id").alias("i"), F.lit(0.0).alias("mean"), F.lit(float(sd) ** 2).alias("variance"))


def tile_readings(keys: DataFrame, cells: DataFrame, radius: float, value: str, fidelity: str = "coarse", sd: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Evidence (name, row, i, h, r) and readings (name, row, y) of the tiles whose centres are keys' cell_id.

    coarse reads a tile's mean (deviation 1 by default), fine each of its cells (0.05). A tile asked for twice is read once.
    """
    if fidelity not in ("coarse", "fine"):
        raise ValueError("fidelity must be coarse or fine")
    centres = cells.join(keys.select("cell_id").distinct(), "cell_id", "left_semi")
    members = near(centres, cells.withColumn("v", F.col(value)), radius, keep=("v",))
    r = F.lit(float((1.0 if fidelity == "coarse" else 0.05) if sd is None else sd) ** 2).alias("r")
    if fidelity == "fine":
        rows = members.select(F.lit("raw").alias("name"), F.concat_ws(":", "a", "b").alias("row"), F.col("b").alias("i"), F.lit(1.0).alias("h"), r, F.col("v").alias("y"))
        return rows.drop("y"), rows.select("name", "row", "y")
    means = members.groupBy("a").agg(F.avg("v").alias("y"), F.count("*").alias("n"))
    named = [F.lit("mean").alias("name"), F.col("a").cast("string").alias("row")]
    return members.join(means, "a").select(*named, F.col("b").alias("i"), (1.0 / F.col("n")).alias("h"), r), means.select(*named, "y")


def ray_lengths(rays: DataFrame, shape: tuple[int, int], spacing: float, points: int = 64) -> DataFrame:
    """rays (ray, x0, y0, x1, y1) to (ray, cell, length): points along a ray, each in its nearest cell."""
    k = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    t = F.col("k") / float(points - 1)
    length = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0"))) / float(points - 1)

    def cell(axis: str, n: int) -> Column:
        at = (F.col(f"{axis}0") + (F.col(f"{axis}1") - F.col(f"{axis}0")) * t) / spacing
        return F.greatest(F.least(F.rint(at), F.lit(float(n - 1))), F.lit(0.0)).cast("long")

    walked = rays.withColumn("length", length).select("*", k)
    return walked.groupBy("ray", (cell("x", shape[0]) * shape[1] + cell("y", shape[1])).alias("cell")).agg((F.count("*") * F.first("length")).alias("length"))


def boundary_nodes(triangles: DataFrame) -> DataFrame:
    """Nodes of edges that belong to one triangle only."""
    edges = triangles.select(F.explode(F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("n1", "n2"), ("n2", "n3"), ("n3", "n1"))])).alias("e"))
    rim = edges.groupBy("e").agg(F.count("*").alias("n")).filter("n = 1")
    return rim.select(F.explode(F.array("e.a", "e.b")).alias("node")).distinct()


def fem_stiffness(nodes: DataFrame, triangles: DataFrame) -> DataFrame:
    """(r, c, v) of linear triangles: assembly is an aggregation; triangles without area count for nothing."""
    t = triangles
    for k in (1, 2, 3):
        t = t.join(nodes.select(F.col("node").alias(f"n{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), f"n{k}")
    area = 0.5 * ((F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    t = t.withColumn("area", F.abs(area)).filter("area >= 1e-14")
    others = {1: (2, 3), 2: (3, 1), 3: (1, 2)}
    b = {k: F.col(f"y{i}") - F.col(f"y{j}") for k, (i, j) in others.items()}
    c = {k: F.col(f"x{j}") - F.col(f"x{i}") for k, (i, j) in others.items()}
    entry = F.array(*[F.struct(F.col(f"n{i}").alias("r"), F.col(f"n{j}").alias("c"), (F.col("kappa") * (b[i] * b[j] + c[i] * c[j]) / (4.0 * F.col("area"))).alias("v")) for i in (1, 2, 3) for j in (1, 2, 3)])
    return t.select(F.explode(entry).alias("e")).groupBy("e.r", "e.c").agg(F.sum("e.v").alias("v"))


def direction(inclination: float, declination: float) -> tuple[float, float, float]:
    i, d = math.radians(inclination), math.radians(declination)
    return math.cos(i) * math.sin(d), math.cos(i) * math.cos(d), -math.sin(i)
