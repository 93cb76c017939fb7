"""Near copies among vectors by a subspace pigeonhole join.

Unit vectors of cosine c or more lie within a squared distance of 2 - 2c. All are
turned by one fixed rotation and their dimensions split into blocks. Each block has
the share of that budget that its dimensions have of all, so a pair within the budget
is within the share of at least one block. A block is range-joined on a grid of its
first dimensions: a vector stands in its own cell and probes the cells above it that
its range meets. A cell's rows are compared in tiles of bounded size; a pair counts in
the first block that has it within its share, so that the union of the candidates is
counted once without a row per pair, and every candidate is verified by its whole cosine.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtally.llm.common import written
from helixtally.llm.components import components

COSINE = 0.98
BLOCK_DIMS = 8
TILE = 2048  # rows of one side of a comparison
CELL_ROWS = 1024  # rows a cell should hold; decides how many dimensions the grid has
_BITS, _MIDDLE = 4, 8  # of a cell's place in one dimension
_PIECE = 1 << 15  # linked pairs whose blocks are looked at at once
_SLACK = 1e-9


_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    if dims not in _ROTATIONS:
        _ROTATIONS[dims] = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]
    return _ROTATIONS[dims]


def blocks_of(dims: int) -> list[slice]:
    """The blocks' dimensions: about BLOCK_DIMS each, differing by one at most."""
    stops = np.linspace(0, dims, max(1, dims // BLOCK_DIMS) + 1).round().astype(int)
    return [slice(a, z) for a, z in itertools.pairwise(stops.tolist())]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; the same for a row wherever it stands."""
    out = vectors.astype(np.float64)
    out /= np.abs(out).max(1, keepdims=True)
    squares = np.zeros(len(out))
    for k in range(out.shape[1]):
        squares += out[:, k] * out[:, k]
    return out / np.sqrt(squares)[:, None]


def turned(units: np.ndarray) -> np.ndarray:
    """Rotated rows; sums run in one order, so that all tasks get the same numbers for a vector."""
    matrix, out = rotation(units.shape[1]), np.zeros_like(units)
    for k, row in enumerate(matrix):
        out += units[:, k, None] * row
    return out


def _cells(places: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, cell and role (0 own, 1 probe) of the cells that rows of one block stand in or probe above."""
    to_cell = lambda x: np.clip(np.floor(x / (2 * reach)).astype(np.int64) + _MIDDLE, 0, 2 * _MIDDLE - 1)
    join = lambda cells: functools.reduce(lambda a, c: a << _BITS | c, cells.T, np.zeros(len(cells), np.int64))
    own = join(to_cell(places))
    low, high = to_cell(places - reach), to_cell(places + reach)  # they differ by one at most, but for rounding
    wide = int((high - low).max(initial=0)) + 1
    rows, cells, roles = [np.arange(len(own))], [own], [np.zeros(len(own), np.int8)]
    for step in itertools.product(range(wide), repeat=places.shape[1]):
        at = low + np.array(step)
        cell = join(at)
        probes = np.flatnonzero((at <= high).all(1) & (cell > own))
        rows.append(probes)
        cells.append(cell[probes])
        roles.append(np.ones(len(probes), np.int8))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(roles)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _classes(vectors: DataFrame, double: bool) -> tuple[DataFrame, DataFrame]:
    """(vec_id, node) per row, node null where nothing can link; and (node, label, dims, body, copies, first) per distinct vector."""
    kind, arrow = (np.float64, pa.float64()) if double else (np.float32, pa.float32())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bodies = []
            for item in part.column(2).cast(pa.list_(arrow)):
                values = item.values
                one = None if values is None or values.null_count or not len(values) else values.to_numpy(zero_copy_only=False)
                bodies.append(one.astype(kind).tobytes() if one is not None and np.isfinite(one).all() and one.any() else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bodies, pa.binary())], ["vec_id", "label", "body"])

    chosen = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"), F.col("embedding").cast(f"array<{'double' if double else 'float'}>"))
    rows = chosen.mapInArrow(batches, "vec_id bigint, label string, body binary")
    node = F.when(F.col("label").isNotNull() & F.col("body").isNotNull(), F.xxhash64("label", "body"))
    rows = written(rows.withColumn("node", node), "vectors")
    linking = rows.where("node IS NOT NULL").groupBy("node", "label", "body").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    return rows.select("vec_id", "node"), written(linking.withColumn("dims", F.octet_length("body") / (8 if double else 4)), "distinct")


def _records(classes: DataFrame, axes: int, budget: float, kind: type, bodies: bool) -> DataFrame:
    """(label, dims, block, cell, role, node, copies, body) for all cells in which a class takes part; body only if asked for."""
    fields = "label string, dims int, block int, cell bigint, role tinyint, node bigint, copies bigint" + ", body binary" * bodies
    names = [f.split()[0] for f in fields.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = part.column(1).to_numpy()
            for dims in np.unique(sizes):
                some = part.filter(pa.array(sizes == dims))
                places = turned(unit(_matrix(some.column(4), kind)))
                for number, block in enumerate(blocks_of(int(dims))):
                    inside = places[:, block][:, :axes]
                    reach = np.sqrt(budget * (block.stop - block.start) / dims) + _SLACK
                    rows, cells, roles = _cells(inside, reach)
                    taken = some.take(pa.array(rows))
                    columns = [taken.column(0), pa.array(np.full(len(rows), dims, np.int32)), pa.array(np.full(len(rows), number, np.int32))]
                    columns += [pa.array(cells), pa.array(roles), taken.column(2), taken.column(3), *([taken.column(4)] * bodies)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return classes.select("label", F.col("dims").cast("int"), "node", "copies", "body").mapInArrow(batches, fields)


def _first_here(one: np.ndarray, two: np.ndarray, dims: int, block: int, budget: float) -> np.ndarray:
    """Whether `block` is the first whose share of the budget holds each pair of turned rows."""
    out = np.ones(len(one), np.bool_)
    for number, part in enumerate(blocks_of(dims)[: block + 1]):
        apart = np.zeros(len(one))
        for k in range(part.start, part.stop):
            apart += (one[:, k] - two[:, k]) ** 2
        within = apart <= budget * (part.stop - part.start) / dims + _SLACK
        out &= within if number == block else ~within
    return out


def _tile(rows: pa.Table, cosine: float, kind: type) -> pa.Table:
    """Per class of one tile that has links: other vectors linked here, and the least place of its links' component."""
    dims, block, a, b = (rows.column(c)[0].as_py() for c in ("dims", "block", "a", "b"))
    rows = rows.sort_by("node")
    units = unit(_matrix(rows.column("body").combine_chunks(), kind))
    places, own, part = turned(units), rows.column("role").to_numpy() == 0, rows.column("chunk").to_numpy()
    nodes, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
    left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)
    budget = 2 - 2 * cosine
    found, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for at in range(0, len(left), 512):
        some = left[at : at + 512]
        alike = (units[some] @ units[right].T >= cosine) & (own[some][:, None] | own[right])
        if a == b:
            alike &= some[:, None] < right
        i, j = np.nonzero(alike)
        i, j = some[i], right[j]
        for piece in range(0, len(i), _PIECE):
            x, y = i[piece : piece + _PIECE], j[piece : piece + _PIECE]
            keep = _first_here(places[x], places[y], dims, block, budget)
            x, y = x[keep], y[keep]
            np.add.at(found, x, copies[y])
            np.add.at(found, y, copies[x])
            while (root[x] != root[y]).any():  # a root is the least place of what is joined so far
                least = np.minimum(root[x], root[y])
                np.minimum.at(root, root[x], least)
                np.minimum.at(root, root[y], least)
                while (root[root] != root).any():
                    root = root[root]
    linked = np.flatnonzero(found)
    return pa.table({"node": nodes[linked], "n": found[linked], "near": nodes[root[linked]]})


def links(classes: DataFrame, cosine: float, double: bool) -> DataFrame:
    """(node, n, near): per class and tile, how many other vectors link with it there, and a class it is joined with."""
    kind, budget = np.float64 if double else np.float32, 2 - 2 * cosine
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    axes = int(np.clip(np.ceil(np.log(max(1, most / CELL_ROWS)) / np.log(4)), 1, BLOCK_DIMS))
    place = ["label", "dims", "block", "cell"]
    full = _records(classes, axes, budget, kind, False).groupBy(*place).count().where(F.col("count") > TILE)
    full = written(full.select(*place, F.ceil(F.col("count") / TILE).cast("int").alias("chunks")), "full")
    rows = _records(classes, axes, budget, kind, True).join(full, place, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = rows.withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other")).drop("chunks", "other")
    return tiles.groupBy(*place, "a", "b").applyInArrow(lambda t: _tile(t, cosine, kind), "node bigint, n bigint, near bigint")


def near_copies(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null and their cosine, in double
    precision, is `cosine` or more. A vector that is null, empty or zero, or holds a null
    or a number that isn't finite, links with nothing, nor do vectors of different length.
    Repeated rows are vectors of their own that link with each other. component_id is the
    smallest vec_id reachable; rows with a null vec_id take part and lend no id, and
    kept is false for them. Other columns are not read.
    """
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    double = element not in ("float", "byte", "short")
    rows, classes = _classes(vectors, double)
    found = written(links(classes, cosine, double), "found")
    edges = found.where("node <> near").select(F.col("node").alias("u"), F.col("near").alias("v"))
    sums = found.groupBy("node").agg(F.sum("n").alias("n"))
    known = classes.select("node", "copies", "first").join(sums, "node", "left").join(components(edges), "node", "left")
    known = written(known.select("node", "first", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "known")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(least, "root").select("node", "n_links", "component_id")
    out = rows.where("node IS NOT NULL").join(named, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("node IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
