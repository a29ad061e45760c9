"""Operator 12, embedding near-dedup: lattice hashing with E8 cells, several tables and probes.

A table projects unit vectors onto ``blocks`` random orthogonal frames of 8 dimensions and decodes each to
its nearest point of the E8 lattice; the points together name the cell. A vector also stands in
the ``probes`` neighbouring cells that are nearest to it: cells where one block moves to one of the
240 lattice neighbours. Two vectors meet where any of their cells is the same, and there their cosine is
computed in double precision. A link is counted in the first cell that both share, so no pair is
listed anywhere: a task gives each vector's number of links in a cell and one neighbour, of
which components are made.

With the defaults a pair at a cosine of exactly 0.95 meets with probability 0.96 (0.99 at 0.97, above
0.999 at 0.98); pairs that never meet are not linked, and no pair below the threshold is. Nothing is capped.

Equal vectors are one node with a count, so copies make no pairs. A cell with more than ``cell_rows``
rows is split in blocks, and each pair of blocks is a group of its own. Vectors go once to each of their
cells, ``tables * (1 + probes)`` in all.

Defined cases: a vector that is null, empty or zero, or holds null or non-finite components, links with
nothing, and so do vectors of different lengths. Repeated rows, and rows of one vector and other ids,
link with one another. A row without an id has its component's smallest id, null if none of it has one; it is
kept where that is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import stored
from .common import checkpointed, with_hot_keys
from .simhash import components

#: Lattice units for a unit vector of 64 dimensions.
SPREAD = 4.0
ODD = 0x9E3779B97F4A7C15


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all of a half with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: of integers with an even sum, or of those moved by a half."""

    def even(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        gap = y - r
        odd = np.flatnonzero(r.sum(axis=1) % 2)
        worst = np.abs(gap[odd]).argmax(axis=1)
        r[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
        return r

    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


class Tables:
    """The random frames and hash numbers for vectors of one length; the same on all machines."""

    def __init__(self, dims: int, tables: int, blocks: int, probes: int):
        rng = np.random.default_rng(12)
        self.tables, self.blocks, self.probes = tables, blocks, probes
        wide = max(dims, 8 * blocks)
        self.frames = [np.linalg.qr(rng.normal(size=(wide, wide)))[0][:dims, : 8 * blocks] * (SPREAD * np.sqrt(wide / 64)) for _ in range(tables)]
        self.odd = rng.integers(0, 1 << 63, size=(tables, blocks, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = np.uint64(dims * ODD % (1 << 64))
        self.near = neighbours()

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The names of each row's cells in a table, its own first; a name is linear in the lattice point."""
        y = unit @ self.frames[table]
        name, gain, moved = np.full(len(y), self.salt), [], []
        for b in range(self.blocks):
            point = nearest_point(part := y[:, 8 * b : 8 * b + 8])
            hashed = self.odd[table, b]
            name += ((2 * point).astype(np.int64).astype(np.uint64) * hashed).sum(axis=1, dtype=np.uint64)
            gain.append((part - point) @ self.near.T)
            moved.append(((2 * self.near).astype(np.int64).astype(np.uint64) * hashed).sum(axis=1, dtype=np.uint64))
        if not self.probes:
            return name[:, None].view(np.int64)
        top = np.argpartition(-np.concatenate(gain, axis=1), self.probes - 1, axis=1)[:, : self.probes]
        return np.concatenate((name[:, None], name[:, None] + np.concatenate(moved)[top]), axis=1).view(np.int64)


@lru_cache(maxsize=8)
def tables_for(dims: int, tables: int, blocks: int, probes: int) -> Tables:
    return Tables(dims, tables, blocks, probes)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the rows' places, and their unit vectors in double precision."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dims)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dims)
        x /= np.abs(x).max(axis=1, keepdims=True)
        yield at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cell_rows_of(nodes: DataFrame, shape: tuple[int, int, int], with_vector: bool = True) -> DataFrame:
    """k (the table), v (the cell), and where asked node, n and vec, a row for each cell of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in by_length(batch.column("vec")):
                tables = tables_for(unit.shape[1], *shape)
                for k in range(shape[0]):
                    names = tables.cells(unit, k)
                    columns = [pa.array(np.full(names.size, k, np.int16)), pa.array(names.T.ravel())]
                    if with_vector:
                        rows = pa.array(np.tile(at, names.shape[1]))
                        columns += [batch.column(c).take(rows) for c in ("node", "n", "vec")]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "v", "node", "n", "vec"][: len(columns)])

    kind = nodes.schema["vec"].dataType.simpleString()
    return nodes.select("node", "n", "vec").mapInArrow(run, "k short, v long" + (f", node long, n long, vec {kind}" if with_vector else ""))


def shared_before(mine: np.ndarray, below: int | None = None) -> Iterator[np.ndarray]:
    """Parts of a table of which rows share which cells (of those named below): rows by cells, 0 or 1."""
    names, at, often = np.unique(mine, return_inverse=True, return_counts=True)
    at = at.reshape(mine.shape)
    use = often > 1 if below is None else (often > 1) & (names < below)
    place = np.cumsum(use) - 1
    for start in range(0, int(use.sum()), 1024):
        part = np.zeros((len(mine), min(1024, int(use.sum()) - start)), np.float32)
        for c in range(mine.shape[1]):
            inside = np.flatnonzero(use[at[:, c]] & (place[at[:, c]] >= start) & (place[at[:, c]] < start + part.shape[1]))
            part[inside, place[at[inside, c]] - start] = 1
        yield part


def links_of_cell(unit: np.ndarray, side: np.ndarray, table: int, name: int, tables: Tables, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in one cell: the linked ones, which pairs of them are linked, and which of these are counted here.

    ``side`` is 0 where the cell is whole, else 1 and 2 for its two blocks, of which only pairs across count.
    """
    near = np.empty((len(unit), len(unit)), bool)
    for i in range(0, len(unit), 1024):
        near[i : i + 1024] = unit[i : i + 1024] @ unit.T >= least
    if side.any():
        near &= side[:, None] != side
    np.fill_diagonal(near, False)
    at = np.flatnonzero(near.any(axis=1))
    near = near[np.ix_(at, at)]
    counted = near.copy()
    for k in range(table + 1 if len(at) else 0):
        for part in shared_before(tables.cells(unit[at], k), name if k == table else None):
            for i in range(0, len(at), 1024):
                counted[i : i + 1024] &= part[i : i + 1024] @ part.T == 0
    return at, near, counted


def roots(near: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] < 0:
            reached = np.zeros(len(near), bool)
            edge = np.array([i])
            while len(edge):
                reached[edge] = True
                edge = np.flatnonzero(near[edge].any(axis=0) & ~reached)
            root[reached] = i
    return root


def links(nodes: DataFrame, least: float, shape: tuple[int, int, int], cell_rows: int) -> DataFrame:
    """node, other, n_links: a row for each cell where a node has links, with the links counted there and one node it reaches."""
    counts = cell_rows_of(nodes, shape, with_vector=False).groupBy("k", "v").count().where(F.col("count") > cell_rows)
    hot = checkpointed(counts.select("k", "v", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts")))
    cells = cell_rows_of(nodes, shape)
    if hot.isEmpty():
        dealt = cells.withColumns({"own": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    else:
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        every = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = cells.join(hot, ["k", "v"], "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("with_", every)
        dealt = dealt.withColumns({"i": F.least("own", "with_"), "j": F.greatest("own", "with_")})
    group = ["k", "v", "i", "j"]
    sorted_ = dealt.select(*group, "own", "node", "n", "vec").repartition(*group).sortWithinPartitions(*group)

    def of_group(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        if rows.num_rows < 2:
            return
        k, v, i, j = (rows.column(c)[0].as_py() for c in range(4))
        own, node, n = (rows.column(c).to_numpy() for c in ("own", "node", "n"))
        for at, unit in by_length(rows.column("vec").chunk(0)):
            side = np.where(own[at] == i, 1, 2) if i != j else np.zeros(len(at), int)
            linked, near, counted = links_of_cell(unit, side, k, v, tables_for(unit.shape[1], *shape), least)
            if len(linked):
                mine = at[linked]
                sums = counted.astype(np.float64) @ n[mine].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(node[mine]), pa.array(node[mine[roots(near)]]), pa.array(sums.astype(np.int64))], names=["node", "other", "n_links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in range(4)]
            new = np.zeros(batch.num_rows, bool)
            for c in keys:
                new[1:] |= c[1:] != c[:-1]
            starts = np.array([0, *np.flatnonzero(new).tolist(), batch.num_rows])
            # A row alone in its cell has no links; the first and the last run may go on in another batch.
            alone = np.diff(starts) == 1
            alone[[0, -1]] = False
            for a, b in zip(starts[:-1][~alone].tolist(), starts[1:][~alone].tolist(), strict=True):
                here = tuple(int(c[a]) for c in keys) if b > a else None
                if here is not None and here != last and rest:
                    yield from of_group(pa.Table.from_batches(rest))
                    rest = []
                if here is not None:
                    rest.append(batch.slice(a, b - a))
                    last = here
        if rest:
            yield from of_group(pa.Table.from_batches(rest))

    return sorted_.mapInArrow(run, "node long, other long, n_links long")


def near_vectors(
    vectors: DataFrame, least: float = 0.95, tables: int = 3, blocks: int = 2, probes: int = 3, cell_rows: int = 2048, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """key, n_links (other vectors linked directly), component_id (the smallest key reachable), kept (key is that one), of each row."""
    v = F.col("vec")
    usable = F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    named = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).withColumn("usable", usable)
    # Two hashes of 64 bits with different seeds stand for the vector where rows meet their node.
    hashed = named.where("usable").withColumns({"h": F.xxhash64("vec"), "g": F.xxhash64(F.lit(12), "vec")})
    groups = hashed.groupBy("h", "g").agg(F.first("vec").alias("vec"), F.min("id").alias("least"), F.count("*").alias("n"))
    nodes = stored(groups.withColumn("node", F.monotonically_increasing_id()))
    found = stored(links(nodes, least, (tables, blocks, probes), cell_rows))
    root = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("near"))
    slim = nodes.select("h", "g", "least", "n", "node").join(root, "node", "left").join(counts, "node", "left")
    slim = checkpointed(slim.select("h", "g", "least", "n", F.coalesce("root", "node").alias("root"), (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    ids = slim.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_"))
    full = checkpointed(with_hot_keys(slim, checkpointed(ids), "root", slim.count()).select(F.struct("h", "g").alias("of"), "n_links", "component_id", F.col("n").alias("n_")))
    rows = stored(hashed.select("id", F.struct("h", "g").alias("of")))
    linked = with_hot_keys(rows, full, "of", rows.count()).select("id", "n_links", "component_id")
    alone = named.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
