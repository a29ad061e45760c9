"""Operator 13, hard-negative mining: vantage-point trees over norm-augmented vectors.

A row x of a block gets one more component, sqrt(M^2 - |x|^2) with M the largest norm of its block, and an
anchor a zero there, and its other components times s = M / |a|, so that it lies on the rows' sphere. Then
|a' - x'|^2 = 2 M^2 - 2 s a.x, so higher scores are nearer, and a window of scores is an annulus around
the anchor. A block's tree halves its rows by their distance to a vantage
point, level by level; each leaf knows the least and largest distance of its rows to each vantage point above it.
The triangle inequality bounds an anchor's distance to a leaf from both sides: leaves outside the
annulus are passed over, the others visited nearest first, until the next cannot hold a better row than
the k found. Scores themselves are exact integers; bounds have slack, so no row is lost.

Trees are built where their rows are read, and written to the shared folder. Anchors are dealt to tasks
in blocks; each block reads the trees' files, in shares if there are fewer blocks than cores, and keeps k
rows an anchor. The shares' rows are merged by rank. Neither side goes through the driver or is broadcast. First
runs the search for positives, rows of the anchor's label in any window; then that for negatives, rows of
other labels in the window of each (anchor, positive).

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part, and none whose
components reach 2^18 (integers of 2^26), beyond which scores times 90 may leave 64 bits. Shorter
vectors count as filled up with zeros. Every row is a row, so repeated ones take a rank each; a positive has another id
than its anchor. Rows without an id are no anchors, and come last among equal scores.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import Spool, stored
from .vectors import whole_numbers

LIMIT = 1 << 26
LEAF_ROWS = 256
TREE_ROWS = 1 << 14
NONE = np.iinfo(np.int64)


def padded(column: pa.Array) -> np.ndarray:
    """A list column's rows, filled up with zeros to the longest."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in double precision where no sum can reach 2^53, else with integers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Tree:
    """A block's rows, leaf by leaf, and for each leaf its ancestors and the distances to their vantage points."""

    def __init__(self, ids: np.ndarray, nameless: np.ndarray, labels: np.ndarray, x: np.ndarray):
        norms = (x.astype(np.float64) ** 2).sum(axis=1)
        self.top = float(norms.max(initial=0))
        lifted = np.concatenate((x, np.sqrt(np.maximum(self.top - norms, 0))[:, None]), axis=1)
        levels = max(0, int(np.ceil(np.log2(max(len(x), 1) / LEAF_ROWS))))
        parts = [np.arange(len(x))]
        points, above = [], [[]]
        for _ in range(levels):
            halves, under = [], []
            for rows, path in zip(parts, above, strict=True):
                far = np.sqrt(((lifted[rows] - lifted[rows].mean(axis=0)) ** 2).sum(axis=1))
                vantage = lifted[rows[far.argmax()]]
                away = np.sqrt(((lifted[rows] - vantage) ** 2).sum(axis=1))
                order = away.argsort(kind="stable")
                for half in np.array_split(order, 2):
                    halves.append(rows[half])
                    under.append([*path, (len(points), away[half].min(), away[half].max())])
                points.append(vantage)
            parts, above = halves, under
        parts = [p[np.lexsort((ids[p], nameless[p]))] for p in parts]
        order = np.concatenate(parts)
        self.ids, self.nameless, self.labels, self.x = ids[order], nameless[order], labels[order], x[order]
        self.starts = np.cumsum([0, *map(len, parts)])
        self.points = np.array(points).reshape(len(points), lifted.shape[1])
        paths = np.array(above, np.float64).reshape(len(parts), levels, 3)
        self.node, self.low, self.high = paths[..., 0].astype(np.int64), paths[..., 1], paths[..., 2]

    PARTS = ("top", "ids", "nameless", "labels", "x", "starts", "points", "node", "low", "high")

    def to_bytes(self) -> bytes:
        np.savez(out := io.BytesIO(), **{p: getattr(self, p) for p in self.PARTS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, body: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(body)) as held:
            for p in cls.PARTS:
                setattr(tree, p, held[p])
        return tree

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest score that each leaf can hold for each anchor."""
        own = (q.astype(np.float64) ** 2).sum(axis=1)[:, None]
        scale = np.sqrt(self.top / np.where(own > 0, own, 1))
        scale = np.where(scale > 0, scale, 1)
        own = own * scale**2
        d = min(q.shape[1], self.points.shape[1] - 1)
        inner = (q[:, :d].astype(np.float64) @ self.points[:, :d].T) * scale
        far = np.sqrt(np.maximum(own + (self.points**2).sum(axis=1) - 2 * inner, 0))[:, self.node]
        nearest = np.maximum(np.maximum(far - self.high, self.low - far), 0).max(axis=2, initial=0)
        farthest = (far + self.high).min(axis=2, initial=np.inf)
        slack = (own + self.top) * 1e-9 + 1
        return ((own + self.top - farthest**2) / 2 - slack) / scale, ((own + self.top - nearest**2) / 2 + slack) / scale


class Search:
    """The k best rows of each of a block of anchors, over any number of trees."""

    def __init__(self, q: np.ndarray, labels: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.q, self.labels, self.own, self.low, self.high, self.same, self.k = q, labels, own, low, high, same, k
        self.score = np.full((len(q), k), NONE.min)
        self.id, self.nameless = np.zeros((len(q), k), np.int64), np.zeros((len(q), k), bool)
        self.found = np.zeros(len(q), np.int64)

    def visit(self, tree: Tree) -> None:
        least, most = tree.bounds(self.q)
        order = (-most).argsort(axis=1, kind="stable")
        active = np.arange(len(self.q))
        for step in range(order.shape[1]):
            leaf = order[active, step]
            full = self.found[active] == self.k
            active = active[(most[active, leaf] >= self.low[active]) & ~(full & (most[active, leaf] < self.score[active, -1]))]
            if not len(active):
                return
            leaf = order[active, step]
            inside = least[active, leaf] <= self.high[active]
            met = [self.leaf(tree, n, active[inside & (leaf == n)]) for n in np.unique(leaf[inside]).tolist()]
            self.merge([np.concatenate(x) for x in zip(*met, strict=True)] if met else [])

    def leaf(self, tree: Tree, n: int, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The rows of a leaf that may be among the k best: anchor, score, id, and whether it has none."""
        a, b = int(tree.starts[n]), int(tree.starts[n + 1])
        score = products(self.q[at], tree.x[a:b])
        fits = (score >= np.maximum(self.low, np.where(self.found == self.k, self.score[:, -1], NONE.min))[at, None]) & (score <= self.high[at, None])
        fits &= (tree.labels[a:b] == self.labels[at, None]) == self.same
        if self.same:
            fits &= (tree.ids[a:b] != self.own[at, None]) | tree.nameless[a:b]
        if b - a > self.k:
            bar = np.partition(np.where(fits, score, NONE.min), b - a - self.k, axis=1)[:, b - a - self.k]
            fits &= score >= bar[:, None]
        i, j = np.nonzero(fits)
        return at[i], score[i, j], tree.ids[a:b][j], tree.nameless[a:b][j]

    def merge(self, met: list[np.ndarray]) -> None:
        if not met or not len(met[0]):
            return
        touched = np.unique(met[0])
        old, place = np.nonzero(np.arange(self.k) < self.found[touched, None])
        rows = [touched[old], *(x[touched][old, place] for x in (self.score, self.id, self.nameless))]
        at, score, ids, nameless = (np.concatenate(x) for x in zip(rows, met, strict=True))
        order = np.lexsort((ids, nameless, -score, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        chosen = order[rank < self.k]
        at, rank = at[rank < self.k], rank[rank < self.k]
        self.score[at, rank], self.id[at, rank], self.nameless[at, rank] = score[chosen], ids[chosen], nameless[chosen]
        self.found[touched] = np.bincount(at, minlength=len(self.q))[touched]


def plant(rows: DataFrame) -> Spool:
    """The trees of (id, label, q), each of a bounded number of rows, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def trees(last: bool) -> Iterator[pa.RecordBatch]:
            while sum(b.num_rows for b in held) >= (1 if last else TREE_ROWS):
                table = pa.Table.from_batches(held).combine_chunks()
                part, rest = table.slice(0, TREE_ROWS).combine_chunks(), table.slice(TREE_ROWS)
                held[:] = rest.to_batches()
                ids, labels, q = (part.column(c).chunk(0) for c in ("id", "label", "q"))
                tree = Tree(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), labels.to_numpy(), padded(q))
                yield pa.RecordBatch.from_arrays([pa.array([tree.to_bytes()], pa.binary())], names=["body"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from trees(False)
        yield from trees(True)

    return Spool(rows.select("id", "label", "q").mapInArrow(run, "body binary"), 1)


def search(asked: DataFrame, trees: Spool, k: int, same: bool, window: tuple[int, int] | None = None, block: int = 4096) -> DataFrame:
    """ask, rank, id, score: the k best rows for each row (ask, label, own, q, positive_score) of ``asked``, a stored table.

    ``same`` asks for rows of the label, else for others; ``window`` gives the least and largest hundredths of positive_score.
    """
    context = asked.sparkSession.sparkContext
    blocks = max(1, -(-asked.count() // block))
    shares = max(1, 2 * context.defaultParallelism // blocks)
    part = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    slots = asked.withColumn("part", part).withColumn("slot", F.pmod(F.xxhash64("ask"), F.lit(blocks)) * shares + F.col("part"))
    dealt = slots.repartition(blocks * shares, "slot").sortWithinPartitions("slot")

    def answer(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        ask, label, own, positive = (rows.column(c).fill_null(0).to_numpy() for c in ("ask", "label", "own", "positive_score"))
        low, high = np.full(len(ask), NONE.min), np.full(len(ask), NONE.max)
        if window:
            low, high = -((-window[0] * positive) // 100), window[1] * positive // 100
        state = Search(padded(rows.column("q").chunk(0)), label, own, low, high, same, k)
        for table in trees.tables(rows.column("part")[0].as_py(), shares):
            for body in table.column("body").to_pylist():
                state.visit(Tree.from_bytes(body))
        i, j = np.nonzero(np.arange(k) < state.found[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(ask[i]), pa.array(state.id[i, j], mask=state.nameless[i, j]), pa.array(state.score[i, j])], names=["ask", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slot = [], None
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and slots[a] != slot:
                        yield from answer(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(a, b - a))
                    slot = slots[a]
        if held:
            yield from answer(pa.Table.from_batches(held))

    found = dealt.select("slot", "part", "ask", "label", "own", "positive_score", "q").mapInArrow(run, "ask long, id long, score long")
    order = Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("ask", "rank", "id", "score")


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), key: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the columns of ``vectors``; ``window`` holds the hundredths of
    the positive's score that a negative's may have.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole_numbers(vector, LIMIT).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("label is not null and q is not null")
    trees = plant(rows)
    anchors = rows.where("anchor and id is not null").withColumn("ask", F.monotonically_increasing_id())
    anchors = stored(anchors.select("ask", "label", F.col("id").alias("own"), F.lit(None).cast("long").alias("positive_score"), "q"))
    best = search(anchors, trees, positives, True)
    pairs = best.select(F.col("ask").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    asked = anchors.drop("positive_score").withColumnRenamed("ask", "anchor").join(pairs, "anchor")
    asked = stored(asked.where("positive_score >= 0").select(F.monotonically_increasing_id().alias("ask"), "label", "own", "positive_id", "positive_score", "q"))
    found = search(asked, trees, negatives, False, window)
    named = asked.select("ask", F.col("own").alias("anchor_id"), "positive_id", "positive_score")
    return found.join(named, "ask").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
