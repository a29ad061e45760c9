"""Operator 11, centroid clustering: float32 screening with rigorous rounding-error intervals.

Vectors and centroids are integers. The square distance to centroid c is |x|^2 + (|c|^2 - 2 x.c), of
which the bracket alone decides. A float32 matrix product gives x.c with an error of at most
g |x| |c|, where g = n u / (1 - n u), u = 2^-24 and n the components plus two, in whatever order the
product is summed; so each bracket lies in a known interval. Centroids whose interval reaches below
the least upper end are the shortlist. A row with one of them has its nearest; the others' are
computed again with integers, equal ones going to the smaller number. Distances, sums and floors are exact.

A round is one pass over the vectors: tasks add up counts and sums of their rows for each centroid,
which Spark sums; the driver gets one number for each centroid and component. The vectors are written
once to the shared folder and never shuffled.

Defined cases: only vectors of ``dims`` components, none null or not finite, take part, and of those only
ones whose integers stay under 2^27 in size (components under 2^19), so that a distance fits 64 bits. A vector
without an id is never a first centroid while there are others. Repeated rows count as often as they
stand; equal ids are ordered by their vectors. With fewer vectors than centroids each is one; without any
the result is empty. An inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import stored
from .vectors import matrix, whole_numbers

LIMIT = 1 << 27


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the number of its nearest row of c, the smaller of equal ones, and the square distance."""
    n = x.shape[1] + 2
    u = 2.0**-24
    lengths = (c * c).sum(axis=1)
    size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)), np.sqrt(lengths.astype(np.float64))
    # The factor beyond 1 covers the roundings of these bounds themselves, in double precision.
    error = np.outer(size[0], size[1]) * (2 * n * u / (1 - n * u) * (1 + 1e-9)) + lengths * 2.0**-50 + 1e-3
    score = lengths - 2.0 * (x.astype(np.float32) @ c.T.astype(np.float32)).astype(np.float64)
    short = score - error <= (score + error).min(axis=1, keepdims=True)
    best = short.argmax(axis=1)
    rows = np.flatnonzero(short.sum(axis=1) > 1)
    if len(rows):
        at, which = np.nonzero(short[rows])
        far = ((x[rows[at]] - c[which]) ** 2).sum(axis=1)
        order = np.lexsort((which, far, at))
        first = np.concatenate(([True], at[order][1:] != at[order][:-1]))
        best[rows[at[order][first]]] = which[order][first]
    return best, ((x - c[best]) ** 2).sum(axis=1)


def totals(vectors: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """By (cluster, place): the sum of its vectors' component at the place; at -1 their number, at -2 their distances."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, far = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), [0] * k
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), dims)
                best, distance = nearest(x, centroids)
                of = (best == np.arange(k)[:, None]).astype(np.float64)
                sums += (of @ x.astype(np.float64)).astype(np.int64)  # below 2^53, so exact
                counts += of.sum(axis=1).astype(np.int64)
                for j in np.unique(best).tolist():
                    far[j] += sum(distance[best == j].tolist())
        met = np.flatnonzero(counts).tolist()
        rows = [(j, p, v) for j in met for p, v in enumerate([*sums[j].tolist(), int(counts[j]), far[j]])]
        place = [p if p < dims else dims - 1 - p for _, p, _ in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([j for j, _, _ in rows], pa.int32()), pa.array(place, pa.int32()), pa.array([Decimal(v) for _, _, v in rows], pa.decimal128(38, 0))],
            names=["cluster", "place", "total"],
        )

    found = vectors.select("q").mapInArrow(run, "cluster int, place int, total decimal(38,0)")
    summed = found.groupBy("cluster", "place").agg(F.sum("total").alias("total"))
    return {(r["cluster"], r["place"]): int(r["total"]) for r in summed.collect()}


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2:", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (the integers) of each vector that takes part.

    The first centroids are the k vectors of smallest SHA-256 of ``seed`` and the id, in that order.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_numbers(vector, LIMIT).alias("q"))
    kept = stored(rows.where(F.size("q") == dims))
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).asc_nulls_last()
    first = kept.orderBy(order, "q").limit(k).select("q").collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(len(first), dims)
    schema = f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<int>"
    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        found = totals(kept, centroids)
        for j in range(len(centroids)):
            if n := found.get((j, -1)):
                centroids[j] = [found[j, p] // n for p in range(dims)]
    found = totals(kept, centroids)
    inertia = [found.get((j, -2), 0) for j in range(len(centroids))]
    names = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])
    fits = [v if v < 1 << 63 else None for v in [*inertia, sum(inertia)]]
    each, whole, points = pa.array(fits[:-1], pa.int64()), fits[-1], pa.array(centroids.tolist(), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, distance = nearest(matrix(batch.column(1), dims), centroids)
                at = pa.array(best)
                columns = [batch.column(0), at.cast(pa.int32()), pa.array(distance), each.take(at), pa.array([whole] * len(best), pa.int64()), names.take(at), points.take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return kept.select("id", "q").mapInArrow(run, schema)
