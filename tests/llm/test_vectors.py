"""The operators on embeddings against their brute-force versions, on the small tables and on odd ones."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from linkwright.llm import centroids, lattice, queries, vantage

from . import brute

KIND = pa.list_(pa.float32())


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Nulls, empty, zero, huge, uneven and non-finite vectors, ties, copies, near copies, and clashing columns."""
    folder = tmp_path_factory.mktemp("odd_vectors")
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 64)).astype(np.float32)
    near = (base[0] + 0.1 * rng.normal(size=(40, 64))).astype(np.float32)
    vectors = [None, [], [0.0] * 64, [-0.0] * 64, [math.nan] + [1.0] * 63, [math.inf] * 64, [None] + [1.0] * 63, [1.0] * 3, [1.0, 1.0, 1.1], [3e38] * 64, [-2e18] * 64, [1e-42] * 64]
    vectors += [*base.tolist(), *near.tolist(), *base[:10].tolist(), *(2 * base[:5]).tolist(), *[base[1].tolist()] * 30]
    ids = list(range(0, 10 * len(vectors), 10))
    labels = [k % 3 for k in range(len(vectors))]
    ids[20], ids[21], ids[75], labels[30], labels[31] = None, None, None, None, 9
    vectors, ids, labels = vectors + vectors[40:50], ids + ids[40:50], labels + labels[40:50]
    n = len(ids)
    clash = {"Cluster": ["x"] * n, "q": [1] * n, "node": [1] * n, "h": [1] * n, "N_links": [{"a": 1}] * n, "ask": [0.5] * n, "anchor": ["a"] * n}
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, KIND), "label": pa.array(labels, pa.int32())} | clash), folder / "embeddings.parquet")
    return str(folder)


@pytest.fixture(params=["tables", "odd"])
def folder(request, sf):
    return sf if request.param == "tables" else request.getfixturevalue("odd")


def rows_of(folder):
    t = pq.read_table(f"{folder}/embeddings.parquet")
    return list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), t["label"].to_pylist(), strict=True))


def found(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


def test_clusters_are_exact(spark, folder):
    got = found(queries.op11_centroid_clusters(spark, folder), "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert got == Counter(brute.clusters([r[:2] for r in rows_of(folder)]))


def test_overlapping_intervals_are_settled_with_integers():
    """Distances that float32 cannot tell apart, and exact ties, which go to the smaller number."""
    rng = np.random.default_rng(5)
    c = rng.integers(-(1 << 26), 1 << 26, size=(12, 64))
    c[7] = c[3] + np.eye(64, dtype=np.int64)[0]
    c[9] = c[3]
    x = np.concatenate((c, c + rng.integers(-2, 3, size=c.shape), np.repeat(c[3:4], 5, axis=0)))
    best, far = centroids.nearest(x, c)
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert best.tolist() == every.argmin(axis=1).tolist() and far.tolist() == every.min(axis=1).tolist()
    assert 9 not in best.tolist()


def test_shortlist_is_short():
    """On ordinary vectors the screening leaves few rows to settle."""
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(size=(2000, 64)) / 8).astype(np.int64)
    c = x[:40].copy()
    asked = []
    real = np.lexsort
    np.lexsort = lambda keys: asked.append(len(keys[0])) or real(keys)
    try:
        best, _ = centroids.nearest(x, c)
    finally:
        np.lexsort = real
    assert best.tolist() == ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()
    assert sum(asked) < 100


def test_links_of_the_tables_and_of_odd_rows(spark, folder):
    got = found(queries.op12_embedding_dedup(spark, folder), "vec_id", "n_links", "component_id", "kept")
    assert got == Counter(brute.vector_links([r[:2] for r in rows_of(folder)]))


def pairs_at(cosine, n, dims=64, seed=7):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=(n, dims))
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(1 - cosine**2) * z


def test_recall_at_the_threshold_and_above(spark):
    """Pairs right above the threshold are the hardest; none below is linked."""
    for cosine, least in ((0.9501, 0.93), (0.98, 0.995), (0.9499, None)):
        a, b = pairs_at(cosine, 1500)
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate((a, b)))], "vec_id long, embedding array<double>")
        out = lattice.near_vectors(df).agg(F.sum("n_links").alias("n"), F.max("n_links").alias("most")).first()
        assert (out.n == 0) if least is None else (out.n >= 2 * least * 1500 and out.most == 1)


def test_a_hot_cell_in_blocks_gives_the_same_links(spark, tmp_path):
    rng = np.random.default_rng(8)
    center = rng.normal(size=64)
    vectors = (center + 0.09 * rng.normal(size=(300, 64))).tolist() + rng.normal(size=(100, 64)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(4)
    whole = found(lattice.near_vectors(df), "vec_id", "n_links", "component_id", "kept")
    split = found(lattice.near_vectors(df, cell_rows=40), "vec_id", "n_links", "component_id", "kept")
    assert whole == split and sum(r[1] for r in whole) > 50_000


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 8)) * 2
    point = lattice.nearest_point(x)
    near = lattice.neighbours()
    assert len(near) == 240 and np.allclose((near**2).sum(axis=1), 2)
    other = ((x[:, None, :] - point[:, None, :] - near[None]) ** 2).sum(axis=2)
    assert (((x - point) ** 2).sum(axis=1)[:, None] <= other + 1e-9).all() and (((x - point) ** 2).sum(axis=1) <= 1 + 1e-9).all()
    assert ((2 * point).sum(axis=1) % 4 == 0).all()


def test_negatives_are_exact(spark, folder):
    got = found(queries.op13_hard_negatives(spark, folder), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert got == Counter(brute.negatives(rows_of(folder)))
    assert got


def test_search_over_several_trees_shares_and_levels(spark, monkeypatch):
    """Small leaves, many trees, tasks with shares of them: the same rows as by brute force, with ties and a hot vector."""
    monkeypatch.setattr(vantage, "LEAF_ROWS", 8)
    rng = np.random.default_rng(10)
    centers = rng.normal(size=(6, 16))
    x = centers[rng.integers(0, 6, 900)] + 0.3 * rng.normal(size=(900, 16))
    x[300:600] = x[300]
    rows = [(k, v, int(c)) for k, (v, c) in enumerate(zip((x / 4).tolist(), rng.integers(0, 4, 900), strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    df = df.withColumn("label", F.when(F.expr("vec_id % 7 = 0"), (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = found(vantage.mine(df, F.expr("vec_id % 100 = 0")), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert got == Counter(brute.negatives(rows))


def test_a_tree_passes_over_leaves_outside_the_annulus(monkeypatch):
    """In vectors of few directions few leaves are visited; in random ones of 64 nearly all are, as distances are alike."""
    monkeypatch.setattr(vantage, "LEAF_ROWS", 16)
    rng = np.random.default_rng(11)
    x = np.floor(256 * (rng.normal(size=(1024, 2)) @ rng.normal(size=(2, 64)))).astype(np.int64)
    none = np.zeros(len(x), bool)
    tree = vantage.Tree.from_bytes(vantage.Tree(np.arange(len(x)), none, np.zeros(len(x), np.int64), x).to_bytes())
    q, free = x[:8], np.iinfo(np.int64)
    visited = []
    state = vantage.Search(q, np.zeros(8, np.int64), np.arange(8), np.full(8, free.min), np.full(8, free.max), True, 5)
    leaf = state.leaf
    state.leaf = lambda tree, n, at: visited.extend(at) or leaf(tree, n, at)
    state.visit(tree)
    score = x[:8] @ x.T
    score[np.arange(8), np.arange(8)] = free.min
    assert (np.sort(score, axis=1)[:, :-6:-1] == state.score).all()
    assert len(visited) < 8 * 64 / 4


@pytest.mark.parametrize("query", [queries.op11_centroid_clusters, queries.op12_embedding_dedup, queries.op13_hard_negatives])
def test_empty_tables(spark, sf, tmp_path, query):
    pq.write_table(pq.read_table(f"{sf}/embeddings.parquet").slice(0, 0), tmp_path / "embeddings.parquet")
    full = query(spark, sf).schema
    out = query(spark, str(tmp_path))
    assert out.count() == 0 and [f.name for f in out.schema] == [f.name for f in full]
