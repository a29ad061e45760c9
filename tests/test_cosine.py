"""The exact cosine join against a comparison of all pairs, and how much of it is left out."""

import numpy as np
import pytest

from linkwright.operators import matching
from linkwright.operators.cosine import Block

WORDS = ["red", "oak", "lamp", "chair", "large", "small", "steel", "sony", "dell", "table", "desk", "light", "cable", "usb", "black", "white", "green", "set", "pro", "mini"]


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def made(kind, n, seed):
    rng = np.random.default_rng(seed)
    if kind == "words":
        return unit(matching.bag_of_words([" ".join(rng.choice(WORDS, rng.integers(0, 9))) + f" m{rng.integers(0, 400)} x{rng.integers(0, 400)}" for _ in range(n)]))
    if kind == "vocabulary":
        x = np.zeros((n, 900))
        for row in x:
            row[(900 * rng.random(rng.integers(1, 14)) ** 3).astype(int)] += rng.integers(1, 3)
        return unit(x)
    if kind == "signed":
        return unit(rng.normal(size=(n, 40)) * (rng.random((n, 40)) < 0.15))
    if kind == "groups":
        centres = rng.normal(size=(20, 24))
        return unit(np.random.default_rng(1).normal(size=(20, 24))[rng.integers(0, 20, n)] + 0.15 * centres[rng.integers(0, 20, n)])
    return unit(rng.normal(size=(n, 24)))


@pytest.mark.parametrize("kind", ["words", "vocabulary", "signed", "groups", "dense"])
@pytest.mark.parametrize("least", [0.0, 0.5, 0.6, 0.75, 0.9, 0.95])
@pytest.mark.parametrize("indexed", [None, True, False])
def test_equal_to_all_pairs(kind, least, indexed):
    x, y = made(kind, 400, 2), made(kind, 600, 3)
    y[:40] = x[:40]
    block = Block(x, least, indexed)
    got = [p for r, c, _ in block.pairs(y) for p in zip(r.tolist(), c.tolist(), strict=True)]
    every = y @ x.T
    sure = set(map(tuple, np.argwhere(every >= least + 1e-9).tolist()))
    assert len(got) == len(set(got)) and sure <= set(got) <= set(map(tuple, np.argwhere(every >= least - 2e-9).tolist()))


@pytest.mark.parametrize("kind,least,most", [("words", 0.9, 0.05), ("vocabulary", 0.9, 0.01), ("vocabulary", 0.6, 0.05), ("signed", 0.9, 0.05), ("groups", 0.95, 0.25)])
def test_few_pairs_are_verified(kind, least, most):
    x, y = made(kind, 2000, 4), made(kind, 2000, 5)
    block = Block(x, least, True)
    for _ in block.pairs(y):
        pass
    assert block.verified < most * len(x) * len(y)


def test_zero_vectors_and_empty_sides():
    zero = np.zeros((3, 5))
    for least in (0.0, 0.5):
        for x, y in ((zero, zero), (np.zeros((0, 5)), zero), (zero, np.zeros((0, 5)))):
            found = sum(len(r) for r, _, _ in Block(x, least).pairs(y))
            assert found == (len(x) * len(y) if least == 0 else 0)


def test_similar_over_many_blocks_plans_no_cartesian_product(spark):
    x, y = made("words", 300, 6), made("words", 500, 7)
    left = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "left_key long, left_vec array<double>").repartition(3)
    right = spark.createDataFrame([(k, v) for k, v in enumerate(y.tolist())], "right_key long, right_vec array<double>").repartition(3)
    every = np.round(np.clip(x @ y.T, 0, 1), 4) >= 0.7
    for block_bytes in (1, 20_000, 64 << 20):
        out = matching.similar(left, right, 0.7, block_bytes=block_bytes, right_rows=64)
        assert "Cartesian" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()
        assert sorted((r.left_key, r.right_key) for r in out.collect()) == list(map(tuple, np.argwhere(every).tolist()))
