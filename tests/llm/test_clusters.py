"""Centroid clustering against a plain version."""

import hashlib
import random

import numpy as np
import pytest

from subscope.llm import clusters


def plain(rows, k, rounds, dims, scale=1024):
    """Lloyd's rule in Python's integers."""
    vectors = []
    for vec_id, v in rows:
        if v is None or len(v) != dims or any(x is None or not np.isfinite(x) for x in v):
            continue
        vectors.append((vec_id, [int(np.float64(np.float32(x)) * scale // 1) for x in v]))
    name = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(vectors, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in vectors:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    found = [(i, *near(v)[::-1]) for i, v in vectors]
    most = (1 << 63) - 1
    own = [min(most, sum(d for _, n, d in found if n == c)) for c in range(len(centroids))]
    total = min(most, sum(d for *_, d in found))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, min(most, d), own[n], total, digest[n]) for i, n, d in found), key=str)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, vector int")
    return sorted((tuple(r) for r in clusters.centroid_clusters(frame, **options).collect()), key=str)


@pytest.mark.parametrize(("k", "dims", "leaf", "grid"), [(8, 64, 4, 0), (12, 2, 2, 3), (30, 3, 3, 4), (5, 4, 1, 0)])
def test_equals_plain(spark, k, dims, leaf, grid):
    """``grid``: few different values, so that vectors repeat and many distances tie."""
    rnd = random.Random(k)
    value = lambda: rnd.randrange(grid) / 1024 if grid else rnd.uniform(-2, 2)
    rows = [(i // 2 if i % 5 == 0 else i, [value() for _ in range(dims)]) for i in range(300)]
    rows += rows[:20] + [(None, rows[3][1]), (None, rows[4][1])]
    assert run(spark, rows, k=k, dims=dims, rounds=6, leaf=leaf) == plain(rows, k, 6, dims)


def test_odd_vectors(spark):
    sound = [(i, [float(i % 3), -0.0001 * i]) for i in range(9)]
    odd = [(100, None), (101, []), (102, [1.0]), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (106, [1.0] * 3)]
    assert run(spark, sound + odd, k=3, dims=2, rounds=10) == plain(sound, 3, 10, 2)
    assert run(spark, sound[:2], k=8, dims=2) == plain(sound[:2], 8, 10, 2)
    assert run(spark, odd, dims=2) == run(spark, [], dims=2) == []
    huge = [*sound, (200, [3e38, -3e38]), (201, [1e20, 1.0]), (202, [1e20, 2.0])]
    assert run(spark, huge, k=4, dims=2, rounds=4) == plain(huge, 4, 4, 2)


def test_tree_opens_few_nodes():
    """Best first with inclusive pruning: exact on ties, and far fewer distances than centroids."""
    rnd = np.random.default_rng(5)
    middles = rnd.integers(-100_000, 100_000, (40, 3))
    points = (middles[rnd.integers(0, 40, 600)] + rnd.integers(-50, 50, (600, 3))).astype(float)
    vectors = (points[rnd.integers(0, 600, 500)] + rnd.integers(-2, 3, (500, 3))).astype(float)
    tree = clusters.Tree.over(points)
    met = 0
    real = clusters.squared

    def counted(a, b):
        nonlocal met
        met += len(a)
        return real(a, b)

    clusters.squared = counted
    try:
        number, exact = tree.nearest(vectors)
    finally:
        clusters.squared = real
    full = ((vectors[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    assert (number == full.argmin(axis=1)).all() and (exact == full.min(axis=1)).all()
    assert met < 0.25 * full.size
