import numpy as np
import pytest
from pyspark.sql import functions as F

from subscope.operators.components import components
from subscope.operators.density import cluster_summary, dbscan


def brute(x, eps, min_samples):
    """Textbook DBSCAN on a full distance matrix."""
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1) <= eps * eps
    core = d.sum(1) >= min_samples
    labels = np.full(len(x), -1)
    cluster = 0
    for i in range(len(x)):
        if not core[i] or labels[i] >= 0:
            continue
        stack = [i]
        labels[i] = cluster
        while stack:
            j = stack.pop()
            for k in np.flatnonzero(d[j]):
                if labels[k] < 0:
                    labels[k] = cluster
                    if core[k]:
                        stack.append(k)
        cluster += 1
    return labels, core


def run(spark, x, eps, min_samples, leaf=64, scale=False, chunk=2048):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, p)) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{n} double" for n in names))
    out = dbscan(df, "id", names, eps, min_samples, scale=scale, leaf=leaf, chunk=chunk)
    got = sorted(out.collect())
    return out, np.array([r["label"] for r in got]), np.array([r["is_core"] for r in got])


@pytest.mark.parametrize("leaf, chunk", [(64, 2048), (2, 2048), (8, 30)])
def test_matches_brute_force_in_two_dimensions(spark, leaf, chunk):
    rng = np.random.default_rng(3)
    x = np.vstack([
        rng.normal(0, 0.3, (150, 2)), rng.normal(3, 0.4, (120, 2)),
        rng.uniform(-3, 6, (60, 2)), np.repeat([[1.5, 1.5]], 40, axis=0),
    ])
    out, labels, core = run(spark, x, 0.35, 8, leaf, chunk=chunk)
    want, want_core = brute(x, 0.35, 8)
    assert (core == want_core).all()
    assert (labels == want).all()
    row = cluster_summary(out).first()
    assert row["n_clusters"] == want.max() + 1 and row["n_noise"] == (want == -1).sum()


def test_matches_brute_force_in_five_dimensions(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (250, 5)), rng.normal(2.5, 0.5, (150, 5))])
    _, labels, core = run(spark, x, 0.9, 10, leaf=4)
    want, want_core = brute(x, 0.9, 10)
    assert (core == want_core).all()
    assert (labels == want).all()


def test_one_crowded_spot_stays_cheap(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 0.01, (4000, 2)), rng.normal(0.3, 0.01, (3000, 2)), rng.uniform(-2, 2, (50, 2))])
    _, labels, core = run(spark, x, 0.3, 30)
    want, want_core = brute(x, 0.3, 30)
    assert (core == want_core).all()
    assert (labels == want).all()


def test_components_of_chains_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(50)]
    hub = [(100, 100 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + hub, "src bigint, dst bigint")
    nodes = spark.range(0, 500).withColumnRenamed("id", "node")
    got = {r["node"]: r["component"] for r in components(edges, nodes).collect()}
    assert all(got[i] == 0 for i in range(51))
    assert all(got[i] == 100 for i in range(100, 400))
    assert all(got[i] == i for i in range(400, 500))


def test_copies_meet_as_one_weighted_place(spark, monkeypatch):
    from subscope.operators import density

    rng = np.random.default_rng(11)
    base = np.vstack([rng.normal(0, 0.5, (80, 3)), rng.uniform(-3, 3, (60, 3))])
    base[0, 0] = -0.0
    x = np.vstack([base] * 7)
    x[140, 0] = 0.0
    met, plain = [], density._Grid.meet

    def counted(grid, left, right, *rest, **named):
        met.extend([left.count(), right.count()])
        return plain(grid, left, right, *rest, **named)

    monkeypatch.setattr(density._Grid, "meet", counted)
    for leaf in (64, 2):
        _, labels, core = run(spark, x, 0.7, 30, leaf)
        want, want_core = brute(x, 0.7, 30)
        assert 0 < want_core.sum() < len(x) and (want == -1).any()
        assert (core == want_core).all()
        assert (labels == want).all()
    assert max(met) <= len(base)


def test_dense_tables_are_not_compared_as_a_whole(spark, monkeypatch):
    from subscope.operators import density

    rng = np.random.default_rng(13)
    x = np.vstack([rng.normal(0, 0.5, (900, 3)), rng.normal(4, 0.5, (700, 3)), rng.uniform(-2, 6, (100, 3))])
    met, plain = [], density._Grid.meet

    def counted(grid, left, right, *rest, **named):
        met.append(left.count() * right.count())
        return plain(grid, left, right, *rest, **named)

    monkeypatch.setattr(density, "FIRST", 100, raising=False)
    monkeypatch.setattr(density._Grid, "meet", counted)
    for leaf in (64, 8):
        met.clear()
        _, labels, core = run(spark, x, 0.8, 30, leaf)
        want, want_core = brute(x, 0.8, 30)
        assert want.max() == 1 and (want == -1).any()
        assert (core == want_core).all()
        assert (labels == want).all()
        assert sum(met) < len(x) ** 2
