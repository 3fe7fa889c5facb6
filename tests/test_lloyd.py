"""K-means of all restarts and all numbers of clusters in one loop."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler

from subscope.operators import lloyd, segments


def points(spark, x, partitions=4):
    names = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([tuple(map(float, r)) for r in x], names).repartition(partitions)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    return np.vstack([rng.normal(at, 0.6, (150, 3)) for at in ((0, 0, 0), (4, 0, 1), (0, 5, 2), (5, 5, 0))])


def test_models_are_fixed_points(spark, cloud):
    fits = lloyd.fit_all(points(spark, cloud).persist(), [2, 4, 6], 3, seed=1)
    assert [(f.k, f.restart) for f in fits] == [(k, i) for k in (2, 4, 6) for i in range(3)]
    for f in fits:
        gaps = ((cloud[:, None] - f.centres[None]) ** 2).sum(axis=2)
        near = gaps.argmin(axis=1)
        assert f.inertia == pytest.approx(gaps.min(axis=1).sum(), rel=1e-12)
        assert f.sizes.tolist() == np.bincount(near, minlength=f.k).tolist() and f.sizes.sum() == len(cloud)
        for c in range(f.k):
            assert np.allclose(f.centres[c], cloud[near == c].mean(axis=0), atol=1e-3)


def test_as_good_as_single_fits(spark, cloud):
    frame = points(spark, cloud).persist()
    vectors = VectorAssembler(inputCols=frame.columns, outputCol="v").transform(frame)
    fits = lloyd.fit_all(frame, [4, 5], 5)
    for k in (4, 5):
        single = min(KMeans(k=k, seed=s, featuresCol="v").fit(vectors).summary.trainingCost for s in range(5))
        assert min(f.inertia for f in fits if f.k == k) <= single * 1.02


def test_partitions_do_not_matter(spark, cloud):
    one, many = (lloyd.fit_all(points(spark, cloud, n), [4], 2) for n in (1, 9))
    for a, b in zip(one, many):
        assert np.allclose(a.centres, b.centres, atol=1e-9) and a.sizes.tolist() == b.sizes.tolist()


def test_copies_and_few_values(spark):
    x = np.vstack([np.zeros((300, 2)), np.ones((5, 2)), [[9.0, -0.0]]])
    (fit,) = lloyd.fit_all(points(spark, x), [3], 1)
    assert fit.inertia == pytest.approx(0, abs=1e-18) and sorted(fit.sizes) == [1, 5, 300]
    (fit,) = lloyd.fit_all(points(spark, np.ones((40, 2))), [3], 1)
    assert fit.centres.tolist() == [[1.0, 1.0]] and fit.sizes.tolist() == [40]


def test_rows_that_cannot_be_placed(spark):
    with pytest.raises(ValueError):
        lloyd.fit_all(spark.createDataFrame([], "a double, b double"), [2], 1)
    with pytest.raises(Exception, match="null or non-finite"):
        lloyd.fit_all(spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a double, b double"), [2], 1)


def test_a_stored_model_has_the_centres(spark, cloud):
    found = segments._as_model(spark, cloud[:7], 3).clusterCenters()
    assert sorted(map(tuple, found)) == sorted(map(tuple, cloud[:7]))


def test_search_runs_few_jobs(spark, cloud):
    frame = points(spark, cloud).persist()
    spark.sparkContext.setJobGroup("lloyd", "fit")
    lloyd.fit_all(frame, [3, 4, 5, 6, 7, 8], 10)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("lloyd"))
    spark.sparkContext.setJobGroup("", "")
    assert 5 < jobs < 200  # sixty single fits take some 25 jobs each
