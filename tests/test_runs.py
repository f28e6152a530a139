"""K-means runs in common passes, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeltext.operators import cluster, metrics


def plain_lloyd(points, centers, max_iter, tolerance):
    passes = 0
    while passes < max_iter:
        near = ((points[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([points[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
        moved = np.sqrt(((new - centers) ** 2).sum(axis=1).max())
        centers, passes = new, passes + 1
        if moved <= tolerance:
            break
    return centers, passes


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    means = rng.normal(size=(4, 3)) * 6
    return np.concatenate([rng.normal(size=(50, 3)) + m for m in means])


@pytest.fixture(scope="module")
def frame(spark, points):
    rows = [(i, p.tolist(), i // 50) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "doc_id long, features array<double>, label int").repartition(3).cache()


def starts_of(spark, runs):
    rows = [(r, c, v.tolist()) for r, centers in runs.items() for c, v in enumerate(centers)]
    return spark.createDataFrame(rows, "run int, cluster int, center array<double>")


def test_runs_equal_separate_runs(spark, points, frame, monkeypatch):
    rng = np.random.default_rng(0)
    # Runs of different sizes; a far-off centroid that never gets a row; equal centroids.
    starts = {0: points[[0, 60, 120]], 3: points[rng.choice(200, 5)], 7: np.vstack([points[:2], [[99.0, 99, 99]]]), 8: points[[5, 5]]}
    passes = []
    once = cluster.run_sums
    monkeypatch.setattr(cluster, "run_sums", lambda rows, runs, active, width: passes.append(active) or once(rows, runs, active, width))
    runs, n = cluster.lloyd_runs(frame, starts_of(spark, starts), max_iter=30, tolerance=1e-9)
    want = {r: plain_lloyd(points, c, 30, 1e-9) for r, c in starts.items()}
    assert runs.names == [0, 3, 7, 8] and n == len(passes) == max(p for _, p in want.values())
    for name, centers in zip(runs.names, runs.centers):
        assert np.allclose(centers, want[name][0])
    assert np.allclose(runs.centers[2][2], 99)
    # A converged run takes no part in later passes.
    assert [sum(i in a for a in passes) for i in range(4)] == [want[r][1] for r in runs.names]
    rows = cluster.assign_runs(frame, runs).collect()
    for r in rows:
        near = [((c - points[r.doc_id]) ** 2).sum(axis=1).argmin() for c in runs.centers]
        assert r.clusters == near


def test_scores_of_runs_are_those_of_each(spark, frame):
    runs, _ = cluster.lloyd_runs(frame, cluster.seeded_starts(frame, 4, runs=3))
    clustered = cluster.assign_runs(frame, runs).cache()
    got = {(r.run, r.metric): r.value for r in cluster.run_scores(clustered, 120).collect()}
    for run in range(3):
        one = clustered.withColumn("cluster", F.col("clusters")[run])
        alone = metrics.cluster_scores(one).first().asDict()
        alone["silhouette"] = metrics.silhouette(one.withColumnRenamed("doc_id", "id"), 120).first()[0]
        assert {m: got[run, m] for m in alone} == pytest.approx(alone)
    assert max(got[r, "homogeneity"] for r in range(3)) > 0.9


def test_starts_differ_by_run_and_repeat(spark, frame):
    first, again = (cluster.seeded_starts(frame, 4, runs=3).collect() for _ in range(2))
    assert first == again and len(first) == 12
    assert len({tuple(r.center) for r in first if r.run == 0}) == 4
    assert {tuple(r.center) for r in first if r.run == 0} != {tuple(r.center) for r in first if r.run == 1}
    few = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(9)], "doc_id long, features array<double>")
    assert cluster.seeded_starts(few, 4, runs=2).count() == 4


def test_too_many_centroids_are_refused(spark):
    starts = starts_of(spark, {0: np.zeros((10, 8))})
    assert cluster.runs_of(starts, 640).centers[0].shape == (10, 8)
    with pytest.raises(ValueError, match="centroids"):
        cluster.runs_of(starts, 639)


def test_ball_index_is_exact_and_prunes(spark):
    """100,000 centroids, many of them equal, in one block and in several."""
    rng = np.random.default_rng(6)
    means = rng.normal(size=(300, 4)) * 20
    centers = means[rng.integers(0, 300, 100_000)] + rng.normal(size=(100_000, 4)).round(1)
    points = np.concatenate([centers[rng.integers(0, 100_000, 60)], means[:60] + rng.normal(size=(60, 4)), rng.normal(size=(5, 4)) * 500])
    want = np.array([((p - centers) ** 2).sum(axis=1).argmin() for p in points])
    index = cluster.BallIndex.of([cluster.Row(cluster=i, center=c) for i, c in enumerate(centers.tolist())])
    _, place, looked = index.nearest(points)
    assert (place == want).all() and looked < 0.1 * len(points) * len(centers)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(999, None)], "id int, features array<double>")
    numbers = spark.createDataFrame([(i, c) for i, c in enumerate(centers.tolist())], "cluster int, center array<double>").repartition(3)
    for block in (cluster.BLOCK_BYTES, 2 << 20):
        out = cluster.nearest_centroid(rows, numbers, block)
        got = {r.id: r.cluster for r in out.collect()}
        assert got.pop(999) is None and [got[i] for i in range(len(points))] == want.tolist()
        assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert {r.cluster for r in cluster.nearest_centroid(rows, numbers.limit(0)).collect()} == {None}


def test_correlations_of_many_levels(spark):
    """20,000 labels on either side, one of them a third of all rows; the grid has 4e8 pairs."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20_000).alias("a"), ((F.col("id") * 7) % 20_011).alias("b")
    )
    found = metrics.correlations(rows, "a", "b")
    assert found.present().count() == rows.distinct().count()
    a, b = (np.array([r[0] for r in rows.orderBy("b", "a").select(c).collect()]) for c in "ab")
    asked = [(0, 7), (1, 7), (14, 98), (0, 0), (5, 123), (10**6, 1)]
    got = {(r.i, r.j): r["corr"] for r in found.of(spark.createDataFrame(asked, "i long, j long")).collect()}
    for i, j in asked[:-1]:
        assert got[i, j] == pytest.approx(np.corrcoef(a == i, b == j)[0, 1], abs=1e-12)
    assert got[10**6, 1] is None
    hot = metrics.one_hot_sparse(rows.unionByName(spark.createDataFrame([(None, 1)], "a long, b long")), "a")
    levels = sorted(set(a.tolist()))
    assert {(r.a, r.one_hot["index"]) for r in hot.collect()} == {*zip(levels, range(len(levels))), (None, None)}
    assert hot.select("one_hot.size").distinct().count() == 1


def test_sparse_and_dense_correlations_agree(spark):
    pairs = [(i % 4, i % 3) for i in range(50)] + [(None, 1), (2, None), (None, None)]
    rows = spark.createDataFrame(pairs, "a int, b int")
    dense = {(r.key1, r.key2): r["corr"] for r in metrics.label_correlation(rows, "a", "b").collect()}
    grid = spark.createDataFrame([(i, j) for i in range(4) for j in range(4)], "i int, j int")
    for r in metrics.correlations(rows, "a", "b").of(grid).collect():
        assert (r["corr"] is None) == (dense[f"a_{r.i}", f"b_{r.j}"] is None)
        assert r["corr"] is None or r["corr"] == pytest.approx(dense[f"a_{r.i}", f"b_{r.j}"])
