"""K-means clustering of feature vectors and what the clusters consist of."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltext.operators.features import LsaModel
from labeltext.operators.metrics import cluster_scores, mean_and_deviation, silhouette_sample, silhouettes
from labeltext.operators.scale import small_table
from labeltext.session import ensure_checkpoint_dir

TOP_TERMS = 10
RUNS = 5
MAX_ITER = 100
# How far, at most, the centroids of a converged run move.
TOLERANCE = 1e-4
# Rows that the starts of all runs are drawn from.
START_SAMPLE = 10_000
# Numbers of the centroids of all runs that one pass may hold.
RUN_BYTES = 64 << 20
# Centroids reach the tasks in blocks of about this many bytes.
BLOCK_BYTES = 64 << 20
# Distances that a task holds at a time.
STEP_NUMBERS = 1 << 20


def fit_kmeans(vectors: DataFrame, k: int, seed: int = 0, max_iter: int = MAX_ITER) -> KMeansModel:
    """One k-means fit on ``features`` (persist those)."""
    return KMeans(k=k, maxIter=max_iter, seed=seed, predictionCol="cluster").fit(vectors)


def assign_clusters(vectors: DataFrame, model: KMeansModel) -> DataFrame:
    """``vectors`` with ``cluster``."""
    return model.transform(vectors)


def class_centroids(rows: DataFrame, label: str = "label") -> DataFrame:
    """``(cluster, center)``: mean ``features`` array per label, summed map-side."""
    return rows.groupBy(F.col(label).alias("cluster")).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("features").cast("array<double>")))).alias("center")
    )


def nearest_centroid(rows: DataFrame, centroids: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` (``features`` array) with ``cluster``: the centroid nearest by
    Euclidean distance, ties to the lower id; null without centroids or features.

    Centroids come to the tasks in broadcast blocks of bounded bytes, each with its
    ``BallIndex``; each row keeps the least (distance, cluster) seen. A table of one
    block, the usual case, is one pass without a shuffle, whatever the number of blocks
    no centroid is ever part of a plan.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    table = centroids.select("cluster", F.col("center").cast("array<double>").alias("center")).checkpoint()
    kind = table.schema["cluster"].dataType
    least = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("cluster", kind)])
    best = rows.withColumn("_best", F.lit(None).cast(least))
    for number, block in enumerate(_blocks(table, block_bytes)):
        if number % 8 == 7:  # keep the plan short when there are many blocks
            best = best.checkpoint()
        search = _searched(rows.sparkSession, BallIndex.of(block), least)
        best = best.withColumn("_best", F.least("_best", search(F.col("features").cast("array<double>"))))
    return best.withColumn("cluster", F.col("_best.cluster")).drop("_best")


@dataclass
class BallIndex:
    """Centroids in balls around pivots, for exact nearest neighbours by the triangle
    inequality: no centroid of a ball is nearer to a point than the point's distance to
    the pivot less the ball's radius, so most balls need no look."""

    ids: pa.Array
    centers: np.ndarray  # ascending by id
    pivots: np.ndarray
    radius: np.ndarray
    members: list[np.ndarray]  # per ball, ascending places

    @classmethod
    def of(cls, block: list[Row]) -> BallIndex:
        block = sorted(block, key=lambda r: r.cluster)
        centers = np.array([r.center for r in block], float)
        # About as many balls as members of one; pivots are spread over the ids.
        pivots = centers[:: max(1, math.isqrt(len(centers)))]
        ball, apart = np.empty(len(centers), np.int64), np.empty(len(centers))
        step = max(1, STEP_NUMBERS // max(1, pivots.size))
        for a in range(0, len(centers), step):
            d = squared_distances(centers[a : a + step], pivots)
            ball[a : a + step], apart[a : a + step] = d.argmin(axis=1), np.sqrt(d.min(axis=1))
        members = [np.flatnonzero(ball == i) for i in range(len(pivots))]
        radius = np.array([apart[m].max(initial=0.0) for m in members])
        return cls(pa.array([r.cluster for r in block]), centers, pivots, radius, members)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Squared distance and place of the nearest centroid of each point, the least
        place of equal ones, and how many distances to centroids that took."""
        best, place, looked = np.full(len(points), np.inf), np.zeros(len(points), np.int64), 0
        to_pivot = np.sqrt(squared_distances(points, self.pivots))
        # The bound gives way by more than rounding may add to it.
        bound = np.maximum(to_pivot * (1 - 1e-9) - self.radius * (1 + 1e-9), 0.0) ** 2
        order = np.argsort(bound, axis=1)
        for turn in range(len(self.pivots)):
            ball = order[:, turn]
            open_ = np.flatnonzero(bound[np.arange(len(points)), ball] <= best)
            if not len(open_):
                break
            for i in np.unique(ball[open_]):
                at, own = open_[ball[open_] == i], self.members[i]
                if not len(own):
                    continue
                looked += len(at) * len(own)
                d = squared_distances(points[at], self.centers[own])
                first = d.argmin(axis=1)
                d, found = d[np.arange(len(at)), first], own[first]
                better = (d < best[at]) | ((d == best[at]) & (found < place[at]))
                best[at[better]], place[at[better]] = d[better], found[better]
        return best, place, looked


def squared_distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Sums of squared differences, added up in the order of the dimensions."""
    out = np.zeros((len(points), len(centers)))
    for x, c in zip(points.T, centers.T, strict=True):
        out += (x[:, None] - c) ** 2
    return out


def _searched(spark: SparkSession, index: BallIndex, least: T.StructType) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(least)
    def search(features: pa.Array) -> pa.Array:
        index = shared.value
        given = features.is_valid().to_numpy(zero_copy_only=False)
        points = features.flatten().to_numpy().reshape(-1, index.centers.shape[1])
        step = max(1, STEP_NUMBERS // max(1, len(index.pivots)))
        parts = [index.nearest(points[a : a + step])[:2] for a in range(0, len(points), step)]
        d, place = np.zeros(len(given)), np.zeros(len(given), np.int64)
        if parts:
            d[given], place[given] = (np.concatenate(p) for p in zip(*parts, strict=True))
        fields = [pa.array(d), index.ids.take(pa.array(place))]
        return pa.StructArray.from_arrays(fields, ["d", "cluster"], mask=pa.array(~given))

    return search


def lloyd(rows: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """``rows`` (``features`` array) with ``cluster`` after ``rounds`` Lloyd steps from the
    centroids ``start(cluster, center)``: assign, then move each to the mean of its
    rows. A centroid without rows goes."""
    ensure_checkpoint_dir(rows.sparkSession)
    centroids = start
    for _ in range(rounds - 1):
        centroids = class_centroids(nearest_centroid(rows, centroids), "cluster").checkpoint()
    return nearest_centroid(rows, centroids)


def seeded_starts(rows: DataFrame, k: int, runs: int = RUNS, sample_size: int = START_SAMPLE, key: str = "doc_id") -> DataFrame:
    """``(run, cluster, center)``: at most ``k`` starts for each of ``runs`` runs, drawn by
    k-means++ (Arthur & Vassilvitskii 2007) with the run's number as seed.

    All runs draw from one sample: the first ``sample_size`` rows in an order hashed from
    ``key``, which bounds what the driver reads. Fewer different rows give fewer starts.
    """
    vectors = rows.select(F.col(key).alias("id"), F.col("features").cast("array<double>").alias("features"))
    sample = silhouette_sample(vectors, sample_size).toArrow().column("features").combine_chunks()
    points = sample.flatten().to_numpy().reshape(len(sample), -1)
    starts = []
    for run in range(runs):
        rng, chosen = np.random.default_rng(run), []
        nearest = np.full(len(points), np.inf)
        while len(chosen) < k and nearest.any():
            chance = None if not chosen else nearest / nearest.sum()
            chosen.append(int(rng.choice(len(points), p=chance)))
            nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        starts += [(run, cluster, points[i].tolist()) for cluster, i in enumerate(chosen)]
    return rows.sparkSession.createDataFrame(starts, "run int, cluster int, center array<double>")


@dataclass
class Runs:
    """Centroids of several runs: per run the ids of its clusters and their centers."""

    names: list[int]
    clusters: list[np.ndarray]
    centers: list[np.ndarray]

    @property
    def bytes(self) -> int:
        return sum(c.nbytes for c in self.centers)


def runs_of(starts: DataFrame, most_bytes: int = RUN_BYTES) -> Runs:
    """``starts(run, cluster, center)`` in the driver. More than ``most_bytes`` of numbers
    raise an error: every task holds all centroids of all runs."""
    size = starts.agg(F.coalesce(F.sum(F.size("center")), F.lit(0))).first()[0] * 8
    if size > most_bytes:
        raise ValueError(f"{size} bytes of centroids, more than {most_bytes}: cluster fewer runs at a time")
    by: dict[int, list[Row]] = {}
    for row in starts.orderBy("run", "cluster").collect():
        by.setdefault(row.run, []).append(row)
    names = sorted(by)
    return Runs(
        names, [np.array([r.cluster for r in by[n]], np.int32) for n in names], [np.array([r.center for r in by[n]]) for n in names]
    )


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The place of the nearest center of each point, the first of equal ones."""
    out = np.empty(len(points), np.int64)
    step = max(1, (1 << 20) // max(1, centers.size))
    for a in range(0, len(points), step):
        apart = points[a : a + step, None] - centers
        out[a : a + step] = np.einsum("ijk,ijk->ij", apart, apart).argmin(axis=1)
    return out


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)


def run_sums(rows: DataFrame, runs: Runs, active: list[int], width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per active run the number of rows of each cluster and the sum of their features,
    from one pass over ``rows`` for all runs together. A task adds up its own first."""
    shared = rows.sparkSession.sparkContext.broadcast([runs.centers[i] for i in active])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared.value
        sums = [np.zeros((len(c), width + 1)) for c in every]
        for batch in batches:
            points = _points(batch) if batch.num_rows else np.zeros((0, width))
            for centers, total in zip(every, sums, strict=True):
                near = _nearest(points, centers)
                total[:, 0] += np.bincount(near, minlength=len(centers))
                order = np.argsort(near, kind="stable")
                first = np.flatnonzero(np.diff(near[order], prepend=-1))
                if len(first):
                    total[near[order][first], 1:] += np.add.reduceat(points[order], first, axis=0)
        which = np.concatenate([np.full(len(s), i, np.int32) for i, s in enumerate(sums)])
        place = np.concatenate([np.arange(len(s), dtype=np.int32) for s in sums])
        values = np.concatenate(sums).ravel()
        at = np.arange(len(which) + 1, dtype=np.int32) * (width + 1)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(values))
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(place), lists], ["run", "place", "v"])

    partial = rows.select(F.col("features").cast("array<double>").alias("features")).mapInArrow(run, "run int, place int, v array<double>")
    summed = partial.groupBy("run", "place").agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width + 1)])
    out = {i: (np.zeros(len(runs.centers[i])), np.zeros_like(runs.centers[i])) for i in active}
    for row in summed.collect():
        counts, sums = out[active[row.run]]
        counts[row.place], sums[row.place] = row[2], row[3:]
    shared.unpersist()
    return out


def lloyd_runs(rows: DataFrame, starts: DataFrame, max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> tuple[Runs, int]:
    """``(centroids, passes)``: Lloyd's iteration of every run of ``starts(run, cluster,
    center)``, all runs in the same passes over ``rows`` (``features``; persist those).

    A cluster without rows keeps its centroid. A run whose centroids all move by at most
    ``tolerance`` has converged and takes no part in further passes; there are at most
    ``max_iter`` of them, whatever the number of runs.
    """
    runs = runs_of(starts)
    active, passes = list(range(len(runs.names))), 0
    while active and passes < max_iter:
        width = runs.centers[active[0]].shape[1]
        sums = run_sums(rows, runs, active, width)
        passes += 1
        moving = []
        for i in active:
            counts, total = sums[i]
            new = np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], runs.centers[i])
            if ((new - runs.centers[i]) ** 2).sum(axis=1).max() > tolerance**2:
                moving.append(i)
            runs.centers[i] = new
        active = moving
    return runs, passes


def assign_runs(rows: DataFrame, runs: Runs) -> DataFrame:
    """``rows`` with ``clusters``: the nearest centroid's id in every run, in their order."""
    shared = rows.sparkSession.sparkContext.broadcast((runs.clusters, runs.centers))

    @F.pandas_udf("array<int>")
    def nearest(features: pd.Series) -> pd.Series:
        clusters, centers = shared.value
        points = np.stack(features.to_numpy()) if len(features) else np.zeros((0, 1))
        each = [ids[_nearest(points, c)] for ids, c in zip(clusters, centers, strict=True)] if len(points) else []
        return pd.Series(list(np.stack(each, axis=1)) if each else [], dtype=object)

    return rows.withColumn("clusters", nearest(F.col("features").cast("array<double>")))


def _blocks(table: DataFrame, most_bytes: int) -> Iterator[list[Row]]:
    """The rows of a checkpointed ``table``, a bounded block at a time."""
    total = table.agg(F.coalesce(F.sum(F.size("center") + 1), F.lit(0))).first()[0] * 8
    if total <= most_bytes:
        if rows := table.collect():
            yield rows
        return
    block, size = [], 0
    for row in table.toLocalIterator():
        block.append(row)
        size += 8 * (len(row.center) + 1)
        if size >= most_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def seeded_starts(rows: DataFrame, k: int, runs: int = RUNS, sample_size: int = START_SAMPLE, key: str = "doc_id") -> DataFrame:
    """``(run, cluster, center)``: at most ``k`` starts for each of ``runs`` runs, drawn by
    k-means++ (Arthur & Vassilvitskii 2007) with the run's number as seed.

    All runs draw from one sample: the first ``sample_size`` rows in an order hashed from
    ``key``, which bounds what the driver reads. Fewer different rows give fewer starts.
    """
    vectors = rows.select(F.col(key).alias("id"), F.col("features").cast("array<double>").alias("features"))
    sample = silhouette_sample(vectors, sample_size).toArrow().column("features").combine_chunks()
    points = sample.flatten().to_numpy().reshape(len(sample), -1)
    starts = []
    for run in range(runs):
        rng, chosen = np.random.default_rng(run), []
        nearest = np.full(len(points), np.inf)
        while len(chosen) < k and nearest.any():
            chance = None if not chosen else nearest / nearest.sum()
            chosen.append(int(rng.choice(len(points), p=chance)))
            nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        starts += [(run, cluster, points[i].tolist()) for cluster, i in enumerate(chosen)]
    return rows.sparkSession.createDataFrame(starts, "run int, cluster int, center array<double>")


@dataclass
class Runs:
    """Centroids of several runs: per run the ids of its clusters and their centers."""

    names: list[int]
    clusters: list[np.ndarray]
    centers: list[np.ndarray]

    @property
    def bytes(self) -> int:
        return sum(c.nbytes for c in self.centers)


def runs_of(starts: DataFrame, most_bytes: int = RUN_BYTES) -> Runs:
    """``starts(run, cluster, center)`` in the driver. More than ``most_bytes`` of numbers
    raise an error: every task holds all centroids of all runs."""
    size = starts.agg(F.coalesce(F.sum(F.size("center")), F.lit(0))).first()[0] * 8
    if size > most_bytes:
        raise ValueError(f"{size} bytes of centroids, more than {most_bytes}: cluster fewer runs at a time")
    by: dict[int, list[Row]] = {}
    for row in starts.orderBy("run", "cluster").collect():
        by.setdefault(row.run, []).append(row)
    names = sorted(by)
    return Runs(
        names, [np.array([r.cluster for r in by[n]], np.int32) for n in names], [np.array([r.center for r in by[n]]) for n in names]
    )


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The place of the nearest center of each point, the first of equal ones."""
    out = np.empty(len(points), np.int64)
    step = max(1, (1 << 20) // max(1, centers.size))
    for a in range(0, len(points), step):
        apart = points[a : a + step, None] - centers
        out[a : a + step] = np.einsum("ijk,ijk->ij", apart, apart).argmin(axis=1)
    return out


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)


def run_sums(rows: DataFrame, runs: Runs, active: list[int], width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per active run the number of rows of each cluster and the sum of their features,
    from one pass over ``rows`` for all runs together. A task adds up its own first."""
    shared = rows.sparkSession.sparkContext.broadcast([runs.centers[i] for i in active])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared.value
        sums = [np.zeros((len(c), width + 1)) for c in every]
        for batch in batches:
            points = _points(batch) if batch.num_rows else np.zeros((0, width))
            for centers, total in zip(every, sums, strict=True):
                near = _nearest(points, centers)
                total[:, 0] += np.bincount(near, minlength=len(centers))
                order = np.argsort(near, kind="stable")
                first = np.flatnonzero(np.diff(near[order], prepend=-1))
                if len(first):
                    total[near[order][first], 1:] += np.add.reduceat(points[order], first, axis=0)
        which = np.concatenate([np.full(len(s), i, np.int32) for i, s in enumerate(sums)])
        place = np.concatenate([np.arange(len(s), dtype=np.int32) for s in sums])
        values = np.concatenate(sums).ravel()
        at = np.arange(len(which) + 1, dtype=np.int32) * (width + 1)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(values))
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(place), lists], ["run", "place", "v"])

    partial = rows.select(F.col("features").cast("array<double>").alias("features")).mapInArrow(run, "run int, place int, v array<double>")
    summed = partial.groupBy("run", "place").agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width + 1)])
    out = {i: (np.zeros(len(runs.centers[i])), np.zeros_like(runs.centers[i])) for i in active}
    for row in summed.collect():
        counts, sums = out[active[row.run]]
        counts[row.place], sums[row.place] = row[2], row[3:]
    shared.unpersist()
    return out


def lloyd_runs(rows: DataFrame, starts: DataFrame, max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> tuple[Runs, int]:
    """``(centroids, passes)``: Lloyd's iteration of every run of ``starts(run, cluster,
    center)``, all runs in the same passes over ``rows`` (``features``; persist those).

    A cluster without rows keeps its centroid. A run whose centroids all move by at most
    ``tolerance`` has converged and takes no part in further passes; there are at most
    ``max_iter`` of them, whatever the number of runs.
    """
    runs = runs_of(starts)
    active, passes = list(range(len(runs.names))), 0
    while active and passes < max_iter:
        width = runs.centers[active[0]].shape[1]
        sums = run_sums(rows, runs, active, width)
        passes += 1
        moving = []
        for i in active:
            counts, total = sums[i]
            new = np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], runs.centers[i])
            if ((new - runs.centers[i]) ** 2).sum(axis=1).max() > tolerance**2:
                moving.append(i)
            runs.centers[i] = new
        active = moving
    return runs, passes


def assign_runs(rows: DataFrame, runs: Runs) -> DataFrame:
    """``rows`` with ``clusters``: the nearest centroid's id in every run, in their order."""
    shared = rows.sparkSession.sparkContext.broadcast((runs.clusters, runs.centers))

    @F.pandas_udf("array<int>")
    def nearest(features: pd.Series) -> pd.Series:
        clusters, centers = shared.value
        points = np.stack(features.to_numpy()) if len(features) else np.zeros((0, 1))
        each = [ids[_nearest(points, c)] for ids, c in zip(clusters, centers, strict=True)] if len(points) else []
        return pd.Series(list(np.stack(each, axis=1)) if each else [], dtype=object)

    return rows.withColumn("clusters", nearest(F.col("features").cast("array<double>")))


def _blocks(table: DataFrame, most_bytes: int) -> Iterator[list[Row]]:
    """The rows of ``table``, a bounded block at a time."""
    block, size = [], 0
    for row in table.toLocalIterator():
        block.append(row)
        size += 8 * (len(row.center) + 1)
        if size >= most_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def term_components(model: LsaModel) -> DataFrame:
    """``(term, component, weight)``: the SVD components, a row per number."""
    return model.components.select("term", F.posexplode("w").alias("component", "weight"))


def centroids_in_term_space(components: DataFrame, centers: list[np.ndarray]) -> DataFrame:
    """``(cluster, term, weight)``: centroids (in component space) mapped back to
    terms, a joined sum over components."""
    long = [
        (cluster, component, float(value))
        for cluster, center in enumerate(centers)
        for component, value in enumerate(center)
    ]
    table = components.sparkSession.createDataFrame(
        long, "cluster int, component int, coordinate double"
    )
    # Spark broadcasts the centroids if they are small and shuffles them if not.
    return (
        components.join(table, "component")
        .groupBy("cluster", "term")
        .agg(F.sum(F.col("weight") * F.col("coordinate")).alias("weight"))
    )


def top_terms(centroids: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    """``(cluster, rank, term, weight)``: the heaviest terms of each cluster.

    The rank limit is applied before the shuffle too, so a cluster's window
    receives at most n rows per map task.
    """
    best = Window.partitionBy("cluster").orderBy(F.desc("weight"), "term")
    return (
        centroids.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n)
        .select("cluster", "rank", "term", "weight")
    )


def class_term_centroids(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """``(cluster, term, weight)``: mean TF-IDF weight of each term per label.

    ``weights`` is the long form; ``labels`` is ``(doc_id, label)`` of every
    document, since a document without the term counts as zero. Labels are the far
    smaller side, so they are hashed and the weights of a partition are not sorted.
    """
    sizes = small_table(labels.groupBy("label").agg(F.count("*").alias("n_docs")))
    labelled = weights.join(labels.hint("shuffle_hash"), "doc_id")
    sums = labelled.groupBy("label", "term").agg(F.sum("weight").alias("total"))
    return sums.join(sizes, "label").select(
        F.col("label").alias("cluster"), "term", (F.col("total") / F.col("n_docs")).alias("weight")
    )


def run_scores(clustered: DataFrame, sample_size: int = 2000) -> DataFrame:
    """``(run, metric, value)`` of every run of ``(doc_id, features, label, clusters)``:
    all runs are counted together and share one silhouette sample."""
    long = clustered.select("label", F.posexplode("clusters").alias("run", "cluster"))
    external = cluster_scores(long, "label", "cluster", ["run"])
    names = [c for c in external.columns if c != "run"]
    rows = external.unpivot("run", names, "metric", "value")
    points = clustered.select(F.col("doc_id").alias("id"), "features", "clusters")
    internal = silhouettes(points, sample_size).select("run", F.lit("silhouette").alias("metric"), F.col("silhouette").alias("value"))
    return rows.unionByName(internal)


def kmeans_runs(
    labelled: DataFrame, k: int, runs: int = RUNS, max_iter: int = MAX_ITER, sample_size: int = 2000
) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Runs with seeds 0..runs-1 on ``(doc_id, features array, label)`` (persist those),
    in one pass per iteration for all of them.

    Returns the scores of every run, the rows with the last run's ``cluster``, and its
    centers.
    """
    found, _ = lloyd_runs(labelled, seeded_starts(labelled, k, runs), max_iter)
    clustered = assign_runs(labelled, found)
    last = clustered.withColumn("cluster", F.element_at("clusters", -1))
    return run_scores(clustered, sample_size), last, found.centers[-1]


def summarise_runs(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric over the runs."""
    return mean_and_deviation(scores.select("metric", "value"))
