"""Labelling, clustering and classification metrics.

Everything that can start from counts does: the rows are counted once, with
map-side pre-aggregation, and the formulas run on the counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltext.operators.scale import join_counted, with_row_index
from labeltext.session import ensure_checkpoint_dir

LOG_FLOOR = -100.0


def label_levels(rows: DataFrame, *labels: str, most: int = 10_000) -> list[int]:
    """The sorted distinct labels of the columns. More than ``most`` raise an error:
    each becomes a column or a pair of columns, so such a table could not be used."""
    every = F.array(*[F.col(c) for c in labels])
    found = rows.select(F.explode(every).alias("v")).where("v IS NOT NULL").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} different labels")
    return sorted(r.v for r in found)


def one_hot(rows: DataFrame, label: str, name: str, levels: list[int] | range | None = None) -> DataFrame:
    """``rows`` with a 0/1 column ``<name>_<level>`` per level, by default per label
    that occurs."""
    levels = label_levels(rows, label) if levels is None else levels
    return rows.withColumns(
        {f"{name}_{v}": F.when(F.col(label) == v, 1).otherwise(0) for v in levels}
    )


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, n)``: rows per pair of labels."""
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def label_correlation(
    rows: DataFrame, a: str, b: str, levels: list[int] | range | None = None
) -> DataFrame:
    """``(key1, key2, corr)``: Pearson correlation of each pair of one-hot columns
    of two labelings; NULL where a column is constant. ``levels`` are by default
    the labels that occur in either labeling.

    A one-hot sum is a count, so the block follows from the contingency counts,
    joined with the grid of levels: one shuffle of pre-aggregated pairs.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    cells = contingency(rows, a, b).checkpoint()
    if levels is None:
        levels = label_levels(cells, a, b)
    spark = rows.sparkSession
    kind = rows.schema[a].dataType.simpleString()
    grid = spark.createDataFrame([(i, j) for i in levels for j in levels], f"i {kind}, j {kind}")
    x = cells.groupBy(F.col(a).alias("i")).agg(F.sum("n").cast("double").alias("x"))
    y = cells.groupBy(F.col(b).alias("j")).agg(F.sum("n").cast("double").alias("y"))
    xy = cells.select(F.col(a).alias("i"), F.col(b).alias("j"), F.col("n").cast("double").alias("xy"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).scalar()
    wide = grid.join(x, "i", "left").join(y, "j", "left").join(xy, ["i", "j"], "left").na.fill(0.0)
    spread = F.sqrt((total * F.col("x") - F.col("x") * F.col("x")) * (total * F.col("y") - F.col("y") * F.col("y")))
    corr = F.try_divide(total * F.col("xy") - F.col("x") * F.col("y"), spread)
    name = lambda prefix, v: F.concat(F.lit(f"{prefix}_"), F.col(v).cast("string"))
    return wide.select(name(a, "i").alias("key1"), name(b, "j").alias("key2"), corr.alias("corr"))


def one_hot_sparse(rows: DataFrame, label: str, name: str = "one_hot") -> DataFrame:
    """``rows`` with ``name``, a struct of ``size`` and ``index``: where the 1 of a one-hot
    vector over the labels that occur stands, in their order. A null label has no index.
    The number of labels has no bound; rows meet their numbers without a hot key."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    numbered = with_row_index(counts, [label], "_index")
    size = F.coalesce(numbered.agg(F.count("*")).scalar(), F.lit(0))
    known = join_counted(rows, numbered, [label], "_n")
    both = known.unionByName(rows.where(F.col(label).isNull()), allowMissingColumns=True)
    return both.select(*rows.columns, F.struct(size.alias("size"), F.col("_index").alias("index")).alias(name))


@dataclass
class Correlations:
    """What all correlations of two labelings' one-hot columns follow from: ``cells(i, j,
    xy)`` that have rows, ``left(i, x, n)`` and ``right(j, y, n)`` with the rows and cells of
    each label, and the number of rows."""

    cells: DataFrame
    left: DataFrame
    right: DataFrame
    total: float

    def _with_values(self, known: DataFrame) -> DataFrame:
        total, x, y = F.lit(self.total), F.col("x"), F.col("y")
        spread = F.sqrt((total * x - x * x) * (total * y - y * y))
        return known.select("i", "j", F.try_divide(total * F.col("xy") - x * y, spread).alias("corr"))

    def present(self) -> DataFrame:
        """``(i, j, corr)`` of every pair of labels that some row has."""
        with_left = join_counted(self.cells, self.left, ["i"], "n").drop("n")
        return self._with_values(join_counted(with_left, self.right, ["j"], "n"))

    def of(self, pairs: DataFrame) -> DataFrame:
        """``(i, j, corr)`` of the ``pairs(i, j)`` asked for, also those that no row has; null
        for labels that do not occur or are constant."""
        known = pairs.select("i", "j").join(self.left.select("i", "x"), "i", "left").join(self.right.select("j", "y"), "j", "left")
        return self._with_values(known.join(self.cells, ["i", "j"], "left").na.fill(0.0, ["xy"]))


def correlations(rows: DataFrame, a: str, b: str) -> Correlations:
    """The counts behind all correlations of ``a`` with ``b``, whatever the number of labels:
    work and size follow the pairs that occur, not the grid of all pairs. Rows without a
    label count in the total only, as in ``label_correlation``'s one-hot columns."""
    ensure_checkpoint_dir(rows.sparkSession)
    every = contingency(rows, a, b).checkpoint()
    total = float(every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    number = F.col("n").cast("double")
    cells = every.select(F.col(a).alias("i"), F.col(b).alias("j"), number.alias("xy"))

    def margin(level: str, value: str) -> DataFrame:
        whole = F.sum("xy").alias(value)
        held = F.count(F.when(F.col("i").isNotNull() & F.col("j").isNotNull(), 1)).alias("n")
        return cells.where(F.col(level).isNotNull()).groupBy(level).agg(whole, held).checkpoint()

    return Correlations(cells.where("i IS NOT NULL AND j IS NOT NULL"), margin("i", "x"), margin("j", "y"), total)


def cluster_scores(
    rows: DataFrame, label: str = "label", cluster: str = "cluster", by: Sequence[str] = ()
) -> DataFrame:
    """Homogeneity, completeness, V-measure (Rosenberg & Hirschberg 2007) and
    adjusted Rand index (Hubert & Arabie 1985), as one row, or one row per group of
    ``by``: all groups are counted together."""
    cells = rows.groupBy(*by, label, cluster).agg(F.count("*").cast("double").alias("n"))
    cells = cells.withColumns(
        {
            "n_label": F.sum("n").over(Window.partitionBy(*by, label)),
            "n_cluster": F.sum("n").over(Window.partitionBy(*by, cluster)),
        }
    )

    # Pairs inside groups of size m: each cell gives its share, n (m - 1) / 2.
    def pairs(m: str) -> Column:
        return F.sum(F.col("n") * (F.col(m) - 1.0) / 2.0)

    # With N rows, sums of n ln n give every entropy without knowing N beforehand.
    sums = cells.groupBy(*by).agg(
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.ln("n")).alias("s_cells"),
        F.sum(F.col("n") * F.ln("n_label")).alias("s_label"),
        F.sum(F.col("n") * F.ln("n_cluster")).alias("s_cluster"),
        pairs("n").alias("p_cells"),
        pairs("n_label").alias("p_label"),
        pairs("n_cluster").alias("p_cluster"),
        F.countDistinct(label).alias("k_label"),
        F.countDistinct(cluster).alias("k_cluster"),
    )
    total = F.col("total")
    log_total = F.ln("total")
    h_label = F.when(F.col("k_label") > 1, log_total - F.col("s_label") / total).otherwise(0.0)
    h_cluster = F.when(F.col("k_cluster") > 1, log_total - F.col("s_cluster") / total).otherwise(0.0)
    mutual = F.when(
        (F.col("k_label") > 1) & (F.col("k_cluster") > 1),
        log_total + (F.col("s_cells") - F.col("s_label") - F.col("s_cluster")) / total,
    ).otherwise(0.0)
    parts = sums.select(
        "*", h_label.alias("h_label"), h_cluster.alias("h_cluster"), mutual.alias("mutual")
    )
    ratios = parts.withColumns(
        {
            "homogeneity": F.when(F.col("h_label") > 0, F.col("mutual") / F.col("h_label")).otherwise(1.0),
            "completeness": F.when(
                F.col("h_cluster") > 0, F.col("mutual") / F.col("h_cluster")
            ).otherwise(1.0),
            "expected": F.try_divide(
                F.col("p_label") * F.col("p_cluster"), total * (total - 1.0) / 2.0
            ),
        }
    )
    both = F.col("homogeneity") + F.col("completeness")
    chance = (F.col("p_label") + F.col("p_cluster")) / 2.0 - F.col("expected")
    return ratios.select(
        *by,
        "homogeneity",
        "completeness",
        F.when(both > 0, 2.0 * F.col("homogeneity") * F.col("completeness") / both)
        .otherwise(0.0)
        .alias("v_measure"),
        F.when(chance != 0, (F.col("p_cells") - F.col("expected")) / chance)
        .otherwise(1.0)
        .alias("adjusted_rand"),
    )


def silhouette_sample(rows: DataFrame, sample_size: int = 2000, seed: int = 0) -> DataFrame:
    """The rows a silhouette is taken on: the first ``sample_size`` in an order
    hashed from id and seed."""
    order = F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed))))
    return rows.orderBy(order, "id").limit(sample_size)


def silhouette(rows: DataFrame, sample_size: int = 2000, seed: int = 0) -> DataFrame:
    """Mean silhouette (Rousseeuw 1987), Euclidean, on a sample of
    ``(id, features array, cluster)``, as one row."""
    one = silhouettes(rows.select("id", "features", F.array("cluster").alias("clusters")), sample_size, seed)
    return one.agg(F.max("silhouette").alias("silhouette"))


def silhouettes(rows: DataFrame, sample_size: int = 2000, seed: int = 0) -> DataFrame:
    """``(run, silhouette)``: the mean silhouette of each run of ``(id, features array,
    clusters array)``, where ``clusters`` holds a row's cluster in every run.

    The sample is the operator's own bound, and one sample serves all runs: its at most
    ``sample_size`` vectors are read once and shared with every task, and each sampled row
    measures its distances to them once and sums them by cluster for each run. No pair of
    rows is ever a row.
    """
    spark = rows.sparkSession
    vectors = F.col("features").cast("array<double>").alias("features")
    sample = silhouette_sample(rows.select("id", "clusters", vectors), sample_size, seed).toArrow()
    if sample.num_rows == 0:
        return spark.createDataFrame([], "run int, silhouette double")
    runs = sample.column("clusters").combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1).T
    codes = [np.unique(run, return_inverse=True)[1] for run in runs]
    points = sample.column("features").combine_chunks().flatten().to_numpy()
    points = points.reshape(sample.num_rows, -1)
    shared = spark.sparkContext.broadcast((points, [(c, np.bincount(c)) for c in codes]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, groups = shared.value
        for batch in batches:
            scores = np.zeros((batch.num_rows, len(groups)))
            for i, at in enumerate(batch.column("id").to_numpy()):
                distances = np.sqrt(((every - every[at]) ** 2).sum(axis=1))
                for run, (group, sizes) in enumerate(groups):
                    sums = np.bincount(group, weights=distances, minlength=len(sizes))
                    own = group[at]
                    others = np.delete(sums / sizes, own)
                    if sizes[own] > 1 and len(others):
                        a, b = sums[own] / (sizes[own] - 1), others.min()
                        scores[i, run] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
            run = np.tile(np.arange(len(groups), dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(scores.ravel())], ["run", "s"])

    scored = spark.range(sample.num_rows).mapInArrow(score, "run int, s double")
    return scored.groupBy("run").agg(F.avg("s").alias("silhouette"))


def mean_and_deviation(runs: DataFrame) -> DataFrame:
    """``(metric, mean_value, std_value)`` over the runs of each metric."""
    return runs.groupBy("metric").agg(
        F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("std_value")
    )


def predicted(p: Column) -> Column:
    """1.0 where the probability is strictly above one half."""
    return (p > 0.5).cast("double")


def cross_entropy(p: Column, y: Column) -> Column:
    """Binary cross-entropy of a row, logarithms floored at -100."""

    def floored_log(x: Column) -> Column:
        return F.when(x > 0, F.greatest(F.ln(x), F.lit(LOG_FLOOR))).otherwise(F.lit(LOG_FLOOR))

    return -(y * floored_log(p) + (1.0 - y) * floored_log(1.0 - p))


def loss_and_accuracy(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean cross-entropy and accuracy of ``(p, y)`` rows, per group if given."""
    p, y = F.col("p"), F.col("y")
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("n_rows"),
        F.avg(cross_entropy(p, y)).alias("bce"),
        F.avg((predicted(p) == y).cast("double")).alias("accuracy"),
    )


def epoch_loss(scored: DataFrame, batch_size: int = 32, order: str = "id") -> DataFrame:
    """Unweighted mean over consecutive batches of the mean cross-entropy."""
    rows = scored.select(order, cross_entropy(F.col("p"), F.col("y")).alias("loss"))
    batch = F.expr(f"row_index div {int(batch_size)}")
    batches = (
        with_row_index(rows, [order]).groupBy(batch.alias("batch")).agg(F.avg("loss").alias("loss"))
    )
    return batches.agg(F.count("*").alias("n_batches"), F.avg("loss").alias("epoch_loss"))
