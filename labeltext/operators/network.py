"""A feed-forward binary classifier whose weights are a table.

``weights(layer, unit, input, weight)`` holds a number per connection; input -1 is a
unit's bias, layers and units count from 0. Hidden layers are affine and rectified, the
last layer is one unit with a sigmoid. Scores and gradients are array expressions of
the JVM over the table's numbers, which go into the plan as one literal per layer once
their number is checked; rows never leave Spark, and only sums of gradients, one per
weight, reach the driver.

Training is gradient descent on the mean cross-entropy with Adam's moments (Kingma & Ba
2015), whole passes in place of batches: a pass over all rows per step, combined
map-side, so a step costs the same shuffle whatever the number of rows. Every epoch's
weights and validation loss are kept; the best epoch is the least loss, found by a window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labeltext.functions.lookups import let
from labeltext.operators.metrics import cross_entropy, loss_and_accuracy, predicted

HIDDEN_UNITS = 5
EPOCHS = 3
STEPS_PER_EPOCH = 20
PATIENCE = 3
# Adam's published settings but for the step size, which suits whole passes.
STEP_SIZE, MOMENT, SQUARE_MOMENT, SMALL = 0.05, 0.9, 0.999, 1e-8
# A model of more numbers does not go into a plan.
MOST_WEIGHTS = 1_000_000

SCHEMA = "layer int, unit int, input int, weight double"
Layers = list[np.ndarray]  # per layer a row per unit: the bias, then a weight per input


def to_table(spark: SparkSession, layers: Layers) -> DataFrame:
    """Layers as a table."""
    rows = [
        (at, unit, place - 1, float(w)) for at, layer in enumerate(layers) for unit, row in enumerate(layer) for place, w in enumerate(row)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def from_table(weights: DataFrame, most: int = MOST_WEIGHTS) -> Layers:
    """The table as layers. More than ``most`` numbers, gaps or repeated ones are an error."""
    rows = weights.select("layer", "unit", "input", "weight").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} weights")
    layers = []
    for at in range(1 + max((r.layer for r in rows), default=-1)):
        own = {(r.unit, r.input): r.weight for r in rows if r.layer == at}
        units, inputs = 1 + max((u for u, _ in own), default=-1), 1 + max((i for _, i in own), default=-1)
        if not own or len(own) != units * (inputs + 1) or len(own) != sum(r.layer == at for r in rows):
            raise ValueError(f"layer {at} is not a whole grid of units and inputs")
        layers.append(np.array([[own[u, i] for i in range(-1, inputs)] for u in range(units)]))
    for before, after in zip(layers, layers[1:]):
        if after.shape[1] - 1 != len(before):
            raise ValueError("a layer's inputs are not the units before it")
    return layers


def started(width: int, hidden: int = HIDDEN_UNITS, seed: int = 0) -> Layers:
    """Weights uniform within 1 / sqrt(inputs), as linear layers usually start."""
    rng = np.random.default_rng(seed)
    draw = lambda units, inputs: rng.uniform(-1, 1, (units, inputs + 1)) / np.sqrt(inputs)
    return [draw(hidden, width), draw(1, hidden)]


def _numbers(values: np.ndarray) -> Column:
    return F.lit([float(v) for v in values])


def _affine(inputs: Column, layer: np.ndarray) -> Column:
    """Every unit's bias plus its weighted inputs."""
    units = F.array(*[F.struct(F.lit(float(row[0])).alias("b"), _numbers(row[1:]).alias("w")) for row in layer])
    add = lambda total, x: total + x
    return F.transform(units, lambda u: F.aggregate(F.zip_with(inputs, u["w"], lambda x, w: x * w), u["b"], add))


def rectified(values: Column) -> Column:
    return F.transform(values, lambda v: F.greatest(v, F.lit(0.0)))


def sigmoid(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-value))


def activations(features: Column, layers: Layers) -> list[Column]:
    """What each layer gets: the features, then each hidden layer's output."""
    out = [features.cast("array<double>")]
    for layer in layers[:-1]:
        out.append(rectified(_affine(out[-1], layer)))
    return out


def forward(features: Column, layers: Layers) -> Column:
    """The probability of label 1."""
    last = activations(features, layers)[-1]
    return sigmoid(F.get(_affine(last, layers[-1]), F.lit(0)))


def score_rows(rows: DataFrame, weights: DataFrame | Layers) -> DataFrame:
    """``rows(features, label)`` with ``p``, ``y`` and the class at one half, ``predicted``."""
    layers = weights if isinstance(weights, list) else from_table(weights)
    scored = rows.withColumn("p", forward(F.col("features"), layers)).withColumn("y", F.col("label").cast("double"))
    return scored.withColumn("predicted", predicted(F.col("p")))


def gradients(rows: DataFrame, layers: Layers) -> tuple[Layers, float, int]:
    """The mean gradient of the cross-entropy for every weight, the mean loss and the number
    of rows, from one pass. Errors go back through the layers as array expressions; a
    row's part of a weight's gradient is its unit's error times the unit's input."""
    names = [f"a{i}" for i in range(len(layers))]
    given = rows.select(F.col("features").cast("array<double>").alias("a0"), F.col("label").cast("double").alias("y"))
    for at, layer in enumerate(layers[:-1]):
        given = given.withColumn(f"a{at + 1}", rectified(_affine(F.col(names[at]), layer)))
    given = given.withColumn("p", sigmoid(F.get(_affine(F.col(names[-1]), layers[-1]), F.lit(0))))
    given = given.withColumn(f"e{len(layers) - 1}", F.array(F.col("p") - F.col("y")))
    for at in range(len(layers) - 2, -1, -1):
        # Error of unit j: the errors after it by their weights, where the unit is active.
        after = F.array(*[_numbers(column) for column in layers[at + 1][:, 1:].T])
        errors = F.col(f"e{at + 1}")
        back = lambda w: F.aggregate(F.zip_with(errors, w, lambda e, x: e * x), F.lit(0.0), lambda t, x: t + x)  # noqa: B023, E731
        passed = F.zip_with(F.transform(after, back), F.col(names[at + 1]), lambda e, a: F.when(a > 0, e).otherwise(0.0))
        given = given.withColumn(f"e{at}", passed)
    # A unit's gradients: its error for the bias, and times each of its inputs.
    parts = []
    for at in range(len(layers)):
        own = lambda e: F.concat(F.array(e), F.transform(names[at], lambda x: e * x))  # noqa: B023, E731
        parts.append(F.flatten(F.transform(f"e{at}", own)))
    loss = F.array(cross_entropy(F.col("p"), F.col("y")))
    places = given.select(F.posexplode(F.concat(loss, *parts)).alias("at", "g")).groupBy("at")
    rows_at = {r["at"]: r for r in places.agg(F.avg("g").alias("g"), F.count("*").alias("n")).collect()}
    if not rows_at:
        raise ValueError("no training rows")
    flat = np.array([rows_at[i].g for i in range(len(rows_at))])
    grads, start = [], 1
    for layer in layers:
        grads.append(flat[start : start + layer.size].reshape(layer.shape))
        start += layer.size
    return grads, float(flat[0]), rows_at[0].n


@dataclass
class TrainedNetwork:
    """``weights`` of the best epoch, and ``history(epoch, train_loss, val_loss, best)``."""

    weights: DataFrame
    history: DataFrame


def best_epochs(history: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """``history(epoch, val_loss, ..)`` with ``best`` (the least loss, the first of equal ones)
    and ``stop``: ``patience`` epochs in a row have not lowered the least loss."""
    order = Window.orderBy("epoch")
    least = F.min("val_loss").over(order.rowsBetween(Window.unboundedPreceding, -1))
    lowers = least.isNull() | (F.col("val_loss") < least)
    marked = history.withColumn("_lowered", F.when(lowers, F.col("epoch")))
    last = F.last("_lowered", ignorenulls=True).over(order)
    ranked = marked.withColumn("stop", F.col("epoch") - last >= patience)
    first = F.row_number().over(Window.orderBy("val_loss", "epoch")) == 1
    return ranked.withColumn("best", first).drop("_lowered")


def train(
    rows: DataFrame, valid: DataFrame, layers: Layers | None = None, hidden: int = HIDDEN_UNITS, epochs: int = EPOCHS,
    steps: int = STEPS_PER_EPOCH, patience: int = PATIENCE, step_size: float = STEP_SIZE, seed: int = 0,
) -> TrainedNetwork:
    """Train on ``(features array, label)`` from ``layers`` or seeded ones (persist both
    inputs). Training stops after ``patience`` epochs without a lower validation loss."""
    spark = rows.sparkSession
    first = rows.select(F.size("features").alias("n")).first()
    if first is None:
        raise ValueError("no training rows")
    layers = started(first.n, hidden, seed) if layers is None else layers
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in layers]
    kept, losses, step = [], [], 0
    for epoch in range(epochs):
        for _ in range(steps):
            grads, loss, _ = gradients(rows, layers)
            step += 1
            moments = [(MOMENT * m + (1 - MOMENT) * g, SQUARE_MOMENT * v + (1 - SQUARE_MOMENT) * g * g) for (m, v), g in zip(moments, grads)]
            layers = [
                w - step_size * (m / (1 - MOMENT**step)) / (np.sqrt(v / (1 - SQUARE_MOMENT**step)) + SMALL)
                for w, (m, v) in zip(layers, moments)
            ]
        kept.append(layers)
        losses.append((epoch, float(loss), float(loss_and_accuracy(score_rows(valid, layers)).first().bce)))
        history = best_epochs(spark.createDataFrame(losses, "epoch int, train_loss double, val_loss double"), patience)
        if history.where("stop").limit(1).count():
            break
    best = history.where("best").first().epoch
    return TrainedNetwork(to_table(spark, kept[best]), history.drop("stop"))
