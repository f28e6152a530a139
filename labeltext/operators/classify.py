"""Binary classifier: training with early stopping, scoring, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltext.operators.metrics import loss_and_accuracy, predicted

HIDDEN_UNITS = 5
EPOCHS = 3
PATIENCE = 3
STEPS_PER_EPOCH = 20


@dataclass
class TrainedClassifier:
    """The best model and ``(epoch, val_loss)`` of every epoch run."""

    model: MultilayerPerceptronClassificationModel
    history: list[tuple[int, float]]
    best_epoch: int


def train_classifier(
    train: DataFrame,
    valid: DataFrame,
    hidden: int = HIDDEN_UNITS,
    epochs: int = EPOCHS,
    steps_per_epoch: int = STEPS_PER_EPOCH,
    patience: int = PATIENCE,
    block_size: int = 32,
    seed: int = 0,
    path: str | None = None,
) -> TrainedClassifier:
    """One hidden layer on ``(features vector, label double)``.

    An epoch is ``steps_per_epoch`` L-BFGS steps from the previous epoch's
    weights. Training stops once ``patience`` epochs have not lowered the
    validation cross-entropy; the best epoch's model is kept, and saved to
    ``path`` if given. Persist both inputs.
    """
    first = train.select("features").first()
    if first is None:
        raise ValueError("no training rows")
    width = first.features.size
    best, history, weights = None, [], None
    for epoch in range(epochs):
        trainer = MultilayerPerceptronClassifier(
            layers=[width, hidden, 2], maxIter=steps_per_epoch, blockSize=block_size, seed=seed
        )
        if weights is not None:
            trainer = trainer.setInitialWeights(weights)
        model = trainer.fit(train)
        weights = model.weights
        loss = loss_and_accuracy(score_rows(valid, model)).first().bce
        history.append((epoch, loss))
        if best is None or loss < best[1]:
            best = (epoch, loss, model)
        elif epoch - best[0] >= patience:
            break
    if path is not None:
        best[2].write().overwrite().save(path)
    return TrainedClassifier(best[2], history, best[0])


def load_classifier(path: str) -> MultilayerPerceptronClassificationModel:
    """A model saved by ``train_classifier``."""
    return MultilayerPerceptronClassificationModel.load(path)


def score_rows(rows: DataFrame, model: MultilayerPerceptronClassificationModel) -> DataFrame:
    """``rows`` with ``p``, ``y`` and the class at one half, ``predicted``."""
    probability = vector_to_array("probability")[1]
    scored = model.transform(rows).withColumns(
        {"p": probability, "y": F.col("label").cast("double")}
    )
    return scored.withColumn("predicted", predicted(F.col("p"))).drop(
        "rawPrediction", "probability", "prediction"
    )


def evaluate(scored: DataFrame) -> DataFrame:
    """Cross-entropy and accuracy by split."""
    return loss_and_accuracy(scored, ["split"])
