"""Network tables, scores and gradients against numpy."""

import numpy as np
import pytest

from labeltext.operators import network


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 6))
    return x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(i, x.tolist(), float(y)) for i, (x, y) in enumerate(zip(*data))]
    return spark.createDataFrame(rows, "doc_id int, features array<double>, label double").repartition(4).cache()


def plain(layers, x):
    for layer in layers[:-1]:
        x = np.maximum(x @ layer[:, 1:].T + layer[:, 0], 0)
    return 1 / (1 + np.exp(-(x @ layers[-1][:, 1:].T + layers[-1][:, 0])[:, 0]))


def deep(seed=4):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=s) for s in ((4, 7), (3, 5), (1, 4))]


def test_table_round_trip_and_checks(spark):
    layers = deep()
    table = network.to_table(spark, layers)
    assert all(np.array_equal(a, b) for a, b in zip(layers, network.from_table(table)))
    for gap in ("NOT (layer = 0 AND unit = 1 AND input = 2)", "layer <> 1"):
        with pytest.raises(ValueError, match="grid"):
            network.from_table(table.where(gap))
    with pytest.raises(ValueError, match="units before"):
        network.from_table(network.to_table(spark, [layers[0], layers[2]]))
    with pytest.raises(ValueError, match="weights"):
        network.from_table(table, most=5)
    with pytest.raises(ValueError, match="grid"):
        network.from_table(table.unionByName(table))


def test_scores(spark, frame, data):
    layers = deep()
    got = {r.doc_id: (r.p, r.predicted) for r in network.score_rows(frame, network.to_table(spark, layers)).collect()}
    for i, p in enumerate(plain(layers, data[0])):
        assert got[i] == (pytest.approx(p), float(p > 0.5))


def test_gradients_are_finite_differences(frame, data):
    layers, (x, y) = deep(), data

    def loss(now):
        p = plain(now, x)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads, mean, n = network.gradients(frame, layers)
    assert n == 240 and mean == pytest.approx(loss(layers))
    for at, layer in enumerate(layers):
        for place in np.ndindex(layer.shape):
            up, down = [w.copy() for w in layers], [w.copy() for w in layers]
            up[at][place] += 1e-6
            down[at][place] -= 1e-6
            assert grads[at][place] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_training_learns_and_keeps_the_best_epoch(frame):
    train, valid = frame.where("doc_id % 3 > 0"), frame.where("doc_id % 3 = 0")
    trained = network.train(train, valid, hidden=6, epochs=4, steps=5, step_size=0.1, seed=2)
    rows = trained.history.orderBy("epoch").collect()
    assert rows[-1].train_loss < rows[0].train_loss < 0.75
    best = min(rows, key=lambda r: (r.val_loss, r.epoch))
    assert [r.epoch for r in rows if r.best] == [best.epoch]
    scored = network.loss_and_accuracy(network.score_rows(valid, trained.weights)).first()
    assert scored.bce == pytest.approx(best.val_loss) and scored.accuracy > 0.6
    with pytest.raises(ValueError, match="no training rows"):
        network.train(train.limit(0), valid)


def test_best_epoch_and_patience(spark):
    losses = [0.9, 0.5, 0.7, 0.5, 0.6, 0.4, 0.8]
    frame = spark.createDataFrame(list(enumerate(losses)), "epoch int, val_loss double")
    rows = network.best_epochs(frame, patience=3).orderBy("epoch").collect()
    assert [r.epoch for r in rows if r.best] == [5] and [r.epoch for r in rows if r.stop] == [4]
