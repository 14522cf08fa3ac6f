import numpy as np
import pytest
from pyspark.sql import functions as F

from driftflow.operators import models, network


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    widths = [4, 6, 5, 1]
    flat = network.first_weights(widths, 3) + 0.1 * rng.standard_normal(4 * 6 + 6 + 6 * 5 + 5 + 5 + 1)
    x, y = rng.standard_normal((30, 4)), (rng.random(30) < 0.5).astype(float)
    masks = [(rng.random((30, n)) >= 0.2) / 0.8 for n in widths[1:-1]]

    def loss(weights):
        h = x
        layers = network.layers_of(weights, widths)
        for w, m in zip(layers[:-1], masks):
            h = np.maximum(h @ w[:-1] + w[-1], 0) * m
        z = (h @ layers[-1][:-1] + layers[-1][-1])[:, 0]
        return np.mean(np.logaddexp(0, z) - y * z)

    slope = network.gradient(x, y, network.layers_of(flat, widths), masks)
    for i in rng.choice(len(flat), 25, replace=False):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert slope[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-6)


@pytest.fixture(scope="module")
def ring(spark):
    """Class 1 lies inside a circle: no straight line tells the two apart."""
    rng = np.random.default_rng(2)
    x = rng.random((4000, 2))
    rows = [(i, float(a), float(b), int((a - 0.5) ** 2 + (b - 0.5) ** 2 < 0.16)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id int, a double, b double, target int").repartition(5)


@pytest.mark.parametrize("per_part, batch", [(10_000, 64), (600, 16)])
def test_learns_what_no_line_can(spark, ring, monkeypatch, per_part, batch):
    """In one part, and in five that are averaged in a tree."""
    monkeypatch.setattr(network, "FAN_IN", 2)
    made = network.Network(("a", "b"), hidden=(32, 16), dropout=0.1, epochs=40, batch=batch, rate=0.01, rows_per_part=per_part)
    model = models.fit(made, ring.where("id < 3000"))
    out = models.score(model, ring.where("id >= 3000"), "net", ["id"], threshold=0.5)
    assert out.columns == ["model", "id", "target", "predicted"] and out.count() == 1000
    assert out.where("target = predicted").count() > 950


def test_same_rows_same_weights_and_nulls(spark, ring):
    made = network.Network(("a", "b"), hidden=(8,), epochs=2, batch=64, rows_per_part=1000)
    once, again = (made.fit(ring) for _ in range(2))
    assert np.allclose(once.weights, again.weights)
    holes = spark.createDataFrame([(None, 0.5, 1), (0.5, 0.5, None), (0.5, 0.5, 1)], "a double, b double, target int")
    assert made.fit(holes.limit(0)).weights.shape == once.weights.shape
    assert np.isfinite(made.fit(holes).weights).all()
    told = once.transform(holes).select(F.col("probability")[1].alias("p"), "prediction").collect()
    assert told[0].p is None and told[0].prediction is None and told[1].p == told[2].p and 0 < told[1].p < 1
