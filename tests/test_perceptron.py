"""The perceptron's gradient against differences, and a planted rule with alike rows held once."""

import numpy as np
from pyspark.ml.functions import array_to_vector

from strideline.operators import perceptron


def test_gradient_equals_differences():
    r = np.random.default_rng(3)
    x, y, n = r.normal(size=(20, 3)), r.integers(0, 3, 20), r.integers(1, 5, 20).astype(float)
    theta = r.normal(size=3 * 4 + 4 + 4 * 3 + 3)
    at = lambda t: perceptron._slope(x, y, n, perceptron._parts(t, 3, 4, 3))
    for i in range(len(theta)):
        e = np.eye(len(theta))[i] * 1e-6
        assert abs((at(theta + e)[-2] - at(theta - e)[-2]) / 2e-6 - at(theta)[i]) < 1e-5


def test_planted_rule_and_alike_rows_held_once(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 2)).round(2)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)] * 10
    df = spark.createDataFrame(rows, "x array<double>, label double").withColumn("features", array_to_vector("x"))
    written = []
    save = perceptron.Scratch.save
    monkeypatch.setattr(perceptron.Scratch, "save", lambda self, df, label: (out := save(self, df, label), written.append(out.count()))[0])
    model = perceptron.Perceptron(hidden=30, steps=60).fit(df)
    assert written[0] <= 300 and all(b <= a for a, b in zip(model.curve, model.curve[1:]))
    told = model.transform(df)
    assert told.filter("prediction = label").count() > 0.9 * 3000


def test_single_precision_is_kept_and_near_double():
    """The work of a chunk stays in single precision, also with far-off inputs, and its sums are near those of double precision."""
    r = np.random.default_rng(7)
    x, y, n = r.normal(size=(500, 4)), r.integers(0, 2, 500), r.integers(1, 9, 500).astype(float)
    x[0] = 1e4
    theta = r.normal(size=4 * 50 + 50 + 50 * 2 + 2)
    with np.errstate(over="raise"):
        a, logs = perceptron._forward(x.astype(np.float32), perceptron._parts(theta.astype(np.float32), 4, 50, 2))
    assert a.dtype == logs.dtype == np.float32 and np.isfinite(a).all() and np.isfinite(logs).all()
    single = perceptron._slope(x[1:].astype(np.float32), y[1:], n[1:].astype(np.float32), perceptron._parts(theta.astype(np.float32), 4, 50, 2))
    double = perceptron._slope(x[1:], y[1:], n[1:], perceptron._parts(theta, 4, 50, 2))
    assert np.abs(single - double).max() < 1e-4 * np.abs(double).max()
