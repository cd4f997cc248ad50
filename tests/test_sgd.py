"""Descent in partitions against exact minimisers."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from strideline.operators import sgd

N = 1500


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(N, 3))
    score = x @ [1.0, -1.5, 0.0] + 0.3
    y = score + r.normal(size=N)
    kind = np.where(y > 1.2, 2, np.where(y > -0.5, 1, 0))
    rows = [(i, [float(v) for v in a], float(b), float(b > 0), float(k), 1.0 + i % 2) for i, (a, b, k) in enumerate(zip(x, y, kind, strict=True))]
    df = spark.createDataFrame(rows, "id int, x array<double>, number double, label double, kind double, weight double")
    return df.withColumn("features", array_to_vector("x")).repartition(3, "id"), x, y, np.array([r[-1] for r in rows])


def _objective(kind, w, z, y, own, penalty, epsilon=0.1):
    return np.average(sgd.loss_and_slope(kind, z @ w, y, epsilon)[0], weights=own) + penalty / 2 * (w[1:] ** 2).sum()


def _least(kind, z, y, own, penalty):
    """Gradient descent on all rows with a falling step, for very long."""
    w, best = np.zeros(z.shape[1]), np.inf
    for t in range(6000):
        slope = sgd.loss_and_slope(kind, z @ w, y, 0.1)[1] * own
        g = z.T @ slope / own.sum()
        g[1:] += penalty * w[1:]
        w = w - (1.0 if kind != "hinge" else 1.0 / (1 + t / 50)) * g
        best = min(best, _objective(kind, w, z, y, own, penalty)) if t % 10 == 0 else best
    return best


@pytest.mark.parametrize("kind", ["log", "hinge", "squared", "huber"])
def test_objective_is_within_a_hundredth_of_the_least(data, kind):
    df, x, number, own = data
    classes = kind in ("log", "hinge")
    y = np.where(number > 0, 1.0, -1.0) if classes else number
    model = sgd.SGD(kind, label="label" if classes else "number", weight="weight", penalty=1e-2).fit(df)
    z = np.hstack([np.ones((N, 1)), x])
    least = _least(kind, z, y, own, 1e-2)
    got = _objective(kind, model.weights[0], z, y, own, 1e-2)
    assert got == pytest.approx(min(model.curve)) and least * 0.999 < got <= least * 1.01
    told = model.transform(df).select("id", "prediction", *(["rawPrediction"] if classes else [])).collect()
    margin = z @ model.weights[0]
    for t in told[::97]:
        assert t["prediction"] == pytest.approx(float(margin[t["id"]] > 0) if classes else margin[t["id"]])


def test_three_classes_side_by_side(data):
    df = data[0]
    model = sgd.SGD("log", classes=3, label="kind").fit(df)
    told = model.transform(df).select("kind", "prediction", "probability").collect()
    assert np.mean([t["kind"] == t["prediction"] for t in told]) > 0.6
    assert all(t["probability"].toArray().sum() == pytest.approx(1) for t in told[:20]) and model.weights.shape == (3, 4)


def test_no_rows(data):
    with pytest.raises(ValueError):
        sgd.SGD().fit(data[0].limit(0))


def test_walks_side_by_side_reach_the_same_minimum(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=(20_000, 2))
    rows = [([float(a), float(b)], float(a - b + 0.5 * e > 0)) for (a, b), e in zip(x, r.normal(size=20_000))]
    df = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    one = sgd.SGD("log").fit(df)
    monkeypatch.setattr(sgd, "WALK", 300)
    seen, plain = [], sgd.SGD._epoch
    monkeypatch.setattr(sgd.SGD, "_epoch", lambda self, *a: seen.append(a[-1]) or plain(self, *a))
    many = sgd.SGD("log").fit(df)
    assert max(seen) > 1 and min(many.curve) < 1.01 * min(one.curve)


def test_folds_side_by_side_learn_from_the_other_rows_in_the_same_passes(spark, monkeypatch):
    r = np.random.default_rng(9)
    x = r.normal(size=(1500, 2))
    y = (x[:, 0] - 2 * x[:, 1] + 0.5 * r.normal(size=1500) > 0).astype(float)
    y[::3] = 1 - y[::3]  # fold 0 has it the other way round
    rows = [([float(v) for v in a], float(b), i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "x array<double>, label double, fold int").withColumn("features", array_to_vector("x"))
    passes, plain = [], sgd.SGD._epoch
    monkeypatch.setattr(sgd.SGD, "_epoch", lambda *a: (passes.append(1), plain(*a))[1])
    models = sgd.SGD("log", 2, epochs=15).fit_folds(df, "fold", 3)
    assert len(passes) <= 16
    for i, m in enumerate(models):
        alone = sgd.SGD("log", 2, epochs=15).fit(df.filter(f"fold != {i}"))
        assert abs(min(m.curve) - min(alone.curve)) < 0.02 * min(alone.curve)
    assert models[0].weights[0, 1] > 0.3 and models[0].weights[0, 2] < -0.6
