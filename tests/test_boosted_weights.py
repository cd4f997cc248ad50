"""Boosting by class probabilities and chained imputation against plain versions."""

import numpy as np
from pyspark.ml.functions import array_to_vector

from strideline.operators import models, prep


def _stump(x, y, w, classes):
    """Class shares on both sides of the cut with the least weighted Gini impurity."""
    best = None
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            impurity = 0.0
            for side in (left, ~left):
                p = np.array([w[side & (y == c)].sum() for c in range(classes)])
                impurity += p.sum() - (p**2).sum() / p.sum()
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, left
    p = np.zeros((len(y), classes))
    for side in (best[1], ~best[1]):
        p[side] = [w[side & (y == c)].sum() / w[side].sum() for c in range(classes)]
    return p


def test_three_rounds_equal_numpy(spark):
    r = np.random.default_rng(5)
    n, classes = 150, 3
    x = np.stack([r.integers(0, 7, n), r.integers(0, 5, n)], axis=1).astype(float)
    y = np.digitize(x[:, 0] + 0.7 * x[:, 1] + r.normal(size=n), [3.5, 5.5])
    w, said = np.ones(n), np.zeros((n, classes))
    for _ in range(3):
        logs = np.log(np.maximum(_stump(x, y, w, classes), 2.0**-52))
        own = np.where(y[:, None] == np.arange(classes), 1.0, -1 / (classes - 1))
        w = w * np.exp(-(classes - 1) / classes * (own * logs).sum(axis=1))
        w /= w.sum()
        said += (classes - 1) * (logs - logs.mean(axis=1, keepdims=True))
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id int, x array<double>, label double").withColumn("features", array_to_vector("x"))
    told = {t["id"]: t["prediction"] for t in models.adaboost(df, df, "label", 3, depth=1, classes=classes).collect()}
    assert all(told[i] == said[i].argmax() for i in range(n))


def test_many_rounds_and_three_classes(spark):
    r = np.random.default_rng(6)
    x = r.uniform(0, 1, (300, 2))
    y = np.where(x[:, 0] < 0.4, 0, np.where(x[:, 1] < 0.5, 1, 2))
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "x array<double>, label double").withColumn("features", array_to_vector("x")).repartition(2)
    told = models.adaboost(df, df, "label", 12, depth=1, classes=3).select("label", "prediction").collect()
    assert np.mean([t["label"] == t["prediction"] for t in told]) > 0.93


def test_chained_imputation_equals_rounds_of_regressions(spark):
    r = np.random.default_rng(7)
    n = 120
    x = r.normal(size=(n, 3))
    x[:, 2] = x[:, 0] - 2 * x[:, 1] + 0.3 * r.normal(size=n)
    gone = r.random((n, 3)) < 0.2
    gone[0] = True
    want = np.where(gone, np.nanmean(np.where(gone, np.nan, x), axis=0), x)
    for _ in range(4):
        for c in range(3):
            others = [j for j in range(3) if j != c]
            z = np.hstack([np.ones((n, 1)), want[:, others]])
            beta = np.linalg.lstsq(z[~gone[:, c]], x[~gone[:, c], c], rcond=None)[0]
            want[gone[:, c], c] = z[gone[:, c]] @ beta
    rows = [(i, *[None if g else float(v) for v, g in zip(a, b, strict=True)], "k") for i, (a, b) in enumerate(zip(x, gone, strict=True))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, other string")
    got = {t["id"]: (t["a"], t["b"], t["c"]) for t in prep.iterative_fill(df, ["a", "b", "c"], 4).collect()}
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-8)
    plans = [len(prep.iterative_fill(df, ["a", "b", "c"], k)._jdf.queryExecution().toString()) for k in (1, 6)]
    assert abs(plans[0] - plans[1]) < 0.2 * plans[0]


def test_alike_rows_are_boosted_as_one(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = r.integers(0, 4, (60, 2))
    y = (x.sum(axis=1) + r.integers(0, 2, 60) > 3).astype(float)
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)] * 50
    df = spark.createDataFrame(rows, "x array<double>, label double").withColumn("features", array_to_vector("x"))
    written = {}
    save = models.Scratch.save

    def counted(self, rows, label):
        out = save(self, rows, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(models.Scratch, "save", counted)
    told = models.adaboost(df, df, "label", 2, depth=1).select("label", "prediction")
    different = len({(*a, b) for a, b in zip(x.tolist(), y, strict=True)})
    assert {written[f"train-{k}"] for k in range(3)} == {different} and written["told"] == 3000
    assert told.filter("label = prediction").count() > 2000


def test_rounds_learn_from_cells_and_are_seldom_written(spark, monkeypatch):
    """Cells are bounded by the bins and written after 1, 2, 4, 8 rounds; when they are written changes nothing."""
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 2))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id int, x array<double>, label double").withColumn("features", array_to_vector("x"))
    written, save = {}, models.Scratch.save
    monkeypatch.setattr(models.Scratch, "save", lambda self, df, label: (out := save(self, df, label), written.update({label: out.count()}))[0])
    first = {r["id"]: r["prediction"] for r in models.adaboost(df, df, "label", 12).collect()}
    assert [k for k in written if k != "told"] == [f"train-{k}" for k in (0, 1, 2, 4, 8)] and written["train-8"] <= 2 * 32 * 32
    assert np.mean([first[i] == b for i, b in enumerate(y)]) > 0.95
    again = models.adaboost(df, df, "label", 12, keep_every=3)
    assert "train-10" in written and {r["id"]: r["prediction"] for r in again.collect()} == first
