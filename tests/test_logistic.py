"""Logistic regressions fitted side by side against conditions of their least objective and Spark's own."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector

from strideline.operators import logistic

N, K = 300, 3


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(N, 3)) * [1.0, 2.0, 0.5]
    y = (x @ [1.2, -0.6, 0.0] + 0.4 + r.logistic(size=N) > 0).astype(float)
    w, fold = r.uniform(0.5, 2, N), r.integers(0, K, N)
    rows = [([float(v) for v in a], float(b), float(c), int(f)) for a, b, c, f in zip(x, y, w, fold, strict=True)]
    df = spark.createDataFrame(rows, "x array<double>, label double, weight double, fold int").withColumn("features", array_to_vector("x"))
    return df.repartition(3), x, y, w, fold


def test_every_model_is_at_its_least(data, monkeypatch):
    df, x, y, w, fold = data
    monkeypatch.setattr(logistic, "MOST", 200)  # several groups
    candidates = [(0.0, 0.0), (0.1, 0.0), (0.02, 1.0), (0.05, 0.5), (5.0, 1.0)]
    betas, accuracy = logistic.fit_grid(df, candidates, K)
    for (penalty, share), of_folds, hits in zip(candidates, betas, accuracy, strict=True):
        for f, (b, hit) in enumerate(zip(of_folds, hits, strict=True)):
            own = fold != f
            p = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
            g = np.array([np.average((p - y)[own] * c[own], weights=w[own]) for c in (np.ones(N), *x.T)])
            assert abs(g[0]) < 1e-7
            for c, slope in zip(b[1:], g[1:] + penalty * (1 - share) * b[1:], strict=True):
                assert abs(slope + penalty * share * np.sign(c)) < 1e-7 if c else abs(slope) <= penalty * share + 1e-7
            held = ~own
            assert hit == pytest.approx(np.mean((p[held] > 0.5) == (y[held] > 0.5)))
    assert not betas[-1][:, 1:].any()


def test_equal_to_sparks_learner(data):
    df = data[0]
    betas, _ = logistic.fit_grid(df, [(0.05, 0.0)], K)
    model = LogisticRegression(regParam=0.05, weightCol="weight", standardization=False, tol=1e-12, maxIter=300).fit(df.filter("fold != 1"))
    assert np.allclose(betas[0, 1], [model.intercept, *model.coefficients], atol=1e-5)


def test_search_names_the_first_best(data):
    got = sorted(logistic.search(data[0], [(0.01, 0.0), (0.01, 0.0), (9.0, 1.0)], K).collect(), key=lambda r: r["candidate"])
    assert [r["best"] for r in got] == [True, False, False] and got[0]["mean_accuracy"] == got[1]["mean_accuracy"] > got[2]["mean_accuracy"]


def test_separable_rows_end(spark):
    rows = [([float(i)], float(i > 0), 1.0, i % 2) for i in range(-20, 21) if i]
    df = spark.createDataFrame(rows, "x array<double>, label double, weight double, fold int").withColumn("features", array_to_vector("x"))
    betas, accuracy = logistic.fit_grid(df, [(0.01, 0.0), (0.01, 1.0)], 3)
    assert np.isfinite(betas).all() and (accuracy[:, :2] == 1).all() and np.isnan(accuracy[:, 2]).all()
