"""Fits from sums against numpy fits of every fold, penalty and left-out row."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strideline.operators import moments

N, FOLDS = 240, 7


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    x = np.stack([r.normal(5, 2, N), r.normal(size=N), r.uniform(0, 100, N)], axis=1)
    y = 3 + x @ [0.5, -2.0, 0.0] + r.normal(size=N)
    w, fold = r.uniform(0.5, 2, N), r.integers(0, FOLDS, N)
    rows = [(i, [float(v) for v in a], float(b), float(c), int(f)) for i, (a, b, c, f) in enumerate(zip(x, y, w, fold, strict=True))]
    odd = [(900, [1.0, None, 2.0], 1.0, 1.0, 0), (901, [1.0, float("nan"), 2.0], 1.0, 1.0, 0), (902, [1.0, 1.0, 1.0], None, 1.0, 1), (903, [1.0, 1.0, 1.0], 1.0, 1.0, None)]
    df = spark.createDataFrame(rows + odd, "id int, x array<double>, y double, w double, fold int").repartition(5, "id")
    return df, x, y, w, fold


def _ridge(x, y, w, penalty):
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    a = (x - mx).T @ ((x - mx) * w[:, None]) + penalty * np.eye(x.shape[1])
    beta = np.linalg.solve(a, (x - mx).T @ ((y - my) * w))
    return np.concatenate([[my - mx @ beta], beta])


@pytest.mark.parametrize("weighted", [False, True])
def test_folds_and_penalties_equal_one_fit_each(data, weighted):
    df, x, y, w, fold = data
    w = w if weighted else np.ones(N)
    sums = moments.saved_moments(df, F.col("x"), F.col("y"), F.col("fold"), F.col("w") if weighted else None)
    got = {(r["fold"], r["penalty"]): r for r in moments.fold_errors(sums, [0.0, 2.5, 1000.0]).collect()}
    assert len(got) == 3 * FOLDS
    for (f, p), r in got.items():
        held = fold == f
        c = _ridge(x[~held], y[~held], w[~held], p)
        assert np.allclose(r["coefficients"], c, atol=1e-8)
        e = y[held] - c[0] - x[held] @ c[1:]
        assert r["mse"] == pytest.approx(np.average(e * e, weights=w[held])) and r["n"] == pytest.approx(w[held].sum())


def test_search_names_the_least_error(data):
    df = data[0]
    sums = moments.saved_moments(df, F.col("x"), F.col("y"), F.col("fold"))
    errors = moments.fold_errors(sums, [0.0, 10.0, 1e6])
    got = {r["penalty"]: r for r in moments.search(errors).collect()}
    assert [p for p, r in got.items() if r["best"]] == [min(got, key=lambda p: got[p]["mean_mse"])]


def test_every_row_left_out_once(data):
    df, x, y, _, _ = data
    known = df.filter("id < 900")
    got = {r["penalty"]: r for r in moments.leave_one_out(known, F.col("x"), F.col("y"), [0.0, 50.0]).collect()}
    for p, r in got.items():
        e = []
        for i in range(N):
            # The penalty on centred inputs of all rows, with the row's own weight taken away.
            z = np.hstack([np.ones((N, 1)), x - x.mean(axis=0)])
            rest = np.arange(N) != i
            c = np.linalg.solve(z[rest].T @ z[rest] + p * np.diag([0, 1, 1, 1]), z[rest].T @ y[rest])
            e.append(y[i] - z[i] @ c)
        assert (r["n"], r["rmse"], r["mae"]) == (N, pytest.approx(np.sqrt(np.mean(np.square(e)))), pytest.approx(np.mean(np.abs(e))))


def test_lasso_meets_its_optimality_conditions(data):
    df, x, y, _, _ = data
    s = moments.Solver(moments.total(moments.fold_moments(df.filter("id < 900"), F.col("x"), F.col("y"), F.lit(0))))
    for penalty in (0.0, 0.3, 2.0, 1e4):
        c = s.lasso(penalty)
        pull = (x - x.mean(axis=0)).T @ (y - c[0] - x @ c[1:]) / N
        for b, g in zip(c[1:], pull, strict=True):
            assert abs(g - penalty * np.sign(b)) < 1e-6 if b else abs(g) <= penalty + 1e-6
    assert np.allclose(s.lasso(0.0), s.ridge(0.0), atol=1e-6) and not s.lasso(1e4)[1:].any()


def test_products_and_out_of_fold(spark, data):
    one = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert list(one.select(F.array(*moments.products(["a", "b"], 3)).alias("p")).first()["p"]) == [2, 3, 4, 6, 9, 8, 12, 18, 27]
    df, x, y, _, fold = data
    sums = moments.saved_moments(df, F.col("x"), F.col("y"), F.col("fold"))
    out = moments.out_of_fold(df, F.col("x"), F.col("fold"), moments.fold_errors(sums, [1.0]))
    got = {r["id"]: r["prediction"] for r in out.collect()}
    assert len(got) == N + 4 and got[903] is None
    for i in range(0, N, 17):
        held = fold == fold[i]
        c = _ridge(x[~held], y[~held], np.ones((~held).sum()), 1.0)
        assert got[i] == pytest.approx(c[0] + x[i] @ c[1:])


def test_learner_signs_and_flat_inputs(data):
    df, x, y, w, _ = data
    rows = df.filter("id < 900").withColumns({"label": (F.col("y") > 5).cast("double"), "features": array_to_vector(F.concat("x", F.array(F.lit(7.0))))})
    model = moments.LeastSquares(1.0, signed=True, weight="w").fit(rows)
    c = _ridge(x, np.where(y > 5, 1.0, -1.0), w, 1.0)
    assert np.allclose(model.coefficients, [*c, 0.0], atol=1e-8)  # a constant input has no part
    told = model.transform(rows).select("label", "prediction").collect()
    assert np.mean([t["label"] == t["prediction"] for t in told]) > 0.85
    flat = moments.LeastSquares(0.0).fit(rows.withColumn("label", F.col("y")))
    assert np.allclose(flat.coefficients, [*_ridge(x, y, np.ones(N), 0.0), 0.0], atol=1e-8)
