"""Learners on planted rules, and fitted figures against numpy."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from strideline.operators import evaluate, models, prep, stats

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    """Label 1 where a + b is positive, with a margin; c is noise; y is linear with noise."""
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 3))
    x[:, 0] += np.sign(x[:, 0] + x[:, 1]) * 0.3
    label = (x[:, 0] + x[:, 1] > 0).astype(float)
    y = 3 * x[:, 0] - 2 * x[:, 1] + 1 + 0.1 * r.normal(size=400)
    rows = [(i, *map(float, v), float(k), float(t), i % 5) for i, (v, k, t) in enumerate(zip(x, label, y))]
    df = spark.createDataFrame(rows, "row bigint, a double, b double, c double, label double, y double, fold int")
    df = models.balanced(VectorAssembler(inputCols=COLS, outputCol="features").transform(df), "label").cache()
    return df, x, label, y


def _accuracy(df):
    return df.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


@pytest.mark.parametrize("name", sorted(models.LEARNERS))
def test_classifiers_find_a_planted_rule(planted, name):
    df = planted[0]
    told = models.LEARNERS[name](3, 2).fit(df.filter("fold != 0")).transform(df.filter("fold = 0"))
    assert _accuracy(told) > 0.85 and told.select("prediction").distinct().count() == 2


def test_three_classes(planted):
    df = planted[0].withColumn("label", F.when(F.col("c") > 0.5, 2.0).otherwise(F.col("label")))
    for name in ("linear_svm", "boosted_trees", "logistic_l2"):
        told = models.LEARNERS[name](3, 3).fit(df).transform(df)
        assert _accuracy(told) > 0.8 and told.select("prediction").distinct().count() == 3


@pytest.mark.parametrize("name", sorted(models.REGRESSORS))
def test_regressors_find_a_planted_line(planted, name):
    df, _, _, y = planted
    told = models.REGRESSORS[name]().setLabelCol("y").fit(df.filter("fold != 0")).transform(df.filter("fold = 0"))
    error = told.agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]
    assert error < 0.5 * y.std()


def test_least_squares_and_ridge_equal_numpy(planted):
    df, x, _, y = planted
    design = np.column_stack([x, np.ones(len(x))])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    model = models.REGRESSORS["linear"]().setLabelCol("y").fit(df)
    assert np.allclose([*model.coefficients, model.intercept], want, atol=1e-6)
    # The penalty applies to standardised columns.
    ridge = models.REGRESSORS["ridge"]().setLabelCol("y").fit(df)
    scale, centred = x.std(axis=0, ddof=1), x - x.mean(axis=0)
    z = centred / scale
    sy = y.std(ddof=1)
    beta = np.linalg.solve(z.T @ z / len(x) + np.eye(3) / sy, z.T @ (y - y.mean()) / len(x)) / scale
    assert np.allclose(ridge.coefficients.toArray(), beta, atol=0.02)


def test_logistic_gradient_vanishes(planted):
    df, x, label, _ = planted
    model = models.LEARNERS["logistic_l2"](3, 2).setMaxIter(200).setTol(1e-10).setStandardization(False).fit(df)
    beta, b0 = model.coefficients.toArray(), model.intercept
    k = np.array([label.sum(), len(label) - label.sum()])
    w = np.where(label == 1, len(label) / (2 * k[0]), len(label) / (2 * k[1]))
    p = 1 / (1 + np.exp(-(x @ beta + b0)))
    assert np.abs((w * (p - label)) @ x / w.sum() + 0.01 * beta).max() < 1e-5
    assert abs((w * (p - label)).sum() / w.sum()) < 1e-5


def test_conditional_logit_gradient_vanishes(spark):
    r = np.random.default_rng(2)
    rows = []
    for race in range(80):
        x = r.normal(size=(6, 2))
        p = np.exp(x @ [1.0, -0.5])
        won = r.choice(6, p=p / p.sum())
        rows += [(race, float(a), float(b), float(i == won)) for i, (a, b) in enumerate(x)]
    beta = np.array(models.conditional_logit(spark.createDataFrame(rows, "race int, a double, b double, won double"), "race", "won", ["a", "b"]))
    m = np.array(rows)
    g = np.zeros(2)
    for race in range(80):
        part = m[m[:, 0] == race]
        e = np.exp(part[:, 1:3] @ beta)
        g += part[part[:, 3] == 1][0, 1:3] - (e / e.sum()) @ part[:, 1:3]
    assert np.abs(g).max() < 1e-5 and beta[0] > 0.5 and beta[1] < -0.1


def test_boosting_bagging_self_training_ridge_sign(planted):
    df = planted[0]
    train, test = df.filter("fold != 0"), df.filter("fold = 0")
    assert _accuracy(models.adaboost(train, test, "label", 4)) > 0.85
    coin = train.withColumn("features", F.lit(None)).drop("features").withColumn("zero", F.lit(0.0))
    coin = VectorAssembler(inputCols=["zero"], outputCol="features").transform(coin)
    flat = models.adaboost(coin.withColumn("label", (F.col("row") % 2).cast("double")), coin.limit(5), "label", 3)
    assert flat.select("prediction").distinct().count() == 1  # rounds that are no better than chance take no part
    bagged = models.bagging(train, test, ["row"], "label", 3).select("label", (F.col("prediction") > 0.5).cast("double").alias("prediction"))
    assert _accuracy(bagged) > 0.85
    hidden = train.withColumn("label", F.when(F.col("fold") < 3, F.col("label")))
    model, n = models.self_training(hidden, "label", 2, 0.75)
    assert _accuracy(model.transform(test)) > 0.85 and n > hidden.filter("label is not null").count()
    assert _accuracy(models.ridge_classifier(train, test, "label")) > 0.85


def test_folds_search_and_stacked_scores(planted):
    df = planted[0]
    oof = evaluate.out_of_fold(df, models.LEARNERS["logistic_l2"](3, 2), "fold", 5)
    assert oof.count() == 400 and oof.select("row").distinct().count() == 400
    assert all(r["accuracy"] > 0.85 and r["n"] == 80 for r in evaluate.fold_scores(oof, "fold", "label").collect())
    from pyspark.ml.classification import LogisticRegression

    found = evaluate.search(df, lambda **p: LogisticRegression(maxIter=20, **p), [{"regParam": 0.001}, {"regParam": 100.0, "elasticNetParam": 1.0}], "fold", 5, "label").collect()
    assert [r["best"] for r in sorted(found, key=lambda r: r["candidate"])] == [True, False]
    assert len(evaluate.draw({"a": [1, 2], "b": [1, 2, 3]}, 6)) == 6 and evaluate.draw({"a": [1, 2]}, 2) == evaluate.draw({"a": [1, 2]}, 2)


def test_calibration_is_a_fitted_sigmoid(planted):
    df, x, label, _ = planted
    scored = df.withColumn("score", F.col("a") + F.col("b") + F.col("c"))
    got = sorted(models.calibrate(scored, "label", "score").select("row", "score", "calibrated").collect())
    s, p = np.array([r["score"] for r in got]), np.array([r["calibrated"] for r in got])
    assert abs((p - label).mean()) < 1e-4 and abs(((p - label) * s).mean()) < 1e-4
    iso = sorted(models.calibrate(scored, "label", "score", "isotonic").select("score", "calibrated").collect())
    assert all(a["calibrated"] <= b["calibrated"] + 1e-12 for a, b in zip(iso, iso[1:]))


def test_chained_imputation_equals_numpy(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=100), r.normal(size=100)
    c = 2 * a - b + 0.5
    rows = [(float(p), float(q), None if i % 7 == 0 else float(v)) for i, (p, q, v) in enumerate(zip(a, b, c))]
    out = prep.iterative_fill(spark.createDataFrame(rows, "a double, b double, c double"), COLS, 1).collect()
    assert np.allclose([x["c"] for x in out], [2 * x["a"] - x["b"] + 0.5 for x in out], atol=1e-6)


def test_selection_and_elimination_keep_the_planted_features(planted):
    df = planted[0]
    both = prep.select_best(df, "label", k=2).withColumn("v", vector_to_array("chosen")).first()
    assert np.allclose(both["v"], [both["a"], both["b"]])
    few = prep.select_best(df, "label", alpha=1e-9).withColumn("v", vector_to_array("chosen")).first()
    assert np.allclose(few["v"], [few["a"], few["b"]])
    rounds = sorted(prep.recursive_elimination(df, COLS, "label", "fold", 5).collect(), key=lambda r: -r["n_features"])
    assert rounds[0]["dropped"] == "c" and [r["n_features"] for r in rounds] == [3, 2, 1] and sum(r["best"] for r in rounds) == 1
    assert max(rounds, key=lambda r: r["best"])["n_features"] >= 2


def test_expansion_and_components(planted):
    df, x, _, _ = planted
    v = prep.chain(COLS, degree=2).fit(df.drop("features")).transform(df.drop("features")).select("row", vector_to_array("features").alias("v"))
    assert len(v.first()["v"]) == prep.expanded_width(3, 2) == 9
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    pcs = prep.chain(COLS, components=2).fit(df.drop("features")).transform(df.drop("features"))
    got = np.array([r["v"] for r in pcs.select("row", vector_to_array("features").alias("v")).orderBy("row").collect()])
    axes = np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs(z @ axes), atol=1e-6)


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(4)
    v = r.integers(0, 50, 201).astype(float)
    df = spark.createDataFrame([(float(x), None if i % 3 else float(i)) for i, x in enumerate(v)], "v double, w double")
    got = {(q["column"], q["share"]): q["q"] for q in stats.exact_quantiles(df, ["v", "w"], [0.0, 0.1, 0.5, 0.73, 1.0]).collect()}
    w = np.array([i for i in range(201) if i % 3 == 0], float)
    for s in (0.0, 0.1, 0.5, 0.73, 1.0):
        assert abs(got["v", s] - np.quantile(v, s)) < 1e-9 and abs(got["w", s] - np.quantile(w, s)) < 1e-9
    assert stats.exact_quantiles(df.limit(0), ["v"], [0.5]).count() == 0


def test_chained_imputation_moves_no_rows_by_pattern(spark):
    rows = [(float(i), float(i % 5), None if i % 2 else 1.0) for i in range(60)]
    out = prep.iterative_fill(spark.createDataFrame(rows, "a double, b double, c double"), COLS, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_elimination_fits_all_folds_in_the_same_passes(planted, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    from strideline.operators import logistic

    df, passes, plain = planted[0], [], logistic._pass
    monkeypatch.setattr(logistic, "_pass", lambda *a: passes.append(1) or plain(*a))
    rows, _ = logistic.alike_rows(df.union(df), "label", "fold", "weight")
    assert rows.count() == 400 and rows.agg(F.sum("n")).first()[0] == 800
    noisy = df.withColumn("label", F.when(F.col("row") % 4 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    rows, _ = logistic.alike_rows(noisy, "label", "fold", "weight")
    passes.clear()
    beta, accuracy = logistic.fit_subsets(rows, [0, -1], np.array([[True, True, True, True], [True, True, False, True]]))
    assert len(passes) < 15 and np.isnan(accuracy[1]) and beta[1][2] == 0
    model = LogisticRegression(weightCol="weight", maxIter=200, tol=1e-12, standardization=False).fit(noisy.filter("fold != 0"))
    assert np.allclose(beta[0], [model.intercept, *model.coefficients], atol=1e-4)
    told = model.transform(noisy.filter("fold = 0")).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert abs(told - accuracy[0]) < 1e-9
