"""Learners by name, and those that Spark ML lacks as loops of Spark jobs.

Only fitted coefficients and metric rows reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideline.operators.adaboost import boosted
from strideline.operators.boosting import HistogramTrees
from strideline.operators.forest import Forest, OnCells
from strideline.operators.moments import LeastSquares
from strideline.operators.neighbours import nearest_rows
from strideline.operators.perceptron import Perceptron
from strideline.operators.sgd import SGD
from strideline.sources.scratch import Scratch

#: name -> learner of (inputs, classes). ``weight`` is the column of row weights.
LEARNERS: dict[str, Callable] = {
    "logistic_l2": lambda d, k: LogisticRegression(regParam=0.01, weightCol="weight", maxIter=20),
    "logistic_l1": lambda d, k: LogisticRegression(regParam=0.01, elasticNetParam=1.0, weightCol="weight", maxIter=20),
    "perceptron_layers": lambda d, k: Perceptron(hidden=1000, classes=k),
    "boosted_trees": lambda d, k: OnCells(_binary(GBTClassifier(maxIter=100, maxDepth=3, seed=42, weightCol="weight"), k)),
    "histogram_trees": lambda d, k: HistogramTrees(classes=k, weight="weight"),
    "tree": lambda d, k: OnCells(DecisionTreeClassifier(maxDepth=10, weightCol="weight", seed=42)),
    "forest": lambda d, k: Forest(classes=k, weight="weight"),
    "linear_svm": lambda d, k: _binary(LinearSVC(weightCol="weight", maxIter=20, regParam=0.01), k),
    "log_sgd": lambda d, k: SGD("log", k, weight="weight"),
    "hinge_sgd": lambda d, k: SGD("hinge", k, weight="weight"),
}
REGRESSORS: dict[str, Callable] = {
    "linear": lambda: LinearRegression(),
    "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0),
    "lasso": lambda: LinearRegression(regParam=0.01, elasticNetParam=1.0),
    "huber": lambda: LinearRegression(loss="huber", maxIter=50),
    "forest_regression": lambda: Forest(classes=0),
}


def _binary(learner, classes: int):
    return learner if classes == 2 else OneVsRest(classifier=learner, weightCol="weight")


def balanced(df: DataFrame, label: str, by: DataFrame | None = None) -> DataFrame:
    """Adds ``weight`` = n / (k n_c) of ``by`` (the training rows), by a join with one row a class."""
    from strideline.operators.stats import balanced_weights

    w = balanced_weights(df if by is None else by, label).select(F.col(label).alias("__l"), "weight")
    return df.join(F.broadcast(w), F.col(label) == F.col("__l")).drop("__l")  # one row a class of a classifier


def alike(df: DataFrame, label: str, weight: str | None = None, *within: str) -> DataFrame:
    """features, label, weight and the columns ``within`` of rows alike in all but weight: one for all, with the sum of their weights.

    Sums over the rows stay the same, and a pass costs what there is of different rows.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    seen = df.groupBy(vector_to_array("features").alias("__x"), F.col(label).cast("double").alias(label), *within).agg(F.sum(w).alias("weight"))
    return seen.repartition(df.sparkSession.sparkContext.defaultParallelism).select(array_to_vector("__x").alias("features"), label, "weight", *within)


def ridge_classifier(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Ridge regression on -1 and 1 with penalty 1; the sign is the class."""
    return LeastSquares(1.0, signed=True, label=label, weight="weight").fit(train).transform(test)


def self_training(train: DataFrame, label: str, rounds: int = 3, sure: float = 0.75) -> tuple[object, int]:
    """Fit on rows with a label, take over confident labels, fit again. The model and the rows labelled at the end."""
    labelled = train.filter(F.col(label).isNotNull())
    rest = train.filter(F.col(label).isNull())
    model = LogisticRegression(labelCol=label, maxIter=20).fit(labelled)
    n = labelled.count()
    for _ in range(rounds):
        p = model.transform(rest)
        promoted = p.filter(F.array_max(vector_to_array("probability")) >= sure).withColumn(label, F.col("prediction"))
        known = labelled.unionByName(promoted.select(labelled.columns))
        now = known.count()
        if now == n:
            break
        model, n = LogisticRegression(labelCol=label, maxIter=20).fit(known), now
    return model, n


def conditional_logit(runs: DataFrame, race: str, won: str, cols: list[str], steps: int = 8) -> list[float]:
    """Newton's method on the within-race softmax; one job a step, d by d sums to the driver."""
    beta = np.zeros(len(cols))
    for _ in range(steps):
        eta = sum((F.col(c) * F.lit(float(b)) for c, b in zip(cols, beta, strict=True)), F.lit(0.0))
        w = Window.partitionBy(race)
        p = runs.withColumn("__e", eta).withColumn("__e", F.exp(F.col("__e") - F.max("__e").over(w)))
        p = p.withColumn("__p", F.col("__e") / F.sum("__e").over(w))
        means = [F.sum(F.col("__p") * F.col(c)).alias(f"m{i}") for i, c in enumerate(cols)]
        seconds = [F.sum(F.col("__p") * F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
        seen = [F.sum(F.col(won) * F.col(c)).alias(f"y{i}") for i, c in enumerate(cols)]
        per = p.groupBy(race).agg(*means, *seconds, *seen, F.sum(won).alias("__w"))
        d = range(len(cols))
        row = per.agg(
            *[F.sum(F.col(f"y{i}") - F.col("__w") * F.col(f"m{i}")).alias(f"g{i}") for i in d],
            *[F.sum(F.col("__w") * (F.col(f"s{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}"))).alias(f"h{i}_{j}") for i in d for j in d if i <= j],
        ).first()
        g = np.array([row[f"g{i}"] for i in d])
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in d] for i in d])
        step = np.linalg.solve(h + 1e-9 * np.eye(len(cols)), g)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def nearest(base: DataFrame, asked: DataFrame, key: str, vector: str, label: str, k: int = 15) -> DataFrame:
    """Class and mean label of the k nearest rows, exact, by squared distance, ties by key."""
    best = nearest_rows(base, asked, key, vector, label, k)
    votes = best.groupBy("asked", "l").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("asked").agg(
        F.max_by("l", F.struct("n", -F.col("l"))).alias("vote"), (F.sum(F.col("l") * F.col("n")) / F.sum("n")).alias("mean_label")
    )


def hash_unit(*keys: Column | str) -> Column:
    """A repeatable number in [0, 1) of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) value of a uniform number, to 5."""
    out, total = F.lit(5.0), 0.0
    steps = []
    for n in range(5):
        total += math.exp(-1) / math.factorial(n)
        steps.append((total, float(n)))
    for limit, n in reversed(steps):
        out = F.when(u < limit, F.lit(n)).otherwise(out)
    return out


def bagging(train: DataFrame, test: DataFrame, key: list[str], label: str, members: int = 10) -> DataFrame:
    """Mean prediction of regressions on Poisson-weighted rows; repeatable by hash."""
    out = test
    for m in range(members):
        rows = train.withColumn("__w", poisson_weight(hash_unit(*key, F.lit(m)))).filter("__w > 0")
        model = LinearRegression(labelCol=label, weightCol="__w", predictionCol=f"__p{m}", regParam=0.01).fit(rows)
        out = model.transform(out)
    mean = sum((F.col(f"__p{m}") for m in range(members)), F.lit(0.0)) / members
    return out.withColumn("prediction", mean).drop(*[f"__p{m}" for m in range(members)])


def adaboost(
    train: DataFrame, test: DataFrame, label: str, rounds: int = 50, depth: int = 2, classes: int = 2, rate: float = 1.0, keep_every: int = 50
) -> DataFrame:
    """Boosting of trees by class probabilities (SAMME.R): adds ``prediction`` to ``test``. The trees grow over cells of binned rows."""
    scratch = Scratch(train.sparkSession, "boost")
    return scratch.save(boosted(train, test, label, scratch, rounds, depth, classes, rate, keep_every), "told")


def calibrate(scored: DataFrame, label: str, score: str, how: str = "sigmoid") -> DataFrame:
    """Adds ``calibrated``: the probability by logistic, or isotonic, regression of the label on out-of-fold scores."""
    from pyspark.ml.feature import VectorAssembler

    if how == "isotonic":
        return IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated").fit(scored).transform(scored)
    v = VectorAssembler(inputCols=[score], outputCol="__s").transform(scored)
    model = LogisticRegression(featuresCol="__s", labelCol=label, predictionCol="__a", rawPredictionCol="__b", probabilityCol="__c").fit(v)
    return model.transform(v).withColumn("calibrated", F.get(vector_to_array("__c"), F.lit(1))).drop("__s", "__a", "__b", "__c")
