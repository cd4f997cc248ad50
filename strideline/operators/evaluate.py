"""Evaluation and model selection. Metrics are aggregates of (label, prediction)."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """precision, recall, f1 and support of every class; a class without predictions has precision 0."""
    c = confusion(df, label, pred)
    sides = c.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("told")),
                F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("told")),
            )
        ).alias("s"),
        (F.col("label") == F.col("prediction")).alias("hit"),
    ).select("s.*", "hit")
    per = sides.groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("told").alias("told"), F.sum(F.when(F.col("hit"), F.col("support")).otherwise(0)).alias("tp")
    )
    p = F.coalesce(F.try_divide("tp", "told"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    per = per.select("cls", p.alias("precision"), r.alias("recall"), "support")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return per.withColumn("f1", f1)


def summary(df: DataFrame, label: str, pred: str) -> DataFrame:
    """accuracy, balanced accuracy (mean recall of the classes that occur), macro and weighted precision, recall and f1, as one row."""
    r = class_report(df, label, pred)
    one = [F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    one += [F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    one.append(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    return r.agg(*one).withColumn("accuracy", F.col("weighted_recall"))


def regression_errors(df: DataFrame, label: str, pred: str) -> DataFrame:
    e = F.col(pred) - F.col(label)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(-F.avg(-e * e)).alias("rmse_of_score"))


def hard_vote(df: DataFrame, members: list[str], out: str) -> DataFrame:
    """Most frequent member prediction, ties to the least class; within the row."""
    votes = F.array_sort(F.array(*[F.col(m) for m in members]))
    counted = F.transform(F.array_distinct(votes), lambda v: F.struct((F.size(votes) - F.size(F.array_remove(votes, v))).alias("n"), (-v).alias("v")))
    return df.withColumn(out, -F.array_max(counted)["v"])


def mean_vote(df: DataFrame, members: list[str], out: str) -> DataFrame:
    return df.withColumn(out, sum((F.col(m) for m in members), F.lit(0.0)) / len(members))


def out_of_fold(df: DataFrame, learner, fold: str, k: int) -> DataFrame:
    """Every row with the prediction of the model that has not seen its fold, and ``score`` of class 1."""
    parts = []
    for i in range(k):
        model = learner.copy().fit(df.filter(F.col(fold) != i))
        p = model.transform(df.filter(F.col(fold) == i))
        c = "probability" if "probability" in p.columns else "rawPrediction"
        parts.append(p.withColumn("score", F.get(vector_to_array(c), F.lit(1))).drop("rawPrediction", "probability"))
    return reduce(DataFrame.unionByName, parts)


def scored_out_of_fold(df: DataFrame, learners: dict[str, object], fold: str, k: int, alike: DataFrame | None = None) -> DataFrame:
    """Every row with each learner's ``score`` of class 1, under its name, by the model that has not seen the row's fold.

    A fold's rows go through all its models in turn, so rows are neither exchanged nor joined. ``alike`` has the same rows
    to learn from, alike ones as one with their summed weights; learners that take ``rows`` learn from the rows themselves. Those that have ``fit_folds`` learn
    all folds' models in the same passes.
    """
    parts = []
    together = {name: learner.fit_folds(df, fold, k) for name, learner in learners.items() if hasattr(learner, "fit_folds")}
    for i in range(k):
        out = df.filter(F.col(fold) == i)
        for name, learner in learners.items():
            by_row = alike is None or getattr(learner, "rows", False)
            model = together[name][i] if name in together else learner.copy().fit((df if by_row else alike).filter(F.col(fold) != i))
            p = model.transform(out)
            c = "probability" if "probability" in p.columns else "rawPrediction"
            out = p.withColumn(name, F.get(vector_to_array(c), F.lit(1))).drop("rawPrediction", "probability", "prediction")
        parts.append(out)
    return reduce(DataFrame.unionByName, parts)


def fold_scores(oof: DataFrame, fold: str, label: str) -> DataFrame:
    return oof.groupBy(F.col(fold).alias("fold")).agg(
        F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def draw(grid: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """n seeded draws from a grid, without repeats as far as it goes."""
    r, out = random.Random(seed), []
    for _ in range(20 * n):
        pick = {k: r.choice(v) for k, v in sorted(grid.items())}
        if pick not in out:
            out.append(pick)
        if len(out) == n:
            break
    return out


def search(df: DataFrame, make, candidates: list[dict], fold: str, k: int, label: str) -> DataFrame:
    """candidate, params, mean_accuracy and best, by out-of-fold accuracy."""
    frames = []
    for i, params in enumerate(candidates):
        oof = out_of_fold(df, make(**params), fold, k)
        s = fold_scores(oof, fold, label).agg(F.avg("accuracy").alias("mean_accuracy"))
        frames.append(s.select(F.lit(i).alias("candidate"), F.lit(str(params)).alias("params"), "mean_accuracy"))
    all_of = reduce(DataFrame.unionByName, frames)
    return all_of.withColumn("best", F.row_number().over(Window.orderBy(F.desc("mean_accuracy"), "candidate")) == 1)  # one row a candidate
