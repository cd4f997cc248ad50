"""Logistic regressions of many folds and penalties, fitted in the same passes.

Rows alike in inputs, label and fold are held once, with their number and summed weight.
Each pass adds up gradient, curvature, loss and hold-out hits of every (candidate, fold) model
over the rows at once, as products of matrices in the tasks; the driver takes one Newton step a
model, by coordinate descent where the penalty has an absolute part, and halves steps that did not
lower the objective. So a search of any number of candidates takes as many jobs as one fit needs
steps. What reaches the driver is a square of the inputs a model.

The objective of a model is the mean weighted log loss of the rows outside its fold plus
penalty (share |b|_1 + (1 - share) / 2 |b|^2); the intercept is free and no column is rescaled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideline.sources.scratch import Scratch

#: Most numbers that a pass brings to the driver; more models go in several groups.
MOST = 1 << 21


def _step(beta: np.ndarray, g: np.ndarray, h: np.ndarray, penalty: float, share: float, sweeps: int = 1000, kept: np.ndarray | None = None) -> np.ndarray:
    """Where the quadratic model of the loss plus the penalty is least; inputs that are not kept stay at 0."""
    if kept is not None:
        out, i = np.zeros(len(beta)), np.flatnonzero(kept)
        out[i] = _step(beta[i], g[i], h[np.ix_(i, i)], penalty, share, sweeps)
        return out
    l1, l2 = penalty * share, penalty * (1 - share)
    q = h.copy()
    q[np.diag_indices(len(q))] += 1e-12
    q[np.arange(1, len(q)), np.arange(1, len(q))] += l2
    r = g - h @ beta
    if l1 == 0:
        return np.linalg.solve(q, -r)
    b = beta.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            pull = -(r[j] + q[j] @ b - q[j, j] * b[j])
            new = pull / q[j, j] if j == 0 else np.sign(pull) * max(abs(pull) - l1, 0.0) / q[j, j]
            moved = max(moved, abs(new - b[j]))
            b[j] = new
        if moved < 1e-12:
            break
    return b


def _pass(rows: DataFrame, betas: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """A line a model: upper triangle of the curvature, gradient, loss, weight, hold-out rows and hits."""
    d = betas.shape[1]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(betas), len(pairs) + d + 4))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            z = np.hstack([np.ones((n, 1)), pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(n, -1)])
            y, w, fold, many = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "fold", "n"))
            margin = z @ betas.T
            held = fold[:, None] == folds
            own = np.where(held, 0.0, w[:, None])
            p = 1 / (1 + np.exp(-margin))
            curve = own * p * (1 - p)
            square = np.stack([z[:, i] * z[:, j] for i, j in pairs], axis=1)
            loss = own * (np.logaddexp(0, margin) - y[:, None] * margin)
            hits = held & ((margin > 0) == (y[:, None] > 0.5))
            out += np.hstack([curve.T @ square, (own * (p - y[:, None])).T @ z, np.stack([loss.sum(0), own.sum(0), many @ held, many @ hits], axis=1)])
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel()], pa.list_(pa.float64()))], ["v"])

    sums = rows.mapInArrow(work, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).toArrow()
    out = np.zeros((len(betas), len(pairs) + d + 4))
    out.ravel()[sums["pos"].to_numpy()] = sums["s"].to_numpy()
    return out


def alike_rows(df: DataFrame, label: str, fold: str, weight: str | None) -> tuple[DataFrame, int]:
    """x, y, fold, the summed weight and the number of rows alike in those, saved; and the inputs with the intercept."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"), F.col(fold).cast("bigint").alias("fold"))
    first = rows.first()
    if first is None:
        raise ValueError("no rows to learn from")
    seen = rows.groupBy("x", "y", "fold").agg(F.sum("w").alias("w"), F.count(F.lit(1)).cast("double").alias("n"))
    spark = df.sparkSession
    return Scratch(spark, "logistic").save(seen.repartition(spark.sparkContext.defaultParallelism), "rows"), len(first["x"]) + 1


def fit_subsets(rows: DataFrame, folds: list[int], kept: np.ndarray, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and hold-out accuracy of a model a line, without penalty: the fold it does not see (-1: none), and its inputs, the intercept first."""
    best, accuracy = _fit(rows, [((0.0, 0.0), f) for f in folds], kept.shape[1], steps, kept)
    return best, accuracy


def fit_grid(
    df: DataFrame, candidates: list[tuple[float, float]], k: int, label: str = "label", fold: str = "fold", weight: str | None = "weight", steps: int = 40
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (candidate, fold, intercept first) and hold-out accuracy (candidate, fold; NaN for a fold without rows).

    ``candidates`` are (penalty, share of the absolute part); ``fold`` has the numbers 0 to k - 1.
    """
    rows, d = alike_rows(df, label, fold, weight)
    group = max(1, MOST // ((d * (d + 1) // 2 + d + 4) * k))
    parts = [_fit(rows, [(c, f) for c in candidates[i : i + group] for f in range(k)], d, steps) for i in range(0, len(candidates), group)]
    shape = (len(candidates), k)
    return np.concatenate([p[0] for p in parts]).reshape(*shape, d), np.concatenate([p[1] for p in parts]).reshape(shape)


def _fit(rows: DataFrame, models: list[tuple[tuple[float, float], int]], d: int, steps: int, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    folds = np.array([f for _, f in models])
    upper = np.triu_indices(d)
    best = np.zeros((len(models), d))
    trial, least = best.copy(), np.full(len(models), np.inf)
    accuracy = np.full(len(models), np.nan)
    open_ = np.ones(len(models), bool)
    for _ in range(steps):
        at = np.flatnonzero(open_)
        for m, line in zip(at, _pass(rows, trial[at], folds[at]), strict=True):
            (penalty, share), total = models[m][0], line[-3]
            if total <= 0:
                open_[m] = False
                continue
            b = trial[m].copy()
            value = line[-4] / total + penalty * (share * np.abs(b[1:]).sum() + (1 - share) / 2 * (b[1:] ** 2).sum())
            if value > least[m] + 1e-13:
                trial[m] = (best[m] + b) / 2
                open_[m] = np.abs(trial[m] - best[m]).max() > 1e-10
                continue
            least[m], best[m] = value, b
            accuracy[m] = line[-1] / line[-2] if line[-2] else np.nan
            h = np.zeros((d, d))
            h[upper] = line[: len(upper[0])] / total
            h = h + np.triu(h, 1).T
            trial[m] = _step(b, line[len(upper[0]) : len(upper[0]) + d] / total, h, penalty, share, kept=None if kept is None else kept[m])
            open_[m] = np.abs(trial[m] - b).max() > 1e-9
        if not open_.any():
            break
    return best, accuracy


def search(df: DataFrame, candidates: list[tuple[float, float]], k: int) -> DataFrame:
    """candidate, params, mean_accuracy over the folds, and best (the first among equals)."""
    _, accuracy = fit_grid(df, candidates, k)
    rows = [(i, f"{{'regParam': {p!r}, 'elasticNetParam': {s!r}}}", float(np.nanmean(a))) for i, ((p, s), a) in enumerate(zip(candidates, accuracy, strict=True))]
    out = df.sparkSession.createDataFrame(rows, "candidate int, params string, mean_accuracy double")
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc("mean_accuracy"), "candidate")) == 1)  # one row a candidate
