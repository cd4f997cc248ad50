"""Linear learners by stochastic gradient descent in partitions.

Rows are shuffled once, in a saved table. In an epoch every task goes over its own rows in mini-batches
from the same weights and sends the average of its steps; a task of many rows goes several walks side by side, each of
at least WALK steps, whose steps are taken together; those averages, weighted by rows, are the next
weights. So an epoch is one job, and a few numbers a task travel. The objective is the
mean loss plus ``penalty`` / 2 times the squared weights; several classes are learnt side
by side, each against the rest. Features should be on one scale.

``curve`` has the objective before each epoch and after the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.operators.moments import told
from strideline.sources.scratch import Scratch


#: Least steps of a walk in an epoch where a task goes several, and most walks of a task.
WALK, WALKS = 1000, 32


def loss_and_slope(kind: str, margin: np.ndarray, y: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its derivative by the margin. Classes are -1 and 1."""
    if kind == "log":
        z = y * margin
        p = np.exp(-np.logaddexp(0, z))
        return np.logaddexp(0, -z), -y * p
    if kind == "hinge":
        gap = 1 - y * margin
        return np.maximum(gap, 0), np.where(gap > 0, -y, 0.0)
    gap = margin - y
    if kind == "squared":
        return gap * gap / 2, gap
    inside = np.abs(gap) <= epsilon
    return np.where(inside, gap * gap / 2, epsilon * np.abs(gap) - epsilon * epsilon / 2), np.where(inside, gap, epsilon * np.sign(gap))


@dataclass
class SGDModel:
    weights: np.ndarray  # a row a class, the intercept first
    loss: str
    curve: list[float]
    features: str

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``; for classes ``rawPrediction``, and ``probability`` by the log loss."""
        x = vector_to_array(self.features)
        margins = [told(x, F.array(*[F.lit(float(v)) for v in w])) for w in self.weights]
        if self.loss in ("squared", "huber"):
            return df.withColumn("prediction", margins[0])
        m = F.array(-margins[0], margins[0]) if len(margins) == 1 else F.array(*margins)
        out = df.withColumn("__m", m)
        added = {"prediction": (F.array_position("__m", F.array_max("__m")) - 1).cast("double"), "rawPrediction": array_to_vector("__m")}
        if self.loss == "log":
            p = F.transform("__m", lambda v: 1 / (1 + F.exp(-v)))
            total = F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
            added["probability"] = array_to_vector(F.transform(p, lambda v: v / total))
        return out.withColumns(added).drop("__m")


@dataclass(frozen=True)
class SGD:
    """Learner: ``loss`` is log or hinge for classes, squared or huber for numbers.

    Steps are ``rate`` / (1 + epoch) ** ``decay``; growth ends early once ``patience`` epochs have not bettered the
    objective by ``tolerance`` of itself.
    """

    loss: str = "log"
    classes: int = 2
    penalty: float = 1e-4
    epochs: int = 40
    batch: int = 32
    rate: float = 0.3
    decay: float = 0.75
    epsilon: float = 0.1
    tolerance: float = 1e-4
    patience: int = 5
    seed: int = 42
    features: str = "features"
    label: str = "label"
    weight: str | None = None
    rows = True  # steps are by row, so alike rows are not taken as one

    def copy(self, extra: dict | None = None) -> SGD:
        return self

    def fit(self, df: DataFrame) -> SGDModel:
        numbers = self.loss in ("squared", "huber")
        lines = 1 if numbers or self.classes == 2 else self.classes
        kept, curve = self._descended(df, F.lit(-1), np.zeros(lines, np.int64), np.array([1]) if lines == 1 else np.arange(lines), False)
        return SGDModel(kept, self.loss, [float(v) for v in curve[:, 0]], self.features)

    def fit_folds(self, df: DataFrame, fold: str, k: int) -> list[SGDModel]:
        """A model for each fold, of the rows outside it, learnt side by side in the same passes; two classes or a number.

        A step takes as many more rows as it leaves out of a fold's model, about.
        """
        if self.loss not in ("squared", "huber") and self.classes != 2:
            raise ValueError("folds are learnt side by side for two classes or a number")
        wider = replace(self, batch=-(-self.batch * k // max(k - 1, 1)))
        kept, curve = wider._descended(df, F.col(fold), np.arange(k), np.ones(k, np.int64), True)
        return [SGDModel(kept[i : i + 1], self.loss, [float(v) for v in curve[:, i]], self.features) for i in range(k)]

    def _descended(self, df: DataFrame, fold: Column, outside: np.ndarray, classes: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
        """The best weights and the curve. Lines (``apart``: models of their own, else one model's) leave out the rows of their fold ``outside``."""
        scratch = Scratch(df.sparkSession, "sgd")
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"), weight.alias("w"), fold.cast("int").alias("f"))
        first = rows.first()
        if first is None:
            raise ValueError("no rows to learn from")
        order = F.xxhash64("x", "y", "w", F.lit(self.seed))
        rows = scratch.save(rows.withColumn("o", order).repartition("o").sortWithinPartitions("o").drop("o"), "rows")
        walks = min(WALKS, max(1, rows.count() // (rows.rdd.getNumPartitions() * self.batch * WALK)))
        numbers = self.loss in ("squared", "huber")
        weights = np.zeros((len(outside), len(first["x"]) + 1))
        curve: list[np.ndarray] = []
        best, kept, since = np.full(len(outside), np.inf), weights.copy(), np.zeros(len(outside), np.int64)
        for epoch in range(self.epochs + 1):
            new, value = self._epoch(rows, weights, epoch, numbers, outside, classes, apart, walks)
            curve.append(value)
            going = since < self.patience  # a model that has ended keeps what it has
            better = going & (value < best)
            since = np.where(better & (value < best * (1 - self.tolerance)), 0, since + 1)
            kept[better], best = weights[better], np.where(better, value, best)
            if (since >= self.patience).all() or epoch == self.epochs:
                break
            weights = new
        scratch.drop(".")
        return kept, np.array(curve)

    def _epoch(self, rows: DataFrame, start: np.ndarray, epoch: int, numbers: bool, outside: np.ndarray, classes: np.ndarray, apart: bool, walks: int) -> tuple[np.ndarray, np.ndarray]:
        """The averaged weights of all tasks' steps, and each line's objective at the start: its model's."""
        kind, penalty, epsilon, batch_rows, seed = self.loss, self.penalty, self.epsilon, self.batch, self.seed
        step = self.rate / (1 + epoch) ** self.decay

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, mean, steps, n, lost, held = np.repeat(start[None], walks, axis=0), np.zeros_like(start), 0, 0, 0.0, 0.0
            r = np.random.default_rng([seed, epoch])
            for batch in batches:
                m = batch.num_rows
                if not m:
                    continue
                x = pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(m, -1)
                z = np.hstack([np.ones((m, 1)), x])
                y, w_of, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "f"))
                said = np.repeat(y[:, None], len(start), axis=1) if numbers else np.where(y[:, None] == classes, 1.0, -1.0)
                seen = (fold[:, None] != outside) if apart else np.ones((m, len(start)), bool)
                own = w_of[:, None] * seen
                lost = lost + (loss_and_slope(kind, z @ start.T, said, epsilon)[0] * own).sum(axis=0)
                held = held + own.sum(axis=0)
                n += m
                side = walks * batch_rows
                deal = np.resize(r.permutation(m), (-(-m // side), walks, batch_rows))
                taken = (np.arange(deal.size) < m).reshape(deal.shape)  # what fills up the last step has no part in it
                for i, real in zip(deal, taken, strict=True):
                    rows_of = (seen[i] & real[:, :, None]).sum(axis=1)[:, :, None]
                    slope = loss_and_slope(kind, z[i] @ w.transpose(0, 2, 1), said[i], epsilon)[1] * own[i] * real[:, :, None]
                    g = slope.transpose(0, 2, 1) @ z[i] / np.maximum(rows_of, 1)
                    g[:, :, 1:] += penalty * w[:, :, 1:]
                    w = w - step * g * (rows_of > 0)
                    steps += walks
                    mean += w.sum(axis=0)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([[*(mean / steps * n).ravel().tolist(), float(n), *lost.tolist(), *held.tolist()]])], ["v"])

        sums = rows.mapInArrow(work, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
        v = np.array([s for _, s in sorted((r["pos"], r["s"]) for r in sums)])
        lines = len(start)
        lost, held = v[-2 * lines : -lines], v[-lines:]
        value = lost / np.maximum(held, 1e-300) + penalty / 2 * (start[:, 1:] ** 2).sum(axis=1)
        if not apart:  # the lines are one model's
            value = np.full(lines, value.sum())
        return (v[: start.size] / v[start.size]).reshape(start.shape), value
