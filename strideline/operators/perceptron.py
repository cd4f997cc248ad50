"""One hidden layer of sigmoids under a softmax, fitted by limited-memory BFGS.

Each step adds up loss and gradient over the rows as products of matrices in the tasks, in single precision within a
chunk of rows and in double precision over the chunks; alike rows are one with their number.
What a task sends is a number a weight of the network.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.sources.scratch import Scratch

#: Rows that are met at once: rows times hidden units are in memory.
CHUNK = 1024


def _parts(theta: np.ndarray, d: int, hidden: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b = d * hidden, d * hidden + hidden
    c = b + hidden * classes
    return theta[:a].reshape(d, hidden), theta[a:b], theta[b:c].reshape(hidden, classes), theta[c:]


def _forward(x: np.ndarray, parts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of the hidden units, and the logarithm of each class's probability."""
    w1, b1, w2, b2 = parts
    a = x @ w1
    a += b1
    np.clip(a, -80, 80, out=a)  # the exponential is finite in single precision too
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1
    np.reciprocal(a, out=a)
    o = a @ w2 + b2
    o -= o.max(axis=1, keepdims=True)
    return a, o - np.log(np.exp(o).sum(axis=1, keepdims=True))


def _slope(x: np.ndarray, y: np.ndarray, n: np.ndarray, parts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Gradient, loss and number of rows, each row counted ``n`` times."""
    a, logs = _forward(x, parts)
    loss = -(n * logs[np.arange(len(y)), y]).sum(dtype=np.float64)
    e = np.exp(logs)
    e[np.arange(len(y)), y] -= 1
    e *= n[:, None]
    ahead = a.T @ e
    back = e @ parts[2].T
    back *= a
    np.subtract(1, a, out=a)
    back *= a
    return np.concatenate([(x.T @ back).ravel(), back.sum(0), ahead.ravel(), e.sum(0), [loss, n.sum(dtype=np.float64)]])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class PerceptronModel:
    theta: np.ndarray
    d: int
    hidden: int
    classes: int
    curve: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and ``probability``."""
        d, parts = self.d, _parts(self.theta.astype(np.float32), self.d, self.hidden, self.classes)

        @F.arrow_udf("array<double>")
        def told(x: pa.Array) -> pa.Array:
            rows = _matrix(x, d).astype(np.float32)
            p = [np.exp(_forward(rows[i : i + CHUNK], parts)[1]) for i in range(0, len(rows), CHUNK)]
            p = np.concatenate(p).astype(np.float64) if p else np.zeros((0, len(parts[3])))
            return pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))

        top = (F.array_position("__told", F.array_max("__told")) - 1).cast("double")
        return df.withColumn("__told", told(vector_to_array("features"))).withColumns({"prediction": top, "probability": array_to_vector("__told")}).drop("__told")


@dataclass(frozen=True)
class Perceptron:
    hidden: int = 1000
    classes: int = 2
    steps: int = 20
    tolerance: float = 1e-6
    seed: int = 42
    label: str = "label"

    def copy(self, extra: dict | None = None) -> Perceptron:
        return self

    def fit(self, df: DataFrame) -> PerceptronModel:
        from strideline.operators.models import alike

        scratch = Scratch(df.sparkSession, "perceptron")
        rows = alike(df, self.label).select(vector_to_array("features").alias("x"), F.col(self.label).alias("y"), F.col("weight").alias("n"))
        rows = scratch.save(rows, "rows")
        first = rows.first()
        if first is None:
            raise ValueError("no rows to learn from")
        d, hidden, classes = len(first["x"]), self.hidden, self.classes
        r = np.random.default_rng(self.seed)
        near, far = np.sqrt(6 / (d + hidden)), np.sqrt(6 / (hidden + classes))
        theta = np.concatenate([r.uniform(-near, near, d * hidden), np.zeros(hidden), r.uniform(-far, far, hidden * classes), np.zeros(classes)])

        def at(theta: np.ndarray) -> tuple[float, np.ndarray]:
            parts = _parts(theta.astype(np.float32), d, hidden, classes)

            def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros(len(theta) + 2)
                for batch in batches:
                    x, n = _matrix(batch.column("x"), d).astype(np.float32), batch.column("n").to_numpy().astype(np.float32)
                    y = batch.column("y").to_numpy().astype(np.int64)
                    for i in range(0, len(y), CHUNK):
                        out += _slope(x[i : i + CHUNK], y[i : i + CHUNK], n[i : i + CHUNK], parts)
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], ["v"])

            sums = rows.mapInArrow(work, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).toArrow()  # a row a weight
            out = np.zeros(len(theta) + 2)
            out[sums["pos"].to_numpy()] = sums["s"].to_numpy()
            return out[-2] / out[-1], out[:-2] / out[-1]

        value, slope = at(theta)
        curve, past = [value], []
        for _ in range(self.steps):
            way = _direction(slope, past)
            if way @ slope >= 0:
                way, past = -slope, []
            step = 1.0 if past else min(1.0, 1 / max(np.linalg.norm(slope), 1e-300))
            for _ in range(20):  # shorter until the objective falls
                new, new_slope = at(theta + step * way)
                if new <= value + 1e-4 * step * (way @ slope):
                    break
                step /= 2
            else:
                break
            moved, bent = step * way, new_slope - slope
            if moved @ bent > 1e-12:
                past = [*past[-9:], (moved, bent)]
            theta, slope, before, value = theta + moved, new_slope, value, new
            curve.append(value)
            if before - value <= self.tolerance * max(abs(before), abs(value)):
                break
        scratch.drop(".")
        return PerceptronModel(theta, d, hidden, classes, curve)


def _direction(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the gradient through the inverse curvature that the last steps have shown."""
    q, shares = slope.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        shares.append(a)
        q -= a * y
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(shares), strict=True):
        q += (a - (y @ q) / (s @ y)) * s
    return -q
