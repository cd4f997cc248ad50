"""Least squares from sums: one scan gives every fold, penalty and member its fit.

A fold's sums of products of (1, x, y) are all that its fit and its error need. The fit
without a fold is solved from the sums of all rows less the fold's, and the error on the
fold is a quadratic form of its own sums. So k folds and m penalties cost one scan and k m
systems of the inputs' size, solved in Spark's tasks, and leaving out one row at a time
follows from the leverages in a second scan.

Penalties are those on the sum of squared errors, ``|y - a - xb|^2 + penalty |b|^2``, or for the
lasso ``|y - a - xb|^2 / 2n + penalty |b|_1``; the intercept is free. Rows with a null in label, weight
or features, or a NaN, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.sources.scratch import Scratch

#: Floats of sums that a task holds before it sends them on.
HELD = 1 << 22
#: Spread below this share of a column's squares, and eigenvalues of scaled sums below it, count as 0.
FLAT = 1e-12

_SUMS = "fold bigint, s array<double>"
_SUMS_ARROW = pa.schema([("fold", pa.int64()), ("s", pa.list_(pa.float64()))])


def _lists(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m).ravel()), m.shape[1]).cast(pa.list_(pa.float64()))


def products(names: list[str], degree: int) -> list[Column]:
    """All products of up to ``degree`` of the columns, without the constant."""
    out: list[tuple[int, Column]] = [(i, F.col(c).cast("double")) for i, c in enumerate(names)]
    last = list(out)
    for _ in range(degree - 1):
        last = [(j, c * F.col(names[j]).cast("double")) for i, c in last for j in range(i, len(names))]
        out += last
    return [c for _, c in out]


def _rows(df: DataFrame, x: Column, y: Column, fold: Column, weight: Column) -> DataFrame:
    rows = df.select(fold.cast("bigint").alias("fold"), x.alias("x"), y.cast("double").alias("y"), weight.cast("double").alias("w"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    return rows.filter(F.col("fold").isNotNull() & F.col("w").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y") & whole)


def fold_moments(df: DataFrame, x: Column, y: Column, fold: Column, weight: Column | None = None) -> DataFrame:
    """fold and s, the products of (1, x, y) summed over the fold's rows, line by line."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held)), _lists(np.stack([m.ravel() for m in held.values()]))], schema=_SUMS_ARROW)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(n, -1)
            z = np.hstack([np.ones((n, 1)), values, batch.column("y").to_numpy(zero_copy_only=False)[:, None]])
            zw = z * batch.column("w").to_numpy(zero_copy_only=False)[:, None]
            folds, of = np.unique(batch.column("fold").to_numpy(), return_inverse=True)
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(len(folds) + 1))
            for k, f in enumerate(folds.tolist()):
                mine = order[ends[k] : ends[k + 1]]
                s = zw[mine].T @ z[mine]
                held[f] = held[f] + s if f in held else s
            if len(held) * z.shape[1] ** 2 > HELD:
                yield sent()
                held.clear()
        if held:
            yield sent()

    def whole(table: pa.Table) -> pa.Table:  # a row a task
        s = np.asarray(pc.list_flatten(table.column("s")).to_numpy()).reshape(table.num_rows, -1).sum(axis=0)
        return pa.table([table.column("fold").slice(0, 1).combine_chunks(), _lists(s[None])], schema=_SUMS_ARROW)

    return _rows(df, x, y, fold, F.lit(1.0) if weight is None else weight).mapInArrow(part, _SUMS).groupBy("fold").applyInArrow(whole, _SUMS)


def total(moments: DataFrame) -> np.ndarray:
    """The sums of all folds; as many numbers as the square of the inputs reach the driver."""
    found = moments.select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    side = round(len(found) ** 0.5)
    out = np.zeros(side * side)
    for r in found:
        out[r["pos"]] = r["v"]
    return out.reshape(side, side)


class Solver:
    """Fits from one matrix of sums, for any penalty."""

    def __init__(self, s: np.ndarray):
        self.n, self.mean, self.y = s[0, 0], s[0, 1:-1] / s[0, 0], s[0, -1] / s[0, 0]
        self.a = s[1:-1, 1:-1] - self.n * np.outer(self.mean, self.mean)
        self.b = s[1:-1, -1] - self.n * self.mean * self.y
        flat = np.diag(self.a) <= FLAT * np.diag(s)[1:-1]  # constant columns take no part
        self.a[flat], self.a[:, flat], self.b[flat] = 0.0, 0.0, 0.0

    def _with(self, beta: np.ndarray) -> np.ndarray:
        return np.concatenate([[self.y - self.mean @ beta], beta])

    def ridge(self, penalty: float) -> np.ndarray:
        """Intercept and coefficients; the columns are scaled while it is solved."""
        a = self.a + penalty * np.eye(len(self.b))
        scale = np.sqrt(np.diag(a))
        scale[scale == 0] = 1.0
        values, vectors = np.linalg.eigh(a / np.outer(scale, scale))
        sure = values > FLAT
        inverse = np.where(sure, 1 / np.where(sure, values, 1.0), 0.0)
        return self._with(vectors @ (inverse * (vectors.T @ (self.b / scale))) / scale)

    def lasso(self, penalty: float, sweeps: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
        """Intercept and coefficients by coordinate descent on the sums."""
        beta, scale = np.zeros(len(self.b)), np.sqrt(np.maximum(np.diag(self.a), 0))
        for _ in range(sweeps):
            moved = 0.0
            for j in np.flatnonzero(scale):
                pull = self.b[j] - self.a[j] @ beta + self.a[j, j] * beta[j]
                new = np.sign(pull) * max(abs(pull) - self.n * penalty, 0.0) / self.a[j, j]
                moved = max(moved, abs(new - beta[j]) * scale[j])
                beta[j] = new
            if moved <= tolerance * max(1.0, np.abs(self.b).max() / max(scale.max(), 1e-300)):
                break
        return self._with(beta)


def fold_errors(moments: DataFrame, penalties: list[float], kind: str = "ridge") -> DataFrame:
    """fold, penalty, n, mse and coefficients (intercept first): the fit on all other folds, its error on this one."""
    all_sums = total(moments)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for f, flat in zip(batch.column("fold").to_pylist(), batch.column("s"), strict=True):
                own = np.array(flat.values).reshape(all_sums.shape)
                if all_sums[0, 0] - own[0, 0] <= 0:
                    continue  # no other rows
                solver = Solver(all_sums - own)
                for p in penalties:
                    c = getattr(solver, kind)(p)
                    v = np.concatenate([-c, [1.0]])
                    out.append((f, p, own[0, 0], max(float(v @ own @ v), 0.0) / own[0, 0], c))
            if out:
                f, p, n, mse, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(p), pa.array(n), pa.array(mse), _lists(np.stack(c))], ["fold", "penalty", "n", "mse", "coefficients"])

    return moments.mapInArrow(solve, "fold bigint, penalty double, n double, mse double, coefficients array<double>")


def search(errors: DataFrame) -> DataFrame:
    """penalty, mean_mse over the folds, and best: the least, the smaller penalty among equals."""
    from pyspark.sql.window import Window

    per = errors.groupBy("penalty").agg(F.avg("mse").alias("mean_mse"))
    return per.withColumn("best", F.row_number().over(Window.orderBy("mean_mse", "penalty")) == 1)  # one row a penalty


def told(x: Column, coefficients: Column) -> Column:
    """Intercept plus the products of an array and its coefficients."""
    both = F.zip_with(x, F.slice(coefficients, 2, F.size(x)), lambda a, b: a * b)
    return F.aggregate(both, F.get(coefficients, F.lit(0)), lambda s, v: s + v)


def out_of_fold(df: DataFrame, x: Column, fold: Column, errors: DataFrame, out: str = "prediction") -> DataFrame:
    """Each row told by the fit without its fold. ``errors`` has one penalty, and a row a fold, which is broadcast."""
    fits = errors.select(F.col("fold").alias("__fold"), F.col("coefficients").alias("__c"))
    return df.join(F.broadcast(fits), fold.cast("bigint") == F.col("__fold"), "left").withColumn(out, told(x, F.col("__c"))).drop("__fold", "__c")


def leave_one_out(df: DataFrame, x: Column, y: Column, penalties: list[float]) -> DataFrame:
    """penalty, n, rmse and mae, each row told by the fit without it: as many folds as rows, in two scans.

    One decomposition serves all penalties; the columns should be on one scale within some powers of ten.
    """
    rows = _rows(df, x, y, F.lit(0), F.lit(1.0))
    s = Solver(total(fold_moments(rows, F.col("x"), F.col("y"), F.lit(0))))
    # In the eigenvectors' coordinates the leverage and the fit are sums of one term each.
    values, vectors = np.linalg.eigh(s.a)
    turned = F.array(*[told(F.col("x"), F.array(*[F.lit(float(v)) for v in (-(s.mean @ q), *q)])) for q in vectors.T])
    pull = vectors.T @ s.b
    at = rows.select("y", turned.alias("z"), F.explode(F.array(*[F.lit(float(p)) for p in penalties])).alias("penalty"))
    level, fit = F.lit(1.0 / s.n), F.lit(float(s.y))
    for i, (value, b) in enumerate(zip(values, pull, strict=True)):
        z, width = F.get("z", F.lit(i)), F.lit(float(max(value, 0.0))) + F.col("penalty")
        level, fit = level + F.try_divide(z * z, width), fit + F.try_divide(z * F.lit(float(b)), width)
    e = F.try_divide(F.col("y") - fit, 1 - level)
    return at.select("penalty", e.alias("e")).groupBy("penalty").agg(F.count("e").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"))


@dataclass(frozen=True)
class LinearModel:
    coefficients: list[float]
    signed: bool
    features: str

    def transform(self, df: DataFrame) -> DataFrame:
        value = told(vector_to_array(self.features), F.array(*[F.lit(c) for c in self.coefficients]))
        return df.withColumn("prediction", (value > 0).cast("double") if self.signed else value)


@dataclass(frozen=True)
class LeastSquares:
    """Learner: linear, ridge or lasso regression; ``signed``: of -1 and 1 for the labels 0 and 1, the sign being the class."""

    penalty: float = 0.0
    kind: str = "ridge"
    signed: bool = False
    label: str = "label"
    weight: str | None = None
    features: str = "features"

    def copy(self, extra: dict | None = None) -> LeastSquares:
        return self

    def fit(self, df: DataFrame) -> LinearModel:
        y = 2.0 * F.col(self.label) - 1 if self.signed else F.col(self.label)
        s = total(fold_moments(df, vector_to_array(self.features), y, F.lit(0), F.col(self.weight) if self.weight else None))
        return LinearModel([float(c) for c in getattr(Solver(s), self.kind)(self.penalty)], self.signed, self.features)


def saved_moments(df: DataFrame, x: Column, y: Column, fold: Column, weight: Column | None = None) -> DataFrame:
    """``fold_moments`` as a table, for its total is read before its rows."""
    return Scratch(df.sparkSession, "moments").save(fold_moments(df, x, y, fold, weight), "sums")
