"""Trees on cells: values become at most BINS bin numbers, rows alike in bins, label and weight are one with their number.

For classes the number of cells is bounded by the bins, whatever the rows; for numbers by the different (bins, label).

``Forest`` grows all its trees level by level in the same passes. A row is drawn Poisson(1) times for each
tree, so ``n`` alike rows are drawn Poisson(n) times; the draw comes from a hash of the cell and the tree, so every pass
sees the same one. A task adds up (node, drawn feature, bin) a tree; one task a tree finds the splits of its level. Only
splits reach the driver. ``OnCells`` hands the cells, with their summed weights, to a learner of Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.operators.boosting import HistogramTrees, _binned, _bytes, _matrix
from strideline.sources.scratch import Scratch

BINS = 32
_SPREAD = 0x9E3779B97F4A7C15


def cuts_of(df: DataFrame, features: str) -> list[np.ndarray]:
    """Upper ends of the bins of each input: its values where they are few, else quantiles."""
    first = df.select(vector_to_array(features).alias("x")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    return HistogramTrees(bins=BINS)._cuts(df.select(vector_to_array(features).alias("x")), len(first["x"]))


def _numbers(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers; that of a missing value is BINS, above all others."""
    return np.minimum(_binned(x, cuts), np.uint8(BINS))


def _cells(df: DataFrame, features: str, label: str, weight: Column, cuts: list[np.ndarray]) -> DataFrame:
    """bins, y, w (one row's weight) and n (how many rows are alike)."""
    d = len(cuts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = _numbers(_matrix(batch.column("x"), d), cuts)
                yield pa.RecordBatch.from_arrays([_bytes(bins), batch.column("y"), batch.column("w")], ["bins", "y", "w"])

    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), weight.cast("double").alias("w"))
    return rows.mapInArrow(work, "bins binary, y double, w double").groupBy("bins", "y", "w").agg(F.count(F.lit(1)).cast("double").alias("n"))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Draws:
    """Poisson numbers of hashed uniforms by the inverse of the distribution function."""

    def __init__(self) -> None:
        self.tables: dict[float, tuple[int, np.ndarray]] = {}

    def _table(self, n: float) -> tuple[int, np.ndarray]:
        if n not in self.tables:
            reach = 10 * math.sqrt(n) + 20
            low = max(0, int(n - reach))
            k = np.arange(low + 1, int(n + reach) + 1)
            logs = np.concatenate([[0.0], np.cumsum(math.log(n) - np.log(k))])
            p = np.exp(logs - logs.max())
            self.tables[n] = low, np.cumsum(p / p.sum())
        return self.tables[n]

    def of(self, h: np.ndarray, n: np.ndarray, tree: int) -> np.ndarray:
        return self.dealt(h, self.kinds(n), tree)

    def kinds(self, n: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """The different numbers of alike rows, each with its places."""
        values, of = np.unique(n, return_inverse=True)
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(len(values) + 1))
        return [(value, order[ends[k] : ends[k + 1]]) for k, value in enumerate(values.tolist())]

    def dealt(self, h: np.ndarray, kinds: list[tuple[float, np.ndarray]], tree: int) -> np.ndarray:
        u = (_mixed(h + np.uint64(_SPREAD * (tree + 1) % (1 << 64))) >> np.uint64(11)).astype(np.float64) / 2.0**53
        out = np.empty(len(h))
        for n, mine in kinds:
            low, table = self._table(n)
            out[mine] = low + np.minimum(np.searchsorted(table, u[mine], "right"), len(table) - 1.0)
        return out


def _node_of(bins: np.ndarray, feature: np.ndarray, at: np.ndarray, levels: int) -> np.ndarray:
    """Where each row of bin numbers stands in a tree whose node i has the children 2 i + 1 and 2 i + 2."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(levels):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (bins[rows, np.maximum(f, 0)] > at[node]), node)
    return node


def _drawn_features(seed: int, tree: int, level: int, d: int, many: int) -> np.ndarray:
    """The features that each node of the level may split on."""
    r = np.random.default_rng([seed, tree, level])
    return np.argsort(r.random((1 << level, d)), axis=1)[:, :many]


def _worth(s: np.ndarray, classes: int) -> np.ndarray:
    """What parts with the given sums explain: a split's gain is the children's less the parent's (Gini, or squares)."""
    if classes:
        return (s**2).sum(axis=-1) / np.maximum(s.sum(axis=-1), 1e-300)
    return s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-300)


@dataclass
class Importances:
    values: np.ndarray

    def toArray(self) -> np.ndarray:
        return self.values


@dataclass
class ForestModel:
    classes: int
    cuts: list[np.ndarray]
    feature: np.ndarray  # tree, node
    at: np.ndarray
    value: np.ndarray  # tree, node, classes or one
    gain: np.ndarray
    features: str

    @property
    def featureImportances(self) -> Importances:
        """The share of each feature in a tree's gains, averaged over trees."""
        out = np.zeros(len(self.cuts))
        for f, g in zip(self.feature, self.gain, strict=True):
            own = np.bincount(f[f >= 0], g[f >= 0], len(out))
            out += own / own.sum() if own.sum() > 0 else 0.0
        return Importances(out / out.sum() if out.sum() > 0 else out)

    def told(self, x: np.ndarray) -> np.ndarray:
        bins = _numbers(x, self.cuts)
        levels = (self.feature.shape[1] + 1).bit_length() - 2
        out = np.zeros((len(x), self.value.shape[2]))
        for f, a, v in zip(self.feature, self.at, self.value, strict=True):
            out += v[_node_of(bins, f, a, levels)]
        return out / len(self.feature)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, for classes also ``probability``: the mean of the trees' leaves."""
        d, told = len(self.cuts), self.told

        @F.arrow_udf("array<double>")
        def scores(x: pa.Array) -> pa.Array:
            values = told(_matrix(x, d))
            return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))

        out = df.withColumn("__told", scores(vector_to_array(self.features)))
        if not self.classes:
            return out.withColumn("prediction", F.get("__told", F.lit(0))).drop("__told")
        top = (F.array_position("__told", F.array_max("__told")) - 1).cast("double")
        return out.withColumns({"prediction": top, "probability": array_to_vector("__told")}).drop("__told")


@dataclass(frozen=True)
class Forest:
    """Learner of ``classes`` classes (labels 0, 1, ...), or of a number where ``classes`` is 0."""

    classes: int = 2
    trees: int = 100
    depth: int = 6
    seed: int = 42
    features: str = "features"
    label: str = "label"
    weight: str | None = None
    rows = True  # a row is drawn by itself, so alike rows are not taken as one before

    def copy(self, extra: dict | None = None) -> Forest:
        return self

    def setLabelCol(self, label: str) -> Forest:
        return replace(self, label=label)

    def fit(self, df: DataFrame) -> ForestModel:
        scratch = Scratch(df.sparkSession, "forest")
        cuts = cuts_of(df, self.features)
        d = len(cuts)
        cells = _cells(df, self.features, self.label, F.col(self.weight) if self.weight else F.lit(1.0), cuts)
        cells = cells.withColumn("h", F.xxhash64("bins", "y", "w", F.lit(self.seed)))
        rows = scratch.save(cells.repartition(df.sparkSession.sparkContext.defaultParallelism, "h"), "cells")
        stats = self.classes or 2
        nodes = (2 << self.depth) - 1
        model = ForestModel(
            self.classes,
            cuts,
            np.full((self.trees, nodes), -1),
            np.zeros((self.trees, nodes), np.int64),
            np.zeros((self.trees, nodes, self.classes or 1)),
            np.zeros((self.trees, nodes)),
            self.features,
        )
        many = math.ceil(math.sqrt(d)) if self.classes else math.ceil(d / 3)
        open_ = np.zeros((self.trees, nodes), bool)
        open_[:, 0] = True
        for level in range(self.depth):
            found = self._level(rows, model, open_, level, d, many, stats)
            first = (1 << level) - 1
            open_[:, first : 2 * first + 1] = False
            for r in found:
                t = r["tree"]
                for line in np.array(r["splits"]).reshape(-1, 4 + 3 * stats):
                    node = first + int(line[0])
                    sums = line[4:].reshape(3, stats)  # of the node, and of its sides
                    model.value[t, node] = self._value(sums[0])
                    if line[1] < 0:
                        continue
                    model.feature[t, node], model.at[t, node], model.gain[t, node] = int(line[1]), int(line[2]), line[3]
                    for side in (1, 2):
                        child = 2 * node + side
                        model.value[t, child] = self._value(sums[side])
                        open_[t, child] = not self.classes or np.count_nonzero(sums[side]) > 1
            if not open_.any():
                break
        scratch.drop(".")
        return model

    def _value(self, s: np.ndarray) -> np.ndarray:
        return s / max(s.sum(), 1e-300) if self.classes else s[1:] / max(s[0], 1e-300)

    def _level(self, rows: DataFrame, model: ForestModel, open_: np.ndarray, level: int, d: int, many: int, stats: int) -> list:
        """A line a tree: for each open node its number in the level, feature (-1 for none), bin, gain, its sums and those of its sides."""
        first, wide, size, seed, classes = (1 << level) - 1, 1 << level, BINS + 1, self.seed, self.classes
        feature, at = model.feature, model.at
        going = np.flatnonzero(open_.any(axis=1)).tolist()
        drawn = {t: _drawn_features(seed, t, level, d, many) for t in going}

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {t: np.zeros(wide * many * size * stats) for t in going}
            draws = _Draws()
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, d)
                y, w, n, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in "ywnh")
                h, kinds, number = h.view(np.uint64), draws.kinds(n), np.arange(len(y))
                for t in going:
                    node = _node_of(bins, feature[t], at[t], level)
                    mine = open_[t, node]
                    slot, i = node[mine] - first, number[mine]
                    own = draws.dealt(h, kinds, t)[i] * w[i]
                    for j in range(many):
                        cell = ((slot * many + j) * size + bins[i, drawn[t][slot, j]]) * stats
                        if classes:
                            sums[t] += np.bincount(cell + y[i].astype(np.int64), own, len(sums[t]))
                        else:
                            sums[t] += np.bincount(cell, own, len(sums[t])) + np.bincount(cell + 1, own * y[i], len(sums[t]))
            yield pa.RecordBatch.from_arrays([pa.array(going, pa.int32()), pa.array([sums[t].tobytes() for t in going], pa.binary())], ["tree", "s"])

        def split(table: pa.Table) -> pa.Table:  # a row a task
            t = table.column("tree")[0].as_py()
            s = np.zeros(wide * many * size * stats)
            for part in table.column("s"):
                s += np.frombuffer(part.as_py())
            s = s.reshape(wide, many, size, stats)
            total = s[:, 0].sum(axis=1)
            left = np.cumsum(s, axis=2)[:, :, :-1]
            right = total[:, None, None] - left
            gain = _worth(left, classes) + _worth(right, classes) - _worth(total, classes)[:, None, None]
            least = 1e-9 * np.maximum(total.sum(axis=-1) if classes else total[:, 0], 1e-300)[:, None, None]
            weight = [v.sum(axis=-1) if classes else v[..., 0] for v in (left, right)]
            gain = np.where((weight[0] > least) & (weight[1] > least), gain, -np.inf)
            lines: list[float] = []
            for k in np.flatnonzero(open_[t, first : first + wide]):
                j, b = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
                fits = gain[k, j, b] > 1e-12 * max(abs(float(_worth(total[k], classes))), 1e-300)
                lines += [float(k), float(drawn[t][k, j]) if fits else -1.0, float(b), float(gain[k, j, b]) if fits else 0.0]
                lines += [*total[k].tolist(), *left[k, j, b].tolist(), *right[k, j, b].tolist()]
            return pa.table([pa.array([t], pa.int32()), pa.array([lines], pa.list_(pa.float64()))], names=["tree", "splits"])

        return rows.mapInArrow(work, "tree int, s binary").groupBy("tree").applyInArrow(split, "tree int, splits array<double>").collect()


@dataclass(frozen=True)
class OnCells:
    """A tree learner of Spark over cells: the sums over rows, and so the trees, are those of the binned rows."""

    learner: object  # with weights in ``weight``
    features: str = "features"
    label: str = "label"
    weight: str = "weight"

    def copy(self, extra: dict | None = None) -> OnCells:
        return self

    def fit(self, df: DataFrame) -> OnCellsModel:
        scratch = Scratch(df.sparkSession, "cells")
        cuts = cuts_of(df, self.features)
        cells = _cells(df, self.features, self.label, F.col(self.weight), cuts)
        # Codes of whole numbers in a fixed order, so that a fit can be repeated.
        x = array_to_vector(F.transform(F.sequence(F.lit(1), F.lit(len(cuts))), lambda i: F.conv(F.hex(F.substring("bins", i, F.lit(1))), 16, 10).cast("double")))
        rows = cells.groupBy("bins", "y").agg(F.sum(F.col("w") * F.col("n")).alias("weight"))
        rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism, "bins").sortWithinPartitions("bins", "y")
        saved = scratch.save(rows.select(x.alias("__bins"), F.col("y").alias(self.label), F.col("weight").alias(self.weight)), "rows")
        model = self.learner.copy().setFeaturesCol("__bins").setLabelCol(self.label).fit(saved)
        scratch.drop(".")
        return OnCellsModel(model, cuts, self.features)


@dataclass
class OnCellsModel:
    model: object
    cuts: list[np.ndarray]
    features: str

    @property
    def featureImportances(self) -> DenseVector:
        return self.model.featureImportances

    def transform(self, df: DataFrame) -> DataFrame:
        d, cuts = len(self.cuts), self.cuts

        @F.arrow_udf("array<double>")
        def bins(x: pa.Array) -> pa.Array:
            found = _numbers(_matrix(x, d), cuts).astype(np.float64)
            return pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), d).cast(pa.list_(pa.float64()))

        return self.model.transform(df.withColumn("__bins", array_to_vector(bins(vector_to_array(self.features))))).drop("__bins")
