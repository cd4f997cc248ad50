"""Boosting of trees by class probabilities (SAMME.R), over cells.

Rows alike in bins and label are one with their number, as in ``forest``: for a few inputs the cells are bounded
by the bins, whatever the rows. A round's tree grows a level a pass; a task works the weights of its cells out from the
trees that are not in its scores yet, which are written after 1, 2, 4, ... rounds. What reaches the driver is a number a (node, input, bin, class).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.operators.boosting import _matrix
from strideline.operators.forest import BINS, _cells, _node_of, _numbers, _worth, cuts_of
from strideline.sources.scratch import Scratch

#: feature, bin and what each node says on each class, of a tree whose node i has the children 2 i + 1 and 2 i + 2.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def _said(p: np.ndarray, classes: int) -> np.ndarray:
    """A tree's say on each class: (k - 1)(log p - mean log p)."""
    logs = np.log(np.maximum(p, 2.0**-52))
    return (classes - 1) * (logs - logs.mean(axis=-1, keepdims=True))


def _grown(sums: np.ndarray, tree: Tree, p: np.ndarray, level: int) -> bool:
    """Splits the nodes of the level by sums of (node, input, bin, class); whether any was split."""
    feature, at, _ = tree
    first, any_ = (1 << level) - 1, False
    total = sums[:, 0].sum(axis=1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    gain = _worth(left, sums.shape[-1]) + _worth(right, sums.shape[-1]) - _worth(total, sums.shape[-1])[:, None, None]
    least = 1e-12 * np.maximum(total.sum(axis=-1), 1e-300)[:, None, None]
    gain = np.where((left.sum(axis=-1) > least) & (right.sum(axis=-1) > least), gain, -np.inf)
    for k in range(len(sums)):
        node, n = first + k, total[k].sum()
        if n <= 0:
            continue
        p[node] = total[k] / n
        j, b = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
        if gain[k, j, b] <= 1e-12 * n:
            continue
        feature[node], at[node], any_ = j, b, True
        for child, side in ((2 * node + 1, left), (2 * node + 2, right)):
            p[child] = np.maximum(side[k, j, b], 0) / side[k, j, b].sum()
    return any_


def _scores(bins: np.ndarray, trees: list[Tree], depth: int, classes: int) -> np.ndarray:
    out = np.zeros((len(bins), classes))
    for feature, at, said in trees:
        out += said[_node_of(bins, feature, at, depth)]
    return out


def boosted(
    train: DataFrame, test: DataFrame, label: str, scratch: Scratch, rounds: int, depth: int, classes: int, rate: float, keep_every: int
) -> DataFrame:
    """Adds ``prediction`` to ``test``. Scores are written once there are as many new rounds as written ones, or ``keep_every``."""
    spark = train.sparkSession
    cuts = cuts_of(train, "features")
    d, size = len(cuts), BINS + 1
    cells = _cells(train, "features", label, F.lit(1.0), cuts).select("bins", "y", "n", F.array_repeat(F.lit(0.0), classes).alias("s"))
    rows = scratch.save(cells.repartition(spark.sparkContext.defaultParallelism), "train-0")
    trees: list[Tree] = []
    kept, shift = 0, 0.0  # rounds whose scores are in the rows, and the logarithm of what weights were divided by

    def sums_of(grown: Tree | None, level: int) -> np.ndarray:
        """Weights by (node, input, bin, class) of the level of the tree that grows."""
        wide, done, by = 1 << level, trees[kept:], shift

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(wide * d * size * classes)
            for batch in batches:
                m = batch.num_rows
                if not m:
                    continue
                bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, d)
                y, n = batch.column("y").to_numpy().astype(np.int64), batch.column("n").to_numpy()
                score = _matrix(batch.column("s"), classes) + _scores(bins, done, depth, classes)
                # The factor of a round is -(k - 1)/k times y . log p, y being 1 at the row's class and -1/(k - 1) elsewhere.
                w = n * np.exp(-rate / (classes - 1) * score[np.arange(m), y] - by)
                slot = _node_of(bins, grown[0], grown[1], level) - (wide - 1) if grown else np.zeros(m, np.int64)
                mine = slot >= 0  # others ended before this level
                for j in range(d):
                    cell = ((slot[mine] * d + j) * size + bins[mine, j]) * classes + y[mine]
                    out += np.bincount(cell, w[mine], len(out))
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], ["v"])

        found = rows.mapInArrow(work, "v array<double>").toArrow()  # as many numbers a task as a level has nodes, inputs, bins and classes
        return np.sum([np.asarray(v.values) for v in found.column("v").combine_chunks()], axis=0).reshape(wide, d, size, classes)

    for _ in range(rounds):
        nodes = (2 << depth) - 1
        p = np.full((nodes, classes), 1.0 / classes)
        tree = np.full(nodes, -1), np.zeros(nodes, np.int64), p
        total = 0.0
        ends: dict[int, np.ndarray] = {}  # weight of the classes in the leaves
        for level in range(depth):
            sums = sums_of(tree if level else None, level)
            if not level:
                total = float(sums[0, 0].sum())
                if total <= 0:
                    break
                sums, shift = sums / total, shift + float(np.log(total))
            first = (1 << level) - 1
            split = _grown(sums, tree, p, level)
            for k in range(len(sums)):
                node, own = first + k, sums[k, 0].sum(axis=0)
                if tree[0][node] < 0:
                    ends[node] = own
                elif level == depth - 1:
                    left = sums[k, tree[0][node], : tree[1][node] + 1].sum(axis=0)
                    ends[2 * node + 1], ends[2 * node + 2] = left, own - left
            if not split:
                break
        if total <= 0:
            break
        wrong = sum(float(w.sum() - w[p[node].argmax()]) for node, w in ends.items())
        trees.append((tree[0], tree[1], _said(p, classes)))
        if wrong <= 1e-12:  # nothing is left to learn
            break
        if len(trees) - kept >= min(max(kept, 1), keep_every):
            done = trees[kept:]

            def scored(batches: Iterator[pa.RecordBatch], done: list[Tree] = done) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, d)
                        s = _matrix(batch.column("s"), classes) + _scores(bins, done, depth, classes)
                        s = pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), classes).cast(pa.list_(pa.float64()))
                        yield pa.RecordBatch.from_arrays([*batch.columns[:3], s], ["bins", "y", "n", "s"])

            rows = scratch.save(rows.mapInArrow(scored, rows.schema), f"train-{len(trees)}")
            scratch.drop(f"train-{kept}")
            kept = len(trees)
    scratch.drop(f"train-{kept}")

    @F.arrow_udf("double")
    def told(x: pa.Array) -> pa.Array:
        return pa.array(_scores(_numbers(_matrix(x, d), cuts), trees, depth, classes).argmax(axis=1).astype(np.float64))

    return test.withColumn("prediction", told(vector_to_array("features")))
