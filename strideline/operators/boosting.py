"""Gradient-boosted trees on histograms, grown leaf by leaf.

Values become bin numbers once, in a saved table that holds alike rows (bins, label) once, with
their number and the sum of their weights: sums over rows are the same, and a pass costs what
there is of different rows, which few values or many copies bound. A tree grows in waves: one pass adds up
gradient, curvature and count by (leaf, feature, bin) for the smaller child of every
split that the best-first order may take, the other child is parent less child, and the
order is followed again with what is now known. So a tree takes as many passes as it
is deep, not as many as it has leaves, and is the tree that splitting the best leaf
first, one at a time, would give. All classes grow in the same passes. A node of at most
``here`` rows is sent to one task, which grows all that can come of it by the same rule.

What a task sends is at most a number a cell, and what reaches the driver is
leaves x features x bins, whatever the rows. Scores of finished trees are carried in the
tasks' code and written to the rows every ``keep_every`` rounds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.sources.scratch import Scratch

BINS = 256  # the last is that of missing values
MISSING = BINS - 1


@dataclass
class Tree:
    """Nodes in order of creation; ``feature`` is -1 at leaves."""

    feature: list[int] = field(default_factory=lambda: [-1])
    at: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    children: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])
    value: list[float] = field(default_factory=lambda: [0.0])

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bin numbers."""
        out = np.zeros(len(bins), np.int64)
        rows = {0: np.arange(len(bins))}
        for i, f in enumerate(self.feature):
            if f < 0 or i not in rows:
                continue
            mine = rows.pop(i)
            b = bins[mine, f]
            left = b <= self.at[i]
            left = np.where(b == MISSING, self.missing_left[i], left)
            for child, part in zip(self.children[i], (mine[left], mine[~left]), strict=True):
                out[part] = child
                rows[child] = part
        return out

    def values_of(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(c, x[:, f], "left"))
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Equally long lists of numbers as rows; null is missing."""
    return np.asarray(pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, width).copy()


def _probabilities(raw: np.ndarray) -> np.ndarray:
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-raw))
        return np.hstack([1 - p, p])
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _slopes(raw: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient and curvature by row and tree, and each row's loss."""
    if classes == 0:
        gap = raw[:, 0] - y
        return (gap * w)[:, None], w[:, None], w * gap * gap / 2
    p = _probabilities(raw)
    loss = -w * np.log(np.maximum(p[np.arange(len(y)), y.astype(int)], 1e-15))
    if classes == 2:
        p = p[:, 1:]
        return (p - y[:, None]) * w[:, None], p * (1 - p) * w[:, None], loss
    return (p - (y[:, None] == np.arange(classes))) * w[:, None], p * (1 - p) * w[:, None], loss


@dataclass
class _Split:
    gain: float
    feature: int
    at: int
    missing_left: bool
    left: np.ndarray  # gradient, curvature and count of the left rows
    right: np.ndarray


def best_split(histogram: np.ndarray, least: int, l2: float) -> _Split | None:
    """The split of greatest gain of (feature, bin, gradient-curvature-count); ties to the first feature and bin."""
    total = histogram[0].sum(axis=0)
    known = histogram[:, :MISSING]
    missing = histogram[:, MISSING]
    ahead = np.cumsum(known, axis=1)

    def worth(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / np.maximum(s[..., 1] + l2, 1e-300)

    best = None
    for missing_left in (False, True):
        left = ahead + (missing[:, None] if missing_left else 0.0)
        right = total - left
        gain = worth(left) + worth(right) - worth(total)
        fits = (left[..., 2] >= least) & (right[..., 2] >= least) & (left[..., 1] >= 1e-3) & (right[..., 1] >= 1e-3)
        gain = np.where(fits, gain, -np.inf)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] > 1e-10 and (best is None or gain[f, b] > best.gain):
            best = _Split(float(gain[f, b]), int(f), int(b), missing_left, left[f, b].copy(), right[f, b].copy())
    return best


class _Growth:
    """A tree whose histograms arrive in waves."""

    def __init__(self, leaves: int, least: int, l2: float, rows: int, here: int = 0):
        self.leaves, self.least, self.l2, self.here = leaves, least, l2, here
        self.tree = Tree()
        self.histograms: dict[int, np.ndarray] = {}
        self.split: dict[int, _Split | None] = {}
        self.total: dict[int, np.ndarray] = {}
        self.order: list[int] = []
        # Nodes whose histogram is asked for, and nodes that one task is to grow.
        self.asked: list[int] = [0] if rows > here else []
        self.small: list[int] = [] if rows > here else [0]

    def learn(self, node: int, histogram: np.ndarray) -> None:
        self.histograms[node] = histogram
        self.total.setdefault(node, histogram[0].sum(axis=0))
        self.split[node] = best_split(histogram, self.least, self.l2)

    def told(self, found: dict[int, np.ndarray], grown: dict[int, tuple[np.ndarray, list[tuple[int, _Split]]]]) -> None:
        """Takes the histograms and small trees asked for, adds the siblings' histograms, and asks for the next."""
        for node, (sums, splits) in grown.items():
            self.total.setdefault(node, sums)
            place = [node]
            for own, s in splits:
                self.split[place[own]] = s
                self._expand(place[own], s)
                place += self.tree.children[place[own]]
            for leaf in place:
                self.split.setdefault(leaf, None)
        parent = {c: (i, pair) for i, pair in enumerate(self.tree.children) if self.tree.feature[i] >= 0 for c in pair}
        for node in self.asked:
            self.learn(node, found[node])
            if node:
                up, pair = parent[node]
                other = pair[0] if pair[1] == node else pair[1]
                if other not in self.split:
                    self.learn(other, self.histograms[up] - found[node])
        self._follow()

    def _follow(self) -> None:
        """Splits the best leaf first as far as is known, and asks for the nodes that could change that."""
        heap, taken, waiting, n = [], [], [], 1
        self.inner: list[int] = []

        def offer(node: int) -> None:
            if self.total[node][2] < 2 * self.least:
                self.split[node] = None
            if node not in self.split:
                waiting.append((len(taken), node))
            elif self.split[node] is not None:
                heapq.heappush(heap, (-self.split[node].gain, node))

        offer(0)
        while heap and n < self.leaves:
            _, node = heapq.heappop(heap)
            taken.append(node)
            s = self.split[node]
            if self.tree.feature[node] < 0:
                self._expand(node, s)
            n += 1
            for child in self.tree.children[node]:
                offer(child)
        self.inner = taken
        # A node made by the last split of a full tree can change nothing.
        needed = {node for at, node in waiting if at < len(taken) or n < self.leaves}
        large = {node for node in needed if self.total[node][2] > self.here}
        # The smaller child is added up; the other one is the rest.
        self.asked = [min(self.tree.children[node], key=lambda c: (self.total[c][2], c)) for node in taken if large.intersection(self.tree.children[node])]
        self.small = sorted(needed - large - set(self.asked))

    def _expand(self, node: int, s: _Split) -> None:
        t, k = self.tree, len(self.tree.feature)
        self.order.append(node)
        t.feature[node], t.at[node], t.missing_left[node], t.children[node] = s.feature, s.at, s.missing_left, (k, k + 1)
        for side in (s.left, s.right):
            t.feature.append(-1), t.at.append(0), t.missing_left.append(False), t.children.append((0, 0)), t.value.append(0.0)
            self.total[len(t.feature) - 1] = side

    def finished(self, rate: float) -> Tree:
        """The tree without the splits that were tried ahead."""
        out, inner, stack = Tree(), set(self.inner), [(0, 0)]
        while stack:
            old, new = stack.pop()
            if old in inner:
                k = len(out.feature)
                out.feature[new], out.at[new] = self.tree.feature[old], self.tree.at[old]
                out.missing_left[new], out.children[new] = self.tree.missing_left[old], (k, k + 1)
                for child, place in zip(self.tree.children[old], (k, k + 1), strict=True):
                    out.feature.append(-1), out.at.append(0), out.missing_left.append(False), out.children.append((0, 0)), out.value.append(0.0)
                    stack.append((child, place))
            else:
                g, h, _ = self.total[old]
                out.value[new] = -rate * g / (h + self.l2) if h + self.l2 > 0 else 0.0
        return out


@dataclass
class HistogramModel:
    """Fitted trees by round and class. ``curve`` has the loss of the rows held back, before each round."""

    classes: int
    cuts: list[np.ndarray]
    start: np.ndarray
    rounds: list[list[Tree]]
    curve: list[float]
    features: str = "features"

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = _binned(x, self.cuts)
        out = np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for k, t in enumerate(trees):
                out[:, k] += t.values_of(bins)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, for classes also ``probability``."""
        d, classes, raw = len(self.cuts), self.classes, self.raw

        @F.arrow_udf("array<double>")
        def told(x: pa.Array) -> pa.Array:
            scores = raw(_matrix(x, d))
            values = _probabilities(scores) if classes else scores
            return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))

        out = df.withColumn("__told", told(vector_to_array(self.features)))
        if not classes:
            return out.withColumn("prediction", F.get("__told", F.lit(0))).drop("__told")
        top = (F.array_position("__told", F.array_max("__told")) - 1).cast("double")
        return out.withColumns({"prediction": top, "probability": array_to_vector("__told")}).drop("__told")


@dataclass(frozen=True)
class HistogramTrees:
    """Learner of ``classes`` classes (labels 0, 1, ...), or of a number where ``classes`` is 0.

    With more than ``early_above`` rows, ``held`` of them are kept out and growth ends when the last
    ``patience`` rounds have not lowered their loss.
    """

    classes: int = 2
    rounds: int = 100
    leaves: int = 31
    bins: int = 255
    rate: float = 0.1
    least: int = 20
    l2: float = 0.0
    held: float = 0.1
    patience: int = 10
    early_above: int = 10_000
    keep_every: int = 10
    here: int = 100_000
    features: str = "features"
    label: str = "label"
    weight: str | None = None

    def copy(self, extra: dict | None = None) -> HistogramTrees:
        return self

    def _cuts(self, rows: DataFrame, d: int) -> list[np.ndarray]:
        """Upper ends of the bins: all distinct values where they are few, else quantiles of a mergeable sketch."""
        share = [k / self.bins for k in range(1, self.bins)]
        x = [F.when(~F.isnan(F.get("x", F.lit(f))), F.get("x", F.lit(f))) for f in range(d)]
        seen = rows.agg(*[F.percentile_approx(c, share, 10_000).alias(f"q{f}") for f, c in enumerate(x)], *[F.approx_count_distinct(c).alias(f"n{f}") for f, c in enumerate(x)]).first()
        out = []
        for f in range(d):
            values = sorted(set(seen[f"q{f}"] or []))
            if seen[f"n{f}"] <= 2 * self.bins:
                few = [r[0] for r in rows.select(x[f].alias("v")).filter("v IS NOT NULL").distinct().limit(self.bins + 1).collect()]
                values = sorted(few)[:-1] if len(few) <= self.bins else values
            out.append(np.array(values, np.float64))
        return out

    def fit(self, df: DataFrame) -> HistogramModel:
        scratch = Scratch(df.sparkSession, "boosting")
        trees_a_round = self.classes if self.classes > 2 else 1
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"), weight.alias("w"))
        first = rows.first()
        if first is None:
            raise ValueError("no rows to learn from")
        d = len(first["x"])
        cuts = self._cuts(rows, d)
        # Rows are held back by content, so a task that is run again holds back the same ones.
        held = F.pmod(F.xxhash64("x", "y"), F.lit(1000)) < int(1000 * self.held)
        binned = rows.select("x", "y", "w", held.alias("held")).mapInArrow(_to_bins(cuts, d), "bins binary, y double, w double, held boolean")
        alike = binned.groupBy("bins", "y", "held").agg(F.sum("w").alias("w"), F.count(F.lit(1)).cast("double").alias("n"))
        alike = alike.repartition(df.sparkSession.sparkContext.defaultParallelism)  # else few small tasks' work in each of many passes
        rows = scratch.save(alike.select("bins", "y", "w", "n", "held", F.array_repeat(F.lit(0.0), trees_a_round).alias("raw")), "rows-0")
        total = rows.agg(F.sum("n")).first()[0]
        early = self.patience > 0 and total > self.early_above
        if not early:
            rows = rows.withColumn("held", F.lit(False))
        start = self._start(rows)
        learnt = int(rows.filter(~F.col("held")).agg(F.sum("n")).first()[0] or 0)
        done: list[list[Tree]] = []
        saved, curve, label = 0, [], 0
        for _ in range(self.rounds):
            growths = [_Growth(self.leaves, self.least, self.l2, learnt, self.here) for _ in range(trees_a_round)]
            state = rows, d, growths, done[saved:], start if not saved else np.zeros_like(start)
            opening = True
            while any(g.asked or g.small for g in growths):
                found, grown = {}, {}
                if any(g.asked for g in growths):
                    found, loss = self._pass(*state)
                if any(g.small for g in growths):
                    grown, loss = self._small(*state)
                if opening:
                    curve.append(loss)
                    opening = False
                    if early and len(curve) > self.patience and min(curve[-self.patience :]) > curve[-self.patience - 1] - 1e-7:
                        return HistogramModel(self.classes, cuts, start, done, curve, self.features)
                for k, g in enumerate(growths):
                    if g.asked or g.small:
                        g.told({node: found[k, node] for node in g.asked}, {node: grown[k, node] for node in g.small if (k, node) in grown})
            trees = [g.finished(self.rate) for g in growths]
            if all(len(t.feature) == 1 for t in trees):
                break  # nothing is left to split
            done.append(trees)
            if len(done) - saved >= self.keep_every:
                new = rows.mapInArrow(_to_scores(done[saved:], start if not saved else np.zeros_like(start), d, trees_a_round), _ROWS)
                rows = scratch.save(new, f"rows-{len(done)}")
                scratch.drop(f"rows-{label}")
                saved = label = len(done)
        scratch.drop(".")
        return HistogramModel(self.classes, cuts, start, done, curve, self.features)

    def _start(self, rows: DataFrame) -> np.ndarray:
        known = rows.filter(~F.col("held"))
        if self.classes == 0:
            return np.array([known.agg(F.sum(F.col("y") * F.col("w")) / F.sum("w")).first()[0]])
        share = {int(r["y"]): r["w"] for r in known.groupBy("y").agg(F.sum("w").alias("w")).collect()}  # a row a class
        p = np.array([max(share.get(k, 0.0), 1e-12) for k in range(self.classes)])
        p /= p.sum()
        return np.array([math.log(p[1] / p[0])]) if self.classes == 2 else np.log(p)

    def _pass(
        self, rows: DataFrame, d: int, growths: list[_Growth], pending: list[list[Tree]], shift: np.ndarray
    ) -> tuple[dict[tuple[int, int], np.ndarray], float]:
        """Histograms of the nodes asked for, and the mean loss of the rows held back."""
        slots, slot_of = _slots(growths, [g.asked for g in growths])
        trees, classes, many = [g.tree for g in growths], self.classes, len(growths)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = np.zeros((len(slots) * d * BINS, 3))
            lost = np.zeros(2)
            for batch in batches:
                bins, y, w, n, held, raw = _unpacked(batch, d, many)
                raw = _scored(raw, bins, pending, shift)
                g, h, loss = _slopes(raw, y, w, classes)
                lost += loss[held].sum(), w[held].sum()
                for k in range(many):
                    slot = slot_of[k][trees[k].leaf_of(bins)]
                    at = np.flatnonzero((slot >= 0) & ~held)
                    for f in range(d):
                        cells += _added((slot[at] * d + f) * BINS + bins[at, f], g[at, k], h[at, k], n[at], len(cells))
            used = np.flatnonzero(cells[:, 2])
            sums = np.vstack([cells[used], [[*lost, 0.0]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), *[pa.array(sums[:, j]) for j in range(3)]], ["cell", "g", "h", "n"])

        sums = rows.mapInArrow(work, "cell bigint, g double, h double, n double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
        cell = sums["cell"].to_numpy()
        values = np.stack([sums[c].to_numpy() for c in "ghn"], axis=1)
        out = np.zeros((len(slots) * d * BINS, 3))
        out[cell[cell >= 0]] = values[cell >= 0]
        lost = values[cell == -1].sum(axis=0)
        out = out.reshape(len(slots), d, BINS, 3)
        return dict(zip(slots, out, strict=True)), float(lost[0] / lost[1]) if lost[1] else math.nan

    def _small(
        self, rows: DataFrame, d: int, growths: list[_Growth], pending: list[list[Tree]], shift: np.ndarray
    ) -> tuple[dict[tuple[int, int], tuple[np.ndarray, list[tuple[int, _Split]]]], float]:
        """The small nodes' sums and the splits that can come of them, and the mean loss of the rows held back."""
        slots, slot_of = _slots(growths, [g.small for g in growths])
        trees, classes, many = [g.tree for g in growths], self.classes, len(growths)
        leaves, least, l2 = self.leaves, self.least, self.l2

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins, y, w, n, held, raw = _unpacked(batch, d, many)
                raw = _scored(raw, bins, pending, shift)
                g, h, loss = _slopes(raw, y, w, classes)
                yield _of_slot(np.array([-1]), np.zeros((1, d), np.uint8), loss[held].sum()[None], w[held].sum()[None], np.ones(1))
                for k in range(many):
                    slot = slot_of[k][trees[k].leaf_of(bins)]
                    at = np.flatnonzero((slot >= 0) & ~held)
                    yield _of_slot(slot[at], bins[at], g[at, k], h[at, k], n[at])

        def grown(table: pa.Table) -> pa.Table:
            slot = table.column("slot")[0].as_py()
            g, h, n = (table.column(c).to_numpy() for c in "ghn")
            sums = [float(g.sum()), float(h.sum()), float(n.sum())]
            flat: list[float] = []
            if slot >= 0:
                bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, d)
                own = _grown_here(bins, g, h, n, leaves, least, l2)
                for node in own.order:
                    s = own.split[node]
                    flat += map(float, (node, s.gain, s.feature, s.at, s.missing_left, *s.left, *s.right))
            return pa.table([pa.array([slot], pa.int32()), pa.array([sums]), pa.array([flat], pa.list_(pa.float64()))], schema=_GROWN)

        told = rows.mapInArrow(sent, "slot int, bins binary, g double, h double, n double").groupBy("slot").applyInArrow(grown, "slot int, sums array<double>, splits array<double>").collect()
        out, loss = {}, math.nan
        for r in told:
            if r["slot"] < 0:
                loss = r["sums"][0] / r["sums"][1] if r["sums"][1] else math.nan
                continue
            lines = np.array(r["splits"]).reshape(-1, 11)
            splits = [(int(x[0]), _Split(x[1], int(x[2]), int(x[3]), bool(x[4]), x[5:8].copy(), x[8:11].copy())) for x in lines]
            out[slots[r["slot"]]] = np.array(r["sums"]), splits
        return out, loss


def _slots(growths: list[_Growth], wanted: list[list[int]]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """The wanted (tree, node) pairs, and for each tree the place in that list of every node, or -1."""
    slots = [(k, node) for k, nodes in enumerate(wanted) for node in nodes]
    slot_of = [np.full(len(g.tree.feature), -1) for g in growths]
    for s, (k, node) in enumerate(slots):
        slot_of[k][node] = s
    return slots, slot_of


def _added(cell: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(cell, x, size) for x in (g, h, n)], axis=1)


def _grown_here(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int, l2: float) -> _Growth:
    """A whole tree of rows in memory; each stands for ``n`` alike."""
    own = _Growth(leaves, least, l2, int(n.sum()), here=-1)
    while own.asked:
        leaf, found = own.tree.leaf_of(bins), {}
        for node in own.asked:
            at = np.flatnonzero(leaf == node)
            found[node] = np.stack([_added(bins[at, f], g[at], h[at], n[at], BINS) for f in range(bins.shape[1])])
        own.told(found, {})
    return own


_GROWN = pa.schema([("slot", pa.int32()), ("sums", pa.list_(pa.float64())), ("splits", pa.list_(pa.float64()))])
_OF_SLOT = pa.schema([("slot", pa.int32()), ("bins", pa.binary()), ("g", pa.float64()), ("h", pa.float64()), ("n", pa.float64())])


def _of_slot(slot: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), _bytes(bins), pa.array(g), pa.array(h), pa.array(n)], schema=_OF_SLOT)


_ROWS = "bins binary, y double, w double, n double, held boolean, raw array<double>"
_ROWS_ARROW = pa.schema([("bins", pa.binary()), ("y", pa.float64()), ("w", pa.float64()), ("n", pa.float64()), ("held", pa.bool_()), ("raw", pa.list_(pa.float64()))])


def _bytes(bins: np.ndarray) -> pa.Array:
    """Rows of bin numbers as equally long strings."""
    rows, d = bins.shape
    ends = pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * np.int32(d))
    return pa.Array.from_buffers(pa.binary(), rows, [None, ends, pa.py_buffer(np.ascontiguousarray(bins, np.uint8))])


def _unpacked(batch: pa.RecordBatch, d: int, many: int):
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, d)
    y, w, n, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "n", "held"))
    return bins, y, w, n, held.astype(bool), _matrix(batch.column("raw"), many)


def _scored(raw: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]], shift: np.ndarray) -> np.ndarray:
    raw += shift
    for trees in rounds:
        for k, t in enumerate(trees):
            raw[:, k] += t.values_of(bins)
    return raw


def _packed(bins: np.ndarray, y, w, n, held, raw: np.ndarray) -> pa.RecordBatch:
    lists = pa.FixedSizeListArray.from_arrays(pa.array(raw.ravel()), raw.shape[1]).cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([_bytes(bins), pa.array(y), pa.array(w), pa.array(n), pa.array(held), lists], schema=_ROWS_ARROW)


def _to_bins(cuts: list[np.ndarray], d: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = _binned(_matrix(batch.column("x"), d), cuts)
                yield pa.RecordBatch.from_arrays([_bytes(bins), *[batch.column(c) for c in ("y", "w", "held")]], ["bins", "y", "w", "held"])

    return work


def _to_scores(rounds: list[list[Tree]], shift: np.ndarray, d: int, many: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, y, w, n, held, raw = _unpacked(batch, d, many)
                yield _packed(bins, y, w, n, held, _scored(raw, bins, rounds, shift))

    return work
