"""Exact nearest neighbours without meeting all pairs.

Rows are dealt to cells, each that of its nearest pivot, and keep their distance to it. An
asked row first meets the nearest cells that hold k rows between them; the k-th best found
is its reach. By the triangle inequality a cell whose distances to the pivot, least to
greatest, all lie further than the reach from the asked row's own distance has nothing nearer, nor
has any single row of which that is true. A cell's rows are nearest to its own pivot, so a pivot that is
further than the nearest one by over twice the reach is skipped with all its cell. So the second round meets the other cells within
reach only, and in them the rows within reach.

Cells go in blocks of at most PART_ROWS rows, a larger cell in several, and an asked row travels once to
each block in which it has a cell to meet. A block meets asked rows CHUNK at a time as products of matrices, which are
off by no more than a known bound; only rows that may be among the k best by them are measured
exactly, and a block keeps its k best before rows travel.

Pivots are at most MOST rows, chosen far apart from a sample by hash; a cell's counts and
bounds are a row each. What is skipped is never a neighbour, whatever the pivots.
Rows without a vector are met by none; ties of the squared distance go by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strideline.operators.form import rounded
from strideline.sources.scratch import Scratch

LEAST, MOST = 8, 1024
#: Rows in a block, and asked rows that meet it at once.
PART_ROWS, CHUNK = 20_000, 2_000
#: Asked rows that a task holds beside a block; more go in several shares, each of which meets the blocks by itself.
ASKED_ROWS = 50_000
#: What the reach is widened by, relative and absolute, for distances of single-precision vectors.
SLACK = 1e-5


def far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, each the furthest from those before it; fewer if there are not as many different ones."""
    chosen = [0]
    gap = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _vectors(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(v), len(pivots)))
    for i in range(0, len(v), 512):  # few enough to stay in a core's cache
        part = v[i : i + 512]
        for j, p in enumerate(pivots):  # differences, not products, so equal vectors are at distance 0
            gap = part - p
            out[i : i + 512, j] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of the rows, term by term in their own precision and order, to 9 digits, as SQL has it."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += (x[:, j] - y[:, j]).astype(np.float64) ** 2
    return rounded(out, 9)


class _Best:
    """The k best pairs so far of some asked rows, and the bound that each row's further ones must keep."""

    def __init__(self, x: np.ndarray, reach: np.ndarray, y: np.ndarray, other: pa.Array, k: int):
        self.x, self.y, self.k, self.met = x, y, k, 0
        self.bound = reach**2
        # The order of the keys, among which ties are settled.
        self.order = np.empty(len(y), np.int64)
        self.order[pc.sort_indices(other).to_numpy()] = np.arange(len(y))
        self.a, self.b, self.gap = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.many = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        self.more.append((a, b))
        self.many += len(a)
        if self.many > 4 * self.k * len(self.x) + 1000:
            self.settle()

    def settle(self) -> None:
        if not self.more:
            return
        a, b = (np.concatenate(side) for side in zip(*self.more, strict=True))
        gap = np.concatenate([self.gap, _gaps(self.x[a], self.y[b])])
        a, b = np.concatenate([self.a, a]), np.concatenate([self.b, b])
        by = np.lexsort((self.order[b], gap, a))
        a, b, gap = a[by], b[by], gap[by]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        last = place == self.k - 1
        self.bound[a[last]] = np.minimum(self.bound[a[last]], gap[last])
        keep = place < self.k
        self.a, self.b, self.gap, self.more, self.many = a[keep], b[keep], gap[keep], [], 0


def _best(pairs: DataFrame, k: int, *within: str) -> DataFrame:
    w = Window.partitionBy("asked", *within).orderBy("gap", "other")
    return pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def nearest_rows(base: DataFrame, asked: DataFrame, key: str, vector: str, label: str, k: int, met: list[Observation] | None = None) -> DataFrame:
    """asked, other, l and gap (the squared distance): the k rows of ``base`` nearest to each asked row, itself left out.

    ``met`` takes an observation of the pairs compared, ``n``, for each round.
    """
    spark = base.sparkSession
    scratch = Scratch(spark, "neighbours")
    b = base.select(F.col(key).alias("other"), F.col(vector).alias("y"), F.col(label).alias("l")).filter("y IS NOT NULL AND other IS NOT NULL")
    a = asked.select(F.col(key).alias("asked"), F.col(vector).alias("x")).filter("x IS NOT NULL AND asked IS NOT NULL")
    want = min(MOST, max(LEAST, math.isqrt(b.count())))
    sample = b.select("y", F.xxhash64(F.col("other").cast("string")).alias("h"), "other").orderBy("h", "other").limit(4 * want).collect()  # at most 4 MOST rows
    if not sample:
        fields = [T.StructField("asked", a.schema["asked"].dataType), *[b.schema[c] for c in ("other", "l")], T.StructField("gap", T.DoubleType())]
        return spark.createDataFrame([], T.StructType(fields))
    pivots = far_apart(np.array([r["y"] for r in sample], np.float64), want)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = _distances(_vectors(batch.column("y")), pivots)
                cell = gap.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "d"])

    placed = T.StructType([*b.schema.fields, T.StructField("cell", T.LongType()), T.StructField("d", T.DoubleType())])
    placed = scratch.save(b.mapInArrow(dealt, placed), "cells")
    count, low, high = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect():  # a row a pivot
        count[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    # Blocks of neighbouring numbers: a large cell's own ones, or one of several small cells.
    parts, start, used, at = np.maximum(-(-count // PART_ROWS), 1), np.zeros(len(pivots), np.int64), 0, 0
    for c, n in enumerate(count.tolist()):
        if used + n > PART_ROWS:
            at, used = at + 1, 0
        start[c] = at
        at, used = (at + int(parts[c]) - 1, PART_ROWS) if parts[c] > 1 else (at, used + n)
    starts, sizes = (F.array(*[F.lit(int(v)) for v in side]) for side in (start, parts))
    cell = F.col("cell").cast("int")
    placed = placed.withColumn("block", F.get(starts, cell) + F.pmod(F.xxhash64("other"), F.get(sizes, cell)))

    def near(q: np.ndarray, least: np.ndarray, reach: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether each of the cells may have a row within reach; ``q`` has the distances to their pivots."""
        r = reach[:, None]
        # A cell's rows are nearer to its pivot than to any other.
        return (q - high[cells] <= r) & (low[cells] - q <= r) & (q - least[:, None] <= 2 * r) & (count[cells] > 0)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = _distances(_vectors(batch.column("x")), pivots)
                order = np.argsort(gap, axis=1, kind="stable")
                enough = (np.cumsum(count[order], axis=1) <= k).sum(axis=1) + 1  # one more row than k, for its own
                home = [o[:n].astype(np.int32) for o, n in zip(order, enough, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gap.min(axis=1)), pa.array(home, pa.list_(pa.int32()))], [*batch.schema.names, "least", "home"])

    extra = [T.StructField("least", T.DoubleType()), T.StructField("home", T.ArrayType(T.IntegerType()))]
    a = scratch.save(a.mapInArrow(homes, T.StructType([*a.schema.fields, *extra])), "asked")
    shares = -(-a.count() // ASKED_ROWS)
    a = a.withColumn("share", F.pmod(F.xxhash64("asked"), F.lit(max(shares, 1)).cast("bigint")))
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(shares, 1) - 1).cast("bigint"))))

    def aims(rows: DataFrame, first: bool) -> DataFrame:
        """A row for each asked row and block in which it has a cell to meet."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if first:
                    cells = batch.column("home").to_pylist()
                else:
                    reach, least = batch.column("reach").to_numpy(), batch.column("least").to_numpy()
                    cells = near(_distances(_vectors(batch.column("x")), pivots), least, reach, np.arange(len(pivots)))
                    cells = [np.setdiff1d(np.flatnonzero(c), h) for c, h in zip(cells, batch.column("home").to_pylist(), strict=True)]
                blocks = [sorted({b for c in own for b in range(start[c], start[c] + parts[c])}) for own in cells]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.list_(pa.int64()))], [*batch.schema.names, "blocks"])

        fields = T.StructType([*rows.schema.fields, T.StructField("blocks", T.ArrayType(T.LongType()))])
        return rows.mapInArrow(work, fields).withColumn("to", F.explode("blocks")).drop("blocks")

    pair = T.StructType([T.StructField("asked", a.schema["asked"].dataType), *[b.schema[c] for c in ("other", "l")], T.StructField("gap", T.DoubleType()), T.StructField("met", T.LongType())])

    def compared(rows: DataFrame, first: bool) -> DataFrame:
        """The k best that each block has of the cells to meet."""

        def meet(asked: pa.Table, base: pa.Table) -> pa.Table:
            out = []
            if asked.num_rows and base.num_rows:
                base = base.sort_by("cell")
                for i in range(0, asked.num_rows, CHUNK):
                    out.append(met_by(asked.slice(i, CHUNK), base))
            empty = pa.table({"asked": asked.column("asked").slice(0, 0), **{c: base.column(c).slice(0, 0) for c in ("other", "l")}, "gap": pa.array([], pa.float64()), "met": pa.array([], pa.int64())})
            return pa.concat_tables([empty, *out])

        def met_by(asked: pa.Table, base: pa.Table) -> pa.Table:
            x, y = (pc.list_flatten(t.column(c)).to_numpy().reshape(t.num_rows, -1) for t, c in ((asked, "x"), (base, "y")))
            cell, d = base.column("cell").to_numpy(), base.column("d").to_numpy()
            cells, ends = np.unique(cell, return_index=True)
            ends = [*ends.tolist(), len(cell)]
            x64, y64 = x.astype(np.float64), y.astype(np.float64)
            x2, y2 = np.einsum("ij,ij->i", x64, x64), np.einsum("ij,ij->i", y64, y64)
            reach = asked.column("reach").to_numpy()
            q = _distances(x64, pivots[cells])
            home = asked.column("home").combine_chunks()
            place = np.searchsorted(cells, home.flatten().to_numpy())
            owner = np.repeat(np.arange(len(x)), np.diff(home.offsets.to_numpy()))
            real = (place < len(cells)) & (cells[np.minimum(place, len(cells) - 1)] == home.flatten().to_numpy())
            wanted = np.zeros(q.shape, bool)
            wanted[owner[real], place[real]] = True
            if not first:
                wanted = near(q, asked.column("least").to_numpy(), reach, cells) & ~wanted
            best = _Best(x, reach, y, base.column("other").combine_chunks(), k)
            # A row does not meet itself.
            keys = base.column("other").combine_chunks().dictionary_encode()
            key, own = keys.indices.to_numpy(), pc.index_in(asked.column("asked"), value_set=keys.dictionary).fill_null(-1).to_numpy()
            off = 1e-12 + x.shape[1] * 2.0**-50 * (x2.max() + y2.max())  # of the products
            for j, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
                mine = np.flatnonzero(wanted[:, j])
                if not len(mine):
                    continue
                gap = x2[mine, None] + y2[lo:hi] - 2 * (x64[mine] @ y64[lo:hi].T)
                fits = np.abs(q[mine, j][:, None] - d[lo:hi]) <= reach[mine, None]
                fits &= own[mine, None] != key[lo:hi]
                best.met += int(np.count_nonzero(fits))
                # Gaps of single-precision vectors differ from the products' by their rounding too.
                fits &= gap <= (best.bound[mine] * (1 + SLACK) + 1e-9 + off)[:, None]
                p, r = np.nonzero(fits)
                best.add(mine[p], r + lo)
            best.settle()
            met = np.zeros(len(best.a), np.int64)
            met[:1] = best.met
            columns = [asked.column("asked").take(pa.array(best.a)), *[base.column(c).take(pa.array(best.b)) for c in ("other", "l")], pa.array(best.gap), pa.array(met)]
            return pa.table(columns, names=["asked", "other", "l", "gap", "met"])

        pairs = aims(rows, first).groupBy("to", "share").cogroup(placed.groupBy("block", "part")).applyInArrow(meet, pair)
        if met is not None:
            met.append(Observation())
            pairs = pairs.observe(met[-1], F.coalesce(F.sum("met"), F.lit(0)).alias("n"))
        return pairs.drop("met")

    first = scratch.save(_best(compared(a.withColumn("reach", F.lit(math.inf)), True), k), "first")
    held = first.groupBy(F.col("asked").alias("of")).agg(F.max("gap").alias("worst"), F.count(F.lit(1)).alias("n"))
    rest = a.join(held, F.col("asked") == F.col("of"), "left")
    reach = F.when(F.col("n") >= k, F.sqrt("worst") * (1 + SLACK) + SLACK).otherwise(F.lit(math.inf))
    rest = rest.select("asked", "x", "least", "home", "share", reach.alias("reach"))
    return _best(first.unionByName(compared(rest, False)), k)
