"""Neighbours by pivots against all pairs, and how many pairs they meet."""

import numpy as np
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strideline.operators import neighbours


def _frame(spark, x):
    rows = [(i, None if v is None else [float(c) for c in v], i % 3) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, v array<double>, label int").repartition(4)


def _plain(x, asked, k):
    out = set()
    for i in asked:
        gaps = sorted((round(float(((x[i] - x[j]) ** 2).sum()), 9), j) for j in range(len(x)) if j != i)
        out |= {(i, j, g) for g, j in gaps[:k]}
    return out


def _found(df):
    return {(r["asked"], r["other"], r["gap"]) for r in df.collect()}


def test_equal_to_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 15)  # cells of many parts
    r = np.random.default_rng(0)
    clusters = np.concatenate([r.normal(c, 0.2, (60, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 9, 3))])
    copies = np.concatenate([np.zeros((40, 2)), r.integers(0, 3, (60, 2)).astype(float)])  # many ties
    for x, k in ((clusters, 4), (copies, 7), (r.normal(size=(50, 8)), 60), (np.ones((5, 2)), 2)):
        df = _frame(spark, x)
        asked = range(0, len(x), 7)
        got = _found(neighbours.nearest_rows(df, df.filter("id % 7 = 0"), "id", "v", "label", k))
        assert got == _plain(x, asked, k)


def test_rows_without_vectors_and_empty_tables(spark):
    df = _frame(spark, [[0.0], None, [2.0], [5.0]])
    got = _found(neighbours.nearest_rows(df, df, "id", "v", "label", 1))
    assert got == {(0, 2, 4.0), (2, 0, 4.0), (3, 2, 9.0)}
    assert neighbours.nearest_rows(df.limit(0), df, "id", "v", "label", 1).count() == 0
    assert neighbours.nearest_rows(df, df.limit(0), "id", "v", "label", 1).count() == 0


def test_pairs_met_grow_slower_than_the_product(spark):
    met = {}
    for n in (400, 3200):
        r = np.random.default_rng(1)
        x = r.uniform(0, 100, (n, 2))
        df = _frame(spark, x)
        rounds: list[Observation] = []
        found = neighbours.nearest_rows(df, df.filter("id % 4 = 0"), "id", "v", "label", 5, rounds)
        assert found.count() == 5 * n // 4
        met[n] = sum(o.get["n"] for o in rounds)
        assert met[n] < n * (n // 4) / 4
    assert met[3200] < 64 * met[400] / 2.5  # eight times the rows: 64 times the pairs without pivots


def test_blocks_and_shares_of_single_precision_rows(spark, monkeypatch):
    """Vectors without clusters, where nothing can be skipped: asked rows travel once a block, in several shares and chunks."""
    for name, n in (("PART_ROWS", 100), ("ASKED_ROWS", 20), ("CHUNK", 3)):
        monkeypatch.setattr(neighbours, name, n)
    x = np.random.default_rng(2).normal(size=(300, 32)).astype(np.float32)
    x[7] = x[11] = x[0]  # copies are at distance 0
    df = _frame(spark, x.tolist()).withColumn("v", F.col("v").cast("array<float>"))
    got = neighbours.nearest_rows(df, df.filter("id % 5 = 0"), "id", "v", "label", 6).collect()
    want = set()
    for i in range(0, 300, 5):
        gaps = sorted((round(float(((x[i] - y).astype(np.float64) ** 2).sum()), 9), j) for j, y in enumerate(x) if j != i)
        want |= {(i, j) for _, j in gaps[:6]}
    assert {(r["asked"], r["other"]) for r in got} == want and len(got) == 360
