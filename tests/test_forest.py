"""Forests on cells against a plain version over rows, and the draws of alike rows."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from strideline.operators import forest


def _rows(spark, n=400, seed=0):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, (n, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 7)).astype(float)
    y = np.where(r.random(n) < 0.1, 1 - y, y)
    df = spark.createDataFrame([(*map(float, v), float(k), float(1 + k)) for v, k in zip(x, y)], "a double, b double, c double, label double, weight double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df), x, y


def test_alike_rows_are_drawn_as_often_as_rows_by_themselves():
    h = np.random.default_rng(1).integers(0, 1 << 63, 40_000).astype(np.uint64)
    for n in (1.0, 7.0, 4000.0):
        got = forest._Draws().of(h, np.full(len(h), n), 3)
        assert abs(got.mean() / n - 1) < 0.02 and abs(got.var() / n - 1) < 0.05
    mixed = forest._Draws().of(h, np.where(np.arange(len(h)) % 2, 5.0, 1.0), 3)
    assert abs(mixed[::2].mean() - 1) < 0.03 and abs(mixed[1::2].mean() - 5) < 0.1


def _plain(cells, draws, drawn, depth, classes):
    """node -> (feature, bin) of one tree grown node by node."""
    out, todo = {}, [(0, np.ones(len(cells), bool))]
    worth = (lambda s: sum(v * v for v in s) / max(sum(s), 1e-300)) if classes else (lambda s: s[1] ** 2 / max(s[0], 1e-300))
    bins, y = np.array([list(c["bins"]) for c in cells]), np.array([c["y"] for c in cells])
    stats = [np.where(y == k, draws, 0.0) for k in range(classes)] if classes else [draws, draws * y]
    while todo:
        node, mine = todo.pop()
        level = (node + 1).bit_length() - 1
        total = [s[mine].sum() for s in stats]
        if level == depth or (classes and sum(v > 0 for v in total) < 2):
            continue
        best = (1e-9, None, None)
        for f in drawn[level][node - (1 << level) + 1]:
            for b in range(forest.BINS):
                left = mine & (bins[:, f] <= b)
                if draws[left].sum() > 0 and draws[mine & ~left].sum() > 0:
                    gain = worth([s[left].sum() for s in stats]) + worth([s[mine & ~left].sum() for s in stats]) - worth(total)
                    if gain > best[0] + 1e-9:
                        best = (gain, int(f), b)
        if best[1] is not None:
            out[node] = best[1:]
            right = bins[:, best[1]] > best[2]
            todo += [(2 * node + 1, mine & ~right), (2 * node + 2, mine & right)]
    return out


def test_trees_equal_a_plain_version(spark):
    df, _, _ = _rows(spark)
    for classes, many in ((2, 2), (0, 1)):
        learner = forest.Forest(classes=classes, trees=4, depth=3, weight="weight")
        model = learner.fit(df)
        cuts = forest.cuts_of(df, "features")
        cells = forest._cells(df, "features", "label", F.col("weight"), cuts).withColumn("h", F.xxhash64("bins", "y", "w", F.lit(42))).collect()
        assert sum(c["n"] for c in cells) == 400
        h, n, w = (np.array([c[k] for c in cells]) for k in "hnw")
        for t in range(4):
            draws = forest._Draws().of(h.view(np.uint64), n, t) * w
            want = _plain(cells, draws, [forest._drawn_features(42, t, level, 3, many) for level in range(3)], 3, classes)
            assert {i: (int(f), int(a)) for i, (f, a) in enumerate(zip(model.feature[t], model.at[t])) if f >= 0} == want


def test_copies_make_no_more_cells_and_missing_values_are_told(spark):
    df, x, y = _rows(spark)
    cuts = forest.cuts_of(df, "features")
    once = forest._cells(df, "features", "label", F.col("weight"), cuts)
    often = forest._cells(df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9)))), "features", "label", F.col("weight"), cuts)
    assert once.count() == often.count() and often.agg(F.sum("n")).first()[0] == 9 * 400
    model = forest.Forest(trees=20).fit(df)
    assert np.isfinite(model.told(np.array([[np.nan, 1.0, 2.0], [3.0, np.nan, np.nan]]))).all()
    told = model.transform(df).select("label", "prediction").collect()
    assert np.mean([r["label"] == r["prediction"] for r in told]) > 0.85
    shares = model.featureImportances.toArray()
    assert abs(shares.sum() - 1) < 1e-9 and shares.argmin() == 2


def test_trees_of_spark_over_cells_are_those_of_the_rows(spark):
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier

    df, _, _ = _rows(spark)
    for learner in (DecisionTreeClassifier(maxDepth=4, weightCol="weight", seed=42), GBTClassifier(maxIter=3, maxDepth=2, seed=42, weightCol="weight")):
        want = learner.fit(df).transform(df).select("features", "prediction")
        got = forest.OnCells(learner).fit(df).transform(df)
        assert "__bins" not in got.columns
        assert sorted(map(str, got.select("features", "prediction").collect())) == sorted(map(str, want.collect()))
