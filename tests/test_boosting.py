"""Histogram trees against a plain version that splits one leaf at a time over raw values."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strideline.operators import boosting


def _plain_tree(x, g, h, leaves, least):
    """Values by row of a tree grown by best leaf; every threshold between values is tried."""

    def best(rows):
        out = None
        worth = lambda r: g[r].sum() ** 2 / max(h[r].sum(), 1e-300)
        for f in range(x.shape[1]):
            known = rows[~np.isnan(x[rows, f])]
            for missing_left in (False, True):
                for v in np.unique(x[known, f]):
                    left = rows[(x[rows, f] <= v) | (missing_left & np.isnan(x[rows, f]))]
                    right = np.setdiff1d(rows, left)
                    if len(left) >= least <= len(right) and h[left].sum() >= 1e-3 <= h[right].sum():
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > 1e-10 and (out is None or gain > out[0] + 1e-12):
                            out = gain, left, right
        return out

    grown = [(np.arange(len(x)), best(np.arange(len(x))))]
    while len(grown) < leaves:
        k = max((k for k in range(len(grown)) if grown[k][1]), key=lambda k: grown[k][1][0], default=None)
        if k is None:
            break
        _, left, right = grown.pop(k)[1]
        grown += [(left, best(left)), (right, best(right))]
    out = np.zeros(len(x))
    for rows, _ in grown:
        out[rows] = -g[rows].sum() / h[rows].sum()
    return out


def _data(n=260, seed=0):
    r = np.random.default_rng(seed)
    x = np.stack([r.integers(0, 25, n).astype(float), r.normal(size=n).round(1), r.integers(0, 3, n).astype(float)], axis=1)
    x[r.random(n) < 0.1, 1] = np.nan
    score = np.nan_to_num(x[:, 1]) + (x[:, 0] > 12) * (x[:, 2] == 1) + 0.3 * r.normal(size=n)
    return x, np.digitize(score, [0.0, 0.9]).astype(float), r.uniform(0.5, 2, n)


def _frame(spark, x, y, w):
    rows = [(i, [float(v) for v in a], float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))]
    df = spark.createDataFrame(rows, "id int, x array<double>, label double, weight double")
    return df.withColumn("features", array_to_vector("x")).repartition(3, "id")


@pytest.mark.parametrize(("classes", "here"), [(0, 1000), (2, 0), (2, 60), (3, 60)])
def test_trees_equal_one_leaf_at_a_time(spark, classes, here):
    x, y, w = _data(180)
    y = y if classes == 3 else (y > 0).astype(float) if classes == 2 else y + x[:, 0] / 9
    learner = boosting.HistogramTrees(classes=classes, rounds=3, leaves=9, least=8, weight="weight", keep_every=2, here=here)
    model = learner.fit(_frame(spark, x, y, w))
    k = classes if classes > 2 else 1
    raw = np.tile(model.start, (len(x), 1))
    for _ in range(3):
        g, h, _ = boosting._slopes(raw.copy(), y, w, classes)
        raw += 0.1 * np.stack([_plain_tree(x, g[:, c], h[:, c], 9, 8) for c in range(k)], axis=1)
    assert np.abs(model.raw(x) - raw).max() < 1e-9
    got = {r["id"]: r for r in model.transform(_frame(spark, x, y, w)).collect()}
    if classes:
        p = boosting._probabilities(raw)
        assert all(np.abs(got[i]["probability"].toArray() - p[i]).max() < 1e-9 and got[i]["prediction"] == p[i].argmax() for i in range(len(x)))
    else:
        assert all(abs(got[i]["prediction"] - raw[i, 0]) < 1e-9 for i in range(len(x)))


def test_many_values_fall_in_quantile_bins_and_growth_ends_early(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 2))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    noise = r.random(3000) < 0.1
    df = _frame(spark, x, np.where(noise, 1 - y, y), np.ones(3000))
    model = boosting.HistogramTrees(rounds=60, leaves=8, early_above=1000, patience=5, rate=0.3).fit(df)
    assert all(len(c) <= 254 for c in model.cuts) and len(model.rounds) < 60
    assert model.curve[0] == pytest.approx(np.log(2), abs=0.02) and min(model.curve) < 0.45
    told = model.transform(df).select("id", "prediction").collect()
    assert np.mean([t["prediction"] == y[t["id"]] for t in told]) > 0.97


def test_rows_alike_and_one_class_make_no_tree(spark):
    x = np.ones((50, 2))
    for y in (np.arange(50) % 2, np.zeros(50)):
        model = boosting.HistogramTrees(rounds=3).fit(_frame(spark, x, y.astype(float), np.ones(50)))
        assert model.rounds == []
        assert boosting._probabilities(model.raw(x))[0, 1] == pytest.approx(y.mean(), abs=1e-9)
    with pytest.raises(ValueError):
        boosting.HistogramTrees().fit(_frame(spark, x, np.zeros(50), np.ones(50)).filter(F.lit(False)))


def test_alike_rows_are_held_once_and_count_as_many(spark, monkeypatch):
    x, y, w = _data(180)
    y = (y > 0).astype(float)
    held_rows = []
    save = boosting.Scratch.save

    def counted(self, df, label):
        out = save(self, df, label)
        held_rows.append(out.count())
        return out

    monkeypatch.setattr(boosting.Scratch, "save", counted)
    learner = boosting.HistogramTrees(rounds=3, leaves=9, weight="weight", here=0, early_above=10**6)
    once = boosting.HistogramTrees(**(learner.__dict__ | {"least": 8})).fit(_frame(spark, x, y, w))
    df = _frame(spark, np.tile(x, (40, 1)), np.tile(y, 40), np.tile(w, 40))
    many = boosting.HistogramTrees(**(learner.__dict__ | {"least": 8 * 40})).fit(df)
    assert np.abs(once.raw(x) - many.raw(x)).max() < 1e-9
    assert held_rows[0] == held_rows[1] <= 180
