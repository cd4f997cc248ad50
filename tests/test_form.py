"""Window features on edge frames, against values worked out by hand or with pandas."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from strideline.functions import scalars
from strideline.operators import evaluate, form, models, nested, prep, splits, stats

DAY = dt.date(2024, 1, 1)


def _dated(spark, rows):
    return spark.createDataFrame([(1, DAY + dt.timedelta(d), float(v)) for d, v in rows], "k int, day date, v double")


def _values(df, order, c):
    return [r[c] for r in df.orderBy(order).collect()]


def test_trailing_window_edges(spark):
    df = _dated(spark, [(0, 1), (84, 2), (85, 4)])
    out = df.withColumns({"n": form.trailing_days("v", "k", "day", 84, "mean"), "r": form.trailing_days("v", "k", "day", 84, "mean", "right")})
    assert _values(out, "day", "n") == [None, None, 2.0]
    assert _values(out, "day", "r") == [1.0, 2.0, 3.0]


def test_trailing_window_takes_peers_alike(spark):
    df = _dated(spark, [(0, 1), (9, 2), (9, 4), (19, 8)])
    out = df.withColumn("n", form.trailing_days("v", "k", "day", 84, "mean")).orderBy("day", "v")
    assert [None if x is None else round(x, 3) for x in _values(out, "v", "n")] == [None, 1.0, 1.0, 2.333]


def test_percent_rank_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 20.0), (1, None), (2, 5.0)], "g int, v double")
    out = df.withColumns({"up": form.pct_rank_in("v", "g"), "down": form.pct_rank_in("v", "g", True)}).toPandas()
    want = out.groupby("g")["v"].rank(pct=True)
    pd.testing.assert_series_equal(out["up"], want, check_names=False)
    pd.testing.assert_series_equal(out["down"], out.groupby("g")["v"].rank(pct=True, ascending=False), check_names=False)


def test_global_percent_rank(spark):
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(200)], "i int, v double")
    out = form.pct_rank_global(df, "v", "r").toPandas().sort_values("i")
    want = out["v"].rank(pct=True)
    assert ((out["r"] - want).abs().fillna(0) < 1e-12).all() and (out["r"].isna() == want.isna()).all()


def test_running_sum_skips_nulls_and_history_does_not_leak(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (1, 3, 3.0)], "k int, t int, v double")
    w = form.history("k", ["t"])
    assert _values(df.withColumn("s", form.running_sum("v", w)), "t", "s") == [1.0, None, 4.0]
    before = _values(df.withColumn("s", form.prior_sum("v", w)), "t", "s")
    changed = df.withColumn("v", F.when(F.col("t") == 3, 99.0).otherwise(F.col("v")))
    assert before == _values(changed.withColumn("s", form.prior_sum("v", w)), "t", "s") == [0.0, 1.0, 1.0]


def test_strict_means_and_form_difference(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in range(1, 8)], "k int, t int, v double")
    w = form.history("k", ["t"])
    out = df.withColumns({"m": form.mean_last("v", w, 3), "d": form.form_difference("v", w), "g": form.prior_mean("v", w)})
    assert _values(out, "t", "m") == [None, None, None, 2.0, 3.0, 4.0, 5.0]
    assert _values(out, "t", "d")[-1] == 6 - 5 - 4 - 3 - 2 - 1
    assert _values(out, "t", "g")[:3] == [None, 1.0, 1.5]


def test_margins(spark):
    df = spark.createDataFrame([(x,) for x in ("1-1/4", "3/4", "2", "HD", "ML", "odd", None)], "m string")
    got = [r[0] for r in df.select(scalars.margin_to_number(F.col("m"))).collect()]
    assert got == [1.25, 0.75, 2.0, 0.125, 15.0, None, None]


def test_row_mad_and_finite(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (float("nan"), 1.0, 1.0)], "a double, b double, c double")
    assert df.limit(1).select(scalars.row_mad(["a", "b", "c"])).first()[0] == 0.5
    assert [r[0] for r in df.select(scalars.finite(F.col("a"))).collect()] == [1.0, None]


def test_python_dict_and_children(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.BooleanType())])
    df = spark.createDataFrame([("{'a': 1, 'b': True}",), ("{'a': None, 'b': False}",)], "s string")
    assert [tuple(r[0]) for r in df.select(nested.python_dict(F.col("s"), schema)).collect()] == [(1, True), (None, False)]
    docs = spark.sql("select 1 id, array(struct(1 as id, 'x' as v)) c union all select 2, array()")
    assert nested.explode_child(docs, "c", ["id"]).columns == ["id", "c_id", "v"]
    assert nested.explode_child(docs, "c", ["id"], outer=True).count() == 2


def test_ordered_split_and_folds(spark):
    df = spark.range(0, 103)
    out = splits.ordered_split(df, ["id"], 0.2)
    assert sorted(r["id"] for r in out.filter("is_test").collect()) == list(range(82, 103))
    assert splits.ordered_split(df, ["id"], rows=5).filter("is_test").count() == 5
    f = df.withColumn("f", splits.folds("id", 5))
    assert f.groupBy("id").agg(F.countDistinct("f").alias("n")).filter("n > 1").isEmpty()


def test_imputation_and_scaling_fit_on_train_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    test = spark.createDataFrame([(None,), (100.0,)], "x double")
    filled = prep.fill(test, prep.fit_fill(train, ["x"]), indicator=True)
    assert sorted((r["x"], r["x_missing"]) for r in filled.collect()) == [(2.0, 1.0), (100.0, 0.0)]
    assert sorted(r["x"] for r in prep.standardise(test.dropna(), ["x"], by=train).collect()) == [98.0]
    assert prep.expanded_width(10, 6) == 8007


def test_report_of_absent_class_and_votes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b")], "l string, p string")
    got = {r["cls"]: (r["precision"], r["recall"], r["support"]) for r in evaluate.class_report(df, "l", "p").collect()}
    assert got == {"a": (1.0, 0.5, 2), "b": (0.0, 0.0, 0), "c": (0.0, 0.0, 1)}
    v = spark.createDataFrame([(1, 2, 2), (3, 1, 2)], "a int, b int, c int")
    assert [r["v"] for r in evaluate.hard_vote(v, ["a", "b", "c"], "v").collect()] == [2, 1]


def test_conditional_logit_finds_the_sign(spark):
    rows = [(r, i, float(i), float(i == 3 or (r % 5 == 0 and i == 1))) for r in range(40) for i in range(4)]
    rows = [(r, x, 1.0 if (i == 3 if r % 5 else i == 1) else 0.0) for r, i, x, _ in rows]
    df = spark.createDataFrame(rows, "race int, x double, won double")
    beta = models.conditional_logit(df, "race", "won", ["x"])
    assert 0 < beta[0] < 10


def test_integrity_and_weights(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3)], "race int, place int")
    assert {r["whole"]: r["races"] for r in stats.race_integrity(df, "race", "place").collect()} == {True: 1, False: 1}
    assert stats.null_census(df.withColumn("z", F.lit(None))).filter("`column` = 'z'").first()["nulls"] == 4


def test_poisson_weights_average_one(spark):
    mean = spark.range(20000).select(F.avg(models.poisson_weight(models.hash_unit("id")))).first()[0]
    assert abs(mean - 1) < 0.05


def test_many_ranks_in_one_sort_equal_the_windows(spark):
    base = spark.range(25_000).withColumns(
        {
            "race": F.when(F.col("id") % 7 != 0, F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(900)))),
            "a": F.when(F.col("id") % 5 != 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40))),
            "b": F.when(F.col("id") % 11 == 0, F.lit(float("nan"))).when(F.col("id") % 4 != 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9)) / 3),
            "c": F.lit(None).cast("double"),
        }
    )
    got = form.pct_ranks_in(base.repartition("race"), {f"{c}_rank": c for c in "abc"}, ["race"])
    want = base.withColumns({f"{c}_rank": form.pct_rank_in(c, "race") for c in "abc"})
    assert got.select("id", "a_rank", "b_rank", "c_rank").exceptAll(want.select("id", "a_rank", "b_rank", "c_rank")).count() == 0
    assert got.count() == 25_000
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_a_rank_is_one_sort(spark):
    values = [0.0, -0.0, float("nan"), 2.5, 2.5, None, 2.5, float("nan"), -1.0]
    df = spark.createDataFrame([(i, i % 2, v) for i, v in enumerate(values * 2)], "i int, g int, v double")
    out = df.repartition("g").withColumns({"up": form.pct_rank_in("v", "g"), "down": form.pct_rank_in("v", "g", True)})
    assert _planned(out).count("Sort [") == 2
    for r in out.collect():
        peers = [float("inf") if x != x else x for i, x in enumerate(values * 2) if i % 2 == r["g"] and x is not None]
        if r["v"] is None:
            assert (r["up"], r["down"]) == (None, None)
            continue
        x = float("inf") if r["v"] != r["v"] else r["v"]
        less, more, ties = sum(p < x for p in peers), sum(p > x for p in peers), peers.count(x)
        assert r["up"] == (less + (ties + 1) / 2) / len(peers) and r["down"] == (more + (ties + 1) / 2) / len(peers)


def test_form_table_goes_by_jockey_while_narrow_and_sorts_six_times(spark):
    from strideline.plans import catalog

    plan = _planned(catalog.queries()["form_features"](spark, "/root/testdata/sf0.001"))
    exchanges = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert exchanges[:3] == ["race_id", "horse", "jockey"]  # the last one first
    assert plan.count("Window [") == plan.count("Sort [") + 1 == 7  # the days' frame goes over the sort of the starts


def test_means_of_the_last_starts_are_in_no_exchange(spark):
    from strideline.plans import catalog

    plan = _planned(catalog.queries()["last_means_table"](spark, "/root/testdata/sf0.001")).splitlines()
    exchanges = [(i, line.split("hashpartitioning(")[1].split("#")[0]) for i, line in enumerate(plan) if "Exchange hashpartitioning(" in line]
    assert [e for _, e in exchanges[:3]] == ["horse", "trainer", "jockey"]  # the last one first
    assert not any("speed" in line or "round(" in line for line in plan[exchanges[0][0] :])


def test_rounding_equals_that_of_columns(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 10.0**k, 200) for k in range(-10, 18, 3)] + [r.integers(-99, 99, 400) / 8, [0.5e-9, 1.5e-9, 2.675, -2.675, 1e300, np.inf]])
    for digits in (2, 9):
        want = spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", digits).alias("x")).toPandas()["x"].to_numpy()
        assert np.array_equal(form.rounded(x, digits), want)
    assert np.isnan(form.rounded(np.array([np.nan]), 2)[0])


def test_form_table_writes_narrow_rows_and_exchanges_them_by_horse_and_race_only(spark, monkeypatch):
    from strideline.plans import starts
    from strideline.sources.scratch import Scratch

    written, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, label, **o: (written.append(len(df.columns)), save(self, df, label, **o))[1])
    out = starts.form_table(spark, "/root/testdata/sf0.001")
    assert len(written) == 1 and written[0] < 20
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    found = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(found) == 2 and all(any(f"({c}#" in line for line in found) for c in ("horse", "race_id"))
