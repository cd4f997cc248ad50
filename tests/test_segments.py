"""Segmented histories and the walk over day frames against plain versions, with a hot entity."""

import datetime as dt
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.operators import form, segments
from strideline.sources.scratch import Scratch

DAY = dt.date(2020, 1, 1)


@pytest.fixture(autouse=True)
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _runs(spark, n=900):
    r = random.Random(1)
    rows = []
    for i in range(n):
        horse = 7 if i % 2 else r.randrange(40)  # one with half of all rows
        rows.append((i // 8, DAY + dt.timedelta(r.randrange(300)), horse, r.randrange(5), i % 8 + 1, r.randrange(1, 9), 1000.0 + r.randrange(5), 60 + r.random(), 50 + r.random()))
    return spark.createDataFrame(rows, "race_id int, race_date date, horse int, jockey int, horse_no int, result int, distance double, finish_time double, weight double")


def test_segmented_form_equals_windows(spark):
    runs = _runs(spark)
    got = segments.form_features(runs, Scratch(spark, "t")).collect()
    names = ["race_id", "horse_no", "starts", "prev_result", "prev_speed", "mean_result_3", "mean_result_6", "sum_distance_4", "form_diff", "rest_days", "weight_change", "wins", "win_rate", "mean_result"]
    want = form.form_features(runs).select(names).collect()

    def rows(found):
        return sorted(tuple(None if r[n] is None else round(float(r[n]), 9) for n in names) for r in found)

    assert rows(got) == rows(want)


def test_a_hot_entity_is_many_segments(spark):
    h = segments.histories(_runs(spark), ["horse"], ["race_date", "race_id", "horse_no"], 3, [], Scratch(spark, "t"), "x")
    spread = h.rows.filter("horse = 7 AND __own").groupBy("__segment").count().collect()
    assert len(spread) >= 4 and max(r["count"] for r in spread) < 200
    led = h.rows.filter("NOT __own").groupBy("__segment").count().collect()
    assert len(led) >= 3 and all(r["count"] <= 3 for r in led)


def test_entity_over_many_small_segments_and_empty(spark):
    rows = [(1, DAY + dt.timedelta(i), i) for i in range(12)] + [(2, DAY, 5), (None, DAY, 1), (None, DAY + dt.timedelta(3), 2)]
    df = spark.createDataFrame(rows, "k int, day date, v int")
    h = segments.histories(df, ["k"], ["day"], 8, ["v"], Scratch(spark, "t"), "x")
    out = h.own(h.rows.withColumns({"n": h.prior_count(), "s": h.prior_sum("v"), "l": F.lag("v", 8).over(h.window)}))
    got = {(r["k"], r["v"]): (r["n"], r["s"], r["l"]) for r in out.collect()}
    assert got == {(1, i): (i, i * (i - 1) // 2, i - 8 if i >= 8 else None) for i in range(12)} | {(2, 5): (0, 0, None), (None, 1): (0, 0, None), (None, 2): (1, 1, None)}
    assert segments.histories(df.limit(0), ["k"], ["day"], 2, [], Scratch(spark, "t"), "y").rows.count() == 0


@pytest.mark.parametrize("closed", ["neither", "right"])
def test_trailing_equals_every_frame(spark, closed):
    r = random.Random(2)
    rows = [(7 if i % 2 else r.randrange(9), r.choice("ab"), DAY + dt.timedelta(r.randrange(60)), None if i % 11 == 0 else float(r.randrange(6))) for i in range(400)]
    rows += [(3, "a", None, 1.0), (50, "a", DAY, None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id int, k int, g string, day date, v double")
    out = segments.trailing(df, ["k", "g"], "day", "v", [20, 7], Scratch(spark, "t"), "x", ("neither", "right")).collect()
    assert len(out) == len(rows)
    end = "" if closed == "neither" else "_right"
    for x in out:
        for span in (20, 7):
            frame = [] if x["day"] is None else [
                v for k, g, d, v in rows
                if (k, g) == (x["k"], x["g"]) and d is not None and v is not None and (closed == "right" or d < x["day"]) and dt.timedelta(0) <= x["day"] - d < dt.timedelta(span)
            ]
            want = (np.mean(frame), np.median(frame), max(frame), min(frame)) if frame else (None,) * 4
            assert tuple(x[f"{s}_{span}{end}"] for s in segments.STATISTICS) == pytest.approx(want)


def test_a_walk_over_a_long_history(spark):
    """A frame of every earlier row: quadratic work would not end."""
    n = 60_000
    r = np.random.default_rng(0)
    value = r.integers(0, 5000, n).astype(float)
    day = np.arange(n) // 3
    mean, middle, most, least = segments._walk(day, value, np.ones(n, int), [(n, "neither")], np.unique(day))
    assert (most[-1], least[-1]) == (value.max(), value.min())
    for d in (1, 777, 19_999):
        assert middle[d] == np.median(value[: 3 * d]) and mean[d] == pytest.approx(value[: 3 * d].mean())


def test_one_exchange_an_entity(spark):
    from strideline.plans import starts

    s = starts.starts(spark, "/root/testdata/sf0.001")
    plan = starts.entity_columns(s)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    for entity in ("horse", "jockey", "trainer"):
        assert sum(f"Exchange hashpartitioning({entity}#" in line for line in initial.splitlines()) == 1, entity


def test_segments_write_the_rows_once(spark):
    scratch = Scratch(spark, "t")
    h = segments.histories(_runs(spark), ["horse"], ["race_date", "race_id", "horse_no"], 6, ["result"], scratch, "x")
    rows = {p.name: spark.read.parquet(str(p)).count() for p in Path(scratch.base).iterdir()}
    assert sorted(n for n in rows.values() if n >= 100) == [900]  # all else is a few rows a segment
    out = h.own(h.rows.withColumns({"n": h.prior_count(), "s": h.prior_sum("result"), "l": F.lag("result", 6).over(h.window)}))
    whole = form.history("horse", ["race_date", "race_id", "horse_no"])
    want = _runs(spark).withColumns({"n": form.prior_count(whole).cast("bigint"), "s": form.prior_sum("result", whole), "l": form.previous("result", whole, 6)})
    assert out.select(want.columns).exceptAll(want).count() == 0 and out.count() == 900


def test_trailing_writes_the_rows_once_and_joins_none_back(spark):
    """The statistics come with the rows; entities without a name are one."""
    rows = [(i, None if i % 3 == 0 else i % 7, DAY + dt.timedelta(i % 50), float(i % 11)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, k int, day date, v double")
    scratch = Scratch(spark, "t")
    out = segments.trailing(df, ["k"], "day", "v", [20], scratch, "x")
    written = {p.name: spark.read.parquet(str(p)).count() for p in Path(scratch.base).iterdir()}
    assert list(written.values()) == [600]
    got = {r["id"]: (r["mean_20"], r["median_20"], r["max_20"], r["min_20"]) for r in out.collect()}
    assert len(got) == 600
    for i, k, day, _ in rows:
        frame = [v for _, of, d, v in rows if of == k and dt.timedelta(0) < day - d < dt.timedelta(20)]
        want = (np.mean(frame), np.median(frame), max(frame), min(frame)) if frame else (None,) * 4
        assert got[i] == pytest.approx(want)


def test_narrow_and_wide_frames_agree(monkeypatch):
    r = np.random.default_rng(5)
    value, n, when = r.integers(0, 9, 500).astype(float), r.integers(1, 4, 500), np.sort(r.integers(0, 400, 500))
    asked = np.unique(when)
    side_by_side = segments._walk(when, value, n, [(30, "neither"), (80, "right")], asked)
    monkeypatch.setattr(segments, "NARROW", 0)
    for a, b in zip(side_by_side, segments._walk(when, value, n, [(30, "neither"), (80, "right")], asked), strict=True):
        assert np.array_equal(a, b, equal_nan=True)
