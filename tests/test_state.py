"""A state moved on day by day against the form table of the whole history."""

import datetime as dt
import random

from pyspark.sql import functions as F

from strideline.operators import form, state

DAY = dt.date(2021, 1, 1)
NAMES = ["starts", "wins", "win_rate", "mean_result", "prev_result", "prev_speed", "mean_result_3", "mean_result_6", "sum_distance_4", "form_diff", "rest_days", "weight_change"]


def _runs(spark):
    r = random.Random(3)
    rows = []
    for day in range(12):  # a horse runs once a day at most
        for no, horse in enumerate(r.sample([None, *range(12)], 7), 1):
            rows.append((day, DAY + dt.timedelta(3 * day), horse, r.randrange(4), no, no, 1000.0 + r.randrange(5), 60 + r.random(), 50 + r.random()))
    return spark.createDataFrame(rows, "race_id int, race_date date, horse int, jockey int, horse_no int, result int, distance double, finish_time double, weight double")


def _rows(df):
    return sorted(tuple(None if r[n] is None else round(float(r[n]), 9) for n in ["race_id", "horse_no", *NAMES]) for r in df.collect())


def test_features_of_the_last_days_come_from_the_state(spark):
    runs = _runs(spark)
    known = state.state_of(runs.filter("race_id < 6"))
    known = state.moved_on(state.moved_on(known, runs.filter("race_id IN (6, 7)")), runs.filter("race_id IN (8, 9, 10)"))
    card = runs.filter("race_id = 11")
    want = _rows(form.form_features(runs).filter("race_id = 11"))
    assert _rows(state.card_features(card, known)) == want
    assert _rows(state.card_features(card.withColumn("result", F.lit(99)), known)) == want  # a card's results are not known yet
    at_once = state.state_of(runs.filter("race_id < 11"))
    assert sorted(map(str, at_once.collect())) == sorted(map(str, known.collect()))


def test_nothing_known_yet(spark):
    runs = _runs(spark)
    none = state.state_of(runs.limit(0))
    got = state.card_features(runs.filter("race_id = 0"), none).collect()
    assert all((r["starts"], r["wins"], r["rest_days"], r["prev_result"], r["win_rate"]) == (0, 0, 0, None, None) for r in got) and len(got) == 7
    assert state.moved_on(none, runs).agg(F.sum("starts")).first()[0] == 84


def test_a_state_is_made_of_counts_and_the_newest_rows(spark):
    rows = [(i, DAY + dt.timedelta(i), 7 if i % 4 else i % 3, 1, 1, None if i % 5 == 0 else i % 6 + 1, 1000.0, 60.0 + i, 50.0) for i in range(400)]
    runs = spark.createDataFrame(rows, "race_id int, race_date date, horse int, jockey int, horse_no int, result int, distance double, finish_time double, weight double")
    got = state.state_of(runs.repartition(5))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in [line for line in plan.splitlines() if "WindowGroupLimit" in line][-1]  # under the exchange
    found = {r["horse"]: r for r in got.collect()}
    for horse in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == horse]
        results = [r[5] for r in own if r[5] is not None]
        r = found.pop(horse)
        assert (r["starts"], r["wins"], r["result_sum"], r["results"]) == (len(own), results.count(1), sum(results), len(results))
        assert [(x["race_id"], x["result"], x["speed"]) for x in r["last"]] == [(o[0], o[5], round(o[6] / o[7], 8)) for o in own[:-7:-1]]
    assert not found


def test_the_card_query_joins_the_runs_once(spark):
    from strideline.plans import catalog

    plan = catalog.queries()["card_from_state"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan
