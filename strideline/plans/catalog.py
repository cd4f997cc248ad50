"""All registered queries of the form-analytics side, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.functions import scalars as sc
from strideline.operators import form, nested, segments, splits, state, stats
from strideline.plans.inputs import RECORDS_SQL, RUNS_SQL, records, runs
from strideline.sources.scratch import Scratch
from strideline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}

ORDER = ["race_date", "race_id", "horse_no", "jockey", "finish_time"]
KEY = ["race_id", "horse_no", "horse", "jockey", "finish_time"]
_W = "PARTITION BY horse ORDER BY race_date, race_id, horse_no, jockey, finish_time"
_K = "race_id, horse_no, horse, jockey, finish_time"


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _ORACLE[name or f.__name__] = sql
        return f

    return add


def oracle_of(name: str) -> str:
    """The SQL twin of a query registered before."""
    return _ORACLE[name]


def queries() -> dict[str, Query]:
    from strideline.plans import fitted, learned, starts  # noqa: F401  register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLE)


def _runs(body: str) -> str:
    return f"WITH runs AS ({RUNS_SQL}) {body}"


# Joins and race-level aggregates


@register(_runs(f"SELECT {_K}, race_date, distance, count(*) OVER (PARTITION BY race_id) AS runners FROM runs"))
def runs_races_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.runner_count(runs(spark, sf_dir), "race_id").select(*KEY, "race_date", "distance", "runners")


@register(
    _runs("""SELECT race_id, count(*) AS n, sum(CASE WHEN result <= 3 THEN 1 ELSE 0 END)::BIGINT AS pos,
    CASE WHEN count(*) = sum(CASE WHEN result <= 3 THEN 1 ELSE 0 END) THEN NULL
         ELSE count(*)::DOUBLE / (count(*) - sum(CASE WHEN result <= 3 THEN 1 ELSE 0 END)) END AS w0,
    CASE WHEN sum(CASE WHEN result <= 3 THEN 1 ELSE 0 END) = 0 THEN NULL
         ELSE count(*)::DOUBLE / sum(CASE WHEN result <= 3 THEN 1 ELSE 0 END) END AS w1
    FROM runs GROUP BY race_id""")
)
def race_label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("podium", (F.col("result") <= 3).cast("int"))
    return stats.race_label_weights(r, "race_id", "podium")


@register(
    _runs("""SELECT whole, count(*) AS races FROM (SELECT race_id, 2 * sum(result) = count(*) * (count(*) + 1) AS whole
    FROM runs GROUP BY race_id) GROUP BY whole""")
)
def race_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.race_integrity(runs(spark, sf_dir), "race_id", "result")


@register(
    _runs("""SELECT race_id, count(*) AS runners, (count(*) * (count(*) - 1) * (count(*) - 2) / 6)::DOUBLE ** 3 AS cost3,
    (count(*) * (count(*) - 1) * (count(*) - 2) / 6)::DOUBLE ** 2 AS cost2 FROM runs GROUP BY race_id HAVING count(*) >= 3""")
)
def ticket_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = runs(spark, sf_dir).groupBy("race_id").agg(F.count(F.lit(1)).alias("runners")).filter("runners >= 3")
    return n.withColumns({"cost3": sc.ticket_cost(F.col("runners"), 3), "cost2": sc.ticket_cost(F.col("runners"), 2)})


# History of an entity


@register(
    _runs(f"""SELECT {_K}, row_number() OVER ({_W}) - 1 AS starts,
    row_number() OVER (PARTITION BY horse, distance ORDER BY race_date, race_id, horse_no, jockey, finish_time) - 1 AS starts_at_distance,
    row_number() OVER (PARTITION BY horse, jockey ORDER BY race_date, race_id, horse_no, jockey, finish_time) - 1 AS starts_with_jockey FROM runs""")
)
def prior_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select(
        *KEY,
        form.prior_count(form.history("horse", ORDER)).cast("bigint").alias("starts"),
        form.prior_count(form.history(["horse", "distance"], ORDER)).cast("bigint").alias("starts_at_distance"),
        form.prior_count(form.history(["horse", "jockey"], ORDER)).cast("bigint").alias("starts_with_jockey"),
    )


@register(
    _runs(f"""SELECT {_K}, lag(result, 1) OVER ({_W}) AS prev1, lag(result, 2) OVER ({_W}) AS prev2, lag(result, 8) OVER ({_W}) AS prev8,
    finish_time - lag(finish_time) OVER ({_W}) AS time_change FROM runs""")
)
def prev_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = form.history("horse", ORDER)
    return runs(spark, sf_dir).select(
        *KEY, *[form.previous("result", w, k).alias(f"prev{k}") for k in (1, 2, 8)], form.change("finish_time", w).alias("time_change")
    )


def _lags(c: str, a: int, b: int) -> str:
    return " + ".join(f"lag({c}, {k}) OVER ({_W})" for k in range(a, b + 1))


@register(
    _runs(
        f"SELECT {_K}, "
        + ", ".join(f"(({_lags('result', 1, k)}) / {k}.0)::DOUBLE AS mean_result_{k}" for k in (2, 3, 4, 6, 8))
        + f", {_lags('distance', 1, 4)} AS sum_distance_4, (({_lags('result', 2, 3)}) / 2.0)::DOUBLE AS mean_2_3, "
        + f"lag(result, 1) OVER ({_W}) - ({_lags('result', 2, 6)}) AS form_diff FROM runs"
    )
)
def mean_last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = form.history("horse", ORDER)
    return runs(spark, sf_dir).select(
        *KEY,
        *[form.mean_last("result", w, k).alias(f"mean_result_{k}") for k in (2, 3, 4, 6, 8)],
        form.sum_last("distance", w, 4).alias("sum_distance_4"),
        form.mean_last("result", w, 2, 2).alias("mean_2_3"),
        form.form_difference("result", w).alias("form_diff"),
    )


@register(
    _runs(f"""SELECT {_K}, coalesce(race_date - lag(race_date) OVER ({_W}), 0)::INT AS rest_days, weight - lag(weight) OVER ({_W}) AS weight_change,
    round(CASE WHEN coalesce(race_date - lag(race_date) OVER ({_W}), 0) = 0 THEN NULL
      ELSE (weight - lag(weight) OVER ({_W})) / (race_date - lag(race_date) OVER ({_W})) END, 9) AS change_a_day,
    (race_date - DATE '0001-01-01')::INT + 1 AS day_number FROM runs""")
)
def day_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = form.history("horse", ORDER)
    return runs(spark, sf_dir).select(
        *KEY,
        form.day_gap("race_date", w).alias("rest_days"),
        form.change("weight", w).alias("weight_change"),
        F.round(form.per_rest_day("weight", "race_date", w), 9).alias("change_a_day"),
        form.day_number("race_date").alias("day_number"),
    )


_PRIOR = f"({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_JW = "PARTITION BY jockey ORDER BY race_date, race_id, horse_no, horse, finish_time"
_JPRIOR = f"({_JW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@register(
    _runs(f"""SELECT {_K}, coalesce(sum((result = 1)::INT) OVER {_PRIOR}, 0)::BIGINT AS wins,
    coalesce(sum((result <= 3)::INT) OVER {_PRIOR}, 0)::BIGINT AS podiums,
    coalesce(sum((result = 1)::INT) OVER {_PRIOR}, 0)::DOUBLE / nullif(row_number() OVER ({_W}) - 1, 0) AS win_rate,
    avg(result) OVER {_PRIOR} AS mean_result,
    sum(result) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running_result FROM runs""")
)
def prior_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = form.history("horse", ORDER)
    won, podium = (F.col("result") == 1).cast("int"), (F.col("result") <= 3).cast("int")
    return runs(spark, sf_dir).select(
        *KEY,
        form.prior_sum(won, w).alias("wins"),
        form.prior_sum(podium, w).alias("podiums"),
        form.prior_rate(won, w).alias("win_rate"),
        form.prior_mean("result", w).alias("mean_result"),
        form.running_sum("result", w).alias("running_result"),
    )


@register(
    _runs(f"""SELECT {_K}, (hw + jw)::BIGINT AS pair_wins, (hw + jw)::DOUBLE / nullif(hn + jn, 0) AS pair_rate FROM (SELECT *,
    coalesce(sum((result = 1)::INT) OVER {_PRIOR}, 0) AS hw, row_number() OVER ({_W}) - 1 AS hn,
    coalesce(sum((result = 1)::INT) OVER {_JPRIOR}, 0) AS jw, row_number() OVER ({_JW}) - 1 AS jn FROM runs)""")
)
def pair_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, j = form.history("horse", ORDER), form.history("jockey", ["race_date", "race_id", "horse_no", "horse", "finish_time"])
    won = (F.col("result") == 1).cast("int")
    r = runs(spark, sf_dir).withColumns({"hw": form.prior_sum(won, h), "hn": form.prior_count(h)})
    r = r.withColumns({"jw": form.prior_sum(won, j), "jn": form.prior_count(j)})
    return r.select(*KEY, (F.col("hw") + F.col("jw")).alias("pair_wins"), F.try_divide(F.col("hw") + F.col("jw"), F.col("hn") + F.col("jn")).alias("pair_rate"))


_RW = "PARTITION BY name ORDER BY day, rec"


@register(
    f"""WITH records AS ({RECORDS_SQL}), gaps AS (SELECT *, coalesce(day - lag(day) OVER ({_RW}), 0)::INT AS rest FROM records)
    SELECT rec, round_even(10 - sum(rest) OVER ({_RW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE / 365, 0) AS age_then FROM gaps"""
)
def rest_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = form.history("name", ["day", "rec"])
    r = records(spark, sf_dir).withColumns({"rest": form.day_gap("day", w), "age": F.lit(10.0)})
    return r.select("rec", form.rest_age("age", "rest", w).alias("age_then"))


def _trailing(how: str, days: int) -> None:
    value = {"mean": "avg(result)", "median": "median(result)", "max": "max(result)", "min": "min(result)"}[how]

    def frame(last: str) -> str:
        return f"(PARTITION BY name ORDER BY day RANGE BETWEEN INTERVAL {days - 1} DAY PRECEDING AND {last})"

    sql = f"""WITH records AS ({RECORDS_SQL}) SELECT rec, round({value} OVER {frame("INTERVAL 1 DAY PRECEDING")}, 6) AS before,
    round({value} OVER {frame("CURRENT ROW")}, 6) AS with_day FROM records"""

    @register(sql, f"trailing_{how}_{days}")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        if how == "median":
            out = segments.trailing(records(spark, sf_dir), ["name"], "day", "result", [days], Scratch(spark, "trailing"), "records", ("neither", "right"))
            return out.select("rec", F.round(f"median_{days}", 6).alias("before"), F.round(f"median_{days}_right", 6).alias("with_day"))
        return records(spark, sf_dir).select(
            "rec",
            F.round(form.trailing_days("result", "name", "day", days, how), 6).alias("before"),
            F.round(form.trailing_days("result", "name", "day", days, how, "right"), 6).alias("with_day"),
        )


for _how in ("mean", "median", "max", "min"):
    for _days in (168, 112, 84):
        _trailing(_how, _days)


@register(
    f"""WITH records AS ({RECORDS_SQL}) SELECT rec, """
    + ", ".join(f"round(avg(result) OVER ({_RW} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 6) AS mean_{k}" for k in (24, 16, 12))
    + f""", CASE WHEN count(*) OVER ({_RW} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) = 6
    THEN round(avg(result) OVER ({_RW} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 6) END AS next_6 FROM records"""
)
def trailing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = form.history("name", ["day", "rec"])
    return records(spark, sf_dir).select(
        "rec",
        *[F.round(form.trailing_rows("result", w, k), 6).alias(f"mean_{k}") for k in (24, 16, 12)],
        F.round(form.next_rows_mean("result", w, 6), 6).alias("next_6"),
    )


# Ranks


def _pct(c: str, g: str, desc: str = "") -> str:
    return f"""CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {g} ORDER BY {c} {desc} NULLS LAST)
    + (count({c}) OVER (PARTITION BY {g}, {c}) - 1) / 2.0)::DOUBLE / count({c}) OVER (PARTITION BY {g}) END"""


@register(
    f"""WITH records AS ({RECORDS_SQL}), p AS (SELECT *, lag(result) OVER ({_RW}) AS prev FROM records)
    SELECT rec, {_pct("result", "day")} AS r_up, {_pct("result", "day", "DESC")} AS r_down, {_pct("prev", "day")} AS prev_up FROM p"""
)
def pct_rank_in_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("prev", form.previous("result", form.history("name", ["day", "rec"])))
    return r.select(
        "rec",
        form.pct_rank_in("result", "day").alias("r_up"),
        form.pct_rank_in("result", "day", descending=True).alias("r_down"),
        form.pct_rank_in("prev", "day").alias("prev_up"),
    )


@register(
    f"""WITH records AS ({RECORDS_SQL}), p AS (SELECT *, lag(result) OVER ({_RW}) AS prev FROM records)
    SELECT rec, CASE WHEN prev IS NOT NULL THEN (rank() OVER (ORDER BY prev DESC NULLS LAST)
    + (count(prev) OVER (PARTITION BY prev) - 1) / 2.0)::DOUBLE / count(prev) OVER () END AS share FROM p"""
)
def pct_rank_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("prev", form.previous("result", form.history("name", ["day", "rec"])))
    return form.pct_rank_global(r, "prev", "share", descending=True).select("rec", "share")


@register(
    _runs(f"""SELECT race_id, count(*) AS pairs, sum((d > 0)::INT)::BIGINT AS rising FROM (SELECT race_id,
    finish_time - lag(finish_time) OVER (PARTITION BY race_id ORDER BY horse_no, horse, jockey, finish_time) AS d FROM runs) WHERE d IS NOT NULL GROUP BY race_id""")
)
def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = form.history("race_id", ["horse_no", "horse", "jockey", "finish_time"])
    d = runs(spark, sf_dir).select("race_id", form.change("finish_time", w).alias("d")).filter("d is not null")
    return d.groupBy("race_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("d") > 0).alias("rising"))


@register(
    f"""WITH runs AS ({RUNS_SQL}), f AS (SELECT *, round_even((distance / finish_time)::DOUBLE, 8) AS speed, (result = 1)::INT AS won FROM runs),
    h AS (SELECT *, row_number() OVER ({_W}) - 1 AS starts,
      row_number() OVER (PARTITION BY horse, distance ORDER BY race_date, race_id, horse_no, jockey, finish_time) - 1 AS starts_at_distance,
      row_number() OVER (PARTITION BY horse, jockey ORDER BY race_date, race_id, horse_no, jockey, finish_time) - 1 AS starts_with_jockey,
      lag(result) OVER ({_W}) AS prev_result, lag(speed) OVER ({_W}) AS prev_speed,
      (({_lags("result", 1, 3)}) / 3.0)::DOUBLE AS mean_result_3, (({_lags("result", 1, 6)}) / 6.0)::DOUBLE AS mean_result_6,
      {_lags("distance", 1, 4)} AS sum_distance_4, lag(result) OVER ({_W}) - ({_lags("result", 2, 6)}) AS form_diff,
      coalesce(race_date - lag(race_date) OVER ({_W}), 0)::INT AS rest_days, weight - lag(weight) OVER ({_W}) AS weight_change,
      coalesce(sum(won) OVER {_PRIOR}, 0)::BIGINT AS wins,
      coalesce(sum(won) OVER {_PRIOR}, 0)::DOUBLE / nullif(row_number() OVER ({_W}) - 1, 0) AS win_rate, avg(result) OVER {_PRIOR} AS mean_result,
      avg(result) OVER (PARTITION BY horse ORDER BY race_date RANGE BETWEEN INTERVAL 167 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS mean_168,
      row_number() OVER ({_JW}) - 1 AS jockey_starts, coalesce(sum(won) OVER {_JPRIOR}, 0)::BIGINT AS jockey_wins FROM f)
    SELECT {_K}, race_date, starts, starts_at_distance, starts_with_jockey, prev_result, prev_speed, round(mean_result_3, 6) AS mean_result_3,
      round(mean_result_6, 6) AS mean_result_6, sum_distance_4, form_diff, rest_days, round(weight_change, 6) AS weight_change, wins, round(win_rate, 6) AS win_rate,
      round(mean_result, 6) AS mean_result, round(mean_168, 6) AS mean_168, jockey_starts, jockey_wins,
      round({_pct("mean_168", "race_id, race_date")}, 6) AS mean_168_rank, round({_pct("weight", "race_id, race_date", "DESC")}, 6) AS weight_rank FROM h"""
)
def form_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = form.form_features(runs(spark, sf_dir))
    rounded = ("mean_result_3", "mean_result_6", "weight_change", "win_rate", "mean_result", "mean_168", "mean_168_rank", "weight_rank")
    names = [*KEY, "race_date", "starts", "starts_at_distance", "starts_with_jockey", "prev_result", "prev_speed", "mean_result_3", "mean_result_6"]
    names += ["sum_distance_4", "form_diff", "rest_days", "weight_change", "wins", "win_rate", "mean_result", "mean_168", "jockey_starts", "jockey_wins"]
    names += ["mean_168_rank", "weight_rank"]
    counts = ("starts", "starts_at_distance", "starts_with_jockey", "jockey_starts")
    return out.select(
        *[F.round(c, 6).alias(c) if c in rounded else F.col(c).cast("bigint") if c in counts else F.col(c) for c in names]
    )


_BY_HORSE = ("starts", "prev_result", "prev_speed", "mean_result_3", "mean_result_6", "sum_distance_4", "form_diff", "rest_days", "weight_change", "wins", "win_rate", "mean_result")
_HORSE_ROUNDED = ("mean_result_3", "mean_result_6", "weight_change", "win_rate", "mean_result")


@register(
    f"""WITH runs AS ({RUNS_SQL}), f AS (SELECT *, round_even((distance / finish_time)::DOUBLE, 8) AS speed, (result = 1)::INT AS won FROM runs)
    SELECT {_K}, row_number() OVER ({_W}) - 1 AS starts, lag(result) OVER ({_W}) AS prev_result, lag(speed) OVER ({_W}) AS prev_speed,
      round((({_lags("result", 1, 3)}) / 3.0)::DOUBLE, 6) AS mean_result_3, round((({_lags("result", 1, 6)}) / 6.0)::DOUBLE, 6) AS mean_result_6,
      {_lags("distance", 1, 4)} AS sum_distance_4, lag(result) OVER ({_W}) - ({_lags("result", 2, 6)}) AS form_diff,
      coalesce(race_date - lag(race_date) OVER ({_W}), 0)::INT AS rest_days, round(weight - lag(weight) OVER ({_W}), 6) AS weight_change,
      coalesce(sum(won) OVER {_PRIOR}, 0)::BIGINT AS wins,
      round(coalesce(sum(won) OVER {_PRIOR}, 0)::DOUBLE / nullif(row_number() OVER ({_W}) - 1, 0), 6) AS win_rate, round(avg(result) OVER {_PRIOR}, 6) AS mean_result FROM f"""
)
def form_features_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histories by horse, cut into segments for entities with a great share of all rows."""
    out = segments.form_features(runs(spark, sf_dir).drop("flag"), Scratch(spark, "segments"))
    return out.select(*KEY, *[F.round(c, 6).alias(c) if c in _HORSE_ROUNDED else F.col(c).cast("bigint") if c == "starts" else F.col(c) for c in _BY_HORSE])


_CARD = "prev_result prev_speed mean_result_3 mean_result_6 sum_distance_4 form_diff rest_days weight_change wins win_rate mean_result".split()


def _nth(c: str, k: int) -> str:
    return f"max(h.{c}) FILTER (back = {k})"


def _sum_of_last(c: str, k: int, start: int = 1) -> str:
    return " + ".join(_nth(c, i) for i in range(start, start + k))


@register(
    f"""WITH runs AS ({RUNS_SQL}), f AS (SELECT *, round_even((distance / finish_time)::DOUBLE, 8) AS speed, (SELECT max(race_date) FROM runs) - INTERVAL 30 DAY AS day FROM runs),
    h AS (SELECT *, row_number() OVER (PARTITION BY horse ORDER BY race_date DESC, race_id DESC, horse_no DESC, jockey DESC, finish_time DESC) AS back FROM f WHERE race_date < day),
    c AS (SELECT * FROM f WHERE race_date >= day)
    SELECT {", ".join(f"c.{k}" for k in KEY)}, count(h.horse) AS starts, {_nth("result", 1)} AS prev_result, {_nth("speed", 1)} AS prev_speed,
      round((({_sum_of_last("result", 3)}) / 3.0)::DOUBLE, 6) AS mean_result_3, round((({_sum_of_last("result", 6)}) / 6.0)::DOUBLE, 6) AS mean_result_6,
      {_sum_of_last("distance", 4)} AS sum_distance_4, {_nth("result", 1)} - ({_sum_of_last("result", 5, 2)}) AS form_diff,
      coalesce(c.race_date - {_nth("race_date", 1)}, 0)::INT AS rest_days, round(c.weight - {_nth("weight", 1)}, 6) AS weight_change,
      count(h.horse) FILTER (h.result = 1) AS wins, round(count(h.horse) FILTER (h.result = 1)::DOUBLE / nullif(count(h.horse), 0), 6) AS win_rate, round(avg(h.result), 6) AS mean_result
    FROM c LEFT JOIN h ON h.horse = c.horse GROUP BY {", ".join(f"c.{k}" for k in KEY)}, c.race_date, c.weight"""
)
def card_from_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card of the last 30 days from the state before them: built from all but a month, moved on by that month."""
    scratch = Scratch(spark, "state")
    r = scratch.save(runs(spark, sf_dir).drop("flag"), "runs")  # joined once for the last day, both states and the card
    last = r.agg(F.max("race_date")).first()[0]
    day = F.lit(last) - F.expr("INTERVAL 30 DAYS")
    month = F.lit(last) - F.expr("INTERVAL 60 DAYS")
    before, between = r.filter(F.col("race_date") < month), r.filter((F.col("race_date") >= month) & (F.col("race_date") < day))
    known = scratch.save(state.moved_on(state.state_of(before), between), "state")
    out = state.card_features(r.filter(F.col("race_date") >= day), known)
    return out.select(*KEY, "starts", *[F.round(c, 6).alias(c) if c in _HORSE_ROUNDED else F.col(c) for c in _CARD])


# Statistics


@register("SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(table(spark, sf_dir, "customer"), "c_mktsegment")


@register("SELECT size, count(*) AS groups FROM (SELECT l_orderkey, count(l_quantity) AS size FROM lineitem GROUP BY 1) GROUP BY 1")
def size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_distribution(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity")


@register("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def crosstab_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.crosstab_long(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@register(
    """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1"""
)
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@register(
    f"""WITH records AS ({RECORDS_SQL}), p AS (SELECT rec, lag(result) OVER ({_RW}) AS prev FROM records)
    SELECT 'rec' AS "column", sum((rec IS NULL)::INT)::BIGINT AS nulls, count(*) AS rows FROM p
    UNION ALL SELECT 'prev', sum((prev IS NULL)::INT)::BIGINT, count(*) FROM p"""
)
def null_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).select("rec", form.previous("result", form.history("name", ["day", "rec"])).alias("prev"))
    return stats.null_census(r)


_NUM = ("l_quantity", "l_extendedprice", "l_discount")


@register(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max FROM lineitem"""
        for c in _NUM
    )
)
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.describe_numeric(table(spark, sf_dir, "lineitem"), list(_NUM))
    return d.select("column", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")], "max")


@register(" UNION ALL ".join(f"""SELECT '{c}' AS "column", round(corr({c}, l_tax), 8) AS corr FROM lineitem""" for c in _NUM))
def corr_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.corr_with(table(spark, sf_dir, "lineitem"), list(_NUM), "l_tax").select("column", F.round("corr", 8).alias("corr"))


@register(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS corr FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]
    )
)
def corr_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.corr_matrix(table(spark, sf_dir, "lineitem"), list(_NUM)).select("a", "b", F.round("corr", 8).alias("corr"))


@register("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@register(
    """SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(trim(text), '\\s+')) AS word FROM documents)
    WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 100"""
)
def word_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.word_counts(table(spark, sf_dir, "documents"), "text").orderBy(F.desc("n"), "word").limit(100)


@register("SELECT l_returnflag, count(*) AS n, (SELECT count(*) FROM lineitem)::DOUBLE / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*)) AS weight FROM lineitem GROUP BY 1")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.balanced_weights(table(spark, sf_dir, "lineitem"), "l_returnflag")


@register("SELECT l_returnflag, l_linenumber, dense_rank() OVER (ORDER BY l_returnflag, l_linenumber) - 1 AS group_no FROM (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem)")
def group_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_number(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"])


@register(
    """SELECT o_custkey, (DATE '1970-01-01' + ((o_orderdate::DATE - DATE '1970-01-01') // 168 * 168)::INT)::DATE AS from_day, count(*) AS n FROM orders GROUP BY 1, 2"""
)
def tumbling_168_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tumbling_counts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", 168)


# Scalars and repairs

_MARGIN = "CASE l_linenumber WHEN 1 THEN '1-' || (l_quantity::INT % 3 + 1) || '/4' WHEN 2 THEN '3/4' WHEN 3 THEN l_quantity::INT::VARCHAR WHEN 4 THEN 'HD' WHEN 5 THEN 'ML' WHEN 6 THEN 'x' END"


@register(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, m AS margin, CASE l_linenumber WHEN 1 THEN 1 + (l_quantity::INT % 3 + 1) / 4.0::DOUBLE
    WHEN 2 THEN 0.75::DOUBLE WHEN 3 THEN l_quantity::INT::DOUBLE WHEN 4 THEN 0.125::DOUBLE WHEN 5 THEN 15.0::DOUBLE END AS lengths
    FROM (SELECT *, {_MARGIN} AS m FROM lineitem)"""
)
def margin_to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    m = (
        F.when(n == 1, F.concat(F.lit("1-"), (q % 3 + 1).cast("string"), F.lit("/4")))
        .when(n == 2, "3/4").when(n == 3, q.cast("string")).when(n == 4, "HD").when(n == 5, "ML").when(n == 6, "x")
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", m.alias("margin")).withColumn(
        "lengths", sc.margin_to_number(F.col("margin"))
    )


@register(
    """SELECT doc_id, (text LIKE '%password%')::INT AS has_password, (text LIKE '%License%')::INT AS has_license,
    md5(lower(replace(replace(text, '.', ''), ',', ''))) AS clean_md5, len(regexp_split_to_array(trim(text), '\\s+')) AS n_tokens FROM documents"""
)
def keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        sc.keyword_flag(t, "password").alias("has_password"),
        sc.keyword_flag(t, "License").alias("has_license"),
        F.md5(sc.clean_text(t)).alias("clean_md5"),
        F.size(F.split(F.trim(t), r"\s+")).cast("bigint").alias("n_tokens"),
    )


@register(
    """SELECT p_partkey, split_part(p_type, ' ', 1) AS venue, nullif(split_part(p_type, ' ', 2), '') AS soil, nullif(split_part(p_type, ' ', 3), '') AS quality FROM part"""
)
def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", *[sc.split_part(t, " ", i + 1).alias(n) for i, n in enumerate(("venue", "soil", "quality"))])


@register(
    """SELECT o_orderkey, o_orderdate::DATE AS day, (o_orderdate::DATE - DATE '0001-01-01')::INT + 1 AS ordinal, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate::DATE END AS parsed FROM orders"""
)
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 10 == 0, "no date").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    day = F.col("o_orderdate").cast("date")
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", day.alias("day"), (F.datediff(day, F.lit("0001-01-01").cast("date")) + 1).alias("ordinal"), sc.parse_day(text, "dd/MM/yyyy").alias("parsed"))


@register(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'won' WHEN l_linenumber = 2 THEN 'second' WHEN l_linenumber = 3 THEN 'third' ELSE 'other' END AS label,
    (l_linenumber <= 3)::INT AS podium, nullif(l_discount, 0) AS discount, coalesce(nullif(l_tax, 0), -1) AS tax FROM lineitem"""
)
def labels_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(n == 1, "won").when(n == 2, "second").when(n == 3, "third").otherwise("other").alias("label"),
        (n <= 3).cast("int").alias("podium"),
        F.nullif("l_discount", F.lit(0)).alias("discount"),
        F.coalesce(F.nullif("l_tax", F.lit(0)), F.lit(-1)).alias("tax"),
    )


@register(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((abs(a - m) + abs(b - m) + abs(c - m)) / 3, 6) AS mad FROM (SELECT *, l_quantity AS a, l_tax * 100 AS b, l_discount * 100 AS c,
    (l_quantity + l_tax * 100 + l_discount * 100) / 3 AS m FROM lineitem)"""
)
def mad_rowwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumns({"a": F.col("l_quantity"), "b": F.col("l_tax") * 100, "c": F.col("l_discount") * 100})
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(sc.row_mad(["a", "b", "c"]), 6).alias("mad"))


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


# Nested data


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a customer: id, details, and its orders as child rows."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("records"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("details"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(F.col("c_custkey").alias("id"), "details", "records")


@register(
    'SELECT c_custkey AS id, c_name AS "details.name", o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey'
)
def explode_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.explode_child(_documents(spark, sf_dir), "records", ["id", "details.name"])


@register("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_struct(_documents(spark, sf_dir).drop("records"), "details")


@register("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, NULL::BOOLEAN AS seen FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("seen", T.BooleanType())])
    quoted = F.replace(F.replace("props", F.lit('"'), F.lit("'")), F.lit("}"), F.lit(", 'seen': None}"))
    return table(spark, sf_dir, "events").select("event_id", nested.python_dict(quoted, schema).alias("p")).select("event_id", "p.*")


@register("SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return nested.union_all([s, c])


# Splits


@register(
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) > (SELECT count(*) FROM orders) - ceil((SELECT count(*) FROM orders) * 0.2) AS is_test FROM orders"""
)
def ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.ordered_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 0.2).select("o_orderkey", "is_test")


@register("SELECT l_orderkey % 5 AS fold, count(*) AS n, count(DISTINCT l_orderkey) AS races FROM lineitem GROUP BY 1")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("fold", splits.folds("l_orderkey", 5, by_hash=False).cast("bigint"))
    return li.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("races"))
