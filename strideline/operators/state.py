"""What is known of each entity as of a day: kept as a table, moved on by new results, joined to new cards.

A state is a row an entity: counts and sums of all its starts, and its last few starts, newest
first. States of disjoint results add up, so a table of them is built from parts of a history
in any order, and a day's results change the entities that ran and no other. A new card then gets its
form features by one join, without the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Starts kept.
LAST = 6

_ORDER = ["race_date", "race_id", "horse_no", "jockey", "finish_time"]
_KEPT = [*_ORDER, "result", "distance", "speed", "weight"]


def _newest(lists: Column) -> Column:
    return F.slice(F.sort_array(lists, asc=False), 1, LAST)


def _added(states: DataFrame, *keys: str) -> DataFrame:
    return states.groupBy(*keys).agg(
        F.sum("starts").alias("starts"), F.sum("wins").alias("wins"), F.sum("result_sum").alias("result_sum"),
        F.sum("results").alias("results"), _newest(F.flatten(F.collect_list("last"))).alias("last"),
    )


def state_of(runs: DataFrame, entity: str = "horse") -> DataFrame:
    """entity, starts, wins, result_sum, results (those with a result) and last, of all ``runs``.

    The counts are summed, and the newest rows chosen, before rows are exchanged by entity as well as after, so an entity
    with a great share of all rows is many tasks' work. ``runs`` is read twice.
    """
    counts = runs.groupBy(entity).agg(
        F.count(F.lit(1)).alias("starts"), F.count_if(F.col("result") == 1).alias("wins"), F.sum("result").alias("result_sum"), F.count("result").alias("results")
    )
    newest = Window.partitionBy(entity).orderBy(*[F.desc(c) for c in _ORDER])
    rows = runs.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= LAST)
    rows = rows.withColumn("speed", F.bround(F.try_divide(F.col("distance"), F.col("finish_time")), 8))
    lists = rows.groupBy(entity).agg(F.collect_list(F.struct(*_KEPT)).alias("last"))
    none = {c: F.lit(0).cast("bigint") for c in ("starts", "wins", "results")} | {"result_sum": F.lit(None).cast(counts.schema["result_sum"].dataType)}
    counts = counts.withColumn("last", F.array().cast(lists.schema["last"].dataType))
    return _added(counts.unionByName(lists.withColumns(none)), entity)


def moved_on(state: DataFrame, results: DataFrame, entity: str = "horse") -> DataFrame:
    """The state after ``results``, which must all be new. Entities that did not run are passed through."""
    new = state_of(results, entity)
    ran = new.select(F.col(entity).alias("__ran"))
    same = F.col(entity).eqNullSafe(F.col("__ran"))
    changed = state.join(ran, same, "left_semi").unionByName(new)
    return state.join(ran, same, "left_anti").unionByName(_added(changed, entity))


def card_features(card: DataFrame, state: DataFrame, entity: str = "horse") -> DataFrame:
    """The card's rows with the form features of their entity as of the state; the card's own results are not looked at."""
    known = state.select(F.col(entity).alias("__of"), *[F.col(c).alias(f"__{c}") for c in ("starts", "wins", "result_sum", "results", "last")])
    out = card.join(known, F.col(entity).eqNullSafe(F.col("__of")), "left")

    def last(c: str, k: int) -> Column:
        return F.get("__last", F.lit(k - 1))[c]

    def of_last(c: str, k: int, start: int = 1) -> Column:
        return sum((last(c, i) for i in range(start + 1, start + k)), last(c, start))

    starts = F.coalesce("__starts", F.lit(0).cast("bigint"))
    wins = F.coalesce("__wins", F.lit(0).cast("bigint"))
    return out.withColumns(
        {
            "starts": starts, "wins": wins, "win_rate": F.try_divide(wins, starts), "mean_result": F.try_divide("__result_sum", "__results"),
            "prev_result": last("result", 1), "prev_speed": last("speed", 1),
            "mean_result_3": of_last("result", 3) / F.lit(3), "mean_result_6": of_last("result", 6) / F.lit(6),
            "sum_distance_4": of_last("distance", 4), "form_diff": last("result", 1) - of_last("result", 5, 2),
            "rest_days": F.coalesce(F.datediff("race_date", last("race_date", 1)), F.lit(0)), "weight_change": F.col("weight") - last("weight", 1),
        }
    ).drop("__of", "__starts", "__wins", "__result_sum", "__results", "__last")
