"""Form features: the history of an entity before each of its starts, and ranks in a race.

All are window expressions over a total order, ascending, so "previous" is ``lag``.
Windows with one entity share one exchange and sort; finish all entity windows
before the race windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from strideline.functions.ordering import global_running
from strideline.sources.scratch import Scratch

FIRST, NOW = Window.unboundedPreceding, Window.currentRow


def history(keys: str | list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(keys).orderBy(*order)


def previous(c: str, w: WindowSpec, k: int = 1) -> Column:
    return F.lag(c, k).over(w)


def _sum_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def sum_last(c: str, w: WindowSpec, k: int, start: int = 1) -> Column:
    """Sum of the k values from the ``start``-th last on; null unless all are there."""
    return _sum_of([previous(c, w, i) for i in range(start, start + k)])


def mean_last(c: str, w: WindowSpec, k: int, start: int = 1) -> Column:
    return sum_last(c, w, k, start) / F.lit(k)


def form_difference(c: str, w: WindowSpec, k: int = 6) -> Column:
    """Last value less the k - 1 before it."""
    return previous(c, w) - sum_last(c, w, k - 1, 2)


def change(c: str, w: WindowSpec) -> Column:
    return F.col(c) - previous(c, w)


def prior_count(w: WindowSpec) -> Column:
    return F.row_number().over(w) - 1


def prior_sum(c: Column | str, w: WindowSpec) -> Column:
    """Sum over earlier rows; 0 at the first."""
    return F.coalesce(F.sum(c).over(w.rowsBetween(FIRST, -1)), F.lit(0))


def running_sum(c: str, w: WindowSpec) -> Column:
    """Sum with the current row in it, null where the current value is; it leaks the outcome."""
    return F.when(F.col(c).isNotNull(), F.sum(c).over(w.rowsBetween(FIRST, NOW)))


def prior_mean(c: str, w: WindowSpec) -> Column:
    return F.avg(c).over(w.rowsBetween(FIRST, -1))


def prior_rate(flag: Column | str, w: WindowSpec) -> Column:
    return F.try_divide(prior_sum(flag, w), prior_count(w))


def day_gap(day: str, w: WindowSpec) -> Column:
    """Days since the previous start, 0 at the first."""
    return F.coalesce(F.datediff(F.col(day), F.lag(day).over(w)), F.lit(0))


def per_rest_day(c: str, day: str, w: WindowSpec) -> Column:
    """Change for each day of rest; null without a rest."""
    return F.try_divide(change(c, w), day_gap(day, w))


def day_number(day: str) -> Column:
    return F.datediff(F.col(day), F.lit("0001-01-01").cast("date")) + 1


def trailing_days(c: str, keys: str | list[str], day: str, days: int, how: str, closed: str = "neither") -> Column:
    """Mean, median, max or min over the last ``days`` days, without or with the current day.

    A row exactly ``days`` days old is outside.
    """
    w = Window.partitionBy(keys).orderBy(day_number(day)).rangeBetween(-(days - 1), -1 if closed == "neither" else 0)
    value = {"mean": F.avg, "median": lambda x: F.percentile(x, F.lit(0.5)), "max": F.max, "min": F.min}[how](F.col(c))
    return value.over(w)


def trailing_rows(c: str, w: WindowSpec, k: int) -> Column:
    return F.avg(c).over(w.rowsBetween(-(k - 1), 0))


def next_rows_mean(c: str, w: WindowSpec, k: int) -> Column:
    """Mean of this and the next k - 1 rows; null unless all are there."""
    ahead = w.rowsBetween(0, k - 1)
    return F.when(F.count(c).over(ahead) == k, F.avg(c).over(ahead))


def rest_age(age: str, rest: str, w: WindowSpec) -> Column:
    """Age at the start: today's age less the rests from this start on, in years, half to even."""
    return F.bround(F.col(age) - F.sum(rest).over(w.rowsBetween(NOW, Window.unboundedFollowing)) / 365, 0)


def pct_rank_in(c: str, keys: str | list[str], descending: bool = False) -> Column:
    """Rank by share of the group's non-null values; ties take their mean rank, null stays null.

    All parts go over one window, so a rank is one sort: ties take the places from ``rank`` to the number up to them.
    """
    keys = [keys] if isinstance(keys, str) else keys
    w = Window.partitionBy(*keys).orderBy(F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last())
    first, last = F.rank().over(w), F.count(c).over(w.rangeBetween(FIRST, NOW))
    return F.when(F.col(c).isNotNull(), (first + last) / 2 / F.count(c).over(w.rowsBetween(FIRST, Window.unboundedFollowing)))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``F.round``: half away from zero, of the number as it is written. Only what is near a tie is rounded as a decimal."""
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.abs(x) * 10.0**digits
        out = np.copysign(np.floor(y + 0.5) / 10.0**digits, x)
        near = np.flatnonzero(np.isfinite(x) & ~(np.abs(y - np.floor(y) - 0.5) > y * 2.0**-50))
    step = Decimal(1).scaleb(-digits)
    out[near] = [float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) if abs(v) < 1e15 else v for v in x[near].tolist()]
    return out


def pct_ranks_in(df: DataFrame, ranks: dict[str, str], keys: list[str], digits: dict[str, int] | None = None) -> DataFrame:
    """Adds ``ranks`` (new name: column), each ``pct_rank_in`` the group, after one sort by ``keys`` for all; rounded where ``digits`` has the name.

    ``df`` has the rows of a group in one partition. A group is held in memory, as windows hold it.
    """
    schema = T.StructType([*df.schema, *[T.StructField(n, T.DoubleType()) for n in ranks]])

    def done(part: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        for name, c in ranks.items():
            part = part.append_column(name, _shares(part.column(c), group, (digits or {}).get(name)))
        yield from part.combine_chunks().to_batches()

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # ends with a group that may go on
        rows = 0  # of the held batches when their groups were last told apart
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 2 * rows:
                continue
            part = pa.Table.from_batches(held)
            group = _numbered(part, keys)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield from done(part.slice(0, last), group[:last])
                held = part.slice(last).to_batches()
            rows = sum(b.num_rows for b in held)
        if held:
            part = pa.Table.from_batches(held)
            yield from done(part, _numbered(part, keys))

    return df.sortWithinPartitions(*keys).mapInArrow(ranked, schema)


def _numbered(part: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's group, of rows sorted by ``keys``; null is a value."""
    new = np.zeros(part.num_rows, bool)
    for k in keys:
        code = part.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def _shares(column: pa.ChunkedArray, group: np.ndarray, digits: int | None) -> pa.Array:
    """Mean rank among the group's known values by their number; null where unknown."""
    known = column.is_valid().to_numpy()
    values, code = np.unique(column.drop_null().to_numpy(), return_inverse=True)
    key, place, ties = np.unique(group[known] * max(len(values), 1) + code, return_inverse=True, return_counts=True)
    of = key // max(len(values), 1)
    before = np.cumsum(ties) - ties
    first = np.searchsorted(of, of)
    share = (before - before[first] + 1 + (ties - 1) / 2) / np.bincount(group[known], minlength=1)[of]
    out = np.zeros(len(group))
    out[known] = (share if digits is None else rounded(share, digits))[place]
    return pa.array(out, mask=~known)


def pct_rank_global(df: DataFrame, c: str, out: str, descending: bool = False) -> DataFrame:
    """The same over the whole table. Only distinct values are put in order, in ranges; then they are joined back."""
    scratch = Scratch(df.sparkSession, "rank")
    values = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("ties"))
    order = F.col("__v").desc() if descending else F.col("__v").asc()
    placed = scratch.save(global_running(values, [order], scratch, "values", total="ties"), "placed")
    n = placed.agg(F.sum("ties")).first()[0] or 1
    share = placed.select("__v", ((F.col("before") + 1 + (F.col("ties") - 1) / 2) / F.lit(n)).alias(out))
    return df.join(share, F.col(c) == F.col("__v"), "left").drop("__v")


_BY_HORSE = ["race_date", "race_id", "horse_no", "jockey", "finish_time"]
_BY_JOCKEY = ["race_date", "race_id", "horse_no", "horse", "finish_time"]


def _horse_sums(runs: DataFrame) -> DataFrame:
    """What the columns of ``by_horse`` are worked out from: counts, sums and earlier values, each taken once."""
    # The starts go by the number of their day, so the frame of days needs no sort of its own.
    w = history("horse", ["__day", *_BY_HORSE[1:]])
    before, days = w.rowsBetween(FIRST, -1), Window.partitionBy("horse").orderBy("__day").rangeBetween(-167, -1)
    out = runs.withColumns({"__day": day_number("race_date"), "speed": F.bround(F.try_divide(F.col("distance"), F.col("finish_time")), 8), "won": (F.col("result") == 1).cast("int")})
    out = out.withColumns(
        {
            "starts": prior_count(w), "wins": prior_sum("won", w), "rest_days": day_gap("race_date", w), "prev_speed": previous("speed", w), "__weight": previous("weight", w),
            **{f"__result_{i}": previous("result", w, i) for i in range(1, 7)}, **{f"__distance_{i}": previous("distance", w, i) for i in range(1, 5)},
            "__sum": F.sum("result").over(before), "__n": F.count("result").over(before), "__sum_168": F.sum("result").over(days), "__n_168": F.count("result").over(days),
        }
    )
    out = out.withColumn("starts_at_distance", prior_count(history(["horse", "distance"], ["__day", *_BY_HORSE[1:]])))
    result = [F.col(f"__result_{i}") for i in range(1, 7)]
    out = out.withColumns(
        {
            "prev_result": result[0], "__result_to_3": _sum_of(result[:3]), "__result_to_6": _sum_of(result), "form_diff": result[0] - _sum_of(result[1:]),
            "sum_distance_4": _sum_of([F.col(f"__distance_{i}") for i in range(1, 5)]),
        }
    )
    return out.drop("__day", *[f"__result_{i}" for i in range(1, 7)], *[f"__distance_{i}" for i in range(1, 5)])


def _horse_means(sums: DataFrame) -> DataFrame:
    out = sums.withColumns(
        {
            "mean_result_3": F.col("__result_to_3") / F.lit(3),
            "mean_result_6": F.col("__result_to_6") / F.lit(6),
            "weight_change": F.col("weight") - F.col("__weight"),
            "win_rate": F.try_divide("wins", "starts"),
            "mean_result": F.try_divide("__sum", "__n"),
            "mean_168": F.try_divide("__sum_168", "__n_168"),
        }
    )
    return out.drop("__result_to_3", "__result_to_6", "__weight", "__sum", "__n", "__sum_168", "__n_168")


def by_horse(runs: DataFrame) -> DataFrame:
    """The columns of the form table that come from a horse's history: one exchange by horse."""
    return _horse_means(_horse_sums(runs))


def by_jockey(runs: DataFrame) -> DataFrame:
    j = history("jockey", _BY_JOCKEY)
    out = runs.withColumns({"jockey_starts": prior_count(j), "jockey_wins": prior_sum((F.col("result") == 1).cast("int"), j)})
    return out.withColumn("starts_with_jockey", prior_count(history(["horse", "jockey"], _BY_HORSE)))


def in_race(runs: DataFrame) -> DataFrame:
    return runs.withColumns(
        {
            "mean_168_rank": pct_rank_in("mean_168", ["race_id", "race_date"]),
            "weight_rank": pct_rank_in("weight", ["race_id", "race_date"], descending=True),
        }
    )


def form_features(runs: DataFrame) -> DataFrame:
    """The form table of ``runs``: race_id, race_date, horse, jockey, horse_no, result, distance,
    finish_time, weight. One exchange by jockey, one by horse, one by race; the rows go by jockey while they
    are narrow, and by race with sums of whole numbers, of which the means are made there."""
    return in_race(_horse_means(_horse_sums(by_jockey(runs)).repartition("race_id")))
