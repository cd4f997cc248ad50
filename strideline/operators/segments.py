"""Histories of an entity cut into segments, so that one with a great share of all rows is many tasks' work.

Rows are range-sorted by entity and time; the ranges are the segments. What a segment needs of
those before it is small: how many rows of its first entity came before, the sums of
their columns, and their last few rows (``History``), or their counts by value over the longest span
of days (``trailing``). Those are handed on by joins on the entity, after which every
segment is worked on by itself. ``trailing_here`` does the same for rows that lie by entity already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from strideline.operators.form import _numbered, day_number, rounded
from strideline.sources.scratch import Scratch


def _same(keys: list[str], other: str) -> Column:
    out = F.lit(True)
    for c in keys:
        out = out & F.col(c).eqNullSafe(F.col(f"{other}{c}"))
    return out


def _renamed(keys: list[str], prefix: str, of: str | None = None) -> list[Column]:
    return [F.col(f"{of}.{c}" if of else c).alias(f"{prefix}{c}") for c in keys]


# Counts, sums and last rows


@dataclass(frozen=True)
class History:
    """Rows of each segment, led by the last ``reach`` rows of its first entity before it (``__own`` is false there).

    Window functions of at most ``reach`` rows back go over ``window``; counts and sums of all earlier rows
    are ``prior_count`` and ``prior_sum``. ``own`` takes the leading rows out at the end.
    """

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy("__segment", *self.keys).orderBy(*self.order)

    def prior_count(self) -> Column:
        here = F.count(F.when(F.col("__own"), 1)).over(self.window.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(F.col("__n0"), F.lit(0)) + here

    def prior_sum(self, c: str) -> Column:
        here = F.sum(F.when(F.col("__own"), F.col(c))).over(self.window.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(F.col(f"__before_{c}"), F.lit(0)) + F.coalesce(here, F.lit(0))

    def own(self, df: DataFrame) -> DataFrame:
        return df.filter("__own").drop(*[c for c in df.columns if c.startswith("__")])


def histories(df: DataFrame, keys: list[str], order: list[str], reach: int, sums: list[str], scratch: Scratch, label: str) -> History:
    """Cuts the histories by ``keys`` in ``order`` into segments. ``sums`` are the columns that ``prior_sum`` is asked for."""
    ranged = scratch.save(df.repartitionByRange(*keys, *order).withColumn("__segment", F.spark_partition_id()), f"{label}-ranged")
    who = F.struct(*keys)
    ends = ranged.groupBy(F.col("__segment").alias("__of")).agg(F.min(who).alias("__first"), F.max(who).alias("__last"))
    ends = scratch.save(ends.select("__of", *_renamed(keys, "__first_", "__first"), *_renamed(keys, "__last_", "__last")), f"{label}-ends")  # a row a segment
    # A segment's last entity is the only one that can go on in the next.
    tail = ranged.join(ends, F.col("__segment") == F.col("__of")).filter(_same(keys, "__last_"))
    tail = tail.groupBy("__of").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__sum_{c}") for c in sums])
    given = ends.select("__of", *_renamed([f"__last_{c}" for c in keys], ""), *_renamed([f"__first_{c}" for c in keys], ""))
    given = given.join(tail.withColumnRenamed("__of", "__at"), F.col("__of") == F.col("__at")).drop("__at")
    # One line of events by entity: a segment takes in what the segments before it gave.
    gives = given.select("__of", F.lit(True).alias("__gives"), *[F.col(f"__last_{c}").alias(f"__e_{c}") for c in keys], "__n", *[f"__sum_{c}" for c in sums])
    zero = [F.lit(0).cast("bigint").alias("__n")] + [F.lit(None).cast(tail.schema[f"__sum_{c}"].dataType).alias(f"__sum_{c}") for c in sums]
    takes = given.select("__of", F.lit(False).alias("__gives"), *[F.col(f"__first_{c}").alias(f"__e_{c}") for c in keys], *zero)
    line = Window.partitionBy(*[f"__e_{c}" for c in keys]).orderBy("__of", "__gives").rowsBetween(Window.unboundedPreceding, -1)
    events = gives.unionByName(takes).withColumns(
        {"__n0": F.coalesce(F.sum("__n").over(line), F.lit(0))} | {f"__before_{c}": F.sum(f"__sum_{c}").over(line) for c in sums}
    )
    events = scratch.save(events.drop(*[f"__sum_{c}" for c in sums]), f"{label}-events")  # two rows a segment
    carried = events.filter("NOT __gives").drop("__gives", "__n")
    of_row = (F.col("__segment") == F.col("__of")) & _same(keys, "__e_")
    placed = ranged.join(F.broadcast(carried), of_row, "left").drop("__of", *[f"__e_{c}" for c in keys]).withColumn("__own", F.lit(True))
    # The rows that a segment asks for, by their place in the entity's whole history. Of a segment's last entity no more than its newest few are.
    back = F.explode(F.sequence(F.greatest(F.col("__n0") - reach, F.lit(0)), F.col("__n0") - 1))
    asked = carried.filter(F.col("__n0") > 0).select(F.col("__of").alias("__to"), *[f"__e_{c}" for c in keys], back.alias("__wanted"))
    upto = events.filter("__gives").select("__of", *[f"__e_{c}" for c in keys], (F.col("__n0") + F.col("__n")).alias("__upto"))
    last = ranged.join(F.broadcast(upto), of_row).drop("__of", *[f"__e_{c}" for c in keys])
    last = last.withColumn("__back", F.row_number().over(Window.partitionBy("__segment").orderBy(*[F.desc(c) for c in order]))).filter(F.col("__back") <= reach)
    led = last.join(asked, _same(keys, "__e_") & (F.col("__upto") - F.col("__back") == F.col("__wanted"))).withColumns({"__segment": F.col("__to"), "__own": F.lit(False)})
    led = led.withColumns({c: F.lit(None).cast(placed.schema[c].dataType) for c in ["__n0", *[f"__before_{c}" for c in sums]]})
    return History(placed.unionByName(led.select(placed.columns)), tuple(keys), tuple(order))


def form_features(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """The histories by horse of the form table, cut into segments: starts, wins, last results and speeds, rest, weight change."""
    from strideline.operators import form

    order = ["race_date", "race_id", "horse_no", "jockey", "finish_time"]
    def speed(distance: str, finish_time: str) -> Column:
        return F.bround(F.try_divide(F.col(distance), F.col(finish_time)), 8)

    h = histories(runs.withColumn("won", (F.col("result") == 1).cast("int")), ["horse"], order, 6, ["won", "result"], scratch, "horse")
    w = h.window
    lags = {"result": 6, "distance": 4, "finish_time": 1}
    out = h.rows.withColumns({f"__{c}_{i}": form.previous(c, w, i) for c, n in lags.items() for i in range(1, n + 1)})
    out = out.withColumns(
        {
            "starts": h.prior_count(), "rest_days": form.day_gap("race_date", w), "weight_change": form.change("weight", w),
            "wins": h.prior_sum("won"), "__sum": h.prior_sum("result"),
        }
    )

    def of_last(c: str, k: int, start: int = 1) -> Column:
        return sum((F.col(f"__{c}_{i}") for i in range(start + 1, start + k)), F.col(f"__{c}_{start}"))

    out = out.withColumns(
        {
            "speed": speed("distance", "finish_time"), "prev_result": F.col("__result_1"), "prev_speed": speed("__distance_1", "__finish_time_1"),
            "mean_result_3": of_last("result", 3) / F.lit(3), "mean_result_6": of_last("result", 6) / F.lit(6), "sum_distance_4": of_last("distance", 4),
            "form_diff": F.col("__result_1") - of_last("result", 5, 2), "win_rate": F.try_divide("wins", "starts"), "mean_result": F.try_divide("__sum", "starts"),
        }
    )
    return h.own(out)


# Order statistics and means of the last days


class _Counts:
    """A multiset of ranks that grows and shrinks; the k-th least in logarithmic time."""

    def __init__(self, kinds: int):
        self.sums = [0] * (kinds + 1)
        self.top = 1 << max(kinds.bit_length() - 1, 0)
        self.n = 0

    def add(self, rank: int, n: int) -> None:
        self.n += n
        i, sums, size = rank + 1, self.sums, len(self.sums)
        while i < size:
            sums[i] += n
            i += i & -i

    def at(self, k: int) -> int:
        """Rank of the k-th least, from 0."""
        i, step, sums, size = 0, self.top, self.sums, len(self.sums)
        while step:
            if i + step < size and sums[i + step] <= k:
                i += step
                k -= sums[i]
            step >>= 1
        return i


#: Days of one entity are this far from the next one's in a line of many.
_APART = 1 << 23
#: Frames of up to so many counts are sorted side by side, so many numbers at once; wider ones are one walk forward.
NARROW, _SIDE = 64, 1 << 20


def _narrow(value: np.ndarray, n: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """median, max and min of the frames of ``width`` counts from each of ``low`` on."""
    at = low[:, None] + np.arange(width)
    order = np.argsort(value[at], axis=1, kind="stable")
    v, upto = np.take_along_axis(value[at], order, axis=1), np.cumsum(np.take_along_axis(n[at], order, axis=1), axis=1)
    k = upto[:, -1] - 1
    here = np.arange(len(low))
    a, b = ((upto <= place[:, None]).sum(axis=1) for place in (k // 2, k - k // 2))
    return 0.5 * v[here, a] + 0.5 * v[here, b], v[:, -1], v[:, 0]


def _walk(when: np.ndarray, value: np.ndarray, n: np.ndarray, frames: list[tuple[int, str]], asked: np.ndarray) -> list[np.ndarray]:
    """mean, median, max and min by frame, of the last days before each of ``asked``, NaN where there are none.

    ``when`` is the day plus _APART times the number of the entity, in order, as is ``asked``; so the wide frames of
    all entities are one walk forward.
    """
    kinds, rank, many = None, [], []
    total = np.concatenate([[0], np.cumsum(value.astype(np.longdouble) * n)])
    count = np.concatenate([[0], np.cumsum(n)])
    out = []
    for span, closed in frames:
        low, high = np.searchsorted(when, asked - span + 1), np.searchsorted(when, asked, "left" if closed == "neither" else "right")
        held = count[high] - count[low]
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = ((total[high] - total[low]) / held).astype(np.float64)
        middle, most, least = (np.full(len(asked), np.nan) for _ in range(3))
        width = high - low
        for w in np.unique(width[(width > 0) & (width <= NARROW)]).tolist():
            mine = np.flatnonzero(width == w)
            for i in range(0, len(mine), _SIDE // w):
                part = mine[i : i + _SIDE // w]
                middle[part], most[part], least[part] = _narrow(value, n, low[part], w)
        wide = np.flatnonzero(width > NARROW)
        if len(wide) and kinds is None:
            kinds, rank = np.unique(value, return_inverse=True)
            rank, many = rank.tolist(), n.tolist()
        counts, a, b = _Counts(len(kinds) if len(wide) else 0), 0, 0
        for i, lo, hi in zip(wide.tolist(), low[wide].tolist(), high[wide].tolist(), strict=True):
            while a < min(lo, b):
                counts.add(rank[a], -many[a])
                a += 1
            if b < lo:
                a = b = lo
            while b < hi:
                counts.add(rank[b], many[b])
                b += 1
            k = counts.n - 1
            middle[i] = 0.5 * kinds[counts.at(k // 2)] + 0.5 * kinds[counts.at(k - k // 2)]
            most[i], least[i] = kinds[counts.at(k)], kinds[counts.at(0)]
        out += [mean, middle, most, least]
    return out


STATISTICS = ("mean", "median", "max", "min")


def _frame_names(frames: list[tuple[int, str]]) -> list[str]:
    return [f"{how}_{span}" + ("" if closed == "neither" else "_right") for span, closed in frames for how in STATISTICS]


def _walked(df: DataFrame, who: list[str], measures: dict[str, tuple[list[str], str]], frames: list[tuple[int, str]], digits: int | None, lead: str | None = None) -> DataFrame:
    """``df`` with the statistics of the measures (start of the new names: further keys beside ``who``, column).

    ``df`` lies sorted by ``who`` and ``__day`` in its partitions. Rows go by as they come: behind them only the measured
    columns of the last entity's rows within the longest span are kept, and rows wait for the end of their
    day only where a frame has the current day. Rows with a number in ``lead`` stand for so many rows, and are not given out.
    """
    names = [f"{start}{x}" for start in measures for x in _frame_names(frames)]
    kept = [c for c in df.columns if c not in ("__day", lead)]
    reach, wait = max(span for span, _ in frames), any(closed == "right" for _, closed in frames)
    columns = list(dict.fromkeys([*who, "__day", *[k for keys, c in measures.values() for k in (*keys, c)], *([lead] if lead else [])]))

    def numbers(part: pa.Table, c: str) -> np.ndarray:
        return np.asarray(part.column(c).cast(pa.float64()).to_numpy(), np.float64)

    def done(past: pa.Table | None, part: pa.Table) -> tuple[pa.Table, pa.Table]:
        """The rows with their statistics, and what is to be kept of them."""
        line = part.select(columns)
        line = line if past is None else pa.concat_tables([past, line])
        before = line.num_rows - part.num_rows
        of, day = _numbered(line, who), numbers(line, "__day")
        n = np.nan_to_num(numbers(line, lead), nan=1.0).astype(np.int64) if lead else np.ones(line.num_rows, np.int64)
        dated = ~np.isnan(day)
        own = np.flatnonzero(dated & (np.arange(line.num_rows) >= before) & (line.column(lead).is_null().to_numpy() if lead else True))
        found = []
        for keys, c in measures.values():
            entity = of
            for k in keys:
                code = line.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                entity = entity * (int(code.max()) + 1) + code
            if keys:  # numbers as small as they can be
                entity = np.unique(entity, return_inverse=True)[1]
            when = entity.astype(np.int64) * _APART + np.where(dated, day, 0).astype(np.int64)
            value = numbers(line, c)
            known = np.flatnonzero(dated & ~np.isnan(value))
            if keys:
                known = known[np.argsort(when[known], kind="stable")]
            asked, place = np.unique(when[own], return_inverse=True)
            for f in _walk(when[known], value[known], n[known], frames, asked):
                column = np.full(line.num_rows, np.nan)
                column[own] = (f if digits is None else rounded(f, digits))[place]
                found.append(pa.array(column[before:], from_pandas=True))
        out = part.select(kept)
        for name, f in zip(names, found, strict=True):
            out = out.append_column(name, f)
        if lead:
            out = out.filter(part.column(lead).is_null())
        return out, line.filter(pa.array((of == of[-1]) & dated & (day > day[-1] - reach)))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = least = 0  # held, and to be held before the next part is worked on
        past = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < least:
                continue
            part = pa.Table.from_batches(held)
            upto = rows
            if wait:
                group = _numbered(part, [*who, "__day"])
                upto = int(np.searchsorted(group, group[-1]))
            if upto:
                out, past = done(past, part.slice(0, upto))
                yield from out.combine_chunks().to_batches()
            held, rows = part.slice(upto).to_batches(), rows - upto
            # What was kept is met again by each part, so a part has a share of its rows.
            least = max(2 * rows, past.num_rows // 2 if past is not None else 0)
        if held:
            yield from done(past, pa.Table.from_batches(held))[0].combine_chunks().to_batches()

    return df.mapInArrow(walked, T.StructType([*[df.schema[c] for c in kept], *[T.StructField(x, T.DoubleType()) for x in names]]))


def trailing(
    df: DataFrame, keys: list[str], day: str, c: str, spans: list[int], scratch: Scratch, label: str, closed: tuple[str, ...] = ("neither",), digits: int | None = None
) -> DataFrame:
    """Adds ``<statistic>_<span>`` of ``c`` over the last ``span`` days, without the current day; a row ``span`` days old is outside.

    With ``closed`` "right" also ``<statistic>_<span>_right``, the current day included. Rounded to ``digits`` if they are given.

    The rows are written once, range-sorted by entity and day, and led by the counts by (entity, day, value) that their
    segment's first entity has before it. Rows of one entity and day stay in one task. Nulls have no part; a null day gives nulls.
    """
    frames = [(span, side) for side in closed for span in spans]
    ranged = df.withColumn("__day", day_number(day)).repartitionByRange(*keys, "__day").withColumn("__segment", F.spark_partition_id())
    ranged = scratch.save(ranged, f"{label}-rows", compression="zstd")
    who = F.struct(*keys, "__day")
    first = ranged.groupBy(F.col("__segment").alias("__to")).agg(F.min(who).alias("f"))  # a row a segment
    first = first.select("__to", *_renamed(keys, "__f_", "f"), F.col("f.__day").alias("__from"))
    ahead = _same(keys, "__f_") & (F.col("__segment") < F.col("__to")) & (F.col("__day") > F.col("__from") - max(spans))
    led = ranged.filter(F.col(c).isNotNull()).select("__segment", "__day", *dict.fromkeys([*keys, c])).join(first, ahead)
    led = led.groupBy(F.col("__to").alias("__segment"), "__day", *dict.fromkeys([*keys, c])).agg(F.count(F.lit(1)).alias("__lead"))
    rows = ranged.withColumn("__lead", F.lit(None).cast("bigint")).unionByName(led, allowMissingColumns=True)
    rows = rows.repartition("__segment", *keys).sortWithinPartitions("__segment", *keys, "__day")
    return _walked(rows, ["__segment", *keys], {"": ([], c)}, frames, digits, "__lead").drop("__segment")


def trailing_here(df: DataFrame, entity: str, day: str, measures: dict[str, tuple[list[str], str]], spans: list[int], digits: int | None = None) -> DataFrame:
    """Adds ``<measure>_<statistic>_<span>`` for several measures (name: keys beside ``entity``, column), without an exchange.

    ``df`` has the rows of an entity in one partition, which is sorted once and gone through row by row; what is kept of an
    entity is its last days.
    """
    rows = df.withColumn("__day", day_number(day)).sortWithinPartitions(entity, "__day")
    return _walked(rows, [entity], {f"{m}_": x for m, x in measures.items()}, [(span, "neither") for span in spans], digits)
