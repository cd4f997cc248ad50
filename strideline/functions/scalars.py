"""Scalar expressions: text, dates, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Margins given by name, in lengths.
MARGINS = {"HD": 0.125, "SH": 0.0625, "N": 0.25, "NOSE": 0.0125, "DH": 0.0, "ML": 15.0}


def margin_to_number(c: Column) -> Column:
    """``1-1/4`` is 1.25, ``3/4`` 0.75, ``2`` 2, a named margin its value; anything else null."""
    named = F.lit(None).cast("double")
    for name, value in MARGINS.items():
        named = F.when(c == name, F.lit(value)).otherwise(named)
    parts = F.split(c, "[-/]")
    number = [F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2, 3)]
    return (
        F.when(c.rlike(r"^\d+-\d+/\d+$"), number[0] + F.try_divide(number[1], number[2]))
        .when(c.rlike(r"^\d+/\d+$"), F.try_divide(number[0], number[1]))
        .when(c.rlike(r"^\d+$"), number[0])
        .otherwise(named)
    )


def split_part(c: Column, pattern: str, i: int) -> Column:
    """The i-th part, from 1; null where there are fewer."""
    return F.try_element_at(F.split(c, pattern), F.lit(i))


def clean_text(c: Column) -> Column:
    return F.lower(F.translate(c, ".,", ""))


def keyword_flag(c: Column, word: str) -> Column:
    return c.contains(word).cast("int")


def parse_day(c: Column, fmt: str) -> Column:
    """Null where the text is no such date."""
    return F.try_to_timestamp(c, F.lit(fmt)).cast("date")


def ticket_cost(n: Column, power: int) -> Column:
    """C(n, 3) to a power, by products."""
    return F.pow(n * (n - 1) * (n - 2) / 6, F.lit(power))


def row_mad(cols: list[str]) -> Column:
    """Mean absolute deviation over a row's columns, nulls left out."""
    values = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = F.try_divide(total(values), F.size(values))
    return F.try_divide(total(F.transform(values, lambda x: F.abs(x - mean))), F.size(values))


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
