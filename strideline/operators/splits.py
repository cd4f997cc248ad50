"""Train and test splits, and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.functions.ordering import global_running
from strideline.sources.scratch import Scratch


def ordered_split(df: DataFrame, order: list[str], fraction: float | None = None, rows: int | None = None) -> DataFrame:
    """Adds ``is_test``: the last fraction (rounded up), or number, of rows in the given order."""
    scratch = Scratch(df.sparkSession, "split")
    placed = scratch.save(global_running(df, [F.col(c) for c in order], scratch, "ranges"), "placed")
    n = placed.count()
    test = rows if rows is not None else -int(-n * fraction // 1)
    return placed.withColumn("is_test", F.col("position") > n - test).drop("position", "before")


def _ticket(keys: list[str], seed: int) -> Column:
    """32 bits of the keys and a seed, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")


def hash_split(key: list[str], percent: int, seed: int = 42) -> Column:
    """The same rows go to train at every run and on any cluster."""
    return _ticket(key, seed) % 100 < percent


def folds(key: str, k: int, by_hash: bool = True) -> Column:
    """Fold number; rows of one key share their fold, so no race straddles two."""
    return (_ticket([key], 0) % k if by_hash else F.pmod(F.col(key), F.lit(k))).cast("int")
