"""Running totals and positions over a whole table, without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideline.sources.scratch import Scratch


def global_running(
    df: DataFrame,
    order: list[Column | str],
    scratch: Scratch,
    label: str,
    total: str | None = None,
    position: str = "position",
    before: str = "before",
) -> DataFrame:
    """Adds ``position`` (1, 2, ... in the global ``order``) and ``before``, the sum of
    column ``total`` over all earlier rows.

    The rows are range-sorted and saved; each range has its count and sum, the sums
    of the ranges are carried forward (one row a range), and each range adds its own
    running values. Ranges are split by the order's columns, so the order should be
    total up to rows that are alike; a hot value needs a further column in ``order``.
    """
    value = F.col(total).cast("bigint") if total else F.lit(0).cast("bigint")
    # Range bounds are sampled, so equal rows stay in one range and the saved table fixes the deal.
    ranged = scratch.save(
        df.repartitionByRange(*order).withColumns({"__range": F.spark_partition_id(), "__value": value}), label
    )
    parts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), F.sum("__value").alias("__sum"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("__range").alias("__of"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__sum0"),
    )
    own = Window.partitionBy("__range").orderBy(*order)
    joined = ranged.join(parts, F.col("__range") == F.col("__of"))
    return joined.withColumns(
        {
            position: F.col("__n0") + F.row_number().over(own),
            before: F.col("__sum0")
            + F.coalesce(F.sum("__value").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    ).drop("__range", "__value", "__of", "__n0", "__sum0")
