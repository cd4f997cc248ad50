"""The driver's tables in the roles of the form data, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.sources.tables import table

RUNS_SQL = """
SELECT l_orderkey AS race_id, o_orderdate::DATE AS race_date, l_partkey AS horse, l_suppkey AS jockey,
       l_linenumber AS horse_no, l_linenumber AS result, l_quantity AS distance,
       l_extendedprice AS finish_time, l_tax AS weight, l_returnflag AS flag
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

RECORDS_SQL = """
SELECT o_custkey AS name, o_orderkey AS rec, o_orderdate::DATE AS day, o_totalprice AS result FROM orders
"""


def runs(spark: SparkSession, sf_dir: str, trained: bool = False) -> DataFrame:
    """Entries joined with their races; ``trained``: with trainer and odds too."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("trainer"), F.col("o_orderdate").cast("date").alias("race_date"))
    more = ["trainer", F.col("l_discount").alias("win_odds")] if trained else []
    li = table(spark, sf_dir, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("race_id"),
        "race_date",
        F.col("l_partkey").alias("horse"),
        F.col("l_suppkey").alias("jockey"),
        F.col("l_linenumber").alias("horse_no"),
        F.col("l_linenumber").alias("result"),
        F.col("l_quantity").alias("distance"),
        F.col("l_extendedprice").alias("finish_time"),
        F.col("l_tax").alias("weight"),
        F.col("l_returnflag").alias("flag"),
        *more,
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated records of entities."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("name"),
        F.col("o_orderkey").alias("rec"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").alias("result"),
    )
