"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.sources.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``links`` (a, b).

    Every round each node takes the least label of its neighbours and then the label
    of its label, so chains halve. Rounds end when no label changes. A hub only
    ever meets an aggregate with map-side combine and joins that can be split.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter(F.col("a") != F.col("b"))
    both = scratch.save(both.distinct(), f"{label}-edges")
    now = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), f"{label}-0")
    k = 0
    while True:
        k += 1
        heard = (
            both.join(now, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("component").alias("heard"))
        )
        taken = scratch.save(
            now.join(heard, F.col("node") == F.col("a")).select("node", "component", F.least("component", "heard").alias("next")),
            f"{label}-{k}-taken",
        )
        jump = taken.select(F.col("node").alias("of"), F.col("next").alias("jumped"))
        new = scratch.save(
            taken.join(jump, F.col("next") == F.col("of"))
            .select("node", F.least("next", "jumped").alias("component"), (F.least("next", "jumped") != F.col("component")).alias("changed")),
            f"{label}-{k}",
        )
        scratch.drop(f"{label}-{k - 1}", f"{label}-{k}-taken")
        if new.filter("changed").isEmpty():
            return new.select("node", "component")
        now = new.select("node", "component")
