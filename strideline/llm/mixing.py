"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, repeated as often as
its target allows. A document's virtual finish time is the source's tokens up to
and with it, divided by the source's target; all documents are range-sorted by
finish time and the mix is truncated where the tokens reach the total budget. So every
source ends within a document of its target, and the last document taken may be cut.

Targets: sources, by code point and null last, have the weights in turn and share
the budget; a target stops at ``max_repeats`` times its source's size, and the
excess is shared anew by weight until no target is above.

Defined results: null text has size 0; a document of size 0 takes 0; equal ids are
told apart by their text's md5, and rows alike in both are interchangeable; equal
finish times go by source, repeat, shuffled order; a very long text is counted whole;
extra columns take no part; an empty table gives an empty result; a budget of 0 takes 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.functions.ordering import global_running
from strideline.llm.columns import WORD, text_of
from strideline.sources.scratch import Scratch


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int, scratch: Scratch) -> DataFrame:
    """source, rank, source_size, source_start (sizes of earlier sources) and target; ``sizes`` has source and size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_running(per, [F.col("source").isNull(), F.col("source")], scratch, "sources", "source_size", "rank", "source_start")
    turn = (F.col("rank") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = scratch.save(
        ranked.select("source", "rank", "source_size", "source_start", weight.alias("weight")).withColumn(
            "most", F.col("source_size") * F.lit(float(max_repeats))
        ),
        "ranked",
    )
    total = ranked.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    # Level of the fill: each round caps the sources that lie above their most. Only two sums reach the driver.
    level = 0.0
    while True:
        over = F.col("most") <= F.col("weight") * F.lit(level)
        row = ranked.agg(
            F.sum(F.when(over, F.col("most")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        new = (total - row["capped"]) / row["open"]
        if new <= level:
            break
        level = new
    target = F.least(F.col("most"), F.col("weight") * F.lit(level))
    return ranked.select("source", "rank", "source_size", "source_start", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = "",
) -> DataFrame:
    """``key``, source, size, source_size, target and taken of every document."""
    scratch = Scratch(docs.sparkSession, "mixing")
    t = text_of(text)
    # Ids and sizes only: the texts are read once and never shuffled.
    sized = scratch.save(
        docs.select(
            F.col(key).alias("key"),
            F.col(source).alias("source"),
            F.regexp_count(t, F.lit(WORD)).cast("bigint").alias("size"),
            F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed))).alias("shuffled"),
            F.md5(t).alias("tie"),
        ),
        "sized",
    )
    targets = scratch.save(source_targets(sized, weights, max_repeats, scratch), "targets")
    d = sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    # Tokens of the source before each document: one order over all sources, for a source may hold a third of all rows.
    d = global_running(d, ["rank", "shuffled", "tie", "size"], scratch, "queues", total="size")
    d = d.withColumn("start", F.col("before") - F.col("source_start")).drop("before", "position", "source_start")
    # One packet a document and repeat that can begin within the target.
    times = F.least(F.lit(max_repeats), F.greatest(F.lit(1), F.ceil(F.col("target") / F.greatest("source_size", F.lit(1)))))
    packets = d.withColumn("repeat", F.explode(F.sequence(F.lit(0), times.cast("int") - 1))).select(
        "key", "source", "size", "source_size", "target", "rank", "shuffled", "tie", "repeat",
        (F.col("start") + F.col("repeat") * F.col("source_size")).alias("sent"),
    )
    packets = packets.withColumn(
        "finish", F.when(F.col("target") > 0, (F.col("sent") + F.col("size")) / F.col("target")).otherwise(F.lit(float("inf")))
    )
    ordered = global_running(packets, ["finish", "rank", "repeat", "shuffled", "tie", "size"], scratch, "packets", total="size")
    budget = sized.agg(F.sum("size")).first()[0] or 0
    took = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("before")))
    return (
        ordered.withColumn("took", took)
        .groupBy("rank", "shuffled", "tie", "key", "source", "size", "source_size", "target")
        .agg(F.sum("took").alias("took"), F.count_if(F.col("repeat") == 0).alias("rows"))
        # Rows alike in id and text were one group: deal their sum out again, at most max_repeats times the size each.
        .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        .select(
            F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target",
            (F.floor(F.col("took") / F.col("rows")) + (F.col("nth") <= F.col("took") % F.col("rows")).cast("bigint")).alias("taken"),
        )
    )
