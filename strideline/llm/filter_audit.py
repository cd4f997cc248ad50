"""Audit of a set of filters: what each one removes in every order, and its Shapley value.

A state is the set of filters that have run; an edge (state, filter) runs one more. What
an edge removes depends on the state alone, so all orders share the edges of one lattice.
Paths are counted forward (orders that reach a state) and backward (orders that go on to
the full set); their product is the number of orders over an edge, and the removals of
a filter's edges weighted by it are its Shapley value times the number of orders. The
steps of a single order are read from the same edges.

Only counts by (part, set of failing filters) meet the lattice: at most 2^n rows a part,
whatever the documents. ``five_filters`` makes them from texts that stay where they are;
what travels is a row a document with a digest of its text.

Defined results: null text is empty; a null part is the empty string; a null id has no
label, is smaller than no other and is never called a copy; equal ids of equal texts
are not copies of each other; a label that differs between rows of one id counts as set
if any row sets it; repeated rows count each; very long texts are read by native functions
only; extra columns take no part; an empty table has no parts, so no rows.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideline.llm.columns import text_of, words_of
from strideline.sources.scratch import Scratch

#: More filters than this have too many orders to report.
MOST = 7
#: Rows without an id are dealt by so many further keys in the join with labels.
SALTS = 1 << 16


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders that pass) of every edge; a state has bit f if filter f has run."""
    states = sorted(range(1 << n), key=int.bit_count)
    reach, leave = {0: 1}, {states[-1]: 1}
    for s in states[1:]:
        reach[s] = sum(reach[s ^ 1 << f] for f in range(n) if s >> f & 1)
    for s in states[-2::-1]:
        leave[s] = sum(leave[s | 1 << f] for f in range(n) if not s >> f & 1)
    return [(s, f, reach[s] * leave[s | 1 << f]) for s in states for f in range(n) if not s >> f & 1]


def _local(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def audit(counts: DataFrame, filters: str, lost: list[str], part: str = "part") -> DataFrame:
    """part, filter_order, step and the counts of that step, for every part, order and step.

    ``counts`` has ``part``, ``mask`` (bit f: filter f fails), ``n`` and the columns of ``lost``,
    whose removals are counted too (as ``<name>_lost``). ``filters`` has a letter a filter.
    """
    n, spark = len(filters), counts.sparkSession
    if not 0 < n <= MOST:
        raise ValueError(f"1 to {MOST} filters, not {n}")
    edges = lattice(n)
    # What every set of failing filters counts as on every edge: a table of n and nothing else.
    roles = [
        {
            "failing": m, "state": s, "filter": f, "paths": paths, "stays": int(not m & (s | 1 << f)), "goes": int(bool(m >> f & 1 and not m & s)),
            "gone": int(bool(m >> f & 1 and m & s)), "only": int(m == 1 << f),
        }
        for s, f, paths in edges
        for m in range(1 << n)
    ]
    met = counts.join(_local(spark, roles), F.col("mask") == F.col("failing"))
    removed = met.groupBy(part, "state", "filter", "paths").agg(
        F.sum(F.col("n") * F.col("stays")).alias("kept"),
        F.sum(F.col("n") * F.col("goes")).alias("removed"),
        F.sum(F.col("n") * F.col("gone")).alias("redundant"),
        F.sum(F.col("n") * F.col("only")).alias("unique_fails"),
        *[F.sum(F.col(c) * F.col("goes")).alias(f"{c}_lost") for c in lost],
    )
    whole = Window.partitionBy(part, "filter")
    removed = removed.withColumn("shapley", F.sum(F.col("removed") * F.col("paths")).over(whole))
    steps = [
        {"of": sum(1 << f for f in order[:k]), "next": order[k], "filter_order": "".join(filters[f] for f in order), "step": k + 1}
        for order in permutations(range(n))
        for k in range(n)
    ]
    read = removed.join(_local(spark, steps), (F.col("state") == F.col("of")) & (F.col("filter") == F.col("next")))
    return read.select(
        part, "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails",
        *[f"{c}_lost" for c in lost], "shapley",
    )


def text_failures(t: Column) -> list[Column]:
    """Few words, few different words, many capitals, marks of markup: true where text ``t`` fails."""
    words = words_of(t)
    return [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * F.regexp_count(t, F.lit("[A-Z]")) > 5 * F.length(t),
        t.rlike("[#$%&*|]"),
    ]


def five_filters(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """part, mask, n, good and toxic: rows by part and failing filters, the fifth being an equal text of a smaller id."""
    t = text_of(text)
    mask = sum((F.when(fails, 1 << f).otherwise(0) for f, fails in enumerate(text_failures(t))), F.lit(0))
    copies = 1 << len(text_failures(t))
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.md5(t).alias("digest"),
    ).withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS))).otherwise(0))
    marks = labels.groupBy(F.col("doc_id").alias("of")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    rows = rows.join(marks.withColumn("zero", F.lit(0).cast("bigint")), (F.col("id") == F.col("of")) & (F.col("salt") == F.col("zero")), "left")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")}
    each = rows.withColumns(flags).groupBy("id", "salt", "digest", "mask", "part", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    # A text may be that of a third of all rows: one row a text, part and label leaves each task.
    alike = each.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    least = F.min("first").over(Window.partitionBy("digest"))
    alike = alike.withColumn("copied", F.col("n") - F.col("n_null") - F.when(F.col("first") == least, F.col("n_first")).otherwise(0))
    return (
        alike.select(
            "part", "good", "toxic",
            F.inline(F.array(
                F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copied")).alias("n")),
                F.struct((F.col("mask") + copies).alias("mask"), F.col("copied").alias("n")),
            )),
        )
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    )


def audit_five(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The five filters, A to E, in all their orders."""
    counts = Scratch(docs.sparkSession, "audit").save(five_filters(docs, labels, **columns), "counts")
    return audit(counts, "ABCDE", ["good", "toxic"])
