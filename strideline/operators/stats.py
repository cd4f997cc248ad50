"""Aggregations and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, c: str, k: int) -> DataFrame:
    return value_counts(df, c).orderBy(F.desc("n"), "value").limit(k)


def size_distribution(df: DataFrame, key: str, c: str) -> DataFrame:
    """How many groups have each number of non-null values."""
    return df.groupBy(key).agg(F.count(c).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    return df.groupBy(a).pivot(b, values).count().fillna(0)


def null_census(df: DataFrame) -> DataFrame:
    """column, nulls and rows of every column, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], F.count(F.lit(1)).alias("__rows"))
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"), F.col("__rows").alias("rows")) for c in df.columns])
    return one.select(F.inline(parts))


def exact_quantiles(df: DataFrame, cols: list[str], shares: list[float]) -> DataFrame:
    """column, share and the interpolated quantile ``q`` of each numeric column.

    Distinct values with their counts are put in order in ranges, and only the two
    ranks around each quantile are picked, so no task holds a column.
    """
    from strideline.functions.ordering import global_running
    from strideline.sources.scratch import Scratch

    scratch = Scratch(df.sparkSession, "quantiles")
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])))
    counted = values.filter("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = scratch.save(global_running(counted, ["column", "v"], scratch, "values", total="n"), "placed")
    sizes = placed.groupBy("column").agg(F.min("before").alias("first"), F.sum("n").alias("size")).withColumnRenamed("column", "of")  # one row a column
    wanted = sizes.select("of", "first", F.explode(F.array(*map(F.lit, shares))).alias("share"), ((F.col("size") - 1) * F.col("share")).alias("at"))
    low, place = F.floor("at"), F.col("before") - F.col("first")
    near = placed.join(wanted, (F.col("column") == F.col("of")) & (place <= F.ceil("at")) & (place + F.col("n") > low))
    lo = F.max(F.when(place <= low, F.col("v")))
    hi = F.max("v")
    return near.groupBy("column", "share", "at").agg(lo.alias("lo"), hi.alias("hi")).select(
        "column", "share", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("q")
    )


def anova_f(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """feature and F: variance between the classes over that inside them, from one aggregate by class."""
    sums = [x for i, c in enumerate(cols) for x in (F.avg(c).alias(f"m{i}"), (F.var_pop(c) * F.count(c)).alias(f"w{i}"), F.count(c).alias(f"n{i}"))]
    per = df.groupBy(label).agg(*sums)  # one row a class
    long = per.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{x}{i}").alias(x) for x in "mwn"]) for i, c in enumerate(cols)])))
    mean = F.sum(F.col("m") * F.col("n")).over(Window.partitionBy("feature")) / F.sum("n").over(Window.partitionBy("feature"))
    long = long.withColumn("gap", F.col("n") * (F.col("m") - mean) * (F.col("m") - mean))
    between, within = F.sum("gap") / (F.count(F.lit(1)) - 1), F.sum("w") / (F.sum("n") - F.count(F.lit(1)))
    return long.groupBy("feature").agg(F.try_divide(between, within).alias("f"))


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles, max; one row a column."""

    def of(c: str) -> Column:
        return F.struct(
            F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        )

    rows = df.agg(F.array(*[of(c) for c in cols]).alias("r")).select(F.inline("r"))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75]).groupBy(F.col("column").alias("of"))
    q = q.agg(*[F.max(F.when(F.col("share") == s, F.col("q"))).alias(f"q{int(100 * s)}") for s in (0.25, 0.5, 0.75)])
    return rows.join(q, F.col("column") == F.col("of"), "left").select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def corr_with(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.corr(c, target).alias("corr")) for c in cols])
    return df.agg(parts.alias("r")).select(F.inline("r"))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, corr of all pairs, each over the rows where both are there."""
    parts = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for i, a in enumerate(cols) for b in cols[i + 1 :]
    ]
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    words = F.explode(F.split(F.trim(F.col(text)), r"\s+"))
    return df.select(words.alias("word")).filter("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def race_integrity(df: DataFrame, race: str, result: str) -> DataFrame:
    """How many races have, and lack, places that sum to n(n+1)/2."""
    per = df.groupBy(race).agg(F.count(result).alias("n"), F.sum(result).alias("s"))
    return per.groupBy((2 * F.col("s") == F.col("n") * (F.col("n") + 1)).alias("whole")).agg(F.count(F.lit(1)).alias("races"))


def race_label_weights(df: DataFrame, race: str, flag: str) -> DataFrame:
    per = df.groupBy(race).agg(F.count(F.lit(1)).alias("n"), F.sum(flag).alias("pos"))
    return per.select(race, "n", "pos", F.try_divide("n", F.col("n") - F.col("pos")).alias("w0"), F.try_divide("n", "pos").alias("w1"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k n_c) of every class, from one aggregate of the classes."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))  # one row
    return per.crossJoin(total).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def runner_count(df: DataFrame, race: str) -> DataFrame:
    return df.withColumn("runners", F.count(F.lit(1)).over(Window.partitionBy(race)))


def group_number(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of each distinct key in key order, from 0; only the keys are put in order."""
    from strideline.functions.ordering import global_running
    from strideline.sources.scratch import Scratch

    scratch = Scratch(df.sparkSession, "groups")
    numbered = global_running(df.select(*keys).distinct(), [F.col(k) for k in keys], scratch, "keys")
    return numbered.select(*keys, (F.col("position") - 1).alias("group_no"))


def tumbling_counts(df: DataFrame, key: str, ts: str, days: int) -> DataFrame:
    return (
        df.groupBy(key, F.window(ts, f"{days} days").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.start").cast("date").alias("from_day"), "n")
    )
