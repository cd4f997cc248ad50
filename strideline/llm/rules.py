"""Quality scores by a sparse ensemble of rules over text statistics.

A forest of shallow trees is grown on labelled rows; every path from a root to a node
is a rule, a conjunction of bounds on statistics. Logistic regression with an absolute
(lasso) penalty weighs the rules, most weights end at 0, and what is left is compiled
into one column expression: intercept plus the weights of the rules that hold. Scoring
is so a projection without a model object, a join or Python.

Statistics are native expressions over the whole text. The fit sees at most about
``Training.rows`` labelled rows, chosen by a hash of their id; the bound keeps the fit
the same size whatever the corpus. All rows are scored.

Defined results: null text is empty, and an empty text has all statistics 0 and a score
like any other; rows without a label, or with one other than 0 and 1, are not learned
from; an id with several label rows or texts is learned from once for each pair; a null id is
scored and never learned from; ties need no order; very long texts are one row, read
by native functions; extra columns take no part; without labelled rows, or with one
label only, there are no rules and the score is the share of label 1 (0.5 without
any); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.columns import let, words_of
from strideline.sources.scratch import Scratch

#: Character classes whose share of a text's code points is a statistic.
CLASSES = {
    "capitals": r"\p{Lu}",
    "letters": r"\p{L}",
    "digits": r"[0-9]",
    "stops": r"[.,;:!?]",
    "symbols": r"[#*$%&|<>@\\^_{}~]",
    "breaks": r"\n",
}
NAMES = (*CLASSES, "words", "word_length", "longest", "different", "different_lines", "ended_lines", "stuttered")


@dataclass(frozen=True)
class Training:
    rows: int = 20_000
    trees: int = 16
    depth: int = 3
    penalty: float = 2e-3
    seed: int = 7


@dataclass(frozen=True)
class Rule:
    """Bounds by statistic, lower < value <= upper, and the weight of a text that meets all."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def holds(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -math.inf:
                out = out & (stats[name] > low)
            if high < math.inf:
                out = out & (stats[name] <= high)
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, stats: Column) -> Column:
        """Probability of label 1, of a struct of statistics."""
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + F.when(r.holds(stats), r.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def statistics(t: Column) -> Column:
    """Struct of the statistics NAMES of a text that is not null."""

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    def of(words: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0)
        n, chars = F.size(words), F.length(t)
        return let(
            lines,
            lambda ls: F.struct(
                *[share(F.regexp_count(t, F.lit(p)), chars).alias(name) for name, p in CLASSES.items()],
                F.log1p(n.cast("double")).alias("words"),
                share(F.length(F.array_join(words, "")), n).alias("word_length"),
                F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("double").alias("longest"),
                share(F.size(F.array_distinct(words)), n).alias("different"),
                share(F.size(F.array_distinct(ls)), F.size(ls)).alias("different_lines"),
                share(F.size(F.filter(ls, lambda x: x.rlike(r"[.!?]\s*$"))), F.size(ls)).alias("ended_lines"),
                share(F.size(F.filter(F.arrays_zip(F.slice(words, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(words, 2, n).alias("b")), lambda x: x["a"] == x["b"])), n).alias("stuttered"),
            ),
        )

    return let(words_of(t), of)


def _rules(tree) -> list[Rule]:
    """The path to every node of a fitted tree, below its root."""
    out = []

    def down(node, bounds: dict[str, tuple[float, float]]) -> None:
        if bounds:
            out.append(Rule(tuple(sorted((name, low, high) for name, (low, high) in bounds.items()))))
        if node.subtreeDepth() == 0:
            return
        name, at = NAMES[node.split().featureIndex()], node.split().threshold()
        low, high = bounds.get(name, (-math.inf, math.inf))
        down(node.leftChild(), bounds | {name: (low, min(high, at))})
        down(node.rightChild(), bounds | {name: (max(low, at), high)})

    down(tree._java_obj.rootNode(), {})
    return out


def fit(rows: DataFrame, training: Training = Training(), key: str = "id", stats: str = "stats", label: str = "label") -> Ensemble:
    """An ensemble from the labelled ``rows``: an id, a struct of statistics, and 0 or 1."""
    scratch = Scratch(rows.sparkSession, "rules")
    known = rows.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    total = known.count()
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(training.seed)), F.lit(1 << 30))
    share = min(1.0, training.rows / max(total, 1))
    sample = known.filter(place < int(share * (1 << 30))).select(
        F.col(label).cast("double").alias("label"),
        F.col(stats).alias("stats"),
        array_to_vector(F.array(*[F.col(stats)[name] for name in NAMES])).alias("features"),
        place.alias("place"),
    )
    # One order, so that the same rows give the same forest.
    sample = scratch.save(sample.repartition(4, "place").sortWithinPartitions("place", "label", "stats"), "sample")
    n, good = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, n):
        share = (good + 1e-6) / (n + 2e-6)
        scratch.drop(".")
        return Ensemble(math.log(share / (1 - share)), ())
    forest = RandomForestClassifier(
        numTrees=training.trees, maxDepth=training.depth, featureSubsetStrategy="onethird", minInstancesPerNode=5, maxBins=64, seed=training.seed
    ).fit(sample)
    rules = sorted({r for tree in forest.trees for r in _rules(tree)}, key=lambda r: r.bounds)
    met = F.array(*[F.when(r.holds(F.col("stats")), 1.0).otherwise(0.0) for r in rules]) if rules else F.array(F.lit(0.0))
    matrix = scratch.save(sample.select("label", array_to_vector(met).alias("features")), "met")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=training.penalty, maxIter=200, tol=1e-7).fit(matrix)
    scratch.drop(".")
    weights = lasso.coefficients.toArray()
    kept = tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, weights, strict=False) if w)
    return Ensemble(float(lasso.intercept), kept)
