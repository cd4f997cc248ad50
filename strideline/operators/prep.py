"""Preparation fitted on training rows only: imputation, scaling, encoding, selection.

Fitted statistics are single rows or one row a distinct value, and are joined or
taken as literals; Spark ML stages are used where they are exact.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    PCA,
    MaxAbsScaler,
    OneHotEncoder,
    PolynomialExpansion,
    StandardScaler,
    StringIndexer,
    UnivariateFeatureSelector,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widest polynomial expansion that is built without a warning.
WIDE = 2_000
#: Most patterns of missing columns whose sums a chained imputation takes to the driver.
PATTERNS = 4096


def fit_fill(df: DataFrame, cols: list[str], how: str = "mean") -> dict[str, object]:
    """Mean, exact median or most frequent value (ties: the least) of each column."""
    if how == "median":
        from strideline.operators.stats import exact_quantiles

        found = {r["column"]: r["q"] for r in exact_quantiles(df, cols, [0.5]).collect()}  # one row a column
        return {c: found.get(c) for c in cols}
    value = {"mean": F.avg, "mode": lambda c: F.mode(c, True)}[how]
    row = df.agg(*[value(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def fill(df: DataFrame, values: dict[str, object], indicator: bool = False) -> DataFrame:
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in values} if indicator else {}
    known = {c: F.coalesce(c, F.lit(v)) for c, v in values.items() if v is not None}
    return df.withColumns(flags).withColumns(known)


def iterative_fill(df: DataFrame, cols: list[str], rounds: int = 3) -> DataFrame:
    """Chained regressions: each column's nulls are predicted from the others, round by round.

    A filled row is a linear function of its known values, the same for all rows with the same columns
    missing. So the sums of products by pattern of missing columns, one scan, give every
    regression of every round; then the rows are filled once.
    """
    from strideline.operators.moments import Solver, fold_moments

    if len(cols) > 62:
        raise ValueError("patterns of at most 62 columns")
    d = len(cols)
    pattern = sum((F.when(F.col(c).isNull(), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, c in enumerate(cols)), F.lit(0).cast("bigint"))
    known = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    rows = fold_moments(df, known, F.lit(0.0), pattern).limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns of missing columns")
    sums = {r["fold"]: np.array(r["s"]).reshape(d + 2, d + 2)[:-1, :-1] for r in rows}
    means = np.zeros(d)
    for i in range(d):
        n, s = (sum(m[0, j] for p, m in sums.items() if not p >> i & 1) for j in (0, i + 1))
        means[i] = s / n if n else 0.0
    # Row c of a pattern's matrix makes (1, values) the filled value of column c.
    fills = {}
    for p in sums:
        fills[p] = np.eye(d + 1)
        for i in range(d):
            if p >> i & 1:
                fills[p][i + 1] = [means[i], *[0.0] * d]
    for _ in range(rounds):
        for i in range(d):
            order = [0, *[j + 1 for j in range(d) if j != i], i + 1]
            s = sum((fills[p] @ m @ fills[p].T for p, m in sums.items() if not p >> i & 1), np.zeros((d + 1, d + 1)))
            if s[0, 0] <= 0:
                continue  # a column without values
            c = Solver(s[np.ix_(order, order)]).ridge(0.0)
            for p in fills:
                if p >> i & 1:
                    fills[p][i + 1] = c @ fills[p][order[:-1]]
    table = [(p, [[float(v) for v in f[i + 1]] for i in range(d)]) for p, f in fills.items()]
    of = df.sparkSession.createDataFrame(table, "__pattern bigint, __fill array<array<double>>")
    out = df.withColumn("__mask", pattern).join(F.broadcast(of), F.col("__mask") == F.col("__pattern"), "left")  # at most PATTERNS rows

    def filled(i: int) -> Column:
        w = F.get("__fill", F.lit(i))
        return F.aggregate(F.zip_with(F.concat(F.array(F.lit(1.0)), known), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    values = {c: F.when(F.col(c).isNull(), filled(i)).otherwise(F.col(c).cast("double")) for i, c in enumerate(cols)}
    return out.withColumns(values).drop("__mask", "__pattern", "__fill")


def nearest_fill(df: DataFrame, key: str, vector: str, c: str, k: int = 12) -> DataFrame:
    """Nulls of ``c`` become the mean of the k rows nearest by ``vector`` that have a value.

    The rows without a value are the query set.
    """
    from strideline.operators.models import nearest

    known, asked = df.filter(F.col(c).isNotNull()), df.filter(F.col(c).isNull())
    means = nearest(known, asked, key, vector, c, k).select("asked", "mean_label")
    filled = df.join(means, F.col(key) == F.col("asked"), "left")
    return filled.withColumn(c, F.coalesce(F.col(c).cast("double"), "mean_label")).drop("asked", "mean_label")


def standardise(df: DataFrame, cols: list[str], by: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation, both of ``by`` (the training rows)."""
    row = (by if by is not None else df).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in cols for f in (F.avg, F.stddev_pop)]).first()
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(row[f"avg_{c}"]), F.lit(row[f"stddev_pop_{c}"])) for c in cols})


def max_abs(df: DataFrame, cols: list[str]) -> DataFrame:
    row = df.agg(*[F.max(F.abs(c)).alias(c) for c in cols]).first()
    return df.withColumns({c: F.try_divide(F.col(c), F.lit(row[c])) for c in cols})


def label_encode(df: DataFrame, c: str, out: str) -> DataFrame:
    """Place of the value among the distinct values, from 0."""
    from strideline.operators.stats import group_number

    numbers = group_number(df.filter(F.col(c).isNotNull()), [c]).withColumnsRenamed({c: "__v", "group_no": out})
    return df.join(numbers, F.col(c) == F.col("__v"), "left").drop("__v")


def onehot_long(df: DataFrame, key: list[str], c: str) -> DataFrame:
    """key, value, 1: the non-zero cells of the one-hot matrix."""
    return df.filter(F.col(c).isNotNull()).select(*key, F.col(c).alias("value"), F.lit(1).alias("one"))


def chain(numeric: list[str], categorical: list[str] = (), degree: int = 1, components: int = 0, scale: str = "standard") -> Pipeline:
    """Assemble, scale, expand and reduce numeric columns; index and encode the others; one vector ``features``."""
    stages = [VectorAssembler(inputCols=list(numeric), outputCol="v0", handleInvalid="keep")]
    stages.append(
        StandardScaler(inputCol="v0", outputCol="v1", withMean=True) if scale == "standard" else MaxAbsScaler(inputCol="v0", outputCol="v1")
    )
    last = "v1"
    if components:
        stages.append(PCA(k=components, inputCol=last, outputCol="v2"))
        last = "v2"
    if degree > 1:
        stages.append(PolynomialExpansion(degree=degree, inputCol=last, outputCol="v3"))
        last = "v3"
    encoded = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_h"))
        encoded.append(f"{c}_h")
    stages.append(VectorAssembler(inputCols=[last, *encoded], outputCol="features"))
    return Pipeline(stages=stages)


def expanded_width(inputs: int, degree: int) -> int:
    """Columns of a polynomial expansion without the constant."""
    top = reduce(lambda a, i: a * (inputs + i) // i, range(1, degree + 1), 1)
    return top - 1


def select_best(df: DataFrame, label: str, k: int | None = None, alpha: float | None = None, by: DataFrame | None = None) -> DataFrame:
    """The k best features by ANOVA F, or those with false-positive rate under alpha, of ``by`` (the training rows), as ``chosen``."""
    s = UnivariateFeatureSelector(featuresCol="features", labelCol=label, outputCol="chosen", selectionMode="fpr" if alpha else "numTopFeatures")
    s = s.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(alpha or k)
    return s.fit(df if by is None else by).transform(df)


def importances(model, names: list[str]) -> list[tuple[str, float]]:
    """Features with importance, or size of coefficient, falling."""
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    return sorted(zip(names, (float(v) for v in values), strict=True), key=lambda x: (-x[1], x[0]))


def recursive_elimination(df: DataFrame, names: list[str], label: str, fold: str, k: int) -> DataFrame:
    """n_features, features, dropped and mean_accuracy: one feature goes each round, the one with the smallest coefficient.

    ``best`` marks the set with the greatest out-of-fold accuracy, the smaller one among equals.
    """
    from pyspark.sql.window import Window

    from strideline.operators.logistic import alike_rows, fit_subsets

    # Each fold is scored by an elimination that has not seen it; the sets named are those of all rows, the last line.
    # The models of a round are fitted in the same passes.
    seen, d = alike_rows(df, label, fold, "weight")
    folds, left = [*range(k), -1], [list(names) for _ in range(k + 1)]
    rows = []
    while left[-1]:
        kept = np.array([[True, *[n in own for n in names]] for own in left])
        beta, accuracy = fit_subsets(seen, folds, kept)
        worst = [min(own, key=lambda n, b=b: (abs(b[1 + names.index(n)]), [-ord(c) for c in n])) for own, b in zip(left, beta, strict=True)]
        scores = [float(a) for a in accuracy[:-1] if not np.isnan(a)]
        rows.append((len(left[-1]), ",".join(left[-1]), worst[-1], sum(scores) / len(scores) if scores else None))
        for own, n in zip(left, worst, strict=True):
            own.remove(n)
    out = df.sparkSession.createDataFrame(rows, "n_features int, features string, dropped string, mean_accuracy double")
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc("mean_accuracy"), "n_features")) == 1)  # one row a feature


def select_from_model(df: DataFrame, model, names: list[str], k: int) -> DataFrame:
    kept = sorted(names.index(n) for n, _ in importances(model, names)[:k])
    return VectorSlicer(inputCol="features", outputCol="chosen", indices=kept).transform(df)
