"""Registered queries of preparation, models and evaluation."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.functions.scalars import finite
from strideline.operators import evaluate, logistic, models, moments, prep, splits
from strideline.operators.boosting import HistogramTrees
from strideline.operators.forest import Forest
from strideline.operators.sgd import SGD
from strideline.plans.catalog import register
from strideline.plans.fitted import fold_sql, solve_sql
from strideline.sources.scratch import Scratch
from strideline.sources.tables import table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_HOLES = "SELECT *, nullif(l_linenumber, 3) AS x, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS s FROM lineitem"


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumns({"x": F.nullif("l_linenumber", F.lit(3)), "s": F.when(F.col("l_linenumber") != 3, F.col("l_returnflag"))})


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, key, flag, features, label, weight and fold, scaled and weighted by the training rows; saved, for most fits read it many times."""
    li = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
    li = li.withColumn("fold", splits.folds("l_orderkey", 5))
    rows = prep.chain(NUM).fit(li.filter("fold != 0")).transform(li).select(*KEY, F.col("l_returnflag").alias("flag"), "features", "label", "fold")
    rows = models.balanced(rows, "label", rows.filter("fold != 0")).withColumn("row", F.monotonically_increasing_id())
    return Scratch(spark, "matrix").save(rows, "rows")


# Preparation


@register(
    f"""WITH h AS ({_HOLES}) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(x, (SELECT avg(x) FROM h)), 6) AS x_mean,
    coalesce(s, (SELECT s FROM h WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)) AS s_mode, (x IS NULL)::INT AS x_missing FROM h"""
)
def impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _holes(spark, sf_dir)
    x = prep.fill(h, prep.fit_fill(h, ["x"]), indicator=True)
    out = prep.fill(x, prep.fit_fill(h, ["s"], "mode"))
    return out.select(*KEY, F.round("x", 6).alias("x_mean"), F.col("s").alias("s_mode"), F.col("x_missing").cast("int"))


_INFINITE = "SELECT *, CASE WHEN l_linenumber = 3 THEN 'inf'::DOUBLE WHEN l_linenumber = 5 THEN '-inf'::DOUBLE ELSE l_quantity::DOUBLE END AS x FROM lineitem"


@register(
    f"""WITH h AS ({_INFINITE}) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN isinf(x) THEN (SELECT avg(x) FROM h WHERE NOT isinf(x)) ELSE x END, 6) AS x_mean,
    isinf(x)::INT AS x_missing FROM h"""
)
def impute_infinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column's infinities count as missing and become the mean of the others."""
    x = F.when(F.col("l_linenumber") == 3, float("inf")).when(F.col("l_linenumber") == 5, float("-inf")).otherwise(F.col("l_quantity").cast("double"))
    h = table(spark, sf_dir, "lineitem").withColumn("x", finite(x))
    out = prep.fill(h, prep.fit_fill(h, ["x"]), indicator=True)
    return out.select(*KEY, F.round("x", 6).alias("x_mean"), F.col("x_missing").cast("int"))


@register(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_pop(l_tax) FROM lineitem), 6) AS tax,
    round(l_quantity / (SELECT max(abs(l_quantity)) FROM lineitem), 6) AS quantity FROM lineitem"""
)
def scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = prep.max_abs(prep.standardise(table(spark, sf_dir, "lineitem"), ["l_tax"]), ["l_quantity"])
    return li.select(*KEY, F.round("l_tax", 6).alias("tax"), F.round("l_quantity", 6).alias("quantity"))


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS value, 1 AS one FROM lineitem")
def onehot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.onehot_long(table(spark, sf_dir, "lineitem"), KEY, "l_returnflag")


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dense_rank() OVER (ORDER BY l_quantity) - 1 AS code FROM lineitem")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.label_encode(table(spark, sf_dir, "lineitem"), "l_quantity", "code").select(*KEY, "code")


@register(
    f"""WITH r AS (SELECT {', '.join(KEY)}, {', '.join(f'{c}::DOUBLE AS x{i}' for i, c in enumerate(NUM[:3]))}, CASE WHEN l_linenumber <> 3 THEN l_tax::DOUBLE END AS y, 1.0::DOUBLE AS w FROM lineitem),
    train AS (SELECT * FROM r WHERE y IS NOT NULL), {solve_sql('s', 'train', 3)}
    SELECT {', '.join(KEY)}, {', '.join(f'x{i} AS {c}' for i, c in enumerate(NUM[:3]))}, round(coalesce(y, c + w0 * x0 + w1 * x1 + w2 * x2), 6) AS l_tax FROM r, s"""
)
def chained_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") != 3, F.col("l_tax")))
    return prep.iterative_fill(li.select(*KEY, *NUM), NUM, 3).withColumn("l_tax", F.round("l_tax", 6))


@register()
def polynomial_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return prep.chain(NUM, ["l_returnflag"], degree=2, components=2).fit(li).transform(li).select(*KEY, "features")


@register()
def feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    train = m.filter("fold != 0")
    best = prep.select_best(m, "label", k=2, by=train).withColumnRenamed("chosen", "anova")
    model = Forest(depth=5).fit(train)
    return prep.select_from_model(best, model, NUM, 2).select(*KEY, "anova", "chosen")


# Models: scored hold-out rows, fold 0


def _fit(name: str) -> None:
    @register(name=f"fit_{name}")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = matrix(spark, sf_dir)
        model = models.LEARNERS[name](len(NUM), 2).fit(m.filter("fold != 0"))
        return model.transform(m.filter("fold = 0")).select(*KEY, "label", "prediction")


for _name in models.LEARNERS:
    _fit(_name)


def _regress(name: str) -> None:
    @register(name=f"fit_{name}")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        li = table(spark, sf_dir, "lineitem").withColumn("fold", splits.folds("l_orderkey", 5)).withColumn("label", F.col("l_extendedprice") / 1000)
        v = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(li)
        return models.REGRESSORS[name]().fit(v.filter("fold != 0")).transform(v.filter("fold = 0")).select(*KEY, "label", "prediction")


for _name in ("lasso", "huber", "forest_regression"):
    _regress(_name)


def _descend(loss: str) -> None:
    @register(name=f"fit_{loss}_sgd")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        li = _scaled_price(spark, sf_dir)
        return SGD(loss).fit(li.filter("fold != 0")).transform(li.filter("fold = 0")).select(*KEY, "label", "prediction")


def _scaled_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("fold", splits.folds("l_orderkey", 5))
    li = prep.standardise(li, ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], by=li.filter("fold != 0"))
    return VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(li.withColumn("label", F.col("l_extendedprice")))


for _name in ("squared", "huber"):
    _descend(_name)


@register()
def sgd_loss_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objective before each epoch, by loss."""
    price, m = _scaled_price(spark, sf_dir).filter("fold != 0"), matrix(spark, sf_dir).filter("fold != 0")
    curves = {loss: SGD(loss).fit(price if loss in ("squared", "huber") else m).curve for loss in ("log", "hinge", "squared", "huber")}
    rows = [(loss, epoch, value) for loss, curve in curves.items() for epoch, value in enumerate(curve)]
    return spark.createDataFrame(rows, "loss string, epoch int, objective double")


@register()
def fit_lasso_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("fold", splits.folds("l_orderkey", 5)).withColumn("label", F.col("l_extendedprice") / 1000)
    v = prep.chain(["l_quantity", "l_discount", "l_tax"], degree=2).fit(li.filter("fold != 0")).transform(li)
    return models.REGRESSORS["lasso"]().fit(v.filter("fold != 0")).transform(v.filter("fold = 0")).select(*KEY, "label", "prediction")


_Z = [f"({c} - (SELECT avg({c}) FROM l WHERE fold <> 0)) / (SELECT stddev_samp({c}) FROM l WHERE fold <> 0) AS x{i}" for i, c in enumerate(NUM)]
_SIGNED = f"""l AS (SELECT *, {fold_sql(5)} AS fold FROM lineitem),
r AS (SELECT {', '.join(KEY)}, fold, {', '.join(_Z)}, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM l),
train AS (SELECT *, (SELECT count(*) FROM r WHERE fold <> 0)::DOUBLE / (2 * count(*) OVER (PARTITION BY y)) AS w FROM r WHERE fold <> 0)"""


@register(
    f"""WITH {_SIGNED}, {solve_sql('s', 'train', len(NUM), 1.0)} SELECT {', '.join(KEY)}, (y > 0)::INT::DOUBLE AS label,
    (c{''.join(f' + w{i} * x{i}' for i in range(len(NUM)))} > 0)::INT::DOUBLE AS prediction FROM r, s WHERE fold = 0"""
)
def fit_ridge_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    return models.ridge_classifier(m.filter("fold != 0"), m.filter("fold = 0"), "label").select(*KEY, "label", "prediction")


@register()
def fit_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("double"))
    v = e.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    v = models.balanced(v, "label").withColumn("fold", splits.folds("vec_id", 5))
    return models.LEARNERS["logistic_l2"](64, 10).fit(v.filter("fold != 0")).transform(v.filter("fold = 0")).select("vec_id", "label", "prediction")


@register()
def fit_histogram_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes, one tree a class and round, grown in the same passes."""
    m = matrix(spark, sf_dir)
    m = m.withColumn("flag", F.when(F.col("flag") == "A", 0.0).when(F.col("flag") == "N", 1.0).otherwise(2.0))
    learner = HistogramTrees(classes=3, label="flag")
    return learner.fit(m.filter("fold != 0")).transform(m.filter("fold = 0")).select(*KEY, F.col("flag").alias("label"), "prediction")


@register()
def self_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds 1 and 2 have labels, 3 and 4 are told by the model, 0 is held out."""
    m = matrix(spark, sf_dir)
    train = m.filter("fold != 0").withColumn("label", F.when(F.col("fold") < 3, F.col("label")))
    model, _ = models.self_training(train, "label", 2, 0.52)
    return model.transform(m.filter("fold = 0")).select(*KEY, "label", "prediction")


@register()
def conditional_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = prep.standardise(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]).withColumn("won", (F.col("l_linenumber") == 1).cast("double"))
    beta = models.conditional_logit(li, "l_orderkey", "won", ["l_quantity", "l_tax"])
    return spark.createDataFrame([("l_quantity", beta[0]), ("l_tax", beta[1])], "feature string, beta double")


@register(
    """WITH p AS (SELECT a.vec_id AS asked, b.vec_id AS other, b.label AS l,
      round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: ((x[1] - x[2])::DOUBLE) * ((x[1] - x[2])::DOUBLE))), 9) AS gap
      FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY gap, other) AS r FROM p),
    v AS (SELECT asked, l, count(*) AS n FROM r WHERE r <= 15 GROUP BY 1, 2),
    b AS (SELECT asked, l, row_number() OVER (PARTITION BY asked ORDER BY n DESC, l) AS k FROM v)
    SELECT b.asked, b.l AS vote, m.mean_label FROM b JOIN (SELECT asked, (sum(l * n) / sum(n))::DOUBLE AS mean_label FROM v GROUP BY 1) m ON b.asked = m.asked WHERE k = 1"""
)
def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return models.nearest(e, e.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding", "label")


# Ensembles


#: The stacked members: seven learners, and ridge classifiers of three penalties whose folds come from one scan.
STACKED = ("logistic_l2", "logistic_l1", "linear_svm", "tree", "forest", "log_sgd", "hinge_sgd")
STACKED_PENALTIES = (1.0, 100.0, 10_000.0)


@register()
def stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest over the out-of-fold scores of ten members."""
    m = matrix(spark, sf_dir)
    x, signed = vector_to_array("features"), 2 * F.col("label") - 1
    errors = moments.fold_errors(moments.saved_moments(m, x, signed, F.col("fold"), F.col("weight")), list(STACKED_PENALTIES))
    seen = Scratch(spark, "alike").save(models.alike(m, "label", "weight", "fold"), "rows")
    rows = evaluate.scored_out_of_fold(m, {name: models.LEARNERS[name](len(NUM), 2) for name in STACKED}, "fold", 5, seen)
    for k, p in enumerate(STACKED_PENALTIES):
        rows = moments.out_of_fold(rows, x, F.col("fold"), errors.filter(F.col("penalty") == p), f"ridge_{k}")
    names = [*STACKED, *[f"ridge_{k}" for k in range(len(STACKED_PENALTIES))]]
    v = Scratch(spark, "stacking").save(VectorAssembler(inputCols=names, outputCol="features").transform(rows.drop("features")), "scores")
    meta = Forest(depth=5).fit(v.filter("fold != 0"))
    return meta.transform(v.filter("fold = 0")).select(*KEY, "label", "prediction")


@register()
def bagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    return models.bagging(m.filter("fold != 0"), m.filter("fold = 0"), KEY, "label", 10).select(*KEY, "label", "prediction")


@register()
def adaboost(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    return models.adaboost(m.filter("fold != 0"), m.filter("fold = 0"), "label").select(*KEY, "label", "prediction")


@register()
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    seen = Scratch(spark, "alike").save(models.alike(m, "label", "weight", "fold"), "rows")
    oof = evaluate.scored_out_of_fold(m, {"score": models.LEARNERS["linear_svm"](len(NUM), 2)}, "fold", 5, seen)
    return models.calibrate(oof, "label", "score").select(*KEY, "label", "score", "calibrated")


# Selection and evaluation, on a prediction that SQL can repeat

_TOLD = """SELECT l_returnflag AS label, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_linenumber > 3 THEN 'R' ELSE 'A' END AS told FROM lineitem"""


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_linenumber") > 3, "R").otherwise("A")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), told.alias("told"))


@register(f"SELECT label, told AS prediction, count(*) AS n FROM ({_TOLD}) GROUP BY 1, 2")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_told(spark, sf_dir), "label", "told")


_REPORT = f"""SELECT c AS cls, p AS precision, r AS recall, support, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM (
    SELECT c, coalesce(tp::DOUBLE / nullif(t, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS r, support FROM (
    SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (told = c) AS t, count(*) FILTER (label = c AND told = c) AS tp
    FROM ({_TOLD}), (SELECT DISTINCT l_returnflag AS c FROM lineitem) GROUP BY c))"""


@register(f"SELECT cls, round(precision, 9) AS precision, round(recall, 9) AS recall, support, round(f1, 9) AS f1 FROM ({_REPORT})")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.class_report(_told(spark, sf_dir), "label", "told")
    return r.select("cls", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "support", F.round("f1", 9).alias("f1"))


@register(
    "SELECT "
    + ", ".join(f"round(avg({m}), 9) AS macro_{m}" for m in ("precision", "recall", "f1"))
    + ", "
    + ", ".join(f"round(sum({m} * support) / sum(support), 9) AS weighted_{m}" for m in ("precision", "recall", "f1"))
    + f", round(sum(recall * support) / sum(support), 9) AS accuracy, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy FROM ({_REPORT})"
)
def named_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.summary(_told(spark, sf_dir), "label", "told")
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


@register(
    "SELECT round(sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))), 9) AS rmse, round(avg(abs(l_tax - l_discount)), 9) AS mae, round(sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))), 9) AS rmse_of_score FROM lineitem"
)
def rmse_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluate.regression_errors(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax")
    return e.select(*[F.round(c, 9).alias(c) for c in e.columns])


_MEMBERS = ("l_linenumber % 2", "l_linenumber % 3", "l_partkey % 2")


@register(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT m FROM (VALUES ({_MEMBERS[0]}), ({_MEMBERS[1]}), ({_MEMBERS[2]})) t(m) GROUP BY m ORDER BY count(*) DESC, m LIMIT 1)::BIGINT AS vote,
    round(({_MEMBERS[0]} + {_MEMBERS[1]} + {_MEMBERS[2]}) / 3.0::DOUBLE, 9) AS mean FROM lineitem"""
)
def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumns({f"m{i}": F.expr(m).cast("bigint") for i, m in enumerate(_MEMBERS)})
    names = [f"m{i}" for i in range(3)]
    out = evaluate.mean_vote(evaluate.hard_vote(li, names, "vote"), names, "mean")
    return out.select(*KEY, F.col("vote").cast("bigint"), F.round("mean", 9).alias("mean"))


@register()
def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    oof = evaluate.out_of_fold(matrix(spark, sf_dir), models.LEARNERS["logistic_l2"](len(NUM), 2), "fold", 5)
    return evaluate.fold_scores(oof, "fold", "label")


@register()
def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 drawn penalties and shares of the absolute part, five folds each: 500 fits in the same passes."""
    r = random.Random(42)
    candidates = [(float(f"{10 ** r.uniform(-4, 0):.6g}"), round(r.random(), 3)) for _ in range(100)]
    return logistic.search(matrix(spark, sf_dir), candidates, 5)


@register()
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = [{"regParam": r} for r in (0.01, 0.1)]
    return evaluate.search(matrix(spark, sf_dir), lambda **p: LogisticRegression(maxIter=10, **p), grid, "fold", 5, "label")


@register()
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    rows = []
    for name in ("logistic_l2", "tree", "forest"):
        told = models.LEARNERS[name](len(NUM), 2).fit(m.filter("fold != 0")).transform(m.filter("fold = 0"))
        rows.append(evaluate.summary(told, "label", "prediction").withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, rows)
