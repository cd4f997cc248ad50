"""Registered queries of fits that follow from sums, each with a SQL twin that solves the same equations."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.operators import evaluate, moments, prep, splits
from strideline.plans.catalog import register
from strideline.sources.tables import table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = ", ".join(KEY)
INPUTS = ["l_quantity", "l_discount", "l_tax"]
FOLDS, DRAWS = 1000, 100


def fold_sql(k: int) -> str:
    return f"('0x' || substr(md5(l_orderkey::VARCHAR || '|0'), 1, 8))::BIGINT % {k}"


# Normal equations in SQL: sums, elimination, back substitution, one step a common table


def solve_sql(name: str, rows: str, d: int, penalty: float = 0.0) -> str:
    """Common tables; the last, ``name``, has the intercept c and weights w0, w1, ... of y on x0, x1, ... in ``rows`` (weights w)."""
    r = range(d)
    means = ", ".join(f"sum(w * x{i}) / sum(w) AS m{i}" for i in r)
    a = [f"sum(w * (x{i} - m{i}) * (x{j} - m{j})){f' + {penalty}::DOUBLE' if i == j else ''} AS a{i}_{j}" for i in r for j in range(i, d)]
    b = [f"sum(w * (x{i} - m{i}) * (y - my)) AS b{i}" for i in r]
    keep = ", ".join(f"any_value(m{i}) AS m{i}" for i in r)
    out = [
        f"{name}_m AS (SELECT {means}, sum(w * y) / sum(w) AS my FROM {rows})",
        f"{name}_e0 AS (SELECT {', '.join(a + b)}, {keep}, any_value(my) AS my FROM {rows}, {name}_m)",
    ]
    for k in range(d - 1):
        less = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(k + 1, d) for j in range(i, d)]
        less += [f"b{i} - a{k}_{i} * b{k} / a{k}_{k} AS b{i}" for i in range(k + 1, d)]
        out.append(f"{name}_e{k + 1} AS (SELECT * REPLACE ({', '.join(less)}) FROM {name}_e{k})")
    last = f"{name}_e{d - 1}"
    for i in reversed(r):
        known = "".join(f" - a{i}_{j} * w{j}" for j in range(i + 1, d))
        out.append(f"{name}_s{i} AS (SELECT *, (b{i}{known}) / a{i}_{i} AS w{i} FROM {last})")
        last = f"{name}_s{i}"
    out.append(f"{name} AS (SELECT my{''.join(f' - m{i} * w{i}' for i in r)} AS c, {', '.join(f'w{i}' for i in r)} FROM {last})")
    return ", ".join(out)


def _told_sql(d: int) -> str:
    return "c" + "".join(f" + w{i} * x{i}" for i in range(d))


_RAW = f"""r AS (SELECT {_K}, {fold_sql(5)} AS fold, {', '.join(f'{c}::DOUBLE AS x{i}' for i, c in enumerate(INPUTS))}, l_extendedprice / 1000 AS y, 1.0::DOUBLE AS w FROM lineitem),
train AS (SELECT * FROM r WHERE fold <> 0)"""
# Scaled by the training rows, then all products of two.
_SCALED = ", ".join(f"(x{i} - (SELECT avg(x{i}) FROM train)) / (SELECT stddev_pop(x{i}) FROM train) AS z{i}" for i in range(3))
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_SQUARES = f"""{_RAW.replace('train AS', 'train0 AS').replace('r AS', 'r0 AS').replace('FROM r WHERE', 'FROM r0 WHERE')},
z AS (SELECT {_K}, fold, y, w, {_SCALED.replace('FROM train)', 'FROM train0)')} FROM r0),
r AS (SELECT {_K}, fold, y, w, z0 AS x0, z1 AS x1, z2 AS x2, {', '.join(f'z{i} * z{j} AS x{k}' for k, (i, j) in enumerate(_PAIRS, 3))} FROM z), train AS (SELECT * FROM r WHERE fold <> 0)"""


def _hold_out_sql(rows: str, d: int, penalty: float) -> str:
    return f"WITH {rows}, {solve_sql('s', 'train', d, penalty)} SELECT {_K}, y AS label, round({_told_sql(d)}, 4) AS prediction FROM r, s WHERE fold = 0"


def _priced(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("fold", splits.folds("l_orderkey", k)).withColumn("label", F.col("l_extendedprice") / 1000)


def _hold_out(rows: DataFrame, x, penalty: float) -> DataFrame:
    """The rows of fold 0 told by the fit on the others."""
    s = moments.total(moments.fold_moments(rows.filter("fold != 0"), x, F.col("label"), F.lit(0)))
    fit = F.array(*[F.lit(float(c)) for c in moments.Solver(s).ridge(penalty)])
    return rows.filter("fold = 0").select(*KEY, "label", F.round(moments.told(x, fit), 4).alias("prediction"))


@register(_hold_out_sql(_RAW, 3, 0.0))
def fit_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hold_out(_priced(spark, sf_dir), F.array(*moments.products(INPUTS, 1)), 0.0)


@register(_hold_out_sql(_RAW, 3, 1.0))
def fit_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hold_out(_priced(spark, sf_dir), F.array(*moments.products(INPUTS, 1)), 1.0)


def _squared(name: str, penalty: float) -> None:
    @register(_hold_out_sql(_SQUARES, 9, penalty), name)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _priced(spark, sf_dir)
        rows = prep.standardise(rows, INPUTS, by=rows.filter("fold != 0"))
        return _hold_out(rows, F.array(*moments.products(INPUTS, 2)), penalty)


_squared("fit_polynomial_regression", 0.0)
_squared("fit_ridge_polynomial", 1.0)


# Many folds and penalties in one scan

_SEED = random.Random(42)
#: Penalties drawn log-uniformly from 0.001 to 100,000.
PENALTIES = sorted(float(f"{10 ** _SEED.uniform(-3, 5):.6g}") for _ in range(DRAWS))
PAIR = ["l_quantity", "l_tax"]
_SUMS = [("n", "1")] + [(f"{a}{b}".replace("1", ""), f"{p} * {q}") for a, p, b, q in (("u", "u", "1", "1"), ("v", "v", "1", "1"), ("y", "y", "1", "1"), ("u", "u", "u", "u"), ("u", "u", "v", "v"), ("v", "v", "v", "v"), ("u", "u", "y", "y"), ("v", "v", "y", "y"), ("y", "y", "y", "y"))]
_FOLDED = f"""r AS (SELECT {_K}, {fold_sql(FOLDS)} AS fold, l_quantity::DOUBLE AS u, l_tax::DOUBLE AS v, l_extendedprice / 1000 AS y FROM lineitem),
f AS (SELECT fold, {', '.join(f'sum({e})::DOUBLE AS {c}' for c, e in _SUMS)} FROM r GROUP BY fold),
t AS (SELECT {', '.join(f'sum({c}) AS {c}' for c, _ in _SUMS)} FROM f),
g AS (SELECT fold, {', '.join(f'f.{c} AS o{c}, t.{c} - f.{c} AS {c}' for c, _ in _SUMS)} FROM f, t),
h AS (SELECT *, uu - u * u / n AS a, uv - u * v / n AS b, vv - v * v / n AS d, uy - u * y / n AS p, vy - v * y / n AS q FROM g WHERE n > 0)"""


def _errors_sql(penalties: list[float]) -> str:
    return f"""{_FOLDED}, l(penalty) AS (VALUES {', '.join(f'({p!r}::DOUBLE)' for p in penalties)}),
    k AS (SELECT *, ((d + penalty) * p - b * q) / ((a + penalty) * (d + penalty) - b * b) AS w0, ((a + penalty) * q - b * p) / ((a + penalty) * (d + penalty) - b * b) AS w1 FROM h, l),
    c AS (SELECT *, (y - w0 * u - w1 * v) / n AS c FROM k),
    e AS (SELECT fold, penalty, ono AS n, (oyy + ono * c * c + w0 * w0 * ouu + w1 * w1 * ovv - 2 * c * oy - 2 * w0 * ouy - 2 * w1 * ovy + 2 * c * w0 * ou + 2 * c * w1 * ov + 2 * w0 * w1 * ouv) / ono AS mse, c, w0, w1 FROM (SELECT *, "on" AS ono FROM c))"""


def _pair_errors(spark: SparkSession, sf_dir: str, penalties: list[float]) -> DataFrame:
    rows = _priced(spark, sf_dir, FOLDS)
    sums = moments.saved_moments(rows, F.array(*moments.products(PAIR, 1)), F.col("label"), F.col("fold"))
    return moments.fold_errors(sums, penalties)


@register(f"WITH {_errors_sql(PENALTIES)} SELECT fold, penalty, n::BIGINT AS n, round(mse, 2) AS mse FROM e")
def fold_penalty_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of 1,000 folds under 100 drawn penalties: 100,000 fits, one scan."""
    e = _pair_errors(spark, sf_dir, PENALTIES)
    return e.select("fold", "penalty", F.col("n").cast("bigint").alias("n"), F.round("mse", 2).alias("mse"))


@register(
    f"""WITH {_errors_sql(PENALTIES)}, m AS (SELECT penalty, avg(mse) AS mean FROM e GROUP BY penalty)
    SELECT penalty, round(mean, 4) AS mean_mse, row_number() OVER (ORDER BY mean, penalty) = 1 AS best FROM m"""
)
def penalty_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random search over 100 draws, each scored by 1,000 folds."""
    return moments.search(_pair_errors(spark, sf_dir, PENALTIES)).withColumn("mean_mse", F.round("mean_mse", 4))


@register(f"WITH {_errors_sql([1.0])} SELECT {_K}, round(c + w0 * u + w1 * v, 4) AS prediction FROM r LEFT JOIN e ON e.fold = r.fold")
def out_of_fold_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row told by the fit that has not seen its fold, of 1,000."""
    rows, x = _priced(spark, sf_dir, FOLDS), F.array(*moments.products(PAIR, 1))
    out = moments.out_of_fold(rows, x, F.col("fold"), _pair_errors(spark, sf_dir, [1.0]))
    return out.select(*KEY, F.round("prediction", 4).alias("prediction"))


_LEFT_OUT = [0.0, 1.0, 100.0, 10_000.0]


@register(
    f"""WITH r AS (SELECT l_quantity::DOUBLE AS u, l_tax::DOUBLE AS v, l_extendedprice / 1000 AS y FROM lineitem),
    m AS (SELECT count(*) AS n, avg(u) AS mu, avg(v) AS mv, avg(y) AS my FROM r),
    s AS (SELECT any_value(n) AS n, any_value(mu) AS mu, any_value(mv) AS mv, any_value(my) AS my, sum((u - mu) ** 2) AS a, sum((u - mu) * (v - mv)) AS b, sum((v - mv) ** 2) AS d,
      sum((u - mu) * (y - my)) AS p, sum((v - mv) * (y - my)) AS q FROM r, m),
    l(penalty) AS (VALUES {', '.join(f'({p}::DOUBLE)' for p in _LEFT_OUT)}),
    k AS (SELECT *, (a + penalty) * (d + penalty) - b * b AS det FROM s, l),
    e AS (SELECT penalty, (y - my - ((d + penalty) * p - b * q) / det * (u - mu) - ((a + penalty) * q - b * p) / det * (v - mv))
      / (1 - 1.0::DOUBLE / n - ((d + penalty) * (u - mu) ** 2 - 2 * b * (u - mu) * (v - mv) + (a + penalty) * (v - mv) ** 2) / det) AS e FROM r, k)
    SELECT penalty, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM e GROUP BY penalty"""
)
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many folds as rows."""
    out = moments.leave_one_out(_priced(spark, sf_dir), F.array(*moments.products(PAIR, 1)), F.col("label"), _LEFT_OUT)
    return out.select("penalty", "n", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


# Ensembles of fitted members: all from one matrix of sums

#: Inputs and penalty of each member.
MEMBERS = [((0, 1, 2), 0.0), ((0, 1, 2), 1.0), ((0, 1, 2), 1e2), ((0, 1, 2), 1e4), ((0, 1, 2), 1e6), ((0,), 0.0), ((1,), 1.0), ((2,), 1.0), ((0, 1), 10.0), ((0, 2), 10.0)]
VOTERS = [((0, 1, 2), 0.0), ((0,), 1.0), ((1,), 1.0), ((2,), 1.0), ((0, 2), 100.0)]


def _member_sql(members: list, rows: str, k: int) -> str:
    """Common tables p0, p1, ...: each member's fit, its inputs renamed in order."""
    inputs, penalty = members[k]
    return f"t{k} AS (SELECT y, w, {', '.join(f'x{i} AS x{j}' for j, i in enumerate(inputs))} FROM {rows}), {solve_sql(f'p{k}', f't{k}', len(inputs), penalty)}"


def _members_sql(rows: str, members: list, value: str) -> tuple[str, list[str], str]:
    tables = ", ".join(_member_sql(members, "train", k) for k in range(len(members)))
    told = [value.format(f"p{k}.c" + "".join(f" + p{k}.w{j} * r.x{i}" for j, i in enumerate(inputs))) for k, (inputs, _) in enumerate(members)]
    return f"WITH {rows}, {tables}", told, "r, " + ", ".join(f"p{k}" for k in range(len(members)))


def member_columns(sums: np.ndarray, x: list, members: list) -> list:
    """What each member says, from sums over all inputs ``x``."""
    out = []
    for inputs, penalty in members:
        at = [0, *[i + 1 for i in inputs], len(sums) - 1]
        c = moments.Solver(sums[np.ix_(at, at)]).ridge(penalty)
        out.append(sum((F.lit(float(b)) * x[i] for b, i in zip(c[1:], inputs, strict=True)), F.lit(float(c[0]))))
    return out


_MEAN, _MEAN_TOLD, _MEAN_FROM = _members_sql(_RAW, MEMBERS, "{}")


@register(f"{_MEAN} SELECT {_K}, y AS label, round(({' + '.join(_MEAN_TOLD)}) / {len(MEMBERS)}, 4) AS prediction FROM {_MEAN_FROM} WHERE fold = 0")
def voting_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of ten fitted members on the hold-out rows."""
    rows, x = _priced(spark, sf_dir), moments.products(INPUTS, 1)
    sums = moments.total(moments.fold_moments(rows.filter("fold != 0"), F.array(*x), F.col("label"), F.lit(0)))
    names = [f"m{k}" for k in range(len(MEMBERS))]
    out = rows.filter("fold = 0").withColumns(dict(zip(names, member_columns(sums, x, MEMBERS), strict=True)))
    return evaluate.mean_vote(out, names, "prediction").select(*KEY, "label", F.round("prediction", 4).alias("prediction"))


_SIGNED = f"""r AS (SELECT {_K}, {fold_sql(5)} AS fold, {', '.join(f'{c}::DOUBLE AS x{i}' for i, c in enumerate(INPUTS))}, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM lineitem),
train AS (SELECT *, (SELECT count(*) FROM r WHERE fold <> 0)::DOUBLE / (2 * count(*) OVER (PARTITION BY y)) AS w FROM r WHERE fold <> 0)"""
_VOTE, _VOTE_TOLD, _VOTE_FROM = _members_sql(_SIGNED, VOTERS, "(({}) > 0)::INT")


@register(f"{_VOTE} SELECT {_K}, (y > 0)::INT AS label, ({' + '.join(_VOTE_TOLD)} > {len(VOTERS) // 2})::INT AS prediction FROM {_VOTE_FROM} WHERE fold = 0")
def voting_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority of five fitted ridge classifiers on the hold-out rows."""
    from strideline.operators.models import balanced

    li = table(spark, sf_dir, "lineitem").withColumn("fold", splits.folds("l_orderkey", 5)).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    x = moments.products(INPUTS, 1)
    train = balanced(li.filter("fold != 0"), "label")
    sums = moments.total(moments.fold_moments(train, F.array(*x), 2 * F.col("label") - 1, F.lit(0), F.col("weight")))
    names = [f"m{k}" for k in range(len(VOTERS))]
    out = li.filter("fold = 0").withColumns({n: (c > 0).cast("int") for n, c in zip(names, member_columns(sums, x, VOTERS), strict=True)})
    return evaluate.hard_vote(out, names, "prediction").select(*KEY, "label", F.col("prediction").cast("int").alias("prediction"))
