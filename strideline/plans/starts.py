"""Registered queries of the full form table: every measure, span and entity, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.functions.ordering import global_running
from strideline.functions.scalars import ticket_cost
from strideline.operators import evaluate, form, models, prep, segments, splits, stats
from strideline.plans.catalog import KEY, ORDER, oracle_of, register
from strideline.plans.inputs import RECORDS_SQL, RUNS_SQL, records, runs
from strideline.sources.scratch import Scratch
from strideline.sources.tables import table

_K = ", ".join(KEY)
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_STARTS = f"""SELECT r.*, round(1000 * distance / finish_time, 6) AS speed
FROM ({RUNS_SQL.replace("l_returnflag AS flag", "l_returnflag AS flag, o_custkey AS trainer, l_discount AS win_odds")}) r"""


def _with_speed(entries: DataFrame) -> DataFrame:
    return entries.withColumn("speed", F.round(1000 * F.col("distance") / F.col("finish_time"), 6))


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with trainer, speed and odds."""
    return _with_speed(runs(spark, sf_dir, trained=True))


def _starts(body: str) -> str:
    return f"WITH starts AS ({_STARTS}) {body}"


# Trailing statistics of three measures over three spans, and their ranks inside the race

_MEASURES = {"result": ["horse"], "speed": ["horse"], "finish_time": ["horse", "distance"]}
_SPANS, _STATS = (168, 112, 84), ("mean", "median", "max", "min")


def _statistic(c: str, how: str, days: int) -> str:
    f = {"mean": "avg"}.get(how, how)
    frame = f"PARTITION BY {', '.join(_MEASURES[c])} ORDER BY race_date RANGE BETWEEN INTERVAL {days - 1} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING"
    return f"round({f}({c}) OVER ({frame}), 9)"


def _rank_sql(c: str, race: str = "race_id") -> str:
    return (
        f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {race} ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY {race}, {c}) - 1) / 2.0::DOUBLE)"
        f" / count({c}) OVER (PARTITION BY {race}) END"
    )


def _trailing_of(measure: str) -> None:
    names = [f"{how}_{days}" for how in _STATS for days in _SPANS]
    made = ", ".join(f"{_statistic(measure, how, days)} AS {how}_{days}" for how in _STATS for days in _SPANS)
    ranks = ", ".join(f"round({_rank_sql(n)}, 9) AS {n}_rank" for n in names)

    @register(_starts(f"SELECT {_K}, {', '.join(names)}, {ranks} FROM (SELECT *, {made} FROM starts)"), f"trailing_table_{measure}")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Twelve trailing statistics of one measure, and the rank of each inside its race."""
        keys = _MEASURES[measure]
        s = starts(spark, sf_dir).select(*dict.fromkeys([*KEY, *keys, "race_date", measure]))
        s = segments.trailing(s, keys, "race_date", measure, list(_SPANS), Scratch(spark, "trailing"), measure, digits=9)
        # Only the key and the statistics go by race.
        s = s.select(*KEY, *names).repartition("race_id")
        return form.pct_ranks_in(s, {f"{n}_rank": n for n in names}, ["race_id"], {f"{n}_rank": 9 for n in names})


for _measure in _MEASURES:
    _trailing_of(_measure)


# Histories

_H = "PARTITION BY horse ORDER BY race_date, race_id, horse_no, jockey, finish_time"
_J = "PARTITION BY jockey ORDER BY race_date, race_id, horse_no, horse, finish_time"
_T = "PARTITION BY trainer ORDER BY race_date, race_id, horse_no, horse, jockey, finish_time"
_BY_JOCKEY = ["race_date", "race_id", "horse_no", "horse", "finish_time"]
_BY_TRAINER = ["race_date", "race_id", "horse_no", "horse", "jockey", "finish_time"]
_LAST = [(c, k) for c in ("speed", "win_odds", "weight") for k in (2, 3, 4)]


@register(
    _starts(
        f"SELECT {_K}, "
        + ", ".join(f"round(({' + '.join(f'lag({c}, {i}) OVER ({_H})' for i in range(1, k + 1))}) / {k}, 9) AS {c}_{k}" for c, k in _LAST)
        + f", round((lag(result, 1) OVER ({_J}) + lag(result, 2) OVER ({_J})) / 2.0::DOUBLE, 6) AS jockey_2, (row_number() OVER ({_T}) - 1)::BIGINT AS trainer_starts FROM starts"
    )
)
def last_means_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the last 2, 3 and 4 speeds, win odds and weights (in the place of place odds, which the tables do not have) by horse; of two results by jockey; starts by trainer."""
    # The nine means are made last, so that no exchange has them; nor the speeds, which are made after the exchange by horse.
    out = runs(spark, sf_dir, trained=True)
    out = out.withColumn("jockey_2", form.sum_last("result", form.history("jockey", _BY_JOCKEY), 2))
    out = out.withColumn("trainer_starts", form.prior_count(form.history("trainer", _BY_TRAINER)))
    h = form.history("horse", ORDER)
    out = _with_speed(out.repartition("horse"))
    out = out.withColumns({f"__{c}_{i}": form.previous(c, h, i) for c in ("speed", "win_odds", "weight") for i in range(1, 5)})
    out = out.withColumns({f"{c}_{k}": F.round(sum((F.col(f"__{c}_{i}") for i in range(2, k + 1)), F.col(f"__{c}_1")) / F.lit(k), 9) for c, k in _LAST})
    out = out.withColumns({"jockey_2": F.round(F.col("jockey_2") / F.lit(2), 6), "trainer_starts": F.col("trainer_starts").cast("bigint")})
    return out.select(*KEY, *[f"{c}_{k}" for c, k in _LAST], "jockey_2", "trainer_starts")


_ENTITIES = {"h": _H, "j": _J, "t": _T}
_PAIRS = ("hj", "ht", "jt")


@register(
    _starts(
        f"SELECT {_K}, "
        + ", ".join(f"({a}w + {b}w)::BIGINT AS {a}{b}_wins, round(({a}w + {b}w)::DOUBLE / nullif({a}n + {b}n, 0), 9) AS {a}{b}_rate" for a, b in _PAIRS)
        + " FROM (SELECT *, "
        + ", ".join(
            f"coalesce(sum((result = 1)::INT) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {e}w, row_number() OVER ({w}) - 1 AS {e}n"
            for e, w in _ENTITIES.items()
        )
        + " FROM starts)"
    )
)
def all_pair_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and rates of wins of horse and jockey, horse and trainer, jockey and trainer."""
    won = (F.col("result") == 1).cast("int")
    windows = {"h": form.history("horse", ORDER), "j": form.history("jockey", _BY_JOCKEY), "t": form.history("trainer", _BY_TRAINER)}
    s = starts(spark, sf_dir)
    for e, w in windows.items():
        s = s.withColumns({f"{e}w": form.prior_sum(won, w), f"{e}n": form.prior_count(w)})
    out = {}
    for a, b in _PAIRS:
        wins, n = F.col(f"{a}w") + F.col(f"{b}w"), F.col(f"{a}n") + F.col(f"{b}n")
        out |= {f"{a}{b}_wins": wins.cast("bigint"), f"{a}{b}_rate": F.round(F.try_divide(wins, n), 9)}
    return s.select(*KEY, *[c.alias(n) for n, c in out.items()])


_POSITIONS = ("result", "distance", "weight", "win_odds")


@register(
    _starts(
        f"SELECT {_K}, {', '.join(f'p{i}, {_rank_sql(f'p{i}')} AS p{i}_rank' for i in range(1, 5))} FROM (SELECT *, "
        + ", ".join(f"lag({c}) OVER ({_H}) AS p{i}" for i, c in enumerate(_POSITIONS, 1))
        + " FROM starts)"
    )
)
def lagged_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four columns of the previous start, and the rank of each inside the race."""
    h = form.history("horse", ORDER)
    s = starts(spark, sf_dir).withColumns({f"p{i}": form.previous(c, h) for i, c in enumerate(_POSITIONS, 1)})
    s = s.select(*KEY, *[f"p{i}" for i in range(1, 5)]).repartition("race_id")
    s = form.pct_ranks_in(s, {f"p{i}_rank": f"p{i}" for i in range(1, 5)}, ["race_id"])
    return s.select(*KEY, *[x for i in range(1, 5) for x in (f"p{i}", f"p{i}_rank")])


@register(
    f"""WITH r AS ({RECORDS_SQL}) SELECT name, rec, round(lag(result, 1) OVER (ORDER BY day, rec) - lag(result, 2) OVER (ORDER BY day, rec), 6) AS change FROM r"""
)
def ungrouped_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change between the last two values across the whole frame: the rows are numbered once, and meet rows one and two back."""
    scratch = Scratch(spark, "shift")
    r = global_running(records(spark, sf_dir), [F.col("day"), F.col("rec")], scratch, "records")
    r = scratch.save(r.drop("before"), "numbered")
    # A row gives its value to the two rows after it.
    sides = F.array(*[F.struct((F.col("position") + k).alias("to"), F.lit(s).alias("sign"), "result") for k, s in ((1, 1.0), (2, -1.0))])
    given = r.select(F.inline(sides)).groupBy("to").agg(F.sum(F.col("sign") * F.col("result")).alias("change"), F.count(F.lit(1)).alias("n"))
    out = r.join(given, F.col("position") == F.col("to"), "left")
    return out.select("name", "rec", F.round(F.when(F.col("n") == 2, F.col("change")), 6).alias("change"))


# The whole form table

_FORM = "starts starts_at_distance starts_with_jockey prev_result prev_speed mean_result_3 mean_result_6 sum_distance_4 form_diff rest_days weight_change wins win_rate mean_result mean_168 jockey_starts jockey_wins mean_168_rank weight_rank".split()
_FORM_ROUNDED = {"mean_result_3", "mean_result_6", "weight_change", "win_rate", "mean_result", "mean_168", "mean_168_rank", "weight_rank"}
_NAMES = [f"{how}_{days}" for how in _STATS for days in _SPANS]


def _narrow_columns(s: DataFrame) -> DataFrame:
    """Counts and sums by jockey and trainer, made while the rows are narrow; speeds are left for later."""
    won = (F.col("result") == 1).cast("int")
    j, t = form.history("jockey", _BY_JOCKEY), form.history("trainer", _BY_TRAINER)
    s = form.by_jockey(s.drop("speed", "flag")).withColumn("jockey_2", form.sum_last("result", j, 2))
    return s.withColumns({"tw": form.prior_sum(won, t), "tn": form.prior_count(t)})


def _horse_columns(s: DataFrame) -> DataFrame:
    """What comes from a horse's history, means of results left as sums: one exchange by horse."""
    h = form.history("horse", ["__day", *ORDER[1:]])  # the order of the other columns by horse, so they share a sort
    s = _with_speed(s.repartition("horse")).withColumnRenamed("speed", "pace").withColumn("__day", form.day_number("race_date"))
    s = s.withColumns({f"{c}_{k}": form.mean_last("pace" if c == "speed" else c, h, k) for c, k in _LAST})
    s = s.withColumns({"p2": form.previous("distance", h), "p4": form.previous("win_odds", h)})
    return form._horse_sums(s).drop("speed", "won", "trainer")


def _pair_columns(s: DataFrame) -> DataFrame:
    """Means, and the sums and rates of pairs, of the sums that came along."""
    s = s.withColumns({"p1": F.col("prev_result"), "p3": F.col("__weight"), "jockey_2": F.col("jockey_2") / F.lit(2), "trainer_starts": F.col("tn")})
    sums = {"h": ("wins", "starts"), "j": ("jockey_wins", "jockey_starts"), "t": ("tw", "tn")}
    for a, b in _PAIRS:
        wins, n = (F.col(x) + F.col(y) for x, y in zip(sums[a], sums[b], strict=True))
        s = s.withColumns({f"{a}{b}_wins": wins.cast("bigint"), f"{a}{b}_rate": F.try_divide(wins, n)})
    return form._horse_means(s)


def entity_columns(s: DataFrame) -> DataFrame:
    """Every column of the form table that comes from the history of a horse, a jockey or a trainer: one exchange each."""
    return _pair_columns(_horse_columns(_narrow_columns(s)))


def _form_table_sql() -> str:
    renamed = [f"(SELECT {_K}, {', '.join(f'{n}{end} AS {m}_{n}{end}' for n in _NAMES for end in ('', '_rank'))} FROM ({oracle_of(f'trailing_table_{m}')}))" for m in _MEASURES]
    parts = [f"({oracle_of(q)})" for q in ("form_features", "last_means_table", "all_pair_rates", "lagged_positions")] + renamed
    return "SELECT * EXCLUDE (race_date) FROM " + " JOIN ".join(f"{p} q{i}" + (f" USING ({_K})" if i else "") for i, p in enumerate(parts))


@register(_form_table_sql())
def form_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All form features in one job: histories by horse, jockey and trainer, 36 statistics of the last days, and all ranks inside the race."""
    # The rows are written once, while they are narrow; the exchanges behind them are freed.
    s = Scratch(spark, "form").save(_narrow_columns(runs(spark, sf_dir, trained=True)), "narrow", compression="zstd")
    measures = {m: (keys[1:], "pace" if m == "speed" else m) for m, keys in _MEASURES.items()}
    s = segments.trailing_here(_horse_columns(s), "horse", "race_date", measures, list(_SPANS), 9)
    s = s.drop("result", "distance", "pace", "win_odds")
    # The windows of a race and date are met by rows parted by race; one more sort serves all other ranks.
    s = form.in_race(_pair_columns(s.repartition("race_id")))
    s = form.pct_ranks_in(s, {f"{c}_rank": c for c in [f"p{i}" for i in range(1, 5)] + [f"{m}_{n}" for m in _MEASURES for n in _NAMES]}, ["race_id"], {f"{m}_{n}_rank": 9 for m in _MEASURES for n in _NAMES})
    rounded = {c: 6 for c in _FORM_ROUNDED} | {f"{c}_{k}": 9 for c, k in _LAST} | {"jockey_2": 6} | {f"{a}{b}_rate": 9 for a, b in _PAIRS}
    whole = {"starts", "starts_at_distance", "starts_with_jockey", "jockey_starts", "trainer_starts"}
    names = [*_FORM, *[f"{c}_{k}" for c, k in _LAST], "jockey_2", "trainer_starts", *[f"{a}{b}_{x}" for a, b in _PAIRS for x in ("wins", "rate")]]
    names += [f"p{i}{end}" for i in range(1, 5) for end in ("", "_rank")] + [f"{m}_{n}{end}" for m in _MEASURES for n in _NAMES for end in ("", "_rank")]
    return s.select(*KEY, *[F.round(c, rounded[c]).alias(c) if c in rounded else F.col(c).cast("bigint").alias(c) if c in whole else F.col(c) for c in names])


# Joins, rows without nulls, splits


@register(
    f"""WITH runs AS ({RUNS_SQL}), w AS (SELECT race_id AS r, count(*) AS n, sum((result <= 3)::INT) AS pos FROM runs GROUP BY 1)
    SELECT {_K}, round(CASE WHEN result <= 3 THEN n::DOUBLE / nullif(pos, 0) ELSE n::DOUBLE / nullif(n - pos, 0) END, 9) AS weight FROM runs LEFT JOIN w ON race_id = r"""
)
def label_weights_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of its label within the race, for every row."""
    r = runs(spark, sf_dir).withColumn("podium", (F.col("result") <= 3).cast("int"))
    w = stats.race_label_weights(r, "race_id", "podium").withColumnRenamed("race_id", "of_race")
    out = r.join(w, F.col("race_id") == F.col("of_race"), "left")
    return out.select(*KEY, F.round(F.when(F.col("podium") == 1, F.col("w1")).otherwise(F.col("w0")), 9).alias("weight"))


_HOLES = "SELECT *, nullif(l_linenumber, 3) AS x, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS s FROM lineitem"


@register(f"SELECT {', '.join(_LINE)}, x::BIGINT AS x, s FROM ({_HOLES}) WHERE x IS NOT NULL AND s IS NOT NULL")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumns(
        {"x": F.nullif("l_linenumber", F.lit(3)).cast("bigint"), "s": F.when(F.col("l_returnflag") != "A", F.col("l_returnflag"))}
    )
    return li.select(*_LINE, "x", "s").dropna(how="any", subset=["x", "s"])


@register(
    """WITH s AS (SELECT n, count(*) AS races FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1), g AS (SELECT unnest(range(3, 15)) AS n),
    c AS (SELECT n, n * (n - 1) * (n - 2) // 6 AS ways FROM g)
    SELECT c.n::BIGINT AS n, ways::BIGINT AS ways, (ways * ways)::BIGINT AS two_races, (ways * ways * ways)::BIGINT AS three_races, coalesce(races, 0) AS races FROM c LEFT JOIN s ON s.n = c.n"""
)
def ticket_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets that 3 to 14 picks cost over two and three races, and how many races have as many runners."""
    grid = spark.range(3, 15).select(F.col("id").alias("n"), ticket_cost(F.col("id"), 1).cast("bigint").alias("ways"))
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("races"))
    ways = F.col("ways")
    return grid.join(sizes, F.col("n") == F.col("size"), "left").select(
        "n", "ways", (ways * ways).alias("two_races"), (ways * ways * ways).alias("three_races"), F.coalesce("races", F.lit(0)).alias("races")
    )


@register(
    "SELECT o_orderkey, ('0x' || substr(md5(o_orderkey::VARCHAR || '|42'), 1, 8))::BIGINT % 100 < 80 AS is_train, ('0x' || substr(md5(o_orderkey::VARCHAR || '|0'), 1, 8))::BIGINT % 5 AS fold FROM orders"
)
def hashed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded 80/20 split, and folds, by hash of the key."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", splits.hash_split(["o_orderkey"], 80).alias("is_train"), splits.folds("o_orderkey", 5).cast("bigint").alias("fold"))


# Selection, importance, imputation by neighbours, vectors

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LABEL = "(l_returnflag = 'R')::INT"


@register(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(((sum(n * (m - g) * (m - g))) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 4) AS f FROM (SELECT count(*) AS n, avg({c}) AS m,
        var_pop({c}) * count(*) AS ss, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY l_returnflag)"""
        for c in _NUM
    )
)
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F of every feature against the classes."""
    f = stats.anova_f(table(spark, sf_dir, "lineitem"), _NUM, "l_returnflag")
    return f.select("feature", F.round("f", 4).alias("f"))


@register()
def select_false_positive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose ANOVA test has a false-positive rate under 0.05."""
    li = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
    li = li.withColumn("fold", splits.folds("l_orderkey", 5))
    rows = prep.chain(_NUM).fit(li.filter("fold != 0")).transform(li).select(*_LINE, "features", "label", "fold")
    return prep.select_best(rows, "label", alpha=0.05, by=rows.filter("fold != 0")).select(*_LINE, "chosen")


@register(
    """WITH m AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_tax) AS b, var_pop(l_tax) AS d,
    covar_pop(l_extendedprice / 1000, l_quantity) AS x, covar_pop(l_extendedprice / 1000, l_tax) AS y FROM lineitem)
    SELECT 'l_quantity' AS feature, round(abs(d * x - b * y) / (a * d - b * b), 5) AS importance FROM m
    UNION ALL SELECT 'l_tax', round(abs(a * y - b * x) / (a * d - b * b), 5) FROM m"""
)
def feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the coefficients of a least-squares fit, falling."""
    from pyspark.ml.feature import VectorAssembler

    names = ["l_quantity", "l_tax"]
    li = table(spark, sf_dir, "lineitem").withColumn("label", F.col("l_extendedprice") / 1000)
    model = models.REGRESSORS["linear"]().fit(VectorAssembler(inputCols=names, outputCol="features").transform(li))
    return spark.createDataFrame(prep.importances(model, names), "feature string, importance double").withColumn("importance", F.round("importance", 5))


@register()
def recursive_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features are dropped one by one, the least first; out-of-fold accuracy of each set."""
    from strideline.plans.learned import matrix

    return prep.recursive_elimination(matrix(spark, sf_dir), _NUM, "label", "fold", 5)


@register(
    """WITH p AS (SELECT a.vec_id AS asked, b.vec_id AS other, b.label AS l,
      round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: ((x[1] - x[2])::DOUBLE) * ((x[1] - x[2])::DOUBLE))), 9) AS gap
      FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY gap, other) AS r FROM p)
    SELECT asked AS vec_id, (sum(l) / count(*))::DOUBLE AS value FROM r WHERE r <= 12 GROUP BY 1 UNION ALL SELECT vec_id, label::DOUBLE FROM embeddings WHERE vec_id % 20 <> 0"""
)
def nearest_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values become the mean of the 12 nearest rows that have one."""
    e = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 20 != 0, F.col("label")))
    return prep.nearest_fill(e, "vec_id", "embedding", "label", 12).select("vec_id", F.col("label").alias("value"))


@register(f"SELECT {', '.join(_LINE)}, l_quantity::DOUBLE AS f0, l_extendedprice::DOUBLE AS f1, l_discount::DOUBLE AS f2, l_tax::DOUBLE AS f3 FROM lineitem")
def matrix_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors written as Parquet and read again."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    li = table(spark, sf_dir, "lineitem")
    rows = VectorAssembler(inputCols=_NUM, outputCol="features").transform(li).select(*_LINE, "features")
    back = Scratch(spark, "matrix").save(rows, "vectors").withColumn("a", vector_to_array("features"))
    return back.select(*_LINE, *[F.get("a", F.lit(i)).alias(f"f{i}") for i in range(4)])


@register(
    """SELECT round(avg(recall), 9) AS balanced_accuracy FROM (SELECT label, avg((label = told)::INT) AS recall FROM (SELECT l_returnflag AS label,
    CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_linenumber > 3 THEN 'R' ELSE 'A' END AS told FROM lineitem) GROUP BY 1)"""
)
def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_linenumber") > 3, "R").otherwise("A")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), told.alias("told"))
    return evaluate.summary(rows, "label", "told").select(F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


@register("SELECT round(quantile_cont(l_extendedprice, 0.5), 6) AS price, round(quantile_cont(l_tax, 0.5), 6) AS tax FROM lineitem")
def median_fill_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that a median imputation puts in."""
    v = prep.fit_fill(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_tax"], "median")
    return spark.createDataFrame([(v["l_extendedprice"], v["l_tax"])], "price double, tax double").select(*[F.round(c, 6).alias(c) for c in ("price", "tax")])
