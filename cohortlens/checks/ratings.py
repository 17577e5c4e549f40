"""Registered queries of the ratings workload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.checks.registry import check, part
from cohortlens.functions import expressions as X
from cohortlens.operators.neighbours import similar_entities
from cohortlens.plans import factor_sgd as S
from cohortlens.plans import ratings as P
from cohortlens.plans import recommend as M
from cohortlens.session import cut_lineage
from cohortlens.sources import domain as D
from cohortlens.sources.readers import Tables, ratings_dataset

USER = 37
FOLDS = 3


def cleaned(t: Tables) -> DataFrame:
    return P.clean(D.ratings(t), D.catalogue(t))


def thinned(t: Tables) -> DataFrame:
    return P.thin(cleaned(t))


def held_out(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, written once because the fits read them many times."""
    return P.holdout(cut_lineage(thinned(t)))


part(
    "w_split",
    """SELECT *, substr(md5(CAST(user AS VARCHAR) || '|' || CAST(item AS VARCHAR) || '|42'), 1, 4) < '4000'
  AS is_test FROM v_thin""",
)
part("w_train", "SELECT user, item, rating FROM w_split WHERE NOT is_test")
part("w_test", "SELECT user, item, rating FROM w_split WHERE is_test")
part("w_mean", "SELECT avg(rating) AS mean, stddev_pop(rating) AS spread FROM w_train")
part("w_user0", "SELECT DISTINCT user, 0.0::DOUBLE AS b_user FROM w_train")
for n in range(1, M.BIAS_ROUNDS + 1):
    part(
        f"w_item{n}",
        f"""SELECT item, sum(rating - mean - b_user) / (10 + count(*)) AS b_item
FROM w_train JOIN w_user{n - 1} USING (user), w_mean GROUP BY item""",
    )
    part(
        f"w_user{n}",
        f"""SELECT user, sum(rating - mean - b_item) / (15 + count(*)) AS b_user
FROM w_train JOIN w_item{n} USING (item), w_mean GROUP BY user""",
    )
_LAST = M.BIAS_ROUNDS
part(
    "w_base",
    f"""SELECT s.user, s.item, s.rating, s.is_test, mean,
  mean + coalesce(b_user, 0) + coalesce(b_item, 0) AS base
FROM w_split s LEFT JOIN w_user{_LAST} u ON u.user = s.user LEFT JOIN w_item{_LAST} i ON i.item = s.item,
  w_mean""",
)
part(
    "w_est",
    "SELECT user, item, rating, greatest(least(base, 10.0), 1.0) AS est FROM w_base WHERE is_test",
)


@check("ratings_clean", "SELECT user, item, rating FROM v_clean")
def ratings_clean(t: Tables) -> DataFrame:
    return ratings_dataset(cleaned(t), "user", "item", "rating")


@check(
    "implicit_ratings", "SELECT user, item, rating FROM v_ratings WHERE rating = 0"
)
def implicit_ratings(t: Tables) -> DataFrame:
    return P.implicit(D.ratings(t))


@check(
    "min_support",
    """WITH i AS MATERIALIZED (SELECT * FROM v_clean WHERE item IN
  (SELECT item FROM v_clean GROUP BY item HAVING count(*) >= 30))
SELECT user, item, rating FROM i
WHERE user IN (SELECT user FROM i GROUP BY user HAVING count(*) >= 20)""",
)
def min_support(t: Tables) -> DataFrame:
    return P.thin(cleaned(t), items=30, users=20)


def _density_sql(stage: str, source: str) -> str:
    return f"""SELECT '{stage}' AS stage, count(DISTINCT user) AS n_users, count(DISTINCT item) AS n_items,
  count(*) AS n_ratings,
  round(coalesce(count(*) / CAST(nullif(count(DISTINCT user) * count(DISTINCT item), 0) AS DOUBLE), 0.0)
    * 100, 6) AS density_pct FROM {source}"""


@check(
    "ratings_density",
    " UNION ALL ".join(
        _density_sql(s, v) for s, v in [("clean", "v_clean"), ("items", "v_thin_items"), ("users", "v_thin")]
    ),
)
def ratings_density(t: Tables) -> DataFrame:
    start = cleaned(t)
    items = P.min_support(start, "item", P.ITEM_SUPPORT)
    users = P.min_support(items, "user", P.USER_SUPPORT)
    stages = [P.density(start, "clean"), P.density(items, "items"), P.density(users, "users")]
    return reduce(DataFrame.unionByName, stages).withColumn("density_pct", X.rounded("density_pct"))


def _similar_sql(entity: str, feature: str, score: str) -> str:
    return f"""SELECT entity, neighbour, round(sim, 6) AS sim, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY sim DESC, neighbour) AS INT) AS rank FROM (
    SELECT a.{entity} AS entity, b.{entity} AS neighbour, {score} AS sim
    FROM v_thin a JOIN v_thin b ON a.{feature} = b.{feature} AND a.{entity} <> b.{entity}
    GROUP BY 1, 2)) WHERE rank <= {M.NEIGHBOURS}"""


@check(
    "user_similarity",
    _similar_sql(
        "user",
        "item",
        "1.0::DOUBLE / (CAST(sum((a.rating - b.rating) * (a.rating - b.rating)) AS DOUBLE) / count(*) + 1.0)",
    ),
)
def user_similarity(t: Tables) -> DataFrame:
    found = similar_entities(cut_lineage(thinned(t)), "user", "item", "rating", M.NEIGHBOURS, "msd")
    return found.withColumn("sim", X.rounded("sim"))


@check(
    "item_cosine",
    _similar_sql(
        "item",
        "user",
        "CAST(sum(a.rating * b.rating) AS DOUBLE) / sqrt(CAST(sum(a.rating * a.rating) AS DOUBLE)"
        " * CAST(sum(b.rating * b.rating) AS DOUBLE))",
    ),
)
def item_cosine(t: Tables) -> DataFrame:
    found = similar_entities(cut_lineage(thinned(t)), "item", "user", "rating", M.NEIGHBOURS, "cosine")
    return found.withColumn("sim", X.rounded("sim"))


@check("baseline_bias", "SELECT user, item, rating, round(est, 6) AS est FROM w_est")
def baseline_bias(t: Tables) -> DataFrame:
    found = M.baseline_predict(*held_out(t))
    return found.select("user", "item", "rating", X.rounded("est").alias("est"))


@check(
    "baseline_rmse",
    "SELECT round(sqrt(avg((est - rating) * (est - rating))), 6) AS rmse FROM w_est",
)
def baseline_rmse(t: Tables) -> DataFrame:
    return P.rmse(M.baseline_predict(*held_out(t))).select(X.rounded("rmse").alias("rmse"))


_SUPPORT = """SELECT e.user, e.item, e.rating, e.est, coalesce(u.n, 0) AS n_user, coalesce(i.n, 0) AS n_item,
  abs(e.est - e.rating) AS err FROM w_est e
LEFT JOIN (SELECT user, count(*) AS n FROM w_train GROUP BY 1) u ON u.user = e.user
LEFT JOIN (SELECT item, count(*) AS n FROM w_train GROUP BY 1) i ON i.item = e.item"""
_SUPPORT_SHOWN = "user, item, rating, round(est, 6) AS est, n_user, n_item, round(err, 6) AS err"


def _errors(t: Tables) -> DataFrame:
    train, test = held_out(t)
    return P.prediction_support(M.baseline_predict(train, test), train).withColumns(
        {"est": X.rounded("est"), "err": X.rounded("err")}
    )


@check("prediction_support", f"SELECT {_SUPPORT_SHOWN} FROM ({_SUPPORT})")
def prediction_support(t: Tables) -> DataFrame:
    return _errors(t)


@check(
    "best_worst",
    f"""WITH s AS MATERIALIZED (SELECT {_SUPPORT_SHOWN} FROM ({_SUPPORT}))
SELECT *, 'best' AS side FROM (SELECT * FROM s ORDER BY err, user, item LIMIT 10)
UNION ALL SELECT *, 'worst' FROM (SELECT * FROM s ORDER BY err DESC, user, item LIMIT 10)""",
)
def best_worst(t: Tables) -> DataFrame:
    return P.best_worst(cut_lineage(_errors(t)))


_KNN = """WITH sim AS MATERIALIZED (
  SELECT a.{a} AS u, b.{a} AS v, 1.0::DOUBLE / (CAST(sum((a.rating - b.rating) * (a.rating - b.rating))
    AS DOUBLE) / count(*) + 1.0) AS sim
  FROM w_train a JOIN w_train b ON a.{b} = b.{b} AND a.{a} <> b.{a} GROUP BY 1, 2),
near AS (SELECT *, row_number() OVER (PARTITION BY {a}, {b} ORDER BY sim DESC, v) AS rank FROM (
  SELECT t.{a}, t.{b}, s.v, s.sim, r.rating, r.rating - r.base AS resid
  FROM w_test t JOIN w_base r ON r.{b} = t.{b} AND NOT r.is_test JOIN sim s ON s.u = t.{a} AND s.v = r.{a})),
mean AS (SELECT {a}, {b}, sum(sim * rating) / sum(sim) AS m, sum(sim * resid) / sum(sim) AS d,
  count(*) AS n FROM near WHERE rank <= 40 GROUP BY 1, 2)
SELECT b.{a}, b.{b}, b.rating, coalesce(n, 0) AS n_neighbours,
  round(greatest(least(coalesce(m, mean), 10.0), 1.0), 6) AS est_basic,
  round(greatest(least(base + coalesce(d, 0.0), 10.0), 1.0), 6) AS est_baseline
FROM w_base b LEFT JOIN mean k ON k.{a} = b.{a} AND k.{b} = b.{b} WHERE b.is_test"""


@check("knn_predict", _KNN.format(a="user", b="item"))
def knn_predict(t: Tables) -> DataFrame:
    found = M.knn_predict(*held_out(t))
    return found.drop("fold").withColumns(
        {c: X.rounded(c) for c in ("est_basic", "est_baseline")}
    )


@check("knn_item", _KNN.format(a="item", b="user"))
def knn_item(t: Tables) -> DataFrame:
    found = M.knn_predict_items(*held_out(t))
    return found.drop("fold").withColumns(
        {c: X.rounded(c) for c in ("est_basic", "est_baseline")}
    )


@check(
    "topk_personal",
    f"""WITH sim AS MATERIALIZED (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY sim DESC, rated) AS rank FROM (
    SELECT a.item, b.item AS rated, 1.0::DOUBLE / (CAST(sum((a.rating - b.rating) * (a.rating - b.rating))
      AS DOUBLE) / count(*) + 1.0) AS sim
    FROM v_thin a JOIN v_thin b ON a.user = b.user AND a.item <> b.item GROUP BY 1, 2))
  WHERE rank <= {M.NEIGHBOURS}),
scored AS (SELECT r.user, s.item, round(sum(s.sim * r.rating) / sum(s.sim), 6) AS est, count(*) AS n_neighbours
  FROM v_thin r JOIN sim s ON s.rated = r.item GROUP BY 1, 2)
SELECT user, item, est, n_neighbours, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY user ORDER BY est DESC, n_neighbours DESC, item) AS position
  FROM scored s WHERE NOT EXISTS (SELECT 1 FROM v_thin t WHERE t.user = s.user AND t.item = s.item))
WHERE position <= 10""",
)
def topk_personal(t: Tables) -> DataFrame:
    return M.personal_top(cut_lineage(thinned(t)), 10)


@check(
    "normal_predictor",
    """SELECT user, item, rating, round(greatest(least(mean + spread * sqrt(-2 * ln(a)) *
  cos(b * (2 * 3.141592653589793::DOUBLE)), 10.0), 1.0), 6) AS est
FROM (SELECT *, (CAST('0x' || substr(md5(k || '|42'), 1, 8) AS BIGINT) + 1) / 4294967296.0::DOUBLE AS a,
    (CAST('0x' || substr(md5(k || '|43'), 1, 8) AS BIGINT) + 1) / 4294967296.0::DOUBLE AS b
  FROM (SELECT *, CAST(user AS VARCHAR) || '|' || CAST(item AS VARCHAR) AS k FROM w_test)), w_mean""",
)
def normal_predictor(t: Tables) -> DataFrame:
    found = M.normal_predictor(*held_out(t))
    return found.select("user", "item", "rating", X.rounded("est").alias("est"))


@check(
    "unseen_items",
    f"""SELECT DISTINCT item FROM v_thin_items
WHERE item NOT IN (SELECT item FROM v_thin_items WHERE user = {USER})""",
)
def unseen_items(t: Tables) -> DataFrame:
    return M.unseen_items(P.min_support(cleaned(t), "item", P.ITEM_SUPPORT), USER)


@check(
    "topk_recs",
    f"""SELECT user, item, round(score, 6) AS score, CAST(row_number() OVER
    (PARTITION BY user ORDER BY score DESC, item) AS INT) AS position
FROM (SELECT DISTINCT user FROM v_clean) u,
  (SELECT item, round(b_item, 9) AS score FROM w_item{_LAST}) i
WHERE (user, item) NOT IN (SELECT (user, item) FROM w_train)
QUALIFY position <= 10""",
)
def topk_recs(t: Tables) -> DataFrame:
    train, _ = held_out(t)
    _, by_item = M.bias_baseline(train)
    scores = by_item.select("item", F.round("b_item", 9).alias("score"))
    found = M.top_unseen(train, scores, 10, cleaned(t).select("user"))
    return found.withColumn("score", X.rounded("score"))


@check("als_rmse")
def als_rmse(t: Tables) -> DataFrame:
    return P.rmse(M.als_predict(*held_out(t), rounds=20))


@check("als_grid")
def als_grid(t: Tables) -> DataFrame:
    return M.als_grid(cut_lineage(thinned(t)), [20, 30], [0.02, 0.5], [10, 20], FOLDS)


@check("co_cluster")
def co_cluster(t: Tables) -> DataFrame:
    return M.co_cluster_predict(*held_out(t)).drop("fold")


def _svd(train: DataFrame, test: DataFrame) -> DataFrame:
    return S.estimates(train, test)[S.ROUNDS]


@check("rmse_leaderboard")
def rmse_leaderboard(t: Tables) -> DataFrame:
    return M.leaderboard(cut_lineage(thinned(t)), FOLDS, {"svd": _svd})


# The grid of the covered factor model, as (rate, penalty).
SVD_CHOICES = [(0.001, 0.02), (0.001, 0.5), (0.01, 0.02), (0.01, 0.5)]
SVD_ROUNDS = [20, 30]


@check("svd_rmse")
def svd_rmse(t: Tables) -> DataFrame:
    """Error of the factor model with 100 factors and 20 rounds."""
    return P.rmse(_svd(*held_out(t)))


@check("svd_grid")
def svd_grid(t: Tables) -> DataFrame:
    """Cross-validated error of every choice; all choices and folds are fitted side by side."""
    train, test = M.folded(cut_lineage(thinned(t)), FOLDS)
    train, test = cut_lineage(train), cut_lineage(test)
    rows = None
    for n, guesses in S.estimates(train, test, SVD_CHOICES, SVD_ROUNDS).items():
        found = P.rmse(guesses, ["choice", "fold"])
        row = found.groupBy("choice").agg(F.avg("rmse").alias("rmse")).withColumn("rounds", F.lit(n))
        rows = row if rows is None else rows.unionByName(row)
    names = F.array(*[F.struct(F.lit(a).alias("rate"), F.lit(b).alias("penalty")) for a, b in SVD_CHOICES])
    chosen = F.get(names, F.col("choice"))
    return rows.select("rounds", chosen["rate"].alias("rate"), chosen["penalty"].alias("penalty"), "rmse").orderBy(
        "rmse", "rounds", "rate", "penalty"
    )


@check("topk_factors")
def topk_factors(t: Tables) -> DataFrame:
    """Every user's ten best unseen items by the factor model."""
    train = cut_lineage(thinned(t).withColumn("fold", F.lit(0)))
    best, _ = S.top_lists(S.fit(train)[S.ROUNDS], train, 10)
    return best
