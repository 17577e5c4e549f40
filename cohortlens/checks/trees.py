"""Registered queries of the histogram trees, with growth unrolled level by level in SQL."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.checks.models import _LABEL, FULL, SEMESTER, data
from cohortlens.checks.registry import check, part
from cohortlens.plans import evaluation as E
from cohortlens.plans import histogram_trees as H
from cohortlens.plans import models as M
from cohortlens.sources.readers import Tables

# The grid of the covered tree and the parameters of the covered boosting.
CHOICES, DEPTHS, FOLDS = [3, 9, 15, 21], [3, 5, 7], 10
BOOST = {"rounds": 20, "depth": 6, "rate": 0.6}
# What SQL unrolls: the first rounds of that boosting, and of a shallow one.
FIRST = {"rounds": 2, "depth": 6, "rate": 0.6}
SHALLOW = {"rounds": 3, "depth": 2, "rate": 1.0}

_SHARES = ", ".join(f"{i / H.BINS!r}" for i in range(1, H.BINS))
part(
    "v_bin_rows",
    f"""SELECT row_number() OVER () AS r, CAST({_LABEL} AS INT) AS label,
  CAST(CAST('0x' || substr(md5(emplid || '|42'), 1, 8) AS BIGINT) % {FOLDS} AS INT) AS fold,
  [{", ".join(f"round(CAST({c} AS DOUBLE), {H.DIGITS}) + 0.0" for c in FULL)}] AS x
FROM v_features WHERE semester_index <= {SEMESTER} AND NOT is_dev
  AND {" AND ".join(f"{c} IS NOT NULL" for c in FULL)}""",
)
part(
    "v_bin_values",
    f"""SELECT r, f, v FROM (SELECT r, unnest(x) AS v, unnest(range(0, {len(FULL)})) AS f FROM v_bin_rows)""",
)
part(
    "v_bin_cuts",
    f"""SELECT f, list_sort(list_distinct(quantile_cont(v, [{_SHARES}]))) AS cuts FROM v_bin_values GROUP BY f""",
)
part(
    "v_bins",
    """SELECT v.r, v.f, CAST(count(c.cut) AS INT) AS bin FROM v_bin_values v
LEFT JOIN (SELECT f, unnest(cuts) AS cut FROM v_bin_cuts) c ON c.f = v.f AND c.cut < v.v GROUP BY v.r, v.f""",
)
part("v_names", f"SELECT unnest(range(0, {len(FULL)})) AS f, unnest([{', '.join(repr(c) for c in FULL)}]) AS feature")


def _best(name: str, sums: str, score: str, good: str, by: str) -> None:
    """Part ``name``: the best cut per (``by``, node) of the part ``sums``."""
    gain = " + ".join(score.format(a=f"({a})", b=f"({b})") for a, b in (("l0", "l1"), ("t0 - l0", "t1 - l1")))
    part(
        name,
        f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY {by}, node ORDER BY gain DESC, f, bin) AS place FROM (
    SELECT *, {gain} - {score.format(a="t0", b="t1")} AS gain FROM (
      SELECT {by}, node, f, bin,
        CAST(sum(s0) OVER upto AS DOUBLE) AS l0, CAST(sum(s1) OVER upto AS DOUBLE) AS l1,
        CAST(sum(s0) OVER every AS DOUBLE) AS t0, CAST(sum(s1) OVER every AS DOUBLE) AS t1
      FROM {sums}
      WINDOW every AS (PARTITION BY {by}, node, f),
        upto AS (PARTITION BY {by}, node, f ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    WHERE {good.format(a="l0", b="l1")} AND {good.format(a="(t0 - l0)", b="(t1 - l1)")})
  WHERE gain > {H.LEAST_GAIN!r}) WHERE place = 1""",
    )


# -- the grid, tree by tree and level by level

_DEEPEST = max(DEPTHS)
part(
    "v_grid_trees",
    f"SELECT k, fold, k * 100 + fold AS tree FROM (SELECT unnest([{', '.join(map(str, CHOICES))}]) AS k), "
    f"(SELECT unnest(range(-1, {FOLDS})) AS fold)",
)
part(
    "v_grid_offers",
    f"""SELECT k, node, f FROM (
  SELECT k, node, f, row_number() OVER (PARTITION BY k, node ORDER BY md5(k || '|' || node || '|' || f)) AS place
  FROM (SELECT DISTINCT k FROM v_grid_trees), (SELECT unnest(range(1, {1 << _DEEPEST})) AS node),
       (SELECT unnest(range(0, {len(FULL)})) AS f)) WHERE place <= k""",
)
part(
    "v_grid_at0",
    "SELECT t.tree, t.k, r.r, r.fold <> t.fold AS used, r.label, 1 AS node FROM v_bin_rows r, v_grid_trees t",
)
for _level in range(_DEEPEST):
    part(
        f"v_grid_sums{_level}",
        f"""SELECT n.tree, n.node, b.f, b.bin, sum(1 - n.label) AS s0, sum(n.label) AS s1
FROM v_grid_at{_level} n JOIN v_grid_offers o ON o.k = n.k AND o.node = n.node
  JOIN v_bins b ON b.r = n.r AND b.f = o.f
WHERE n.used GROUP BY n.tree, n.node, b.f, b.bin""",
    )
    _best(f"v_grid_cut{_level}", f"v_grid_sums{_level}", "({a} * {a} + {b} * {b}) / ({a} + {b})", "{a} + {b} > 0", "tree")
    part(
        f"v_grid_at{_level + 1}",
        f"""SELECT n.tree, n.k, n.r, n.used, n.label, 2 * n.node + CASE WHEN b.bin > c.bin THEN 1 ELSE 0 END AS node
FROM v_grid_at{_level} n JOIN v_grid_cut{_level} c ON c.tree = n.tree AND c.node = n.node
  JOIN v_bins b ON b.r = n.r AND b.f = c.f""",
    )
part(
    "v_grid_nodes",
    " UNION ALL ".join(
        f"SELECT {i} AS level, tree, node, sum(1 - label) AS s0, sum(label) AS s1 FROM v_grid_at{i} WHERE used "
        "GROUP BY tree, node"
        for i in range(_DEEPEST + 1)
    ),
)
part(
    "v_grid_reached",
    " UNION ALL ".join(
        f"SELECT {i} AS level, tree, r, label, node FROM v_grid_at{i} WHERE NOT used" for i in range(_DEEPEST + 1)
    ),
)
part(
    "v_grid_accuracy",
    f"""SELECT k, depth, avg(accuracy) AS accuracy FROM (
  SELECT t.k, t.fold, x.depth, avg(CASE WHEN (x.s1 > x.s0) = (x.label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM (
    SELECT a.tree, a.r, a.label, d.depth, n.s0, n.s1,
      row_number() OVER (PARTITION BY a.tree, a.r, d.depth ORDER BY a.level DESC) AS place
    FROM v_grid_reached a JOIN (SELECT unnest([{', '.join(map(str, DEPTHS))}]) AS depth) d ON a.level <= d.depth
      JOIN v_grid_nodes n ON n.tree = a.tree AND n.node = a.node) x
  JOIN v_grid_trees t USING (tree) WHERE x.place = 1 GROUP BY t.k, t.fold, x.depth)
GROUP BY k, depth""",
)
part(
    "v_grid_chosen",
    "SELECT k, depth FROM v_grid_accuracy ORDER BY round(accuracy, 12) DESC, k, depth LIMIT 1",
)


def _binned(t: Tables, columns: list[str] = FULL):
    return H.binned(data(t, columns), len(columns), fit_on=~F.col("is_dev"))


def _grid(t: Tables) -> tuple[DataFrame, list, H.Grid]:
    rows, cuts = _binned(t)
    return rows, cuts, H.grid_search(M.train_part(rows), len(FULL), CHOICES, DEPTHS, FOLDS)


@check(
    "tree_grid",
    """SELECT CAST(a.k AS INT) AS max_features, CAST(a.depth AS INT) AS max_depth, round(a.accuracy, 9) AS accuracy,
  a.k = c.k AND a.depth = c.depth AS chosen FROM v_grid_accuracy a, v_grid_chosen c""",
)
def tree_grid(t: Tables) -> DataFrame:
    """Mean accuracy over the folds of every choice, all grown together."""
    _, _, grid = _grid(t)
    rows = [(c, d, v, (c, d) == (grid.choice, grid.depth)) for (c, d), v in grid.accuracy.items()]
    found = t.spark.createDataFrame(rows, "max_features int, max_depth int, accuracy double, chosen boolean")
    return found.withColumn("accuracy", F.round("accuracy", 9))


_GRID_CUTS = " UNION ALL ".join(
    f"SELECT {i} AS level, tree, node, f, bin FROM v_grid_cut{i}" for i in range(_DEEPEST)
)


@check(
    "tree_splits",
    f"""SELECT CAST(n.node AS INT) AS node, m.feature, round(u.cuts[c.bin + 1], 6) + 0.0 AS threshold,
  CAST(n.s0 AS BIGINT) AS n_0, CAST(n.s1 AS BIGINT) AS n_1
FROM v_grid_nodes n JOIN v_grid_chosen h ON n.tree = h.k * 100 - 1 AND n.level <= h.depth
LEFT JOIN ({_GRID_CUTS}) c ON c.tree = n.tree AND c.node = n.node AND c.level < h.depth
LEFT JOIN v_names m ON m.f = c.f LEFT JOIN v_bin_cuts u ON u.f = c.f""",
)
def tree_splits(t: Tables) -> DataFrame:
    """The chosen tree: cut and label counts of every node."""
    _, cuts, grid = _grid(t)
    rows = H.cut_table(grid.best, grid.depth, cuts, FULL)
    found = t.spark.createDataFrame(rows, "node int, feature string, threshold double, n_0 bigint, n_1 bigint")
    return found.withColumn("threshold", F.round("threshold", 6) + 0.0)


@check("tree_t")
def tree_t(t: Tables) -> DataFrame:
    """The chosen tree's parameters and its metrics on both parts."""
    started = time.time()
    rows, _, grid = _grid(t)
    seconds = time.time() - started
    predictions = M.held(H.tree_predictions(rows, grid.best, grid.depth))
    return M.judge(predictions).select(
        F.lit("tree").alias("model"),
        F.lit(len(FULL)).alias("n_features"),
        F.lit(f"max_depth={grid.depth}, max_features={grid.choice}").alias("parameters"),
        "*",
        F.lit(seconds).alias("fit_seconds"),
    )


# -- boosting, round by round and level by level


def _boosted_sql(prefix: str, rounds: int, depth: int, rate: float) -> str:
    """Parts that unroll the first rounds; returns the query of their nodes."""
    unit = f"{H.UNIT!r}"
    part(f"v_{prefix}_m0", "SELECT r, label, CAST(0.0 AS DOUBLE) AS margin FROM v_bin_rows")
    score = f"({{a}} / {unit}) * ({{a}} / {unit}) / ({{b}} / {unit} + 1.0)"
    shown = []
    for i in range(rounds):
        at = f"v_{prefix}_at{i}_"
        part(
            f"{at}0",
            f"""SELECT r, 1 AS node, CAST(round((p - label) * {unit}) AS BIGINT) AS g,
  CAST(round(p * (1 - p) * {unit}) AS BIGINT) AS h
FROM (SELECT r, label, 1 / (1 + exp(-margin)) AS p FROM v_{prefix}_m{i})""",
        )
        for level in range(depth):
            part(
                f"v_{prefix}_sums{i}_{level}",
                f"""SELECT 0 AS tree, n.node, b.f, b.bin, sum(n.g) AS s0, sum(n.h) AS s1
FROM {at}{level} n JOIN v_bins b ON b.r = n.r GROUP BY n.node, b.f, b.bin""",
            )
            cut = f"v_{prefix}_cut{i}_{level}"
            _best(cut, f"v_{prefix}_sums{i}_{level}", score, f"{{b}} >= {unit}", "tree")
            part(
                f"{at}{level + 1}",
                f"""SELECT n.r, n.g, n.h, 2 * n.node + CASE WHEN b.bin > c.bin THEN 1 ELSE 0 END AS node
FROM {at}{level} n JOIN {cut} c ON c.node = n.node JOIN v_bins b ON b.r = n.r AND b.f = c.f""",
            )
        nodes = " UNION ALL ".join(
            f"""SELECT n.node, n.g, n.h, c.f, c.bin FROM (
  SELECT node, sum(g) AS g, sum(h) AS h FROM {at}{level} GROUP BY node) n
  LEFT JOIN {f"v_{prefix}_cut{i}_{level}" if level < depth else "(SELECT 0 AS node, 0 AS f, 0 AS bin WHERE FALSE)"} c
    ON c.node = n.node"""
            for level in range(depth + 1)
        )
        part(
            f"v_{prefix}_nodes{i}",
            f"""SELECT node, g / {unit} AS g, h / {unit} AS h, f, bin,
  CASE WHEN f IS NULL THEN -{rate!r} * (g / {unit}) / (h / {unit} + 1.0) END AS value FROM ({nodes})""",
        )
        ends = " UNION ALL ".join(f"SELECT r, node FROM {at}{level}" for level in range(depth + 1))
        part(
            f"v_{prefix}_m{i + 1}",
            f"""SELECT m.r, m.label, m.margin + n.value AS margin FROM v_{prefix}_m{i} m
JOIN ({ends}) e ON e.r = m.r JOIN v_{prefix}_nodes{i} n ON n.node = e.node AND n.value IS NOT NULL""",
        )
        shown.append(f"SELECT {i + 1} AS round, * FROM v_{prefix}_nodes{i}")
    return f"""SELECT CAST(x.round AS INT) AS round, CAST(x.node AS INT) AS node, m.feature,
  round(u.cuts[x.bin + 1], 6) + 0.0 AS threshold, round(x.g, 6) + 0.0 AS gradient, round(x.h, 6) + 0.0 AS hessian,
  round(x.value, 6) + 0.0 AS value
FROM ({" UNION ALL ".join(shown)}) x LEFT JOIN v_names m ON m.f = x.f LEFT JOIN v_bin_cuts u ON u.f = x.f"""


def _nodes(t: Tables, parameters: dict) -> DataFrame:
    """Cut or value, gradient and hessian of every node of the first rounds."""
    rows, cuts = _binned(t)
    model = H.boost(M.train_part(rows), len(FULL), **parameters)
    listed = []
    for i, (tree, value) in enumerate(zip(model.trees, model.values)):
        for node, feature, threshold, g, h in H.cut_table(tree, tree.depth, cuts, FULL):
            own = None if feature else float(value[node])
            listed.append((i + 1, node, feature, threshold, g / H.UNIT, h / H.UNIT, own))
    found = t.spark.createDataFrame(
        listed,
        "round int, node int, feature string, threshold double, gradient double, hessian double, value double",
    )
    return found.withColumns(
        {c: F.round(c, 6) + 0.0 for c in ("threshold", "gradient", "hessian", "value")}
    )


@check("gbt_splits", _boosted_sql("deep", **FIRST))
def gbt_splits(t: Tables) -> DataFrame:
    return _nodes(t, FIRST)


@check("gbt_splits_shallow", _boosted_sql("flat", **SHALLOW))
def gbt_splits_shallow(t: Tables) -> DataFrame:
    return _nodes(t, SHALLOW)


@check("gbt_t")
def gbt_t(t: Tables) -> DataFrame:
    """Metrics of second-order boosting on both parts."""
    started = time.time()
    rows, _ = _binned(t)
    model = H.boost(M.train_part(rows), len(FULL), **BOOST)
    seconds = time.time() - started
    return M.judge(M.held(H.boosted_predictions(rows, model))).select(
        F.lit("gbt").alias("model"),
        F.lit(len(FULL)).alias("n_features"),
        F.lit(", ".join(f"{k}={v}" for k, v in sorted(BOOST.items()))).alias("parameters"),
        "*",
        F.lit(seconds).alias("fit_seconds"),
    )


@check("gbt_rounds")
def gbt_rounds(t: Tables) -> DataFrame:
    """AUC of both parts after every round; all rounds are scored in one pass."""
    rows, _ = _binned(t)
    model = H.boost(M.train_part(rows), len(FULL), **BOOST)
    scored = M.held(H.boosted_predictions(rows, model, every_round=True))
    return E.roc_auc(scored, by=["round", "is_dev"])
