"""Model fits, diagnostics, resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardframe.functions.nulls import without_nulls
from yardframe.catalog.analyses import BOTH, _all_players
from yardframe.catalog.base import register
from yardframe.catalog.steps import ALL_PLAYER_PLAYS
from yardframe.models.design import Design, Factor, Numeric, complete_cases
from yardframe.models.linear import (
    breusch_pagan, fit_linear, fit_logistic, predict, rmse, robust_covariance, score_logistic, trend_line,
)
from yardframe.models.mixed import (
    backward_step, factor_table, fit_mixed, fixed_ratio_intercepts, gather, level_cells, pair_table,
)
from yardframe.models.resample import cv_backward_subset, stratified_split
from yardframe.operators.joins import settle
from yardframe.plans import player_plays, ratings

KEY = ["game_id", "play_id"]
AIR = (Numeric("air_yards"),)


@register("design_matrix", """
SELECT game_id, play_id, 1.0::DOUBLE AS intercept, CASE WHEN posteam_type = 'home' THEN 1.0 ELSE 0.0 END::DOUBLE AS home,
       CASE WHEN down IS NOT NULL THEN CASE WHEN down = 2 THEN 1.0 ELSE 0.0 END END::DOUBLE AS down2,
       CASE WHEN down IS NOT NULL THEN CASE WHEN down = 3 THEN 1.0 ELSE 0.0 END END::DOUBLE AS down3,
       CASE WHEN down IS NOT NULL THEN CASE WHEN down = 4 THEN 1.0 ELSE 0.0 END END::DOUBLE AS down4,
       asinh(yardline_100) AS yardline
FROM plays""", reals=["yardline"])
def _(t):
    design = Design.learn(t.plays, [Factor("posteam_type"), Factor("down"),
                                    Numeric("yardline", "asinh(yardline_100)")])
    columns = design.columns()
    renamed = {"(Intercept)": "intercept", "posteam_typehome": "home"}
    return t.plays.select(*KEY, *[c.alias(renamed.get(name, name)) for name, c in columns.items()])


_LINE_SQL = """
SELECT regr_slope(epa, air_yards) AS slope, regr_intercept(epa, air_yards) AS intercept,
       regr_count(epa, air_yards) AS n FROM plays WHERE play_type = 'pass'"""


def _passes(t) -> DataFrame:
    return t.plays.filter(F.col("play_type") == "pass")


def _epa_on_air(t):
    return fit_linear(_passes(t), F.col("epa"), AIR)


@register("ols_fit", f"""
SELECT '(Intercept)' AS term, intercept AS estimate FROM ({_LINE_SQL})
UNION ALL SELECT 'air_yards', slope FROM ({_LINE_SQL})""", reals=["estimate"])
def _(t):
    return _epa_on_air(t).summary(t.spark).select("term", "estimate")


_OLS_PARTS = """
parts AS (
  SELECT regr_slope(epa, air_yards) AS slope, regr_intercept(epa, air_yards) AS intercept,
         regr_r2(epa, air_yards) AS r2, CAST(regr_count(epa, air_yards) AS BIGINT) AS n,
         regr_sxx(epa, air_yards) AS sxx, regr_avgx(epa, air_yards) AS mx,
         (regr_syy(epa, air_yards) - pow(regr_sxy(epa, air_yards), 2) / regr_sxx(epa, air_yards))
           / (regr_count(epa, air_yards) - 2.0) AS s2
  FROM plays WHERE play_type = 'pass')
"""


@register("ols_summary", """
SELECT 'air_yards' AS term, slope AS estimate, sqrt(s2 / sxx) AS std_error, slope / sqrt(s2 / sxx) AS t_value,
       r2, n, sqrt(s2) AS sigma FROM parts
UNION ALL
SELECT '(Intercept)', intercept, sqrt(s2 * (1.0 / n + mx * mx / sxx)),
       intercept / sqrt(s2 * (1.0 / n + mx * mx / sxx)), r2, n, sqrt(s2) FROM parts""",
          steps=_OLS_PARTS, reals=["estimate", "std_error", "t_value", "r2", "sigma"])
def _(t):
    fit = _epa_on_air(t)
    return fit.summary(t.spark).drop("p_value").withColumns({
        "r2": F.lit(fit.r2), "n": F.lit(fit.rows).cast("bigint"), "sigma": F.lit(fit.sigma2 ** 0.5)})


@register("ols_predict", f"""
SELECT game_id, play_id, intercept + slope * air_yards AS pred, epa - (intercept + slope * air_yards) AS residual
FROM plays, ({_LINE_SQL}) WHERE play_type = 'pass'""", reals=["pred", "residual"])
def _(t):
    return predict(_passes(t), _epa_on_air(t), "pred").select(
        *KEY, "pred", (F.col("epa") - F.col("pred")).alias("residual"))


_LOG_ODDS = """
odds AS (
  SELECT pass_location, ln(avg(complete_pass) / (1 - avg(complete_pass))) AS log_odds
  FROM plays WHERE play_type = 'pass' AND pass_location IS NOT NULL GROUP BY pass_location)
"""
LOCATION = (Factor("pass_location"),)


@register("logistic_fit", """
SELECT CASE WHEN pass_location = 'left' THEN '(Intercept)' ELSE 'pass_location' || pass_location END AS term,
       log_odds - CASE WHEN pass_location = 'left' THEN 0 ELSE (SELECT log_odds FROM odds WHERE pass_location = 'left') END
         AS estimate
FROM odds""", steps=_LOG_ODDS, reals=["estimate"])
def _(t):
    return fit_logistic(_passes(t), F.col("complete_pass"), LOCATION).coefficients(t.spark).select("term", "estimate")


@register("logistic_link_score", """
SELECT game_id, play_id, log_odds AS link, 1 / (1 + exp(-log_odds)) AS probability
FROM plays p LEFT JOIN odds o ON p.pass_location = o.pass_location WHERE play_type = 'pass'""",
          steps=_LOG_ODDS, reals=["link", "probability"])
def _(t):
    passes = _passes(t)
    fit = fit_logistic(passes, F.col("complete_pass"), LOCATION)
    return score_logistic(passes, fit).select(*KEY, "link", "probability")


# ---------------------------------------------------------------- mixed models

RUSH_GROUPS = ["rusher_id", "team_location_gap"]


@register("mixed_crossproducts", """
SELECT 'rusher_id' AS block, rusher_id AS level_a, CAST(NULL AS VARCHAR) AS level_b, CAST(count(*) AS BIGINT) AS n,
       sum(shotgun) AS shotgun_sum, sum(epa) AS epa_sum
FROM model_rows GROUP BY rusher_id
UNION ALL
SELECT 'team_location_gap', team_location_gap, NULL, count(*), sum(shotgun), sum(epa) FROM model_rows GROUP BY team_location_gap
UNION ALL
SELECT 'pair', rusher_id, team_location_gap, count(*), NULL, NULL FROM model_rows GROUP BY rusher_id, team_location_gap""",
          tables=BOTH, reals=["shotgun_sum", "epa_sum"],
          steps=ALL_PLAYER_PLAYS.rstrip() + """,
model_rows AS (SELECT rusher_id, team_location_gap, CAST(shotgun AS DOUBLE) AS shotgun, epa FROM players
  WHERE play_type = 'run' AND epa IS NOT NULL AND shotgun IS NOT NULL
    AND rusher_id IS NOT NULL AND team_location_gap IS NOT NULL)""")
def _(t):
    runs = player_plays.run_model_rows(_all_players(t, with_strength=False))
    rows = complete_cases(runs, F.col("epa"), [Numeric("shotgun")], RUSH_GROUPS)
    cells = settle(level_cells(rows, RUSH_GROUPS, {"shotgun": F.col("shotgun"), "epa": F.col("_y")}))
    blocks = [factor_table(cells, g, 2).select(
                  F.lit(g).alias("block"), F.col("level").alias("level_a"),
                  F.lit(None).cast("string").alias("level_b"), "n",
                  F.col("s0").alias("shotgun_sum"), F.col("s1").alias("epa_sum")) for g in RUSH_GROUPS]
    pairs = pair_table(cells, *RUSH_GROUPS).select(F.lit("pair").alias("block"), "level_a", "level_b", "n")
    return reduce(DataFrame.unionByName, blocks).unionByName(pairs, allowMissingColumns=True)


def _rushing(t):
    runs = player_plays.run_model_rows(_all_players(t))
    return fit_mixed(runs, F.col("epa"), ratings.RUSHING_TERMS, RUSH_GROUPS)


@register("mixed_fit")
def _(t):
    return _rushing(t).variance_table()


@register("mixed_fixed_ratio", """
SELECT g.level, g.n, b.b + (0.25 * g.n / (1 + 0.25 * g.n)) * (g.mean - b.b) AS intercept
FROM (SELECT rusher_id AS level, count(*) AS n, avg(epa) AS mean FROM plays
      WHERE rusher_id IS NOT NULL AND epa IS NOT NULL GROUP BY rusher_id) g,
     (SELECT sum(n / (1 + 0.25 * n) * mean) / sum(n / (1 + 0.25 * n)) AS b
      FROM (SELECT rusher_id, count(*) AS n, avg(epa) AS mean FROM plays
            WHERE rusher_id IS NOT NULL AND epa IS NOT NULL GROUP BY rusher_id)) b""", reals=["intercept"])
def _(t):
    return fixed_ratio_intercepts(t.plays, "rusher_id", "epa", theta=0.5)


@register("mixed_summary")
def _(t):
    return _rushing(t).summary()


def _line_rows(t) -> DataFrame:
    runs = player_plays.run_model_rows(_all_players(t, with_strength=False))
    return without_nulls(runs, ["epa", "rush_position", "down"])


@register("mixed_backward_step")
def _(t):
    fixed, random, _ = backward_step(
        gather(_line_rows(t), F.col("epa"), ratings.LINE_TERMS, list(ratings.LINE_GROUPS)))
    return fixed.select(F.lit("fixed").alias("part"), "term", "eliminated", F.col("f_value").alias("statistic"), "p_value"
                        ).unionByName(random.select(F.lit("random").alias("part"), F.col("factor").alias("term"),
                                                    "eliminated", F.col("lrt").alias("statistic"), "p_value"))


@register("rating_component_split")
def _(t):
    sets = player_plays.pass_model_sets(_all_players(t, with_strength=False))
    with_receivers, without = ratings.passing_fits(sets["all"])
    return with_receivers.variance_table().withColumn("model", F.lit("with receivers")).unionByName(
        without.variance_table().withColumn("model", F.lit("without receivers")))


# ---------------------------------------------------------------- resampling and diagnostics

_FOLD = "CAST(('0x' || substr(md5('123|' || game_id || '|' || play_id), 1, 7))::BIGINT % 10 AS INT)"


@register("cv_backward_subset")
def _(t):
    return cv_backward_subset(_line_rows(t), F.col("epa"), ratings.LINE_TERMS, KEY).results


@register("cv_fold_rmse", """
SELECT r.fold, CAST(count(*) AS BIGINT) AS n, sqrt(avg(pow(r.epa - (c.a + c.b * r.air_yards), 2))) AS rmse
FROM folded r JOIN (SELECT f.fold, regr_slope(d.epa, d.air_yards) AS b, regr_intercept(d.epa, d.air_yards) AS a
                    FROM (SELECT DISTINCT fold FROM folded) f JOIN folded d ON d.fold <> f.fold GROUP BY f.fold) c
ON r.fold = c.fold GROUP BY r.fold""", reals=["rmse"],
          steps=f"folded AS (SELECT {_FOLD} AS fold, epa, air_yards FROM plays "
                "WHERE play_type = 'pass' AND epa IS NOT NULL AND air_yards IS NOT NULL)")
def _(t):
    search = cv_backward_subset(_passes(t), F.col("epa"), AIR, KEY, sizes=[1])
    return search.fold_results.select("fold", "n", "rmse")


@register("stratified_split", """
SELECT game_id, play_id, rn <= ceil(round(0.7 * size, 9)) AS in_train FROM (
  SELECT game_id, play_id, count(*) OVER (PARTITION BY bin) AS size,
         row_number() OVER (PARTITION BY bin ORDER BY md5('123|' || game_id || '|' || play_id)) AS rn
  FROM (SELECT p.*, CASE WHEN yards_gained <= c.q1 THEN c.q1 WHEN yards_gained <= c.q2 THEN c.q2
                         WHEN yards_gained <= c.q3 THEN c.q3 ELSE c.q4 END AS bin
        FROM plays p, (SELECT quantile_cont(yards_gained, 0.25) AS q1, quantile_cont(yards_gained, 0.5) AS q2,
                              quantile_cont(yards_gained, 0.75) AS q3, max(yards_gained) AS q4
                       FROM plays WHERE play_type = 'run') c
        WHERE play_type = 'run'))""")
def _(t):
    runs = t.plays.filter(F.col("play_type") == "run").select(*KEY, "yards_gained")
    return stratified_split(runs, "yards_gained", KEY).drop("yards_gained")


@register("metric_rmse", f"""
SELECT sqrt(avg(pow(intercept + slope * air_yards - epa, 2))) AS rmse
FROM plays, ({_LINE_SQL}) WHERE play_type = 'pass'""", reals=["rmse"])
def _(t):
    return rmse(predict(_passes(t), _epa_on_air(t), "pred"), "pred", "epa")


@register("breusch_pagan", f"""
SELECT count(e2) * regr_r2(e2, air_yards) AS statistic, 1 AS df
FROM (SELECT air_yards, pow(epa - (intercept + slope * air_yards), 2) AS e2
      FROM plays, ({_LINE_SQL}) WHERE play_type = 'pass' AND epa IS NOT NULL AND air_yards IS NOT NULL)""",
          reals=["statistic"], places=5)
def _(t):
    test = breusch_pagan(_passes(t), F.col("epa"), _epa_on_air(t))
    return t.spark.createDataFrame([(test["statistic"], test["df"])], "statistic double, df int")


@register("robust_hc3", f"""
SELECT sqrt(sum(w * pow(air_yards - mx, 2)) / pow(max(sxx), 2)) AS slope_error,
       sqrt(sum(w * pow(1.0 / n - mx * (air_yards - mx) / sxx, 2))) AS intercept_error
FROM (SELECT air_yards, mx, sxx, n,
             pow((epa - (intercept + slope * air_yards)) / (1 - (1.0 / n + pow(air_yards - mx, 2) / sxx)), 2) AS w
      FROM plays, parts WHERE play_type = 'pass' AND epa IS NOT NULL AND air_yards IS NOT NULL)""",
          steps=_OLS_PARTS, reals=["slope_error", "intercept_error"])
def _(t):
    fit = _epa_on_air(t)
    covariance = robust_covariance(_passes(t), F.col("epa"), fit)
    errors = {row["term"]: row["std_error"] for row in fit.summary(t.spark, covariance).collect()}
    return t.spark.createDataFrame([(errors["air_yards"], errors["(Intercept)"])],
                                   "slope_error double, intercept_error double")


@register("trend_line", """
SELECT slope, intercept, n, mx AS mean_x, sxx, sqrt(s2) AS sigma FROM parts""", steps=_OLS_PARTS,
          reals=["slope", "intercept", "mean_x", "sxx", "sigma"], places=4)
def _(t):
    return trend_line(_passes(t), "air_yards", "epa")
