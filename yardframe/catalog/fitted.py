"""Fits checked by closed forms and bisection in SQL, and boards chained to their fits."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardframe.catalog.analyses import BOTH, _players, _season_rosters
from yardframe.catalog.base import ERAS, SEASON, register
from yardframe.catalog.reml import reml_steps
from yardframe.catalog.steps import FIRST_ROWS, PASS_SETS, RUSH_ROWS
from yardframe.models.design import Factor, Numeric
from yardframe.models.linear import breusch_pagan, fit_linear
from yardframe.models.mixed import fit_mixed
from yardframe.plans import expected, player_plays, ratings

KEY = ["game_id", "play_id"]
AIR = (Numeric("air_yards"),)
THETAS = (0.05, 0.25, 1.0, 3.0)

# ---------------------------------------------------------------- one-factor mixed models

_PASS_ROWS = ("SELECT passer_id AS level, air_yards AS x, epa AS y FROM plays WHERE play_type = 'pass' AND passer_id IS NOT NULL "
              "AND air_yards IS NOT NULL AND epa IS NOT NULL")


def _one_factor(t, terms=AIR):
    return fit_mixed(t.plays.filter(F.col("play_type") == "pass"), F.col("epa"), terms, ["passer_id"])


@register("mixed_profile", "SELECT theta, deviance FROM m_profile", steps=reml_steps("m", _PASS_ROWS, True, list(THETAS)),
          reals=["deviance"], places=4)
def _(t):
    profile = _one_factor(t).profile
    return t.spark.createDataFrame([(theta, float(profile.deviance([theta]))) for theta in THETAS],
                                   "theta double, deviance double")


@register("mixed_fit_one_factor", """
SELECT intercept, b1 AS slope, sqrt(s2 * v_intercept) AS intercept_error, sqrt(s2 * v1) AS slope_error,
       b1 / sqrt(s2 * v1) AS slope_t, tau * s2 AS group_variance, s2 AS residual_variance, deviance, true AS converged
FROM m_fit""", steps=reml_steps("m", _PASS_ROWS, True), places=4,
          reals=["intercept", "slope", "intercept_error", "slope_error", "slope_t", "group_variance", "residual_variance", "deviance"])
def _(t):
    fit = _one_factor(t)
    table = {r["term"]: r for r in fit.summary().collect()}
    parts = {r["factor"]: r["variance"] for r in fit.variance_table().collect()}
    start, slope = table["(Intercept)"], table["air_yards"]
    return t.spark.createDataFrame(
        [(start["estimate"], slope["estimate"], start["std_error"], slope["std_error"], slope["t_value"],
          parts["passer_id"], parts["Residual"], float(fit.deviance), fit.converged)],
        "intercept double, slope double, intercept_error double, slope_error double, slope_t double, "
        "group_variance double, residual_variance double, deviance double, converged boolean")


@register("mixed_group_intercepts", "SELECT level, intercept, 'passer_id' AS factor FROM m_levels",
          steps=reml_steps("m", _PASS_ROWS, True), reals=["intercept"], places=5)
def _(t):
    return _one_factor(t).group_intercepts("passer_id")


# ---------------------------------------------------------------- least squares

@register("ols_offset", """
SELECT '(centred)' AS term, regr_intercept(epa, air_yards) AS estimate FROM plays WHERE play_type = 'pass'
UNION ALL SELECT 'far', regr_slope(epa, air_yards) FROM plays WHERE play_type = 'pass'""", reals=["estimate"])
def _(t):
    passes = t.plays.filter(F.col("play_type") == "pass")
    fit = fit_linear(passes, F.col("epa"), [Numeric("far", "cast(air_yards as double) + 1000000000")])
    slope = fit.slopes["far"]
    rows = [("(centred)", float(fit.mean_y - slope * (fit.means[0] - 1e9))), ("far", slope)]
    return t.spark.createDataFrame(rows, "term string, estimate double")


_TAILS = """
runs AS (SELECT yards_gained AS y, ydstogo AS a, score_differential AS b FROM plays
         WHERE play_type = 'run' AND yards_gained IS NOT NULL AND ydstogo IS NOT NULL AND score_differential IS NOT NULL),
c AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb,
             covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, covar_pop(y, y) AS yy FROM runs),
fit AS (SELECT *, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS ca, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS cb FROM c),
tests AS (SELECT *, n - 3 AS df, (ca * ay + cb * byy) / yy AS r2 FROM fit),
squares AS (SELECT a, b, pow(y - my - ca * (a - ma) - cb * (b - mb), 2) AS e FROM runs, tests),
d AS (SELECT count(*)::DOUBLE AS n, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, e) AS ae,
             covar_pop(b, e) AS be, covar_pop(e, e) AS ee FROM squares),
values_t AS (
  SELECT 'ydstogo' AS test, ca / sqrt(yy * (1 - r2) * n / df * bb / (n * (aa * bb - ab * ab))) AS statistic, df FROM tests
  UNION ALL
  SELECT 'score_differential', cb / sqrt(yy * (1 - r2) * n / df * aa / (n * (aa * bb - ab * ab))), df FROM tests),
tails AS (
  SELECT test, statistic, df, atan(abs(statistic) / sqrt(df)) AS t0, least(pi() / 2, atan(abs(statistic) / sqrt(df)) + 14 / sqrt(df)) AS t1,
         least(pi() / 2, 14 / sqrt(df)) AS t2 FROM values_t),
simpson AS (
  SELECT test, statistic,
         sum(w * pow(cos(t0 + (t1 - t0) * k / 4000), df - 1)) * (t1 - t0) / (sum(w * pow(cos(t2 * k / 4000), df - 1)) * t2) AS p_value
  FROM tails, (SELECT k, CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w FROM (SELECT unnest(range(4001)) AS k))
  GROUP BY test, statistic, t0, t1, t2)
"""


@register("ols_p_values", """
SELECT test, statistic, p_value FROM simpson
UNION ALL SELECT 'F', r2 / 2 / ((1 - r2) / df), pow(1 + r2 / (1 - r2), -df / 2) FROM tests
UNION ALL SELECT 'Breusch-Pagan', n * r, exp(-n * r / 2)
FROM (SELECT n, (ae * (bb * ae - ab * be) + be * (aa * be - ab * ae)) / (aa * bb - ab * ab) / ee AS r FROM d)""",
          steps=_TAILS, reals=["statistic", "p_value"], places=5)
def _(t):
    runs = t.plays.filter(F.col("play_type") == "run")
    fit = fit_linear(runs, F.col("yards_gained"), [Numeric("ydstogo"), Numeric("score_differential")])
    rows = [(r["term"], r["t_value"], r["p_value"]) for r in fit.summary(t.spark).collect() if r["term"] != "(Intercept)"]
    whole = fit.fit_statistics(t.spark).first()
    rows.append(("F", whole["f_value"], whole["p_value"]))
    test = breusch_pagan(runs, F.col("yards_gained"), fit)
    rows.append(("Breusch-Pagan", test["statistic"], test["p_value"]))
    return t.spark.createDataFrame(rows, "test string, statistic double, p_value double")


@register("ols_wide_factor", """
SELECT term, avg(m) - (SELECT avg(epa) FROM passes WHERE passer_id = (SELECT min(passer_id) FROM passes)) * max(less) AS estimate
FROM (SELECT CASE WHEN passer_id = (SELECT min(passer_id) FROM passes) THEN '(Intercept)' ELSE 'passer_id' || passer_id END AS term,
             CASE WHEN passer_id = (SELECT min(passer_id) FROM passes) THEN 0 ELSE 1 END AS less, avg(epa) AS m
      FROM passes GROUP BY passer_id) GROUP BY term""", reals=["estimate"],
          steps="passes AS (SELECT * FROM plays WHERE play_type = 'pass' AND passer_id IS NOT NULL AND epa IS NOT NULL)")
def _(t):
    passes = t.plays.filter(F.col("play_type") == "pass")
    return fit_linear(passes, F.col("epa"), [Factor("passer_id")]).summary(t.spark).select("term", "estimate")


# ---------------------------------------------------------------- boards

@cache
def _receiver_steps() -> str:
    """Ratings of passers and receivers from two one-factor fits without predictors."""
    usable = ("epa IS NOT NULL AND down IS NOT NULL AND rec_position IS NOT NULL AND air_yards IS NOT NULL "
              "AND pass_location IS NOT NULL AND passer_id IS NOT NULL AND receiver_id IS NOT NULL")
    rows = "SELECT {} AS level, 0.0 AS x, epa AS y FROM pass_rows WHERE " + usable
    return (PASS_SETS.rstrip() + "," + reml_steps("a", rows.format("passer_id"), False) + ","
            + reml_steps("b", rows.format("receiver_id"), False) + """,
passers AS (
  SELECT l.level AS passer_id, l.intercept AS epa_with_rec, r.team, r.position, r.full_name, w.attempts
  FROM a_levels l LEFT JOIN season_rosters r ON l.level = r.gsis_id
  LEFT JOIN (SELECT passer_id, count(*) AS attempts FROM pass_rows GROUP BY passer_id) w ON l.level = w.passer_id
  WHERE w.attempts > 15),
team_board AS (
  SELECT team, sum(epa_with_rec * attempts) AS total_ipa_w_rec, CAST(sum(attempts) AS BIGINT) AS total_attempts,
         sum(epa_with_rec * attempts) / nullif(sum(attempts), 0) AS team_ipa_avg FROM passers GROUP BY team)""")


def _one_factor_boards(t) -> dict[str, DataFrame]:
    players = _players(t, with_strength=False)
    used = player_plays.pass_model_sets(players)["all"].filter("passer_id IS NOT NULL AND receiver_id IS NOT NULL")
    fits = [fit_mixed(used, F.col("epa"), [], [key]) for key in ("passer_id", "receiver_id")]
    return ratings.passing_boards(*fits, player_plays.pass_model_rows(players), _season_rosters(t), str(SEASON), attempts=15)


@register("passer_board_one_factor", "SELECT * FROM passers", tables=BOTH, steps=_receiver_steps(), reals=["epa_with_rec"], places=5)
def _(t):
    return _one_factor_boards(t)["passer"]


@register("receiver_board_one_factor", """
SELECT l.level AS receiver_id, r.position, l.intercept AS epa_rec, r.team, r.full_name, w.targets, g.total_attempts, g.team_ipa_avg,
       '2001' AS year, l.intercept / nullif(g.team_ipa_avg, 0) AS relative_ipa, l.intercept * w.targets AS total_ipa
FROM b_levels l LEFT JOIN season_rosters r ON l.level = r.gsis_id
LEFT JOIN (SELECT receiver_id, count(*) AS targets FROM pass_rows GROUP BY receiver_id) w ON l.level = w.receiver_id
LEFT JOIN team_board g ON r.team IS NOT DISTINCT FROM g.team""", tables=BOTH, steps=_receiver_steps(),
          reals=["epa_rec", "team_ipa_avg", "relative_ipa", "total_ipa"], places=4)
def _(t):
    return _one_factor_boards(t)["receiver"]


def _boards(t) -> dict[str, DataFrame]:
    players = _players(t, with_strength=False)
    fit = ratings.passing_fits(player_plays.pass_model_sets(players)["all"])[0]
    return ratings.passing_boards(fit, fit, player_plays.pass_model_rows(players), _season_rosters(t), str(SEASON), attempts=15)


@register("passer_board")
def _(t):
    return _boards(t)["passer"]


@register("receiver_board")
def _(t):
    return _boards(t)["receiver"]


_SCORED = RUSH_ROWS.rstrip() + """,
quartiles AS (SELECT quantile_cont(yards_gained, 0.25) AS q1, quantile_cont(yards_gained, 0.5) AS q2,
                     quantile_cont(yards_gained, 0.75) AS q3, max(yards_gained) AS q4 FROM rush_rows),
split AS (
  SELECT *, rn <= ceil(round(0.7 * size, 9)) AS in_train FROM (
    SELECT *, count(*) OVER (PARTITION BY bin) AS size,
           row_number() OVER (PARTITION BY bin ORDER BY md5('123|' || game_id || '|' || play_id)) AS rn
    FROM (SELECT p.*, CASE WHEN yards_gained <= c.q1 THEN c.q1 WHEN yards_gained <= c.q2 THEN c.q2
                           WHEN yards_gained <= c.q3 THEN c.q3 ELSE c.q4 END AS bin FROM rush_rows p, quartiles c))),
coded AS (SELECT regr_slope(asinh(yards_gained), ydstogo) AS b, regr_intercept(asinh(yards_gained), ydstogo) AS a
          FROM split WHERE in_train),
scored AS (SELECT *, exp(a + b * ydstogo) AS exp_pred FROM split, coded)
"""


def _one_term_model(t) -> expected.ExpectedRush:
    return expected.expected_rush_model(expected.expected_rush_rows(t.plays, ERAS), terms=(Numeric("ydstogo"),))


@register("rusher_board_one_term", """
SELECT g.*, g.carries * g.expected_ypa AS expected_total_yards, g.carries * g.actual_ypa AS actual_total_yards,
       g.carries * g.actual_ypa - g.carries * g.expected_ypa AS total_diff,
       f.rookie_year, f.full_name, f.position, f.height, f.weight, CAST(g.season - f.rookie_year AS INT) AS years_in_league
FROM (SELECT rusher_id, season, posteam, count(*) AS carries, avg(exp_pred) AS expected_ypa,
             avg(yards_gained) AS actual_ypa, avg(yards_gained) - avg(exp_pred) AS avg_diff
      FROM scored WHERE rusher_id IS NOT NULL GROUP BY rusher_id, season, posteam HAVING count(*) >= 20) g
LEFT JOIN first_rows f ON g.rusher_id IS NOT DISTINCT FROM f.gsis_id""", tables=BOTH, steps=_SCORED.rstrip() + "," + FIRST_ROWS,
          reals=["expected_ypa", "actual_ypa", "avg_diff", "expected_total_yards", "actual_total_yards", "total_diff"], places=5)
def _(t):
    return expected.rusher_board(_one_term_model(t), t.rosters)


@register("feed_line_one_term", """
SELECT exp_pred AS x, yards_gained AS y, intercept + slope * exp_pred AS line,
       sqrt((syy - sxy * sxy / sxx) / (n - 2)) * sqrt(1.0 / n + pow(exp_pred - mx, 2) / sxx) AS line_error
FROM (SELECT * FROM scored WHERE NOT in_train),
     (SELECT regr_slope(yards_gained, exp_pred) AS slope, regr_intercept(yards_gained, exp_pred) AS intercept,
             regr_count(yards_gained, exp_pred) AS n, regr_avgx(yards_gained, exp_pred) AS mx, regr_sxx(yards_gained, exp_pred) AS sxx,
             regr_syy(yards_gained, exp_pred) AS syy, regr_sxy(yards_gained, exp_pred) AS sxy FROM scored WHERE NOT in_train)""",
          steps=_SCORED, reals=["x", "y", "line", "line_error"], places=4)
def _(t):
    return expected.feed_with_line(_one_term_model(t))


@register("rusher_over_expected_fitted")
def _(t):
    return expected.rusher_board(expected.expected_rush_model(expected.expected_rush_rows(t.plays, ERAS)), t.rosters)


@register("feed_predicted_actual_fitted")
def _(t):
    return expected.feed_with_line(expected.expected_rush_model(expected.expected_rush_rows(t.plays, ERAS)))


# ---------------------------------------------------------------- completion

@register("completion_by_location", """
SELECT game_id, play_id, r.log_odds AS cpoe_link, r.rate AS expected_completion, complete_pass - r.rate AS cpoe
FROM attempts a LEFT JOIN (SELECT pass_location, avg(complete_pass) AS rate, ln(avg(complete_pass) / (1 - avg(complete_pass))) AS log_odds
                           FROM attempts WHERE pass_location IS NOT NULL GROUP BY pass_location) r ON a.pass_location = r.pass_location""",
          steps="""attempts AS (SELECT * FROM plays WHERE season_type = 'REG' AND pass_attempt = 1 AND season BETWEEN 1998 AND 1999)""",
          reals=["cpoe_link", "expected_completion", "cpoe"])
def _(t):
    scored, _ = expected.completion_score(t.plays, [1998, 1999], terms=(Factor("pass_location"),))
    return scored.select(*KEY, "cpoe_link", "expected_completion", "cpoe")


@register("completion_fit_state")
def _(t):
    """Whether the completion model of the analysis has finite estimates on these rows."""
    rows = expected.completion_rows(t.plays, [1998, 1999])
    _, fit = expected.completion_score(t.plays, [1998, 1999])
    return t.spark.createDataFrame([(fit.converged, fit.separated, fit.rounds, rows.count())],
                                   "converged boolean, separated boolean, rounds int, attempts bigint")
