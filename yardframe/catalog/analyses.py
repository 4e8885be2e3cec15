"""The analyses that users call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardframe.catalog.base import ERAS, MAX_RANK, SEASON, SPAN, TEAM, register
from yardframe.catalog.steps import (
    BACK_RUNS, DEFENSE_SPLIT, FIRST_ROWS, PASS_SETS, PLAYER_PLAYS, RUSH_ROWS, WAR,
)
from yardframe.operators.joins import settle
from yardframe.plans import expected, player_plays, ratings, splits, strength, war
from yardframe.functions.nulls import row_count

KEY = ["game_id", "play_id"]
BOTH = ["plays", "rosters"]


def _season(t) -> DataFrame:
    return t.plays.filter(F.col("season") == SEASON)


def _season_rosters(t) -> DataFrame:
    return t.rosters.filter(F.col("season") == SEASON)


def _players(t, with_strength: bool = True) -> DataFrame:
    plays = _season(t)
    return player_plays.player_plays(
        plays, _season_rosters(t), strength.team_strength(plays) if with_strength else None)


def _all_players(t, with_strength: bool = True) -> DataFrame:
    """Player plays of all seasons; a player's first roster row stands for the player."""
    return player_plays.player_plays(t.plays, settle(expected.first_roster_rows(t.rosters)),
                                     strength.team_strength(t.plays) if with_strength else None)


# ---------------------------------------------------------------- splits

@register("third_and_long", """
SELECT CAST(substr(game_id, 1, 4) AS INT) AS year, passer, season_type, count(*) AS attempts,
       CAST(sum(CASE WHEN incomplete_pass = 0 THEN 1 ELSE 0 END) AS BIGINT) AS completions,
       CAST(sum(third_down_converted) AS BIGINT) AS conversions,
       avg(ydstogo) AS avg_distance, avg(air_yards) AS avg_airyards,
       sum(CASE WHEN incomplete_pass = 0 THEN 1 ELSE 0 END) / count(*) AS completion_pct,
       sum(third_down_converted) / count(*) AS conversion_pct
FROM plays WHERE posteam = 'NATION_0' AND down = 3 AND ydstogo >= 7 GROUP BY 1, 2, 3""",
          reals=["avg_distance", "avg_airyards", "completion_pct", "conversion_pct"])
def _(t):
    return splits.third_and_long(t.plays, TEAM)


@register("low_win_prob_first", """
SELECT game_id, play_id, season, posteam, wp, team_wp, game_seconds_remaining FROM (
  SELECT *, CASE WHEN posteam = 'NATION_0' THEN wp WHEN posteam <> 'NATION_0' THEN 1 - wp END AS team_wp,
         row_number() OVER (PARTITION BY game_id ORDER BY game_seconds_remaining DESC, play_id) AS rn
  FROM plays WHERE (home_team = 'NATION_0' OR away_team = 'NATION_0') AND season >= 1996 AND wp <= 0.25
    AND game_seconds_remaining < 3600 AND game_half = 'Half1') WHERE rn = 1""", reals=["wp", "team_wp"])
def _(t):
    return splits.low_win_prob_first(t.plays, TEAM, first_season=1996, limit=0.25).select(
        *KEY, "season", "posteam", "wp", "team_wp", "game_seconds_remaining")


@register("passer_epa_season", """
SELECT passer, season, count(*) AS attempts, CASE WHEN count(*) = count(epa) THEN avg(epa) END AS avg_epa
FROM plays WHERE posteam = 'NATION_0' AND passer IS NOT NULL GROUP BY passer, season
HAVING count(*) >= 50""", reals=["avg_epa"])
def _(t):
    return splits.passer_epa_season(t.plays, TEAM)


@register("passer_epa_all", """
SELECT passer, posteam, season, count(*) AS attempts, avg(epa) AS avg_epa
FROM plays WHERE passer IS NOT NULL GROUP BY passer, posteam, season HAVING count(*) >= 60""", reals=["avg_epa"])
def _(t):
    return splits.passer_epa_all(t.plays, min_attempts=60)


@register("passer_epa_slice", """
SELECT passer, posteam, season, count(*) AS attempts, avg(epa) AS avg_epa
FROM plays WHERE passer IS NOT NULL AND season = 1999 GROUP BY passer, posteam, season
HAVING count(*) >= 60""", reals=["avg_epa"])
def _(t):
    return splits.passer_epa_slice(t.plays, 1999, min_attempts=60)


@register("plays_by_epa", """
SELECT game_id, play_id, passer, rusher, epa FROM plays WHERE posteam = 'NATION_0'
ORDER BY epa DESC NULLS LAST, game_id, play_id""", reals=["epa"])
def _(t):
    return splits.plays_by_epa(t.plays.select(*KEY, "posteam", "passer", "rusher", "epa"), TEAM).drop("posteam")


_TEAM_TOTALS = """
team_totals AS (
  SELECT season, count(*) AS team_dropbacks, CAST(sum(pass_attempt) AS BIGINT) AS team_attempts,
         CAST(sum(complete_pass) AS BIGINT) AS team_completions,
         sum(CASE WHEN complete_pass = 1 THEN yards_gained END) AS team_passyards,
         sum(air_yards) AS team_air_yards, sum(yards_after_catch) AS team_yac,
         sum(CASE WHEN complete_pass = 1 THEN yards_gained END) / nullif(sum(pass_attempt), 0) AS team_ypa,
         sum(CASE WHEN complete_pass = 1 THEN yards_gained END) / count(*) AS team_ypd,
         sum(complete_pass) / nullif(sum(pass_attempt), 0) AS team_comp_pct
  FROM plays WHERE posteam = 'NATION_0' AND season BETWEEN 1995 AND 1999 AND play_type = 'pass' GROUP BY season)
"""
_TEAM_REALS = ["team_passyards", "team_air_yards", "team_yac", "team_ypa", "team_ypd", "team_comp_pct"]


@register("team_pass_totals", "SELECT * FROM team_totals", steps=_TEAM_TOTALS, reals=_TEAM_REALS)
def _(t):
    return splits.team_pass_totals(t.plays, TEAM, SPAN)


@register("receiver_relative", """
SELECT r.*, team_dropbacks, team_attempts, team_completions, team_passyards, team_air_yards, team_yac,
       team_ypa, team_ypd, team_comp_pct,
       receiver_comp_pct / nullif(team_comp_pct, 0) AS relative_comp,
       receiver_ypt / nullif(team_ypa, 0) AS relative_ypa
FROM (SELECT season, receiver_id, receiver_player_name, count(*) AS targets,
             CAST(sum(complete_pass) AS BIGINT) AS receptions,
             sum(CASE WHEN complete_pass = 1 THEN yards_gained END) AS rec_yards,
             sum(air_yards) AS rec_airyards, sum(yards_after_catch) AS rec_yac,
             sum(CASE WHEN complete_pass = 1 THEN yards_gained END) / count(*) AS receiver_ypt,
             sum(CASE WHEN complete_pass = 1 THEN yards_gained END) / nullif(sum(complete_pass), 0) AS receiver_ypc,
             sum(complete_pass) / count(*) AS receiver_comp_pct
      FROM plays WHERE posteam = 'NATION_0' AND season BETWEEN 1995 AND 1999 AND play_type = 'pass'
      GROUP BY season, receiver_id, receiver_player_name) r
LEFT JOIN team_totals t ON r.season = t.season""", steps=_TEAM_TOTALS,
          reals=[*_TEAM_REALS, "rec_yards", "rec_airyards", "rec_yac", "receiver_ypt", "receiver_ypc",
                 "receiver_comp_pct", "relative_comp", "relative_ypa"])
def _(t):
    return splits.receiver_relative(t.plays, TEAM, SPAN)


_TEAM_PASS = """
team_pass AS (
  SELECT s.*, avg_airyards / nullif(avg_total_pass, 0) AS airyard_pct, avg_yac / nullif(avg_total_pass, 0) AS yac_pct,
         t.team_color
  FROM (SELECT posteam, count(*) AS dropbacks, avg(epa) AS avg_pass_epa, avg(air_yards) AS avg_airyards,
               avg(yards_after_catch) AS avg_yac, avg(yards_gained) AS avg_yards_gained_pass,
               avg(CASE WHEN air_yards IS NOT NULL THEN yards_gained END) AS avg_ypa,
               avg(air_yards) + avg(yards_after_catch) AS avg_total_pass
        FROM plays WHERE season = 2001 AND play_type = 'pass' GROUP BY posteam) s
  LEFT JOIN teams t ON s.posteam IS NOT DISTINCT FROM t.team_abbr),
team_run AS (
  SELECT posteam, count(*) AS carries, avg(epa) AS avg_run_epa, avg(yards_gained) AS avg_yards_run
  FROM plays WHERE season = 2001 AND play_type = 'run' GROUP BY posteam),
team_both AS (
  SELECT p.*, r.carries, r.avg_run_epa, r.avg_yards_run
  FROM team_pass p LEFT JOIN team_run r ON p.posteam IS NOT DISTINCT FROM r.posteam)
"""
_TEAM_PASS_REALS = ["avg_pass_epa", "avg_airyards", "avg_yac", "avg_yards_gained_pass", "avg_ypa",
                    "avg_total_pass", "airyard_pct", "yac_pct"]
_RUN_REALS = ["avg_run_epa", "avg_yards_run"]


@register("team_air_yac", "SELECT * FROM team_pass", tables=["plays", "teams"], steps=_TEAM_PASS,
          reals=_TEAM_PASS_REALS)
def _(t):
    return splits.team_air_yac(t.plays, t.teams, SEASON)


@register("team_rush_eff", "SELECT * FROM team_run", tables=["plays", "teams"], steps=_TEAM_PASS, reals=_RUN_REALS)
def _(t):
    return splits.team_rush_eff(t.plays, SEASON)


@register("team_pass_run", "SELECT * FROM team_both", tables=["plays", "teams"], steps=_TEAM_PASS,
          reals=[*_TEAM_PASS_REALS, *_RUN_REALS])
def _(t):
    return splits.team_pass_run(t.plays, t.teams, SEASON)


def _feed_sql(x: str, size: str, per_point: int) -> str:
    return f"""
SELECT posteam, team_color, {x} AS x, avg_pass_epa AS y, {size} / {per_point}.0 AS point_size,
       m.mean_x, m.mean_y, m.slope, m.intercept
FROM team_both, (SELECT avg({x}) AS mean_x, avg(avg_pass_epa) AS mean_y,
                        regr_slope(avg_pass_epa, {x}) AS slope, regr_intercept(avg_pass_epa, {x}) AS intercept
                 FROM team_both) m"""


_FEED_REALS = ["x", "y", "point_size", "mean_x", "mean_y", "slope", "intercept"]


@register("feed_run_pass", _feed_sql("avg_run_epa", "carries", 75), tables=["plays", "teams"],
          steps=_TEAM_PASS, reals=_FEED_REALS)
def _(t):
    return splits.feed_run_pass(t.plays, t.teams, SEASON)


@register("feed_yards_epa", _feed_sql("avg_yards_gained_pass", "dropbacks", 60), tables=["plays", "teams"],
          steps=_TEAM_PASS, reals=_FEED_REALS)
def _(t):
    return splits.feed_yards_epa(t.plays, t.teams, SEASON)


# ---------------------------------------------------------------- strength and model rows

@register("team_strength_pivot", "SELECT posteam, pass_strength, rush_strength FROM strength", tables=BOTH,
          steps=PLAYER_PLAYS, reals=["pass_strength", "rush_strength"])
def _(t):
    return strength.team_strength(_season(t))


@register("offense_strength", "SELECT game_id, play_id, posteam, run_strength, pass_strength FROM pass_rows",
          tables=BOTH, steps=PASS_SETS, reals=["run_strength", "pass_strength"])
def _(t):
    players = _players(t, with_strength=False)
    return strength.offense_strength(
        player_plays.pass_model_rows(players), player_plays.run_model_rows(players)
    ).select(*KEY, "posteam", "run_strength", "pass_strength")


@register("defense_strength", """
SELECT a.defteam, a.season, a.dropbacks, a.def_strength, d.def_strength_pass, d.def_strength_run
FROM (SELECT defteam, season, count(*) AS dropbacks, -avg(epa) AS def_strength
      FROM plays WHERE pass_attempt = 1 GROUP BY defteam, season) a
LEFT JOIN defense d ON coalesce(a.defteam, 'NA') || '_' || a.season = d.def_season""",
          steps=DEFENSE_SPLIT, reals=["def_strength", "def_strength_pass", "def_strength_run"])
def _(t):
    from yardframe.functions.text import unite
    from yardframe.operators.joins import lookup_join

    attempts = strength.defense_strength(t.plays.filter(F.col("pass_attempt") == 1))
    keyed = unite(attempts, "def_season", ["defteam", "season"])
    return lookup_join(keyed, settle(strength.defense_strength_split(t.plays)), "def_season").drop("def_season")


@register("player_plays", """
SELECT game_id, play_id, play_type, passer_id, receiver_id, rusher_id, passer_position, rec_position,
       rush_position, location_gap, team_location_gap, pass_strength, rush_strength FROM players""",
          tables=BOTH, steps=PLAYER_PLAYS, reals=["pass_strength", "rush_strength"])
def _(t):
    return _players(t).select(
        *KEY, "play_type", "passer_id", "receiver_id", "rusher_id", "passer_position", "rec_position",
        "rush_position", "location_gap", "team_location_gap", "pass_strength", "rush_strength")


_USABLE = ("epa IS NOT NULL AND down IS NOT NULL AND rec_position IS NOT NULL AND air_yards IS NOT NULL "
           "AND pass_location IS NOT NULL")


@register("model_sets", f"""
SELECT model_set, passer_id, receiver_id, count(*) AS plays, avg(epa) AS avg_epa, sum(yac) AS yac,
       avg(run_strength) AS run_strength, avg(pass_strength) AS pass_strength, CAST(sum(qb_hit) AS BIGINT) AS hits
FROM (SELECT 'all' AS model_set, coalesce(yards_after_catch, 0) AS yac, * FROM pass_rows WHERE {_USABLE}
      UNION ALL SELECT 'complete', coalesce(yards_after_catch, 0), * FROM pass_rows WHERE {_USABLE} AND complete_pass = 1
      UNION ALL SELECT 'incomplete', coalesce(yards_after_catch, 0), * FROM pass_rows WHERE {_USABLE} AND complete_pass = 0)
GROUP BY model_set, passer_id, receiver_id
UNION ALL
SELECT 'run', rusher_id, rush_position, count(*), avg(epa), NULL, NULL, NULL, NULL FROM players
WHERE play_type = 'run' AND epa IS NOT NULL AND rush_position IS NOT NULL AND down IS NOT NULL
GROUP BY rusher_id, rush_position""", tables=BOTH, steps=PASS_SETS,
          reals=["avg_epa", "yac", "run_strength", "pass_strength"])
def _(t):
    players = _players(t, with_strength=False)
    sets = player_plays.pass_model_sets(players)
    labelled = reduce(DataFrame.unionByName,
                      [rows.withColumn("model_set", F.lit(name)) for name, rows in sets.items()])
    passes = labelled.groupBy("model_set", "passer_id", "receiver_id").agg(
        row_count().alias("plays"), F.avg("epa").alias("avg_epa"), F.sum("yards_after_catch").alias("yac"),
        F.avg("run_strength").alias("run_strength"), F.avg("pass_strength").alias("pass_strength"),
        F.sum("qb_hit").alias("hits"))
    runs = (player_plays.line_model_rows(players)
            .groupBy(F.lit("run").alias("model_set"), F.col("rusher_id").alias("passer_id"),
                     F.col("rush_position").alias("receiver_id"))
            .agg(row_count().alias("plays"), F.avg("epa").alias("avg_epa")))
    return passes.unionByName(runs, allowMissingColumns=True)


@register("xry_dataset", "SELECT * FROM rush_rows", steps=RUSH_ROWS,
          reals=["yards_gained", "def_strength_pass", "def_strength_run"])
def _(t):
    return expected.expected_rush_rows(t.plays, ERAS)


@register("rusher_over_expected", """
SELECT g.*, g.carries * g.expected_ypa AS expected_total_yards, g.carries * g.actual_ypa AS actual_total_yards,
       g.carries * g.actual_ypa - g.carries * g.expected_ypa AS total_diff,
       f.rookie_year, f.full_name, f.position, f.height, f.weight, CAST(g.season - f.rookie_year AS INT) AS years_in_league
FROM (SELECT rusher_id, season, posteam, count(*) AS carries, avg(1 + 0.3 * ydstogo) AS expected_ypa,
             avg(yards_gained) AS actual_ypa, avg(yards_gained) - avg(1 + 0.3 * ydstogo) AS avg_diff
      FROM rush_rows WHERE rusher_id IS NOT NULL GROUP BY rusher_id, season, posteam HAVING count(*) >= 20) g
LEFT JOIN first_rows f ON g.rusher_id IS NOT DISTINCT FROM f.gsis_id""", tables=BOTH,
          steps=RUSH_ROWS.rstrip() + "," + FIRST_ROWS,
          reals=["expected_ypa", "actual_ypa", "avg_diff", "expected_total_yards", "actual_total_yards", "total_diff"])
def _(t):
    scored = expected.expected_rush_rows(t.plays, ERAS).withColumn("exp_pred", 1 + 0.3 * F.col("ydstogo"))
    return expected.rusher_over_expected(scored, t.rosters)


@register("feed_predicted_actual", "SELECT 1 + 0.3 * ydstogo AS x, yards_gained AS y FROM rush_rows",
          steps=RUSH_ROWS, reals=["x", "y"])
def _(t):
    scored = expected.expected_rush_rows(t.plays, ERAS).withColumn("exp_pred", 1 + 0.3 * F.col("ydstogo"))
    return expected.feed_predicted_actual(scored)


# ---------------------------------------------------------------- models end to end

@register("completion_score")
def _(t):
    scored, _ = expected.completion_score(t.plays, [1998, 1999])
    return scored.select(*KEY, "passer_id", "cpoe_link", "expected_completion", "cpoe")


@register("xry_model")
def _(t):
    rows = expected.expected_rush_rows(t.plays, ERAS)
    model = expected.expected_rush_model(rows)
    model.release()  # the result holds only the tables below
    robust = model.robust_coefficients.select("term", F.col("std_error").alias("robust_error"),
                                              F.col("p_value").alias("robust_p_value"))
    return (model.coefficients.join(F.broadcast(robust), "term", "left")
            .withColumns({"rmse": F.lit(model.rmse), "r2": F.lit(model.fit.r2),
                          "bp_statistic": F.lit(model.heteroskedasticity["statistic"]),
                          "bp_p_value": F.lit(model.heteroskedasticity["p_value"])}))


@register("player_ratings")
def _(t):
    boards = ratings.player_ratings(_players(t), _season_rosters(t), attempts=15, targets=5, carries=4, rushes=3)
    named = [boards["passer"].select(F.lit("passer").alias("board"), F.col("passer_id").alias("subject"), "full_name",
                                     F.col("passer_rating").alias("rating"), F.col("attempts").alias("plays")),
             boards["receiver"].select(F.lit("receiver").alias("board"), F.col("receiver_id").alias("subject"), "full_name",
                                       F.col("receiver_rating").alias("rating"), F.col("targets").alias("plays")),
             boards["rusher"].select(F.lit("rusher").alias("board"), F.col("rusher_id").alias("subject"), "full_name",
                                     F.col("rusher_rating").alias("rating"), F.col("carries").alias("plays")),
             boards["line"].select(F.lit("line").alias("board"), F.col("team_location_gap").alias("subject"),
                                   F.lit(None).cast("string").alias("full_name"),
                                   F.col("line_rating").alias("rating"), F.col("rushes").alias("plays"))]
    return reduce(DataFrame.unionByName, named)


@register("passer_split")
def _(t):
    sets = player_plays.pass_model_sets(_players(t, with_strength=False))
    return ratings.passer_split(*ratings.passing_fits(sets["all"]))


_PASSERS = """
passers AS (
  SELECT w.passer_id, w.epa_with_rec, w.attempts, r.team, r.position, r.full_name
  FROM (SELECT passer_id, avg(epa) AS epa_with_rec, count(*) AS attempts FROM pass_rows GROUP BY passer_id) w
  LEFT JOIN season_rosters r ON w.passer_id IS NOT DISTINCT FROM r.gsis_id WHERE w.attempts > 15),
team_ratings AS (
  SELECT team, sum(epa_with_rec * attempts) AS total_ipa_w_rec, CAST(sum(attempts) AS BIGINT) AS total_attempts,
         sum(epa_with_rec * attempts) / nullif(sum(attempts), 0) AS team_ipa_avg
  FROM passers GROUP BY team)
"""


def _passes(t) -> DataFrame:
    return player_plays.pass_model_rows(_players(t, with_strength=False))


def _team_ratings(t, passes: DataFrame) -> DataFrame:
    """Team ratings with each passer's plain mean EPA as the rating."""
    means = passes.groupBy("passer_id").agg(F.avg("epa").alias("epa_with_rec"))
    passers = ratings.named_rating(means, "passer_id", "epa_with_rec", _season_rosters(t),
                                   settle(ratings.workload(passes, "passer_id", "attempts")), "attempts", 15)
    return ratings.team_weighted_rating(passers)


@register("team_weighted_rating", "SELECT * FROM team_ratings", tables=BOTH,
          steps=PASS_SETS.rstrip() + "," + _PASSERS, reals=["total_ipa_w_rec", "team_ipa_avg"])
def _(t):
    return _team_ratings(t, _passes(t))


@register("receiver_relative_rating", """
SELECT w.receiver_id, r.position, w.epa_rec, r.team, r.full_name, w.targets, g.total_attempts, g.team_ipa_avg,
       '2001' AS year, w.epa_rec / nullif(g.team_ipa_avg, 0) AS relative_ipa, w.epa_rec * w.targets AS total_ipa
FROM (SELECT receiver_id, avg(epa) AS epa_rec, count(*) AS targets FROM pass_rows GROUP BY receiver_id) w
LEFT JOIN season_rosters r ON w.receiver_id IS NOT DISTINCT FROM r.gsis_id
LEFT JOIN team_ratings g ON r.team IS NOT DISTINCT FROM g.team""", tables=BOTH,
          steps=PASS_SETS.rstrip() + "," + _PASSERS, reals=["epa_rec", "team_ipa_avg", "relative_ipa", "total_ipa"])
def _(t):
    passes = _passes(t)
    means = passes.groupBy("receiver_id").agg(F.avg("epa").alias("epa_rec"))
    receivers = ratings.named_rating(means, "receiver_id", "epa_rec", _season_rosters(t),
                                     settle(ratings.workload(passes, "receiver_id", "targets")), "targets", None)
    return ratings.receiver_relative_rating(receivers, _team_ratings(t, passes), str(SEASON))


@register("receiver_raw_relative", """
SELECT r.receiver, r.posteam, r.rec_position, r.avg_epa_receiver, r.targets, q.avg_epa_passer, q.attempts,
       sqrt(pow(r.avg_epa_receiver, 2) / nullif(pow(q.avg_epa_passer, 2), 0)) AS relative_epa
FROM (SELECT receiver, posteam, rec_position, count(*) AS targets,
             CASE WHEN count(*) = count(epa) THEN avg(epa) END AS avg_epa_receiver
      FROM pass_rows GROUP BY receiver, posteam, rec_position HAVING count(*) >= 8) r
LEFT JOIN (SELECT posteam, count(*) AS attempts, CASE WHEN count(*) = count(epa) THEN avg(epa) END AS avg_epa_passer
           FROM pass_rows GROUP BY posteam) q ON r.posteam IS NOT DISTINCT FROM q.posteam""",
          tables=BOTH, steps=PASS_SETS, reals=["avg_epa_receiver", "avg_epa_passer", "relative_epa"])
def _(t):
    return ratings.receiver_raw_relative(_passes(t), min_targets=8)


@register("workload_counts", """
SELECT 'attempts' AS load, passer_id AS subject, count(*) AS plays FROM players WHERE play_type = 'pass' GROUP BY passer_id
UNION ALL SELECT 'targets', receiver_id, count(*) FROM players WHERE play_type = 'pass' GROUP BY receiver_id
UNION ALL SELECT 'carries', rusher_id, count(*) FROM players WHERE play_type = 'run' GROUP BY rusher_id
UNION ALL SELECT 'rushes', team_location_gap, count(*) FROM players WHERE play_type = 'run' GROUP BY team_location_gap""",
          tables=BOTH, steps=PLAYER_PLAYS)
def _(t):
    players = _players(t, with_strength=False)
    passes, runs = player_plays.pass_model_rows(players), player_plays.run_model_rows(players)
    loads = [(passes, "passer_id", "attempts"), (passes, "receiver_id", "targets"),
             (runs, "rusher_id", "carries"), (runs, "team_location_gap", "rushes")]
    return reduce(DataFrame.unionByName, [
        ratings.workload(rows, key, "plays").select(F.lit(load).alias("load"), F.col(key).alias("subject"), "plays")
        for rows, key, load in loads])


@register("line_rating")
def _(t):
    return ratings.line_rating(_players(t, with_strength=False))


# ---------------------------------------------------------------- wins above replacement

@register("rb_base", """
SELECT game_id, play_id, rusher_id, season, team_run_gap, def_season, rookie_year, full_name, position, wpa
FROM back_runs""", tables=BOTH, steps=BACK_RUNS, reals=["wpa"])
def _(t):
    return war.back_runs(t.plays, t.rosters).select(
        *KEY, "rusher_id", "season", "team_run_gap", "def_season", "rookie_year", "full_name", "position", "wpa")


@register("carries_rank", "SELECT * FROM ranked", tables=BOTH, steps=BACK_RUNS)
def _(t):
    return war.carries_rank(war.back_runs(t.plays, t.rosters))


@register("replacement_pool", """
SELECT game_id, play_id, rusher_id, season, carries, rank_carries, rusher_season FROM pooled""",
          tables=BOTH, steps=BACK_RUNS)
def _(t):
    runs = war.back_runs(t.plays, t.rosters)
    return war.pool_replacement(runs, settle(war.carries_rank(runs)), MAX_RANK).select(
        *KEY, "rusher_id", "season", "carries", "rank_carries", "rusher_season")


@register("replacement_level")
def _(t):
    runs = war.back_runs(t.plays, t.rosters)
    pooled = war.pool_replacement(war.with_run_defense(runs, t.plays), settle(war.carries_rank(runs)), MAX_RANK)
    return war.replacement_level(war.rusher_season_ratings(war.fit_wpa(pooled)))


def _given_war(t) -> DataFrame:
    """The wins table with each label's plain mean win probability added as its rating."""
    runs = war.back_runs(t.plays, t.rosters)
    ranks = settle(war.carries_rank(runs))
    means = war.pool_replacement(runs, ranks, MAX_RANK).groupBy("rusher_season").agg(F.avg("wpa").alias("wpa_average"))
    return war.wins_above_replacement(settle(war.with_label_parts(means)), ranks,
                                      settle(expected.first_roster_rows(t.rosters)))


_WAR_REALS = ["wpa_average", "replacement_level", "replacement_wins", "wins", "rushing_war"]


@register("war", "SELECT * FROM war", tables=BOTH, steps=WAR, reals=_WAR_REALS)
def _(t):
    return _given_war(t)


@register("war_fitted")
def _(t):
    return war.running_back_war(t.plays, t.rosters, MAX_RANK)


@register("war_slices", """
SELECT 'span' AS slice, rusher_id, season, full_name, rushing_war, carries FROM war WHERE season BETWEEN 1995 AND 1999
UNION ALL
SELECT 'season', rusher_id, season, full_name, rushing_war, carries FROM war WHERE season = 2001""",
          tables=BOTH, steps=WAR, reals=["rushing_war"])
def _(t):
    table = settle(_given_war(t))
    columns = ["rusher_id", "season", "full_name", "rushing_war", "carries"]
    span = war.war_span(table, SPAN).select(F.lit("span").alias("slice"), *columns)
    return span.unionByName(war.war_season(table, SEASON).select(F.lit("season").alias("slice"), *columns))


@register("war_career", """
SELECT rusher_id, full_name,
       CASE WHEN count(*) = count(carries) THEN CAST(sum(carries) AS BIGINT) END AS total_carries,
       CASE WHEN count(*) = count(rushing_war) THEN sum(rushing_war) END AS total_war,
       CASE WHEN count(*) = count(rushing_war) THEN CAST(sum(CASE WHEN rushing_war > 0 THEN 1 ELSE 0 END) AS BIGINT) END
         AS seasons_above_zero,
       CASE WHEN count(*) = count(rushing_war) THEN sum(rushing_war) / nullif(sum(carries), 0) END AS wpa_per_carry
FROM war GROUP BY rusher_id, full_name""", tables=BOTH, steps=WAR, reals=["total_war", "wpa_per_carry"])
def _(t):
    return war.war_career(_given_war(t))
