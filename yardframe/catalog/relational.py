"""Scans, projections, filters, joins, aggregates, ranks, reshaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from yardframe.catalog.analyses import _all_players
from yardframe.catalog.base import ERAS, MAX_RANK, SEASON, SPAN, TEAM, register
from yardframe.catalog.steps import ALL_PLAYER_PLAYS, BACK_RUNS, FIRST_ROWS, PLAYER_PLAYS
from yardframe.functions.nulls import (
    if_else, null_fill, paste, ratio, row_count, strict_mean, strict_mean_where, strict_sum, sum_where,
    threshold_flag, weighted_mean, without_nulls,
)
from yardframe.functions.text import (
    decode_player_ids, season_of_game, separate, to_integer, unite,
)
from yardframe.models.design import Design, Factor
from yardframe.operators.joins import (
    lookup_join, natural_left_join, role_join, settle, suffixed_left_join,
)
from yardframe.operators.rows import (
    dense_rank_within, first_per_key, pivot_mean, sort_asc, sort_desc,
)
from yardframe.plans.expected import era_of
from yardframe.plans.player_plays import player_plays
from yardframe.plans.strength import defense_strength
from yardframe.plans.war import back_runs, carries_rank, pool_replacement
from yardframe.sources.tables import in_seasons, missing_games

KEY = ["game_id", "play_id"]


# ---------------------------------------------------------------- scans

@register("scan_plays", """
SELECT season, season_type, play_type, count(*) AS plays, count(epa) AS with_epa, sum(wp) AS wp_sum
FROM plays GROUP BY season, season_type, play_type""", reals=["wp_sum"])
def _(t):
    return t.plays.groupBy("season", "season_type", "play_type").agg(
        row_count().alias("plays"), F.count("epa").alias("with_epa"), F.sum("wp").alias("wp_sum"))


@register("append_new_games", """
SELECT game_id, play_id, season FROM plays
WHERE game_id NOT IN (SELECT game_id FROM plays WHERE season <= 1998)""")
def _(t):
    return missing_games(t.plays, t.plays.filter(F.col("season") <= 1998)).select(*KEY, "season")


@register("scan_rosters", "SELECT * FROM rosters WHERE season BETWEEN 1995 AND 1999", tables=["rosters"])
def _(t):
    return in_seasons(t.rosters, SPAN)


@register("team_dimension", "SELECT * FROM teams", tables=["teams"])
def _(t):
    return t.teams


# ---------------------------------------------------------------- projections

@register("select_columns", "SELECT game_id, play_id, posteam, defteam, season, down, epa FROM plays",
          reals=["epa"])
def _(t):
    return t.plays.select(*KEY, "posteam", "defteam", "season", "down", "epa")


@register("drop_columns", "SELECT season, gsis_id, full_name, position FROM rosters", tables=["rosters"])
def _(t):
    return t.rosters.drop("team", "height", "weight")


@register("rename_columns", """
SELECT season AS rookie_year, gsis_id, position AS passer_position FROM rosters""", tables=["rosters"])
def _(t):
    return t.rosters.select("season", "gsis_id", "position").withColumnsRenamed(
        {"season": "rookie_year", "position": "passer_position"})


@register("derived_columns", """
SELECT game_id, play_id, air_yards + yards_after_catch AS total_yards,
       air_yards / nullif(air_yards + yards_after_catch, 0) AS air_share,
       1 - air_yards / nullif(air_yards + yards_after_catch, 0) AS yac_share
FROM plays WHERE play_type = 'pass'""", reals=["total_yards", "air_share", "yac_share"])
def _(t):
    passes = t.plays.filter(F.col("play_type") == "pass")
    return (passes.withColumn("total_yards", F.col("air_yards") + F.col("yards_after_catch"))
                  .withColumn("air_share", ratio("air_yards", "total_yards"))
                  .withColumn("yac_share", 1 - F.col("air_share"))
                  .select(*KEY, "total_yards", "air_share", "yac_share"))


@register("factor_levels_ref", """
SELECT factor, level, CAST(row_number() OVER (PARTITION BY factor ORDER BY level <> ref, level) AS INT) AS place
FROM (SELECT DISTINCT 'rec_position' AS factor, 'WR' AS ref, rec_position AS level FROM players WHERE rec_position IS NOT NULL
      UNION ALL
      SELECT DISTINCT 'rush_position', 'RB', rush_position FROM players WHERE rush_position IS NOT NULL)""",
          tables=["plays", "rosters"], steps=ALL_PLAYER_PLAYS)
def _(t):
    players = _all_players(t, with_strength=False)
    terms = [Factor("rec_position", ref="WR"), Factor("rush_position", ref="RB")]
    levels = Design.learn(players, terms).levels
    return t.spark.createDataFrame(
        [(name, level, place + 1) for name, known in levels.items() for place, level in enumerate(known)],
        "factor string, level string, place int")


@register("text_to_number", """
SELECT CAST(substr(game_id, 1, 4) AS INT) AS year, CAST(NULL AS INT) AS team_number, count(*) AS plays
FROM plays GROUP BY 1""")
def _(t):
    return t.plays.select(season_of_game(F.col("game_id")).alias("year"),
                          to_integer(F.col("posteam")).alias("team_number")
                          ).groupBy("year", "team_number").agg(row_count().alias("plays"))


# ---------------------------------------------------------------- filters

@register("filter_equality", "SELECT game_id, play_id FROM plays WHERE season = 2001 AND play_type = 'run'")
def _(t):
    return t.plays.filter(F.col("season") == SEASON).filter(F.col("play_type") == "run").select(*KEY)


@register("filter_conjunction", """
SELECT game_id, play_id, ydstogo FROM plays WHERE posteam = 'NATION_0' AND down = 3 AND ydstogo >= 7""")
def _(t):
    return t.plays.filter((F.col("posteam") == TEAM) & (F.col("down") == 3) & (F.col("ydstogo") >= 7)
                          ).select(*KEY, "ydstogo")


@register("filter_disjunction", """
SELECT game_id, play_id, home_team, away_team FROM plays
WHERE home_team = 'NATION_0' OR away_team = 'NATION_0'""")
def _(t):
    return t.plays.filter((F.col("home_team") == TEAM) | (F.col("away_team") == TEAM)
                          ).select(*KEY, "home_team", "away_team")


@register("filter_membership", """
SELECT game_id, play_id, play_type, season FROM plays
WHERE play_type IN ('pass', 'run') AND season IN (1995, 1996, 1997, 1998, 1999)""")
def _(t):
    return in_seasons(t.plays.filter(F.col("play_type").isin("pass", "run")), SPAN
                      ).select(*KEY, "play_type", "season")


@register("filter_range", """
SELECT game_id, play_id, wp FROM plays
WHERE season >= 1997 AND wp <= 0.3 AND game_seconds_remaining < 3600""", reals=["wp"])
def _(t):
    return t.plays.filter((F.col("season") >= 1997) & (F.col("wp") <= 0.3)
                          & (F.col("game_seconds_remaining") < 3600)).select(*KEY, "wp")


@register("filter_not_null", """
SELECT game_id, play_id FROM plays
WHERE yardline_100 IS NOT NULL AND down IS NOT NULL AND roof IS NOT NULL""")
def _(t):
    return t.plays.filter(F.col("yardline_100").isNotNull() & F.col("down").isNotNull()
                          & F.col("roof").isNotNull()).select(*KEY)


@register("filter_flag", """
SELECT game_id, play_id, CASE WHEN complete_pass = 1 THEN 'complete' ELSE 'incomplete' END AS result
FROM plays WHERE play_type = 'pass'""")
def _(t):
    passes = t.plays.filter(F.col("play_type") == "pass").select(*KEY, "complete_pass")
    complete = passes.filter(F.col("complete_pass") == 1).withColumn("result", F.lit("complete"))
    other = passes.filter(F.col("complete_pass") == 0).withColumn("result", F.lit("incomplete"))
    return complete.unionByName(other).drop("complete_pass")


@register("filter_regex", """
SELECT rusher_season, count(*) AS runs FROM pooled
WHERE rusher_season LIKE '%replacement%' GROUP BY rusher_season""",
          tables=["plays", "rosters"], steps=BACK_RUNS)
def _(t):
    return (_pooled(t).filter(F.col("rusher_season").rlike("replacement"))
                      .groupBy("rusher_season").agg(row_count().alias("runs")))


@register("having_threshold", """
SELECT passer, season, count(*) AS attempts FROM plays WHERE passer IS NOT NULL
GROUP BY passer, season HAVING count(*) >= 50""")
def _(t):
    return (t.plays.filter(F.col("passer").isNotNull()).groupBy("passer", "season")
             .agg(row_count().alias("attempts")).filter(F.col("attempts") >= 50))


@register("complete_cases", """
SELECT game_id, play_id FROM plays WHERE epa IS NOT NULL AND posteam_type IS NOT NULL
AND shotgun IS NOT NULL AND pass_location IS NOT NULL AND air_yards IS NOT NULL
AND passer_id IS NOT NULL AND receiver_id IS NOT NULL""")
def _(t):
    return without_nulls(t.plays, ["epa", "posteam_type", "shotgun", "pass_location", "air_yards",
                                   "passer_id", "receiver_id"]).select(*KEY)


# ---------------------------------------------------------------- joins

def _players(t):
    rosters = t.rosters.filter(F.col("season") == SEASON)
    return player_plays(t.plays.filter(F.col("season") == SEASON), rosters)


def _pooled(t):
    runs = back_runs(t.plays, t.rosters)
    return pool_replacement(runs, settle(carries_rank(runs)), MAX_RANK)


@register("left_join_renamed_key", """
SELECT p.game_id, p.play_id, p.rusher_id, r.full_name, r.position
FROM plays p LEFT JOIN (SELECT * FROM rosters WHERE season = 2001) r ON p.rusher_id IS NOT DISTINCT FROM r.gsis_id""",
          tables=["plays", "rosters"])
def _(t):
    roster = t.rosters.filter(F.col("season") == SEASON).select("gsis_id", "full_name", "position")
    return lookup_join(t.plays.select(*KEY, "rusher_id"), roster, {"rusher_id": "gsis_id"}, null_safe=True)


@register("left_join_same_key", """
SELECT p.game_id, p.play_id, p.posteam, s.n AS team_plays
FROM plays p LEFT JOIN (SELECT posteam, count(*) AS n FROM plays GROUP BY posteam) s ON p.posteam = s.posteam""")
def _(t):
    team = t.plays.groupBy("posteam").agg(row_count().alias("team_plays"))
    return lookup_join(t.plays.select(*KEY, "posteam"), settle(team), "posteam")


@register("left_join_composite_key", """
SELECT p.game_id, p.play_id, p.defteam, p.season, d.dropbacks, d.def_strength
FROM plays p LEFT JOIN (SELECT defteam, season, count(*) AS dropbacks, -avg(epa) AS def_strength
                        FROM plays WHERE pass_attempt = 1 GROUP BY defteam, season) d
ON p.defteam = d.defteam AND p.season = d.season""", reals=["def_strength"])
def _(t):
    strength = defense_strength(t.plays.filter(F.col("pass_attempt") == 1))
    return lookup_join(t.plays.select(*KEY, "defteam", "season"), settle(strength), ["defteam", "season"])


@register("natural_left_join", """
SELECT a.passer_id, a.mean_epa, b.mean_wpa
FROM (SELECT passer_id, avg(epa) AS mean_epa FROM plays GROUP BY passer_id) a
LEFT JOIN (SELECT passer_id, avg(wpa) AS mean_wpa FROM plays WHERE receiver_id IS NOT NULL GROUP BY passer_id) b
ON a.passer_id IS NOT DISTINCT FROM b.passer_id""", reals=["mean_epa", "mean_wpa"])
def _(t):
    first = t.plays.groupBy("passer_id").agg(F.avg("epa").alias("mean_epa"))
    second = (t.plays.filter(F.col("receiver_id").isNotNull())
               .groupBy("passer_id").agg(F.avg("wpa").alias("mean_wpa")))
    return natural_left_join(first, settle(second))


@register("merge_left_outer", """
SELECT w.passer_id, w.attempts, r.team, r.position, r.full_name
FROM (SELECT passer_id, count(*) AS attempts FROM plays WHERE season = 2001 AND play_type = 'pass' GROUP BY passer_id) w
LEFT JOIN rosters r ON w.passer_id = r.gsis_id AND r.season = 2001""", tables=["plays", "rosters"])
def _(t):
    loads = (t.plays.filter((F.col("season") == SEASON) & (F.col("play_type") == "pass"))
              .groupBy("passer_id").agg(row_count().alias("attempts")))
    people = t.rosters.filter(F.col("season") == SEASON).select("gsis_id", "team", "position", "full_name")
    return lookup_join(loads, people, {"passer_id": "gsis_id"}, null_safe=True, salt_on=["passer_id"])


@register("join_suffix_resolution", """
SELECT b.game_id, b.play_id, b.rusher_id || '_' || b.season AS rusher_season, b.season, b.rusher_id,
       r.carries, r.rank_carries
FROM back_runs b LEFT JOIN ranked r ON b.rusher_id || '_' || b.season = r.rusher_season""",
          tables=["plays", "rosters"], steps=BACK_RUNS)
def _(t):
    runs = back_runs(t.plays, t.rosters)
    keyed = unite(runs, "rusher_season", ["rusher_id", "season"]).select(*KEY, "rusher_season", "season", "rusher_id")
    both = suffixed_left_join(keyed, settle(carries_rank(runs)), ["rusher_season"])
    return both.drop("season_y", "rusher_id_y").withColumnsRenamed(
        {"season_x": "season", "rusher_id_x": "rusher_id"})


@register("role_playing_join", """
SELECT p.game_id, p.play_id, a.position AS passer_position, b.position AS rec_position, c.position AS rush_position
FROM plays p LEFT JOIN r a ON p.passer_id IS NOT DISTINCT FROM a.gsis_id
LEFT JOIN r b ON p.receiver_id IS NOT DISTINCT FROM b.gsis_id
LEFT JOIN r c ON p.rusher_id IS NOT DISTINCT FROM c.gsis_id""",
          tables=["plays", "rosters"], steps="r AS (SELECT * FROM rosters WHERE season = 2001)")
def _(t):
    roles = {"passer_id": "passer_position", "receiver_id": "rec_position", "rusher_id": "rush_position"}
    roster = t.rosters.filter(F.col("season") == SEASON)
    return role_join(t.plays.select(*KEY, *roles), roster, roles).drop(*roles)


@register("aggregate_join_back", """
SELECT p.game_id, p.play_id, p.posteam, s.run_strength
FROM plays p LEFT JOIN (SELECT posteam, avg(epa) AS run_strength FROM plays WHERE play_type = 'run' GROUP BY posteam) s
ON p.posteam IS NOT DISTINCT FROM s.posteam WHERE p.play_type = 'pass'""", reals=["run_strength"])
def _(t):
    strength = (t.plays.filter(F.col("play_type") == "run").groupBy("posteam")
                 .agg(F.avg("epa").alias("run_strength")))
    passes = t.plays.filter(F.col("play_type") == "pass").select(*KEY, "posteam")
    return lookup_join(passes, settle(strength), "posteam", null_safe=True)


@register("join_fanout", """
SELECT p.game_id, p.play_id, r.season AS roster_season, r.position
FROM plays p LEFT JOIN rosters r ON p.rusher_id IS NOT DISTINCT FROM r.gsis_id
WHERE p.rusher_id IS NOT NULL""", tables=["plays", "rosters"])
def _(t):
    roster = t.rosters.select("gsis_id", F.col("season").alias("roster_season"), "position")
    runs = t.plays.filter(F.col("rusher_id").isNotNull()).select(*KEY, "rusher_id")
    return lookup_join(runs, roster, {"rusher_id": "gsis_id"}, null_safe=True).drop("rusher_id")


# ---------------------------------------------------------------- aggregates

def _agg(name, spark_aggs, sql_aggs, reals=(), where="", test=None, keys=("posteam", "season")):
    """Register one aggregate of plays by ``keys``."""
    listed = ", ".join(keys)

    @register(name, f"SELECT {listed}, {sql_aggs} FROM plays {where} GROUP BY {listed}", reals=reals)
    def _(t):
        rows = t.plays if test is None else t.plays.filter(test)
        return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in spark_aggs().items()])


_PASS = dict(where="WHERE play_type = 'pass'", test="play_type = 'pass'")

_agg("agg_count", lambda: {"plays": row_count()}, "count(*) AS plays")
_agg("agg_sum", lambda: {"attempts": F.sum("pass_attempt"), "air": F.sum("air_yards")},
     "CAST(sum(pass_attempt) AS BIGINT) AS attempts, sum(air_yards) AS air", ["air"])
_agg("agg_sum_strict", lambda: {"air": strict_sum("air_yards"), "gained": strict_sum("yards_gained")},
     "CASE WHEN count(*) = count(air_yards) THEN sum(air_yards) END AS air, "
     "CASE WHEN count(*) = count(yards_gained) THEN sum(yards_gained) END AS gained",
     ["air", "gained"], keys=("posteam", "season", "passer_id"), **_PASS)
_agg("agg_mean_skip_null", lambda: {"avg_epa": F.avg("epa"), "avg_airyards": F.avg("air_yards")},
     "avg(epa) AS avg_epa, avg(air_yards) AS avg_airyards", ["avg_epa", "avg_airyards"])
_agg("agg_mean_strict", lambda: {"avg_epa": strict_mean("epa"), "avg_yards": strict_mean("yards_gained")},
     "CASE WHEN count(*) = count(epa) THEN avg(epa) END AS avg_epa, "
     "CASE WHEN count(*) = count(yards_gained) THEN avg(yards_gained) END AS avg_yards",
     ["avg_epa", "avg_yards"], keys=("rusher_id", "season"))
_agg("agg_mean_pushed", lambda: {"def_strength_run": -F.avg("epa")}, "-avg(epa) AS def_strength_run",
     ["def_strength_run"], keys=("defteam", "season"), where="WHERE play_type = 'run'",
     test="play_type = 'run'")
_agg("agg_conditional_sum", lambda: {"pass_yards": sum_where("yards_gained", F.expr("complete_pass = 1"))},
     "sum(CASE WHEN complete_pass = 1 THEN yards_gained END) AS pass_yards", ["pass_yards"], **_PASS)
_agg("agg_conditional_mean",
     lambda: {"avg_ypa": strict_mean_where("yards_gained", F.expr("air_yards IS NOT NULL")),
      "epa_in_air": strict_mean_where("epa", F.expr("air_yards IS NOT NULL"))},
     "avg(CASE WHEN air_yards IS NOT NULL THEN yards_gained END) AS avg_ypa, "
     "CASE WHEN count(CASE WHEN air_yards IS NOT NULL THEN 1 END) = count(CASE WHEN air_yards IS NOT NULL THEN epa END) "
     "THEN avg(CASE WHEN air_yards IS NOT NULL THEN epa END) END AS epa_in_air",
     ["avg_ypa", "epa_in_air"], **_PASS)
_agg("group_multi_key", lambda: {"plays": row_count()}, "count(*) AS plays",
     keys=("receiver", "posteam", "pass_location"))


@register("agg_sibling_expression", """
SELECT rusher_id, season, count(*) AS carries, avg(yards_gained) AS actual, avg(ydstogo) AS wanted,
       avg(yards_gained) - avg(ydstogo) AS gap
FROM plays WHERE play_type = 'run' GROUP BY rusher_id, season""", reals=["actual", "wanted", "gap"])
def _(t):
    return (t.plays.filter(F.col("play_type") == "run").groupBy("rusher_id", "season")
             .agg(row_count().alias("carries"), F.avg("yards_gained").alias("actual"), F.avg("ydstogo").alias("wanted"))
             .withColumn("gap", F.col("actual") - F.col("wanted")))


@register("agg_ratio", """
SELECT season, receiver_id, count(*) AS targets, CAST(sum(complete_pass) AS BIGINT) AS receptions,
       sum(yards_gained) / nullif(sum(complete_pass), 0) AS per_catch,
       sum(complete_pass) / count(*) AS catch_rate
FROM plays WHERE play_type = 'pass' GROUP BY season, receiver_id""", reals=["per_catch", "catch_rate"])
def _(t):
    return (t.plays.filter(F.col("play_type") == "pass").groupBy("season", "receiver_id")
             .agg(row_count().alias("targets"), F.sum("complete_pass").alias("receptions"),
                  F.sum("yards_gained").alias("yards"))
             .withColumns({"per_catch": ratio("yards", "receptions"),
                           "catch_rate": ratio("receptions", "targets")})
             .drop("yards"))


@register("agg_global", """
SELECT avg(m) AS mean_team_epa, count(*) AS teams
FROM (SELECT posteam, avg(epa) AS m FROM plays WHERE play_type = 'pass' GROUP BY posteam)""",
          reals=["mean_team_epa"])
def _(t):
    team = (t.plays.filter(F.col("play_type") == "pass").groupBy("posteam").agg(F.avg("epa").alias("m")))
    return team.agg(F.avg("m").alias("mean_team_epa"), row_count().alias("teams"))


@register("agg_weighted_mean", """
SELECT posteam, sum(m * n) / sum(n) AS weighted
FROM (SELECT posteam, passer_id, avg(epa) AS m, count(*) AS n FROM plays WHERE play_type = 'pass'
      GROUP BY posteam, passer_id) GROUP BY posteam""", reals=["weighted"])
def _(t):
    passers = (t.plays.filter(F.col("play_type") == "pass").groupBy("posteam", "passer_id")
                .agg(F.avg("epa").alias("m"), row_count().alias("n")))
    return passers.groupBy("posteam").agg(weighted_mean("m", "n").alias("weighted"))


@register("agg_two_level", """
SELECT season, count(*) AS rushers, max(carries) AS most, CAST(sum(carries) AS BIGINT) AS total
FROM (SELECT rusher_id, season, count(*) AS carries FROM plays WHERE rusher_id IS NOT NULL
      GROUP BY rusher_id, season) GROUP BY season""")
def _(t):
    carries = (t.plays.filter(F.col("rusher_id").isNotNull()).groupBy("rusher_id", "season")
                .agg(row_count().alias("carries")))
    return carries.groupBy("season").agg(row_count().alias("rushers"), F.max("carries").alias("most"),
                                         F.sum("carries").alias("total"))


# ---------------------------------------------------------------- ranks and sorts

@register("dense_rank_desc", """
SELECT rusher_id, season, carries,
       CAST(dense_rank() OVER (PARTITION BY season ORDER BY carries DESC) AS INT) AS rank_carries
FROM (SELECT rusher_id, season, count(*) AS carries FROM plays WHERE rusher_id IS NOT NULL
      GROUP BY rusher_id, season)""")
def _(t):
    carries = (t.plays.filter(F.col("rusher_id").isNotNull()).groupBy("rusher_id", "season")
                .agg(row_count().alias("carries")))
    return dense_rank_within(settle(carries), "season", "carries", "rank_carries")


@register("first_row_per_key", "SELECT rookie_year, gsis_id, full_name, position FROM first_rows",
          tables=["rosters"], steps=FIRST_ROWS)
def _(t):
    rows = t.rosters.select("season", "gsis_id", "full_name", "position")
    order = [F.col("season"), F.col("full_name"), F.col("position")]
    return first_per_key(rows, ["gsis_id"], order).withColumnRenamed("season", "rookie_year")


@register("first_row_scan_order", """
SELECT game_id, play_id, season, posteam, game_seconds_remaining
FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY game_seconds_remaining DESC, play_id) AS rn FROM plays)
WHERE rn = 1""")
def _(t):
    rows = t.plays.select(*KEY, "season", "posteam", "game_seconds_remaining")
    return first_per_key(rows, ["game_id"], [-F.col("game_seconds_remaining"), F.col("play_id")])


@register("sort_desc", "SELECT game_id, play_id, epa FROM plays ORDER BY epa DESC NULLS LAST, game_id, play_id",
          reals=["epa"])
def _(t):
    return sort_desc(t.plays.select(*KEY, "epa"), "epa", *KEY)


@register("sort_asc", "SELECT season, gsis_id, full_name FROM rosters ORDER BY season NULLS LAST, gsis_id",
          tables=["rosters"])
def _(t):
    return sort_asc(t.rosters.select("season", "gsis_id", "full_name"), "season", "gsis_id")


# ---------------------------------------------------------------- sets and shapes

@register("union_by_name", """
SELECT game_id, play_id, passer_position, rec_position, rush_position FROM both_roles""",
          tables=["plays", "rosters"], steps=PLAYER_PLAYS)
def _(t):
    return _players(t).select(*KEY, "passer_position", "rec_position", "rush_position")


@register("pivot_wide", """
SELECT posteam, avg(CASE WHEN play_type = 'pass' THEN epa END) AS pass_epa,
       avg(CASE WHEN play_type = 'run' THEN epa END) AS run_epa
FROM plays WHERE play_type IN ('pass', 'run') GROUP BY posteam""", reals=["pass_epa", "run_epa"])
def _(t):
    return pivot_mean(t.plays, "posteam", "play_type", "epa", {"pass": "pass_epa", "run": "run_epa"})


@register("unite_keep", """
SELECT game_id, play_id, posteam, run_location, run_gap,
       coalesce(posteam, 'NA') || '_' || coalesce(run_location, 'NA') || '_' || coalesce(run_gap, 'NA') AS team_run_gap
FROM plays""")
def _(t):
    parts = ["posteam", "run_location", "run_gap"]
    return unite(t.plays.select(*KEY, *parts), "team_run_gap", parts)


@register("unite_drop", """
SELECT coalesce(defteam, 'NA') || '_' || season AS def_season, count(*) AS plays FROM plays GROUP BY defteam, season""")
def _(t):
    counts = t.plays.groupBy("defteam", "season").agg(row_count().alias("plays"))
    return unite(counts, "def_season", ["defteam", "season"], keep=False)


@register("separate_columns", """
SELECT game_id, split_part(game_id, '_', 1) AS year, split_part(game_id, '_', 2) AS number, count(*) AS plays
FROM plays GROUP BY game_id""")
def _(t):
    return separate(t.plays.groupBy("game_id").agg(row_count().alias("plays")), "game_id", ["year", "number"])


# ---------------------------------------------------------------- scalar functions

@register("str_substring", "SELECT game_id, play_id, substr(game_id, 1, 4) AS year_text FROM plays")
def _(t):
    return t.plays.select(*KEY, F.substring("game_id", 1, 4).alias("year_text"))


@register("str_paste", """
SELECT game_id, play_id, coalesce(run_location, 'NA') || ' ' || coalesce(run_gap, 'NA') AS label FROM plays""")
def _(t):
    return t.plays.select(*KEY, paste("run_location", "run_gap").alias("label"))


@register("decode_ids", "SELECT game_id, play_id, passer_id, receiver_id, rusher_id FROM plays")
def _(t):
    # ids in their encoded form: four digits, the id's bytes in hex, eight more digits
    ids = ["passer_id", "receiver_id", "rusher_id"]

    def encoded(name):
        digits = F.lower(F.hex(F.encode(F.col(name), "utf-8")))
        part = [F.substring(digits, start, 4) for start in (1, 5, 9, 13, 17)]
        form = F.concat(F.lit("3201"), part[0], F.lit("-"), part[1], F.lit("-"), part[2], F.lit("-"),
                        part[3], F.lit("-"), part[4], F.lit("00a1b2c3"))
        return F.when(F.col("home_team") != TEAM, form).otherwise(F.col(name))

    rows = t.plays.select(*KEY, "home_team", *ids).withColumns({name: encoded(name) for name in ids})
    return decode_player_ids(rows).drop("home_team")


@register("ifelse_null_safe", """
SELECT game_id, play_id, CASE WHEN down >= 3 THEN 'late' WHEN down < 3 THEN 'early' END AS when_down,
       CASE WHEN posteam = 'NATION_0' THEN wp WHEN posteam <> 'NATION_0' THEN 1 - wp END AS team_wp
FROM plays""", reals=["team_wp"])
def _(t):
    return t.plays.select(
        *KEY, if_else(F.col("down") >= 3, F.lit("late"), F.lit("early")).alias("when_down"),
        if_else(F.col("posteam") == TEAM, F.col("wp"), 1 - F.col("wp")).alias("team_wp"))


@register("era_bucket", """
SELECT season, CASE WHEN season = 1995 THEN 1 WHEN season BETWEEN 1996 AND 1997 THEN 2
       WHEN season BETWEEN 1998 AND 1999 THEN 3 WHEN season = 2000 THEN 4 ELSE 5 END AS era, count(*) AS plays
FROM plays GROUP BY season""")
def _(t):
    counts = t.plays.groupBy("season").agg(row_count().alias("plays"))
    return counts.withColumn("era", era_of(F.col("season"), ERAS))


@register("null_fill", """
SELECT game_id, play_id, coalesce(run_gap, 'Other') AS run_gap, coalesce(yards_after_catch, 0) AS yards_after_catch
FROM plays""", reals=["yards_after_catch"])
def _(t):
    return t.plays.select(*KEY, null_fill("run_gap", "Other").alias("run_gap"),
                          null_fill("yards_after_catch", 0.0).alias("yards_after_catch"))


@register("math_asinh", """
SELECT game_id, play_id, asinh(yards_gained) AS a, asinh(score_differential) AS b FROM plays""", reals=["a", "b"])
def _(t):
    return t.plays.select(*KEY, F.asinh("yards_gained").alias("a"), F.asinh("score_differential").alias("b"))


@register("math_exp", "SELECT game_id, play_id, exp(epa) AS e FROM plays", reals=["e"])
def _(t):
    return t.plays.select(*KEY, F.exp("epa").alias("e"))


@register("math_sqrt_ratio", """
SELECT posteam, passer_id, sqrt(pow(avg(epa), 2) / nullif(pow(avg(wpa), 2), 0)) AS r
FROM plays GROUP BY posteam, passer_id""", reals=["r"], places=4)
def _(t):
    means = t.plays.groupBy("posteam", "passer_id").agg(F.avg("epa").alias("e"), F.avg("wpa").alias("w"))
    square = ratio(F.pow("e", F.lit(2)), F.pow("w", F.lit(2)))
    return means.select("posteam", "passer_id", F.sqrt(square).alias("r"))


@register("math_arithmetic", """
SELECT game_id, play_id, 1 - wp AS loss, -epa AS flipped, yards_gained * ydstogo AS product,
       yards_gained - ydstogo AS gap FROM plays""", reals=["loss", "flipped", "product", "gap"])
def _(t):
    return t.plays.select(
        *KEY, (1 - F.col("wp")).alias("loss"), (-F.col("epa")).alias("flipped"),
        (F.col("yards_gained") * F.col("ydstogo")).alias("product"),
        (F.col("yards_gained") - F.col("ydstogo")).alias("gap"))


@register("threshold_flag", """
SELECT game_id, play_id, CASE WHEN epa > 0 THEN 1 WHEN epa <= 0 THEN 0 END AS above_zero FROM plays""")
def _(t):
    return t.plays.select(*KEY, threshold_flag("epa", 0).alias("above_zero"))
