"""WITH members that several checking queries share."""

PLAYER_PLAYS = """
season_plays AS (SELECT * FROM plays WHERE season = 2001),
season_rosters AS (SELECT gsis_id, position, team, full_name FROM rosters WHERE season = 2001),
strength AS (
  SELECT posteam, avg(CASE WHEN play_type = 'pass' THEN epa END) AS pass_strength,
         avg(CASE WHEN play_type = 'run' THEN epa END) AS rush_strength
  FROM season_plays WHERE play_type IN ('pass', 'run') GROUP BY posteam),
both_roles AS (
  SELECT p.*, a.position AS passer_position, b.position AS rec_position, CAST(NULL AS VARCHAR) AS rush_position
  FROM season_plays p
  LEFT JOIN season_rosters a ON p.passer_id IS NOT DISTINCT FROM a.gsis_id
  LEFT JOIN season_rosters b ON p.receiver_id IS NOT DISTINCT FROM b.gsis_id
  WHERE p.receiver_id IS NOT NULL
  UNION ALL
  SELECT p.*, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), c.position
  FROM season_plays p
  LEFT JOIN season_rosters c ON p.rusher_id IS NOT DISTINCT FROM c.gsis_id
  WHERE p.rusher_id IS NOT NULL),
labelled AS (
  SELECT *, CASE WHEN run_location = 'middle' THEN 'middle'
                 WHEN run_location <> 'middle' AND play_type = 'run'
                 THEN run_location || ' ' || coalesce(run_gap, 'NA') END AS location_gap
  FROM both_roles),
players AS (
  SELECT l.*, CASE WHEN play_type = 'run' THEN coalesce(l.posteam, 'NA') || ' ' || coalesce(location_gap, 'NA') END
           AS team_location_gap, s.pass_strength, s.rush_strength
  FROM labelled l LEFT JOIN strength s ON l.posteam IS NOT DISTINCT FROM s.posteam)
"""

PASS_SETS = PLAYER_PLAYS.rstrip() + """,
run_means AS (SELECT posteam, avg(epa) AS m FROM players WHERE play_type = 'run' GROUP BY posteam),
pass_means AS (SELECT posteam, avg(epa) AS m FROM players WHERE play_type = 'pass' GROUP BY posteam),
pass_rows AS (
  SELECT p.* EXCLUDE (pass_strength), r.m AS run_strength, q.m AS pass_strength
  FROM players p LEFT JOIN run_means r ON p.posteam IS NOT DISTINCT FROM r.posteam
  LEFT JOIN pass_means q ON p.posteam IS NOT DISTINCT FROM q.posteam
  WHERE play_type = 'pass')
"""

DEFENSE_SPLIT = """
run_defense AS (
  SELECT coalesce(defteam, 'NA') || '_' || season AS def_season, -avg(epa) AS def_strength_run
  FROM plays WHERE play_type = 'run' GROUP BY defteam, season),
pass_defense AS (
  SELECT coalesce(defteam, 'NA') || '_' || season AS def_season, -avg(epa) AS def_strength_pass
  FROM plays WHERE play_type = 'pass' GROUP BY defteam, season),
defense AS (
  SELECT p.def_season, p.def_strength_pass, r.def_strength_run
  FROM pass_defense p LEFT JOIN run_defense r ON p.def_season = r.def_season)
"""

FIRST_ROWS = """
first_rows AS (
  SELECT season AS rookie_year, gsis_id, full_name, position, height, weight
  FROM (SELECT *, row_number() OVER (PARTITION BY gsis_id ORDER BY season, full_name, position) AS rn FROM rosters)
  WHERE rn = 1)
"""

BACK_RUNS = FIRST_ROWS.rstrip() + """,
back_runs AS (
  SELECT p.*, coalesce(p.posteam, 'NA') || '_' || coalesce(run_location, 'NA') || '_' || coalesce(run_gap, 'NA') AS team_run_gap,
         coalesce(p.defteam, 'NA') || '_' || p.season AS def_season, f.rookie_year, f.full_name, f.position
  FROM plays p LEFT JOIN first_rows f ON p.rusher_id IS NOT DISTINCT FROM f.gsis_id
  WHERE play_type = 'run' AND f.position = 'RB' AND p.rusher_id IS NOT NULL),
counted AS (SELECT rusher_id, season, count(*) AS carries FROM back_runs GROUP BY rusher_id, season),
ranked AS (
  SELECT rusher_id, season, carries,
         CAST(dense_rank() OVER (PARTITION BY season ORDER BY carries DESC) AS INT) AS rank_carries,
         rusher_id || '_' || season AS rusher_season
  FROM counted),
pooled AS (
  SELECT b.* , r.carries, r.rank_carries,
         CASE WHEN r.rank_carries <= 10 THEN r.rusher_season ELSE 'replacement-level_' || b.season END AS rusher_season
  FROM back_runs b LEFT JOIN ranked r ON b.rusher_id = r.rusher_id AND b.season = r.season)
"""

WAR = BACK_RUNS.rstrip() + """,
ratings AS (
  SELECT rusher_season, avg(wpa) AS wpa_average,
         split_part(rusher_season, '_', 1) AS label_id,
         CAST(split_part(rusher_season, '_', 2) AS INT) AS label_season
  FROM pooled GROUP BY rusher_season),
replacement AS (
  SELECT label_season AS season_n, wpa_average AS replacement_level
  FROM ratings WHERE label_id LIKE '%replacement%'),
war_base AS (
  SELECT r.rusher_season, r.wpa_average, k.season, k.rusher_id, k.carries, f.rookie_year, f.full_name,
         f.position, f.height, f.weight, k.season AS season_n
  FROM ratings r LEFT JOIN ranked k ON r.rusher_season = k.rusher_season
  LEFT JOIN first_rows f ON k.rusher_id = f.gsis_id),
war AS (
  SELECT w.*, p.replacement_level, p.replacement_level * w.carries AS replacement_wins,
         w.wpa_average * w.carries AS wins,
         w.wpa_average * w.carries - p.replacement_level * w.carries AS rushing_war
  FROM war_base w LEFT JOIN replacement p ON w.season_n IS NOT DISTINCT FROM p.season_n)
"""

RUSH_ROWS = DEFENSE_SPLIT.rstrip() + """,
rush_rows AS (
  SELECT p.game_id, p.play_id, p.rusher_id, p.posteam_type, p.posteam, p.defteam, p.yardline_100,
         p.half_seconds_remaining, p.game_half, p.down, p.ydstogo,
         CASE WHEN season = 1995 THEN 1 WHEN season BETWEEN 1996 AND 1997 THEN 2
              WHEN season BETWEEN 1998 AND 1999 THEN 3 WHEN season = 2000 THEN 4 ELSE 5 END AS era,
         p.shotgun, p.no_huddle, coalesce(p.run_gap, 'Other') AS run_gap, p.score_differential,
         p.season, p.roof, p.yards_gained, coalesce(p.defteam, 'NA') || '_' || p.season AS def_season,
         d.def_strength_pass, d.def_strength_run
  FROM plays p LEFT JOIN defense d ON coalesce(p.defteam, 'NA') || '_' || p.season = d.def_season
  WHERE p.play_type = 'run' AND p.yardline_100 IS NOT NULL AND p.down IS NOT NULL AND p.roof IS NOT NULL)
"""

#: all seasons; a player's first roster row stands for the player
ALL_PLAYER_PLAYS = FIRST_ROWS.rstrip() + "," + PLAYER_PLAYS.replace(
    "SELECT * FROM plays WHERE season = 2001", "SELECT * FROM plays").replace(
    "SELECT gsis_id, position, team, full_name FROM rosters WHERE season = 2001", "SELECT gsis_id, position FROM first_rows")
