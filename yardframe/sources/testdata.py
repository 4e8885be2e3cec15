"""Plays, rosters and teams derived from the star-schema test tables.

Each text runs unchanged in Spark SQL and in the checking engine; only the table names in
braces are filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLAYS_SQL = """
SELECT
  CAST(year(o.o_orderdate) AS STRING) || '_' || CAST(o.o_orderkey AS STRING) AS game_id,
  CAST(l.l_linenumber * 10000000 + l.l_partkey * 100 + CAST(l.l_quantity AS INT) AS BIGINT) AS play_id,
  CAST(year(l.l_shipdate) AS INT) AS season,
  CASE WHEN month(l.l_shipdate) = 1 THEN 'POST' ELSE 'REG' END AS season_type,
  cn.n_name AS posteam, sn.n_name AS defteam,
  CASE WHEN l.l_linestatus = 'F' THEN 'home' ELSE 'away' END AS posteam_type,
  CASE WHEN l.l_linestatus = 'F' THEN cn.n_name ELSE sn.n_name END AS home_team,
  CASE WHEN l.l_linestatus = 'F' THEN sn.n_name ELSE cn.n_name END AS away_team,
  CASE WHEN l.l_partkey % 99 > 49 THEN cn.n_name ELSE sn.n_name END AS side_of_field,
  CASE l.l_returnflag WHEN 'R' THEN 'pass' WHEN 'A' THEN 'run' ELSE 'punt' END AS play_type,
  CASE WHEN l.l_returnflag = 'R' THEN '00-' || lpad(CAST(cn.n_nationkey * 2 + l.l_suppkey % 2 AS STRING), 7, '0') END AS passer_id,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber <> 7 THEN '01-' || lpad(CAST(cn.n_nationkey * 5 + l.l_partkey % 5 AS STRING), 7, '0') END AS receiver_id,
  CASE WHEN l.l_returnflag = 'A' AND l.l_linenumber <> 7 THEN '02-' || lpad(CAST(cn.n_nationkey * 4 + o.o_custkey % 4 AS STRING), 7, '0') END AS rusher_id,
  CASE WHEN l.l_returnflag = 'R' THEN 'P.00-' || CAST(cn.n_nationkey * 2 + l.l_suppkey % 2 AS STRING) END AS passer,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber <> 7 THEN 'P.01-' || CAST(cn.n_nationkey * 5 + l.l_partkey % 5 AS STRING) END AS receiver,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber <> 7 THEN 'P.01-' || CAST(cn.n_nationkey * 5 + l.l_partkey % 5 AS STRING) END AS receiver_player_name,
  CASE WHEN l.l_returnflag = 'A' AND l.l_linenumber <> 7 THEN 'P.02-' || CAST(cn.n_nationkey * 4 + o.o_custkey % 4 AS STRING) END AS rusher,
  CASE WHEN l.l_returnflag = 'A' AND round(l.l_tax * 100) <> 0 THEN CASE p.p_size % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'middle' ELSE 'right' END END AS run_location,
  CASE WHEN l.l_returnflag = 'A' AND round(l.l_tax * 100) <> 0 AND p.p_size % 3 <> 1 THEN CASE p.p_partkey % 3 WHEN 0 THEN 'end' WHEN 1 THEN 'tackle' ELSE 'guard' END END AS run_gap,
  CASE WHEN l.l_returnflag = 'R' AND round(l.l_tax * 100) <> 8 THEN CASE p.p_size % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'middle' ELSE 'right' END END AS pass_location,
  CAST(CASE WHEN l.l_linenumber < 7 THEN least(l.l_linenumber, 4) END AS INT) AS down,
  CAST(1 + p.p_size % 20 AS INT) AS ydstogo,
  CAST(1 + l.l_partkey % 99 AS INT) AS yardline_100,
  CAST(l.l_orderkey % 2 AS INT) AS shotgun,
  CAST(CASE WHEN l.l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS INT) AS no_huddle,
  CAST(CASE WHEN l.l_partkey % 99 < 10 THEN 1 ELSE 0 END AS INT) AS goal_to_go,
  CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS INT) AS qb_hit,
  CAST(CASE WHEN l.l_returnflag = 'A' AND l.l_suppkey % 11 = 0 THEN 1 ELSE 0 END AS INT) AS qb_scramble,
  CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_quantity <= 3 THEN 1 ELSE 0 END AS INT) AS sack,
  CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_quantity = 5 THEN 1 ELSE 0 END AS INT) AS interception,
  CAST(CASE WHEN l.l_quantity >= 48 THEN 1 ELSE 0 END AS INT) AS touchdown,
  CAST(CASE WHEN l.l_quantity <= 1 THEN 1 ELSE 0 END AS INT) AS fumble,
  CAST((l.l_orderkey * 37 + l.l_partkey) % 3601 AS INT) AS game_seconds_remaining,
  CAST(((l.l_orderkey * 37 + l.l_partkey) % 3601) % 1801 AS INT) AS half_seconds_remaining,
  CASE WHEN (l.l_orderkey * 37 + l.l_partkey) % 3601 > 1800 THEN 'Half1' ELSE 'Half2' END AS game_half,
  CAST(o.o_custkey % 29 - 14 AS INT) AS score_differential,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'dome' WHEN '2-HIGH' THEN 'closed' WHEN '3-MEDIUM' THEN 'open' WHEN '5-LOW' THEN 'outdoors' END AS roof,
  CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'turf' ELSE 'grass' END AS surface,
  CAST(CASE WHEN o.o_orderpriority = '5-LOW' THEN 20 + o.o_custkey % 70 END AS INT) AS temp,
  CAST(CASE WHEN o.o_orderpriority = '5-LOW' THEN o.o_custkey % 25 END AS INT) AS wind,
  CAST(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS INT) AS pass_attempt,
  CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_quantity > 18 THEN 1 ELSE 0 END AS INT) AS complete_pass,
  CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_quantity <= 18 THEN 1 ELSE 0 END AS INT) AS incomplete_pass,
  CAST(CASE WHEN l.l_linenumber = 3 AND l.l_quantity > 30 THEN 1 ELSE 0 END AS INT) AS third_down_converted,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber <> 6 THEN l.l_quantity - 5 END AS air_yards,
  CASE WHEN l.l_returnflag = 'R' AND l.l_quantity > 18 THEN CAST(p.p_size % 15 AS DOUBLE) END AS yards_after_catch,
  CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_quantity <= 18 THEN 0 ELSE CAST(l.l_quantity AS INT) % 23 - 3 END AS DOUBLE) AS yards_gained,
  CASE WHEN NOT (round(l.l_discount * 100) = 5 AND round(l.l_tax * 100) = 4) THEN (l.l_extendedprice - 53000) / 25000 END AS epa,
  l.l_discount * 10 AS wp, l.l_tax - 0.04 AS wpa
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} cn ON c.c_nationkey = cn.n_nationkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} sn ON s.s_nationkey = sn.n_nationkey
JOIN {part} p ON l.l_partkey = p.p_partkey
"""

ROSTERS_SQL = """
SELECT CAST(1995 + y.step AS INT) AS season, n.n_name AS team,
  k.pre || '-' || lpad(CAST(n.n_nationkey * k.per + i.slot AS STRING), 7, '0') AS gsis_id,
  'Player ' || k.pre || '-' || CAST(n.n_nationkey * k.per + i.slot AS STRING) AS full_name,
  CASE WHEN k.pre = '00' THEN 'QB'
       WHEN k.pre = '01' THEN CASE WHEN i.slot < 3 THEN 'WR' WHEN i.slot = 3 THEN 'TE' ELSE 'RB' END
       ELSE CASE WHEN i.slot < 3 THEN 'RB' ELSE 'QB' END END AS position,
  CAST(68 + i.slot AS INT) AS height, CAST(190 + 5 * i.slot AS INT) AS weight
FROM {nation} n
JOIN (VALUES ('00', 2), ('01', 5), ('02', 4)) AS k(pre, per) ON k.per > 0
JOIN (VALUES (0), (1), (2), (3), (4)) AS i(slot) ON i.slot < k.per
JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) AS y(step) ON y.step >= (n.n_nationkey + i.slot) % 4
WHERE (n.n_nationkey * k.per + i.slot) % 17 <> 16
"""

TEAMS_SQL = """
SELECT n_name AS team_abbr, '#' || lpad(CAST(n_nationkey AS STRING), 6, '0') AS team_color FROM {nation}
"""

_TABLES = ("lineitem", "orders", "customer", "supplier", "nation", "part")


def _derive(spark: SparkSession, folder: str, text: str) -> DataFrame:
    used = [name for name in _TABLES if "{" + name + "}" in text]
    return spark.sql(text, **{name: spark.read.parquet(f"{folder}/{name}.parquet") for name in used})


def plays(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(spark, folder, PLAYS_SQL)


def rosters(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(spark, folder, ROSTERS_SQL)


def teams(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(spark, folder, TEAMS_SQL)


def common_tables(*names: str) -> str:
    """``WITH`` prefix for checking SQL that defines the named derived tables."""
    texts = {"plays": PLAYS_SQL, "rosters": ROSTERS_SQL, "teams": TEAMS_SQL}
    plain = {name: name for name in _TABLES}
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({texts[name].format(**plain)})" for name in names)
