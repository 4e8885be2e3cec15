"""Stores, schemas and the refresh of the play store."""

import pytest

from yardframe.schemas import PLAYS, ROSTERS, check
from yardframe.sources import testdata
from yardframe.sources.tables import STAGED, append_new_games, in_seasons, scan_plays, scan_rosters

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plays(spark):
    return testdata.plays(spark, FOLDER).cache()


def test_refresh_adds_each_game_once(spark, plays, tmp_path):
    path = str(tmp_path / "plays")
    append_new_games(plays.filter("substr(game_id, 1, 4) <= '1997'"), path)
    before = scan_plays(spark, path).count()
    append_new_games(plays, path)
    append_new_games(plays, path)
    stored = scan_plays(spark, path)
    assert 0 < before < stored.count() == plays.count()
    assert stored.select("game_id", "play_id").distinct().count() == plays.count()


def test_season_filter_reads_only_its_folders(spark, plays, tmp_path):
    path = str(tmp_path / "plays")
    append_new_games(plays, path)
    one = scan_plays(spark, path, [2001]).select("epa")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    assert "ReadSchema: struct<epa:double>" in plan
    assert one.count() == plays.filter("season = 2001").count()


def test_seasons_as_range_and_as_list(plays):
    assert in_seasons(plays, [1996, 1997]).count() == plays.filter("season IN (1996, 1997)").count()
    assert in_seasons(plays, [1996, 1999]).count() == plays.filter("season IN (1996, 1999)").count()
    assert in_seasons(plays, []).count() == 0


def test_rosters_round_trip(spark, tmp_path):
    path = str(tmp_path / "rosters")
    testdata.rosters(spark, FOLDER).write.parquet(path)
    assert scan_rosters(spark, path, range(1995, 1997)).count() == \
        testdata.rosters(spark, FOLDER).filter("season < 1997").count()


def test_schema_check_names_the_column(spark, plays):
    assert check(plays, PLAYS) is plays
    with pytest.raises(ValueError, match="gsis_id: expected string, found nothing"):
        check(testdata.rosters(spark, FOLDER).drop("gsis_id"), ROSTERS)


def _write_staged(rows, path):
    rows.write.mode("overwrite").partitionBy("season").parquet(f"{path}/{STAGED}")


def test_refresh_that_fails_while_writing_leaves_no_rows(spark, plays, tmp_path):
    path = str(tmp_path / "store")
    append_new_games(plays.filter("substr(game_id, 1, 4) <= '1997'"), path)
    before = scan_plays(spark, path).count()
    _write_staged(plays.filter("substr(game_id, 1, 4) > '1997'").limit(5), path)
    (tmp_path / "store" / STAGED / "_SUCCESS").unlink()  # as if the run had ended before its last file
    assert scan_plays(spark, path).count() == before
    append_new_games(plays, path)
    assert scan_plays(spark, path).count() == plays.count()
    assert not (tmp_path / "store" / STAGED).exists()


def test_refresh_that_fails_while_files_move_is_completed(spark, plays, tmp_path):
    store = tmp_path / "store"
    append_new_games(plays.filter("substr(game_id, 1, 4) <= '1997'"), str(store))
    _write_staged(plays.filter("substr(game_id, 1, 4) > '1997'").repartition(4), str(store))
    for file in sorted((store / STAGED).glob("season=*/*.parquet"))[::2]:  # half of the files have moved, games are cut
        (store / file.parent.name).mkdir(exist_ok=True)
        file.rename(store / file.parent.name / file.name)
    assert scan_plays(spark, str(store)).count() < plays.count()
    append_new_games(plays, str(store))
    assert scan_plays(spark, str(store)).count() == plays.count()
    append_new_games(plays, str(store))
    assert scan_plays(spark, str(store)).count() == plays.count()


def test_refresh_of_nothing(spark, plays, tmp_path):
    path = str(tmp_path / "store")
    append_new_games(plays.limit(0), path)
    assert scan_plays(spark, path).count() == 0
    append_new_games(plays, path)
    assert scan_plays(spark, path).count() == plays.count()
