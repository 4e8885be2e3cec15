"""Plays, rosters and teams as Parquet tables.

Plays are stored partitioned by ``season``, so a season filter reads only its folders.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardframe.operators.joins import fits_broadcast, settle
from yardframe.schemas import PLAYS, ROSTERS, TEAMS


def scan_plays(spark: SparkSession, path: str, seasons: Iterable[int] | None = None) -> DataFrame:
    plays = spark.read.schema(PLAYS).parquet(path)
    return plays if seasons is None else in_seasons(plays, seasons)


def scan_rosters(spark: SparkSession, path: str, seasons: Iterable[int] | None = None) -> DataFrame:
    rosters = spark.read.schema(ROSTERS).parquet(path)
    return rosters if seasons is None else in_seasons(rosters, seasons)


def scan_teams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEAMS).parquet(path)


def in_seasons(df: DataFrame, seasons: Iterable[int]) -> DataFrame:
    """Keep the given seasons; a run of years becomes one range test."""
    years = sorted(set(seasons))
    if not years:
        return df.filter(F.lit(False))
    if years[-1] - years[0] + 1 == len(years):
        return df.filter(F.col("season").between(years[0], years[-1]))
    return df.filter(F.col("season").isin(years))


def missing_games(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``incoming`` whose game the store does not hold yet."""
    held = settle(existing.select("game_id").distinct())
    if fits_broadcast(held):
        held = F.broadcast(held)
    return incoming.join(held, "game_id", "left_anti")


STAGED = "_staged"  # inside the store; Spark does not read folders whose names begin with an underscore


def append_new_games(incoming: DataFrame, path: str) -> None:
    """Add the missing games to the play store; a second run with the same input adds nothing.

    Rows are written to a staging folder first, whose success mark Spark sets when all files are whole; then the files
    move into their seasons. A run that fails while writing leaves no rows in the store, and one that fails
    while files move is completed by the next run before games are compared, so no game stays cut. One run at a time.
    The rebalance step gathers a season's rows into files of the advisory partition size and splits
    a season that holds more.
    """
    spark = incoming.sparkSession
    names = [field.name for field in PLAYS if field.name in incoming.columns]
    rows = incoming.select(names)
    finish_staged(spark, path)
    if _has_rows_at(spark, path):
        # only the folders of incoming seasons are read; there is one season a year
        seasons = [r["season"] for r in rows.select("season").distinct().collect()]
        stored = spark.read.parquet(path).select("season", "game_id")
        rows = missing_games(rows, in_seasons(stored, [s for s in seasons if s is not None])
                             if None not in seasons else stored)
    (rows.hint("rebalance", F.col("season"))
         .write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
         .partitionBy("season").parquet(f"{path}/{STAGED}"))
    finish_staged(spark, path)


def finish_staged(spark: SparkSession, path: str) -> None:
    """Move the files of a whole staged batch into the store; a batch without success mark is left to be overwritten."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    staged = folder(f"{path}/{STAGED}")
    system = staged.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder(staged, "_SUCCESS")):
        return
    files = system.listFiles(staged, True)
    while files.hasNext():
        file = files.next().getPath()
        if file.getName().startswith(("_", ".")):
            continue
        season = folder(path, file.getParent().getName())
        system.mkdirs(season)
        if not system.rename(file, folder(season, file.getName())):
            raise OSError(f"{file} could not be moved into {season}")
    system.delete(staged, True)


def _has_rows_at(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(hadoop_path) and any(not f.getPath().getName().startswith(("_", ".")) for f in system.listStatus(hadoop_path))
