"""Registration of queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardframe.schemas import PLAYS, ROSTERS, TEAMS, check
from yardframe.sources import testdata

# parameters of the analyses, chosen for the derived tables
TEAM = "NATION_0"
SEASON = 2001
SPAN = range(1995, 2000)
ERAS = ((1, 1995, 1995), (2, 1996, 1997), (3, 1998, 1999), (4, 2000, 2000))
MAX_RANK = 10

NUDGE = 1e-10


class Inputs:
    """The derived tables of one folder, built when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def plays(self) -> DataFrame:
        return check(testdata.plays(self.spark, self.folder), PLAYS)

    @cached_property
    def rosters(self) -> DataFrame:
        return check(testdata.rosters(self.spark, self.folder), ROSTERS)

    @cached_property
    def teams(self) -> DataFrame:
        return check(testdata.teams(self.spark, self.folder), TEAMS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def register(name: str, sql: str | None = None, tables: Sequence[str] = ("plays",),
             reals: Sequence[str] = (), places: int = 6, steps: str = ""):
    """Register a query. ``reals`` are rounded to ``places`` on both sides, after a nudge that is
    larger than the noise of a sum's order, so that exact ties round alike.

    ``sql`` is the checking query over ``tables``; ``steps`` holds further WITH members.
    """
    def wrap(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = build(Inputs(spark, folder))
            return result.withColumns({c: F.round(F.col(c) + NUDGE, places) for c in reals}) if reals else result

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            swap = ", ".join(f"round({c} + {NUDGE}, {places}) + 0.0 AS {c}" for c in reals)
            picked = f"SELECT * REPLACE ({swap}) FROM ({sql})" if reals else sql
            members = testdata.common_tables(*tables) + (",\n" + steps.strip().rstrip(",") if steps else "")
            CHECKS[name] = f"{members}\n{picked}"
        return build
    return wrap
