"""Completion model and expected rushing yards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardframe.functions.nulls import null_fill, row_count, strict_mean, without_nulls
from yardframe.functions.text import decode_player_ids, unite
from yardframe.models.design import Factor, Numeric, Term
from yardframe.models.linear import (
    LinearFit, LogisticFit, breusch_pagan, fit_linear, fit_logistic, predict, rmse,
    robust_covariance, score_logistic, trend_line,
)
from yardframe.models.resample import stratified_split
from yardframe.operators.joins import lookup_join, settle
from yardframe.operators.rows import first_per_key
from yardframe.plans.strength import defense_strength_split, with_defense_strength
from yardframe.sources.tables import in_seasons

COMPLETION_TERMS = (
    Factor("posteam_type"), Factor("shotgun"), Factor("no_huddle"), Factor("pass_location"),
    Numeric("air_yards"), Numeric("def_strength"),
)


def completion_rows(plays: DataFrame, seasons: Sequence[int]) -> DataFrame:
    """Regular-season pass attempts with the defence's strength in that season."""
    attempts = in_seasons(
        plays.filter((F.col("season_type") == "REG") & (F.col("pass_attempt") == 1)), seasons)
    return with_defense_strength(attempts)


def completion_score(plays: DataFrame, seasons: Sequence[int], terms: Sequence[Term] = COMPLETION_TERMS
                     ) -> tuple[DataFrame, LogisticFit]:
    """Every pass attempt with its completion log-odds, probability and completion over expected."""
    rows = completion_rows(plays, seasons)
    fit = fit_logistic(rows, F.col("complete_pass"), terms)
    scored = score_logistic(rows, fit, "cpoe_link", "expected_completion")
    return scored.withColumn("cpoe", F.col("complete_pass") - F.col("expected_completion")), fit


# fixed values: era number with its first and last season; later seasons are era 5
ERAS = ((1, 1999, 2001), (2, 2002, 2005), (3, 2006, 2013), (4, 2014, 2017))
LAST_ERA = 5


def era_of(season: Column, eras: Sequence[tuple[int, int, int]] = ERAS, last: int = LAST_ERA) -> Column:
    era = None
    for number, start, end in eras:
        test = season.between(start, end)
        era = F.when(test, F.lit(number)) if era is None else era.when(test, F.lit(number))
    return era.otherwise(F.lit(last))


RUSH_COLUMNS = (
    "rusher_id", "posteam_type", "posteam", "defteam", "yardline_100", "half_seconds_remaining",
    "game_half", "down", "ydstogo", "era", "shotgun", "no_huddle", "run_gap",
    "score_differential", "season", "roof", "yards_gained",
)


def expected_rush_rows(plays: DataFrame, eras: Sequence[tuple[int, int, int]] = ERAS) -> DataFrame:
    """Runs with era, gap (``Other`` where none) and the defence's pass and run strength."""
    runs = without_nulls(
        plays.filter(F.col("play_type") == "run")
        .withColumn("era", era_of(F.col("season"), eras))
        .withColumn("run_gap", null_fill("run_gap", "Other"))
        .select("game_id", "play_id", *RUSH_COLUMNS),
        ["yardline_100", "down", "roof"])
    return lookup_join(unite(runs, "def_season", ["defteam", "season"]),
                       settle(defense_strength_split(plays)), "def_season")


RUSH_TERMS = (
    Factor("posteam_type"), Numeric("asinh_yardline", "asinh(yardline_100)"), Factor("down"),
    Numeric("ydstogo"), Factor("shotgun"), Factor("run_gap"),
    Numeric("asinh_score", "asinh(score_differential)"), Factor("roof"), Factor("era"),
    Numeric("def_strength_pass"), Numeric("def_strength_run"),
)


def back_transform(prediction: Column, inverse: str = "exp") -> Column:
    """Yards from the modelled scale: ``exp`` as the analysis has it, or the true inverse ``sinh``."""
    return {"exp": F.exp, "sinh": F.sinh}[inverse](prediction)


@dataclass(frozen=True)
class ExpectedRush:
    """The fit, the scored validation rows and the diagnostics; ``release`` drops the kept rows."""
    rows: DataFrame
    fit: LinearFit
    validation: DataFrame
    rmse: float
    heteroskedasticity: dict[str, float]
    coefficients: DataFrame
    robust_coefficients: DataFrame

    def release(self) -> None:
        self.rows.unpersist()


def expected_rush_model(rows: DataFrame, share: float = 0.7, seed: int = 123,
                        inverse: str = "exp", terms: Sequence[Term] = RUSH_TERMS) -> ExpectedRush:
    """Fit on a stratified share of the rows, score the rest and test the residual variance."""
    spark = rows.sparkSession
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    split = stratified_split(rows, "yards_gained", ["game_id", "play_id"], share, seed)
    train, held_out = split.filter("in_train"), split.filter(~F.col("in_train"))
    outcome = F.asinh("yards_gained")
    fit = fit_linear(train, outcome, terms)
    scored = with_rush_prediction(held_out, fit, inverse).withColumns({
        "over_pred": F.col("yards_gained") - F.col("pred"),
        "asinh_yards_gained": F.asinh("yards_gained"),
    })
    return ExpectedRush(
        rows, fit, scored,
        rmse(scored, "exp_pred", "yards_gained").first()["rmse"],
        breusch_pagan(train, outcome, fit),
        fit.summary(spark),
        fit.summary(spark, robust_covariance(train, outcome, fit)))


def with_rush_prediction(rows: DataFrame, fit: LinearFit, inverse: str = "exp") -> DataFrame:
    return predict(rows, fit, "pred").withColumn("exp_pred", back_transform(F.col("pred"), inverse))


def feed_predicted_actual(scored: DataFrame) -> DataFrame:
    """Points of predicted against actual yards."""
    return scored.select(F.col("exp_pred").alias("x"), F.col("yards_gained").alias("y"))


def with_trend(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``line``, the least-squares line at each point, and ``line_error``, its standard error;
    t times the error is the half width of the confidence band."""
    fitted = trend_line(points, x, y).first()  # one row

    def part(name: str) -> Column:
        return F.lit(fitted[name]).cast("double")
    gap = F.col(x) - part("mean_x")
    return points.withColumns({
        "line": part("intercept") + part("slope") * F.col(x),
        "line_error": part("sigma") * F.sqrt(1.0 / part("n") + gap * gap / part("sxx"))})


def feed_with_line(model: ExpectedRush) -> DataFrame:
    """The validation points of the fit, predicted against actual, with their trend line."""
    return with_trend(feed_predicted_actual(model.validation))


def rusher_board(model: ExpectedRush, rosters: DataFrame, inverse: str = "exp", min_carries: int = 20) -> DataFrame:
    """Rushers over expected, with every run scored by the fit."""
    return rusher_over_expected(with_rush_prediction(model.rows, model.fit, inverse), rosters, min_carries=min_carries)


def first_roster_rows(rosters: DataFrame) -> DataFrame:
    """Each player's first roster row; its season is the rookie year."""
    first = first_per_key(
        rosters.select("season", "gsis_id", "full_name", "position", "height", "weight"),
        ["gsis_id"], [F.col("season"), F.col("full_name"), F.col("position")])
    return first.withColumnRenamed("season", "rookie_year")


def rusher_over_expected(scored: DataFrame, rosters: DataFrame, predicted: str = "exp_pred",
                         min_carries: int = 20) -> DataFrame:
    """Rushers by season and team with actual against expected yards per carry."""
    leaders = (
        decode_player_ids(scored)
        .groupBy("rusher_id", "season", "posteam")
        .agg(row_count().alias("carries"),
             strict_mean(predicted).alias("expected_ypa"),
             strict_mean("yards_gained").alias("actual_ypa"))
        .withColumn("avg_diff", F.col("actual_ypa") - F.col("expected_ypa"))
        .withColumns({"expected_total_yards": F.col("carries") * F.col("expected_ypa"),
                      "actual_total_yards": F.col("carries") * F.col("actual_ypa")})
        .withColumn("total_diff", F.col("actual_total_yards") - F.col("expected_total_yards"))
        .filter(F.col("rusher_id").isNotNull() & (F.col("carries") >= min_carries))
    )
    named = lookup_join(leaders, settle(first_roster_rows(rosters)), {"rusher_id": "gsis_id"},
                        null_safe=True, salt_on=["season", "posteam"])
    return named.withColumn("years_in_league", F.col("season") - F.col("rookie_year"))
