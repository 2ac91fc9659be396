"""Scoring stored predictions and deciding what to publish or refit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kickframe.params import MIN_NEW_MATCHES, SETTLEMENT_WINDOW_DAYS

OUTCOME = {"H": "Home Win", "D": "Draw", "A": "Away Win"}
KEY = ["match_date", "home_team", "away_team"]
PROBS = {"Home Win": "p_home", "Draw": "p_draw", "Away Win": "p_away"}


def outcome_label() -> Column:
    return (
        F.when(F.col("fthg") > F.col("ftag"), "Home Win").when(F.col("fthg") < F.col("ftag"), "Away Win")
        .when(F.col("fthg") == F.col("ftag"), "Draw")
    )


def brier(actual: Column) -> Column:
    total = F.lit(0.0)
    for name, col in PROBS.items():
        total = total + F.pow(F.col(col) - F.when(actual == name, 1.0).otherwise(0.0), F.lit(2.0))
    return total


def log_loss(actual: Column) -> Column:
    p = F.lit(None)
    for name, col in PROBS.items():
        p = F.when(actual == name, F.col(col)).otherwise(p)
    return -F.ln(F.greatest(p, F.lit(1e-15)))


def _joined(predictions: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    # The latest row speaks for a pair that a source lists twice on a day.
    actual = results.groupBy(*key).agg(F.max_by("actual", "match_id").alias("actual"))
    return predictions.join(actual, key, "left")


def _score_aggs() -> list[Column]:
    scored = F.col("actual").isNotNull()
    n = F.count_if(scored)
    hit = F.count_if(scored & (F.col("predicted_outcome") == F.col("actual")))
    err = F.sum(F.when(scored, brier(F.col("actual"))))
    safe = lambda x: F.round(F.when(n > 0, x / n).otherwise(0.0), 4)
    return [safe(hit).alias("accuracy"), safe(err).alias("brier_score"), n.alias("scored_matches"),
            F.count(F.lit(1)).alias("total_predictions")]


def score_predictions(predictions: DataFrame, results: DataFrame) -> DataFrame:
    """Accuracy and Brier score per day; unmatched predictions are not scored."""
    return _joined(predictions, results, KEY).groupBy("match_date").agg(*_score_aggs())


def evaluation_metrics(predictions: DataFrame, results: DataFrame, today: Column, days: int) -> DataFrame:
    """Scores per league and day for the last days up to yesterday; empty ones dropped."""
    recent = F.col("match_date").between(F.date_sub(today, days), F.date_sub(today, 1))
    joined = _joined(predictions.where(recent), results.where(recent), ["league_code", *KEY])
    return joined.groupBy("league_code", "match_date").agg(*_score_aggs()).where(F.col("scored_matches") > 0)


def settlement(predictions: DataFrame, results: DataFrame, today: Column,
               window: int = SETTLEMENT_WINDOW_DAYS) -> DataFrame:
    """Attach results once, to unsettled predictions of the last days.

    Settled rows are never rewritten, so running it twice changes nothing.
    """
    due = F.col("match_date").between(F.date_sub(today, window), F.date_sub(today, 1))
    found = results.where(due).groupBy("league_code", *KEY).agg(F.max_by("actual", "match_id").alias("_found"))
    joined = predictions.join(found, ["league_code", *KEY], "left")
    return joined.withColumns({
        "settled_now": F.col("actual").isNull() & F.col("_found").isNotNull(),
        "actual": F.coalesce("actual", "_found"),
    }).drop("_found")


def rolling_accuracy(settled: DataFrame, window_days: int) -> DataFrame:
    """Daily sums per league and overall, with the trailing window's accuracy.

    Rows are reduced to one per league and day before the window, so a league's
    partition, and that of all leagues, holds at most one row per day.
    """
    hit = F.when(F.col("predicted_outcome") == F.col("actual"), 1).otherwise(0)
    base = settled.where(F.col("actual").isNotNull()).withColumns({
        "_hit": hit, "_brier": brier(F.col("actual")), "_loss": log_loss(F.col("actual"))})
    daily = base.groupBy("match_date", "league_code").agg(
        F.count(F.lit(1)).alias("settled"), F.sum("_hit").alias("correct"),
        F.sum("_brier").alias("brier_sum"), F.sum("_loss").alias("logloss_sum"))
    sums = ["settled", "correct", "brier_sum", "logloss_sum"]
    both = daily.groupingSets([["match_date", "league_code"], ["match_date"]], "match_date", "league_code").agg(
        *[F.sum(c).alias(c) for c in sums]
    ).withColumn("league_code", F.coalesce("league_code", F.lit("_ALL_")))
    trailing = Window.partitionBy("league_code").orderBy(F.unix_date("match_date")).rangeBetween(-(window_days - 1), 0)
    total = lambda c: F.sum(c).over(trailing)
    return both.withColumns({
        "window_accuracy": total("correct") / total("settled"),
        "window_brier": total("brier_sum") / total("settled"),
        "window_logloss": total("logloss_sum") / total("settled"),
    })


def new_match_count(matches: DataFrame, last_trained: Column) -> DataFrame:
    """Matches newer than the cut-off; all of them when never trained."""
    newer = F.when(last_trained.isNull(), True).otherwise(F.col("match_date") > last_trained)
    return matches.agg(F.count_if(newer).alias("new_matches"))


def retrain_decision(models: DataFrame, matches: DataFrame, threshold: int = MIN_NEW_MATCHES,
                     enabled: bool = True) -> DataFrame:
    """Whether each model should be refitted, and why; rules in fixed order.

    `models` has one row per model: model, model_exists, last_trained. Matches
    are counted per day first; models are placed among the days and take the sum
    of the later ones, so the window holds one row per calendar day and model.
    """
    days = matches.where(F.col("match_date").isNotNull()).groupBy("match_date").agg(F.count(F.lit(1)).alias("n"))
    latest = days.agg(F.max("match_date")).scalar()
    later = Window.orderBy(F.col("_d").desc()).rangeBetween(Window.unboundedPreceding, -1)
    placed = models.select("*", F.unix_date("last_trained").alias("_d"), F.lit(0).cast("bigint").alias("n")).unionByName(
        days.select(F.unix_date("match_date").alias("_d"), "n"), allowMissingColumns=True)
    counted = F.when(F.col("_d").isNotNull(), F.sum("n").over(later))
    newer = (
        placed.withColumn("new_matches", F.coalesce(counted, F.lit(0))).where(F.col("model").isNotNull())
        .drop("_d", "n").withColumn("latest", latest)
    )
    has_new = F.col("latest").isNotNull() & (F.col("last_trained").isNull() | (F.col("latest") > F.col("last_trained")))
    # The numbers behind a code are columns of their own.
    rules = [
        (F.lit(not enabled), False, "off"),
        (~F.col("model_exists"), True, "no_model"),
        (F.col("last_trained").isNull(), True, "undated_model"),
        (F.col("latest").isNull(), True, "undated_data"),
        (~has_new, False, "nothing_newer"),
        (F.col("new_matches") < threshold, False, "too_few"),
        (F.lit(True), True, "enough"),
    ]
    refit, reason = F.when(F.lit(False), False), F.when(F.lit(False), "")
    for condition, verdict, code in rules:
        refit, reason = refit.when(condition, F.lit(verdict)), reason.when(condition, F.lit(code))
    return newer.withColumns({"has_new_data": has_new, "should_retrain": refit, "reason": reason, "threshold": F.lit(threshold)})


def served_dates(predictions: DataFrame, served: DataFrame) -> DataFrame:
    """Distinct prediction dates of served leagues, in order."""
    return predictions.join(served, "league_code", "left_semi").select("match_date").distinct().orderBy("match_date")


def history_query(matches: DataFrame, leagues: list[str], known: set[str]) -> DataFrame:
    """Finished matches of the asked leagues; an unknown code is an error."""
    unknown = sorted(set(leagues) - known)
    if unknown:
        raise ValueError(f"unknown league codes: {', '.join(unknown)}")
    return matches.where(F.col("league_code").isin(sorted(set(leagues)))).where(
        F.col("fthg").isNotNull() & F.col("ftag").isNotNull())
