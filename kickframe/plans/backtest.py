"""Rolling-origin backtests of the cross-league predictor."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.functions.seasons import start_year
from kickframe.operators import goals as gl
from kickframe.operators import ratings as rt
from kickframe.operators import scoring as sc
from kickframe.operators.features import encoded_result
from kickframe.params import CALIBRATION_DRAW_RATE, CROSS, SCORES, CrossLeagueParams, ScoreParams
from kickframe.plans.dixoncoles import dc_fit_before
from kickframe.session import stage


def season_folds(matches: DataFrame, p: CrossLeagueParams = CROSS) -> DataFrame:
    """The last seasons present, one fold each: [cut, cut + 1 year)."""
    years = matches.select(start_year("match_date", p.season_start_month).alias("season_start")).distinct()
    last = years.where(F.col("season_start").isNotNull()).orderBy(F.col("season_start").desc()).limit(p.holdout_seasons)
    cut = F.make_date("season_start", F.lit(p.season_start_month), F.lit(1))
    return last.withColumns({"cut": cut, "end": F.add_months(cut, 12)})


def holdout_gate(matches: DataFrame, supplementary: DataFrame, fold, p: CrossLeagueParams = CROSS) -> tuple[DataFrame, DataFrame]:
    """(training rows, gated holdout) of a fold; counts come from training rows only."""
    train = matches.where(F.col("match_date") < F.lit(fold.cut))
    held = supplementary.where((F.col("match_date") >= F.lit(fold.cut)) & (F.col("match_date") < F.lit(fold.end)))
    counts = gl.match_counts(train)
    return train, gl.refusal_reason(held, counts.select("team"), counts, p)


def rolling_origin(domestic: DataFrame, supplementary: DataFrame, p: CrossLeagueParams = CROSS,
                   scores: ScoreParams = SCORES, max_iter: int = 100) -> tuple[DataFrame, DataFrame]:
    """(held-out rows with both legs, one summary row per fold).

    One rating walk serves every fold, since ratings are recorded before each
    match. The score models of all folds, each on the rows before its cut, are fitted
    together. A fold below the minimum contributes nothing and says so.
    """
    spark = domestic.sparkSession
    cols = ["match_id", "match_date", "home_team", "away_team", "fthg", "ftag"]
    combined = domestic.select(*cols).unionByName(supplementary.select(*cols))
    walked = rt.shared_walk(domestic, supplementary).where("source = 'supplementary'").select("match_id", "elo_expected_home")
    rated = stage(supplementary.select(*cols).join(walked, "match_id"), "rated")
    rows, summary, gated = None, [], []
    for fold in season_folds(supplementary, p).orderBy("season_start").collect():
        _, held = holdout_gate(combined, rated, fold, p)
        held = stage(held, "held")
        kept, refused = held.agg(F.count_if(F.col("refusal").isNull()), F.count_if(F.col("refusal").isNotNull())).first()
        counted = kept if kept >= p.min_holdout_matches else 0
        summary.append((fold.season_start, counted, refused))
        if counted:
            gated.append((fold, held))
    models = dc_fit_before(combined, [fold.cut for fold, _ in gated], scores, max_iter) if gated else {}
    for i, (fold, held) in enumerate(gated):
        model = models[i]
        rates = gl.dc_rates(held.where(F.col("refusal").isNull()), model.strengths(spark), F.lit(model.home_advantage))
        priced = gl.goal_markets(rates, model.rho, scores)
        part = priced.select(
            "match_id", "match_date", F.lit(fold.season_start).alias("season_start"), "elo_expected_home",
            F.col("away_win").alias("q_away"), F.col("draw").alias("q_draw"), F.col("home_win").alias("q_home"),
            encoded_result().alias("label"))
        rows = part if rows is None else rows.unionByName(part)
    folds = spark.createDataFrame(summary, "season_start int, evaluated bigint, refused bigint")
    return rows, folds


def calibration_effect(domestic: DataFrame, supplementary: DataFrame, draw_rate: float = CALIBRATION_DRAW_RATE) -> DataFrame:
    """The same cross-league matches scored under linked and isolated ratings."""
    cols = ["match_id", "match_date", "home_team", "away_team", "fthg", "ftag"]
    linked = rt.elo_final(rt.both_corpora(domestic, supplementary))
    isolated = rt.elo_final(domestic)
    out = None
    for name, ratings in (("linked", linked), ("isolated", isolated)):
        predicted = gl.cross_league_predict(supplementary.select(*cols), ratings, p=replace(CROSS, draw_rate=draw_rate))
        scored = predicted.select(
            encoded_result().alias("label"), F.col("away_win").alias("p_away"), F.col("draw").alias("p_draw"),
            F.col("home_win").alias("p_home"))
        part = sc.metrics_1x2(scored).withColumn("ratings", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
