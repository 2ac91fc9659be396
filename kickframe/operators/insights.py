"""Team and head-to-head profiles.

Last-n statistics rank rows newest first and keep n; Spark prunes each key to n
rows before the shuffle, so a hot team costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kickframe.operators.features import team_matches
from kickframe.params import INSIGHTS, InsightParams

OWN = {"cards_y": ("hy", "ay"), "cards_r": ("hr", "ar")}


def team_rows(matches: DataFrame) -> DataFrame:
    """Team-match records with own shots, corners and cards and the outcome."""
    extra = [(name, lambda home, c=cols: F.col(c[0] if home else c[1])) for name, cols in OWN.items()]
    extra.append(("league_code", lambda home: F.col("league_code")))
    rows = team_matches(matches, stats=("gf", "ga", "shots", "sot", "corners"), extra=extra)
    won, drew = F.col("gf") > F.col("ga"), F.col("gf") == F.col("ga")
    return rows.where(F.col("gf").isNotNull() & F.col("ga").isNotNull()).withColumns({
        "letter": F.when(won, "W").when(drew, "D").otherwise("L"),
        "points": F.when(won, 3).when(drew, 1).otherwise(0),
    })


def _record_aggs() -> list[Column]:
    count = lambda cond: F.count_if(cond)
    return [
        F.count(F.lit(1)).alias("played"),
        count(F.col("letter") == "W").alias("wins"),
        count(F.col("letter") == "D").alias("draws"),
        count(F.col("letter") == "L").alias("losses"),
        F.sum("gf").alias("goals_for"),
        F.sum("ga").alias("goals_against"),
        F.sum("points").alias("points"),
    ]


def _per_game(df: DataFrame) -> DataFrame:
    ratio = lambda c: F.col(c) / F.col("played")
    return df.withColumns({
        "points_per_game": ratio("points"), "win_pct": ratio("wins"), "draw_pct": ratio("draws"),
        "loss_pct": ratio("losses"), "avg_goals_for": ratio("goals_for"),
        "avg_goals_against": ratio("goals_against"),
        "goal_difference": F.col("goals_for") - F.col("goals_against"),
    })


def team_record(matches: DataFrame) -> DataFrame:
    """Win/draw/loss record per team: overall, at home and away, in one pass."""
    rows = team_rows(matches).withColumn("venue", F.when(F.col("is_home"), "home").otherwise("away"))
    # Venue totals first, then their sum: the overall row needs no second scan.
    venues = rows.groupBy("team", "venue").agg(*_record_aggs())
    names = ["played", "wins", "draws", "losses", "goals_for", "goals_against", "points"]
    both = venues.groupingSets([["team", "venue"], ["team"]], "team", "venue").agg(
        *[F.sum(n).alias(n) for n in names]
    )
    return _per_game(both.withColumn("venue", F.coalesce("venue", F.lit("overall"))))


def recent_rows(matches: DataFrame, n: int) -> DataFrame:
    """The last n records of each team with their recency rank."""
    newest = Window.partitionBy("team").orderBy(F.col("match_date").desc(), F.col("match_id").desc())
    return team_rows(matches).withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def _form(length: int) -> Column:
    letters = F.sort_array(F.collect_list(F.when(F.col("recency") <= length, F.struct("recency", "letter"))))
    return F.array_join(F.transform(letters, lambda s: s["letter"]), "").alias("form")


def _rates() -> list[Column]:
    share = lambda cond: (F.count_if(cond) / F.count(F.lit(1)))
    return [
        share(F.col("ga") == 0).alias("clean_sheets"),
        share(F.col("gf") == 0).alias("failed_to_score"),
        share((F.col("gf") > 0) & (F.col("ga") > 0)).alias("btts"),
        share(F.col("gf") + F.col("ga") > 2.5).alias("over_25"),
    ]


def _averages() -> list[Column]:
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return [
        mean(F.col("shots")).alias("avg_shots"), mean(F.col("sot")).alias("avg_sot"),
        mean(F.col("corners")).alias("avg_corners"),
        mean(F.col("cards_y") + F.col("cards_r")).alias("avg_cards"),
    ]


def recent_form(matches: DataFrame, p: InsightParams = INSIGHTS) -> DataFrame:
    """Record over the last matches and the form letters, newest first."""
    recent = recent_rows(matches, p.recent_matches)
    return _per_game(recent.groupBy("team").agg(*_record_aggs(), _form(p.form_length)))


def team_rates(matches: DataFrame, p: InsightParams = INSIGHTS) -> DataFrame:
    return recent_rows(matches, p.recent_matches).groupBy("team").agg(*_rates())


def team_averages(matches: DataFrame, p: InsightParams = INSIGHTS) -> DataFrame:
    """Own-side averages; a match with a missing part is left out of that one."""
    return recent_rows(matches, p.recent_matches).groupBy("team").agg(*_averages())


def team_profile(matches: DataFrame, p: InsightParams = INSIGHTS) -> DataFrame:
    """Recent record, form, rates and averages of every team in one pass."""
    recent = recent_rows(matches, p.recent_matches)
    return _per_game(recent.groupBy("team").agg(
        *_record_aggs(), _form(p.form_length), *_rates(), *_averages()))


def head_to_head(matches: DataFrame, p: InsightParams = INSIGHTS) -> DataFrame:
    """All meetings of each pair from either side, with the latest ones listed.

    `home_team` is the side whose view is taken, wherever the match was played.
    """
    rows = team_rows(matches)
    totals = rows.groupBy("team", "opponent").agg(
        F.count(F.lit(1)).alias("played"),
        F.count_if(F.col("letter") == "W").alias("home_wins"),
        F.count_if(F.col("letter") == "D").alias("draws"),
        F.count_if(F.col("letter") == "L").alias("away_wins"),
        F.sum("gf").alias("home_goals"), F.sum("ga").alias("away_goals"),
        F.count_if((F.col("gf") > 0) & (F.col("ga") > 0)).alias("btts_count"),
        F.count_if(F.col("gf") + F.col("ga") > 2.5).alias("over_25_count"),
    )
    newest = Window.partitionBy("team", "opponent").orderBy(F.col("match_date").desc(), F.col("match_id").desc())
    line = F.concat_ws(
        " ", F.date_format("match_date", "dd/MM/yyyy"),
        F.when(F.col("is_home"), "home").otherwise("away"),
        F.concat_ws("-", F.col("gf").cast("string"), F.col("ga").cast("string")), "letter",
    )
    listed = (
        rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= p.h2h_matches)
        .groupBy("team", "opponent")
        .agg(F.sort_array(F.collect_list(F.struct("_rn", line.alias("line")))).alias("l"))
        .select("team", "opponent", F.array_join(F.transform("l", lambda s: s["line"]), "; ").alias("meetings"))
    )
    per = lambda c: F.col(c) / F.col("played")
    return (
        totals.join(listed, ["team", "opponent"])
        .withColumns({
            "avg_goals_home": per("home_goals"), "avg_goals_away": per("away_goals"),
            "avg_goals_total": (F.col("home_goals") + F.col("away_goals")) / F.col("played"),
            "btts_pct": per("btts_count"), "over_25_pct": per("over_25_count"),
        })
        .withColumnsRenamed({"team": "home_team", "opponent": "away_team"})
    )


def league_average_goals(matches: DataFrame, p: InsightParams = INSIGHTS) -> DataFrame:
    """Mean goals per side in each league."""
    means = (F.avg("fthg") + F.avg("ftag")) / F.lit(2.0)
    return matches.groupBy("league_code").agg(
        F.coalesce(means, F.lit(p.fallback_goals)).alias("league_avg")
    )


def team_stats(matches: DataFrame, p: InsightParams = INSIGHTS) -> DataFrame:
    """Recent goal averages per venue and recent overall statistics."""
    n = p.recent_matches
    rows = team_rows(matches)
    order = [F.col("match_date").desc(), F.col("match_id").desc()]
    at_venue = (
        rows.withColumn("_rn", F.row_number().over(Window.partitionBy("team", "is_home").orderBy(*order)))
        .where(F.col("_rn") <= n).groupBy("team")
    )
    mean = lambda home, c: F.coalesce(F.avg(F.when(F.col("is_home") == home, F.col(c))), F.lit(0.0))
    venue = at_venue.agg(
        mean(True, "gf").alias("avg_goals_scored_home"), mean(True, "ga").alias("avg_goals_conceded_home"),
        mean(False, "gf").alias("avg_goals_scored_away"), mean(False, "ga").alias("avg_goals_conceded_away"),
    )
    overall = recent_rows(matches, n).groupBy("team").agg(
        F.count(F.lit(1)).alias("matches_played"), *_averages()[:3], *[x for x in _rates() if True],
        (F.sum("points") / F.count(F.lit(1))).alias("form_points"),
    ).drop("failed_to_score")
    return venue.join(overall, "team")


def match_insights(fixtures: DataFrame, h2h: DataFrame, profiles: DataFrame, markets: DataFrame) -> DataFrame:
    """Fixture view: head-to-head, both profiles and goal markets side by side."""
    def side(prefix: str) -> DataFrame:
        cols = ["points_per_game", "form", "btts", "over_25", "avg_shots"]
        return profiles.select(F.col("team").alias(f"{prefix}_team"),
                               *[F.col(c).alias(f"{prefix}_{c}") for c in cols])

    meet = h2h.select("home_team", "away_team", "played", "home_wins", "draws", "away_wins")
    return (
        fixtures.join(meet, ["home_team", "away_team"], "left")
        .join(side("home"), "home_team", "left").join(side("away"), "away_team", "left")
        .join(markets, "match_id", "left")
        .na.fill(0, ["played", "home_wins", "draws", "away_wins"])
    )
