"""Bookmaker odds: aggregation, value, divergence, pairing by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.functions.probability import confidence_band, implied_triple, kelly
from kickframe.params import VALUE, ValueParams

OUTCOMES = (("Home Win", "home"), ("Draw", "draw"), ("Away Win", "away"))
SIDES = ("home", "draw", "away")
LABELS = {"home": "h", "draw": "d", "away": "a"}


def implied_probs(quotes: DataFrame) -> DataFrame:
    """Normalised implied probabilities of every quote."""
    triple = implied_triple(*[F.col(f"odds_{s}") for s in SIDES])
    return quotes.withColumns({f"prob_{s}": c for s, c in zip(SIDES, triple)})


def aggregate_odds(quotes: DataFrame) -> DataFrame:
    """Mean and best price over priced sources, mean probability over all.

    Averages combine map-side, so a match quoted by very many sources costs one
    partial row per task.
    """
    aggs = [F.count(F.lit(1)).alias("sources")]
    for s in SIDES:
        priced = F.when(F.col(f"odds_{s}") > 0, F.col(f"odds_{s}"))
        aggs += [
            F.coalesce(F.avg(priced), F.lit(0.0)).alias(f"avg_{s}"),
            F.coalesce(F.max(priced), F.lit(0.0)).alias(f"best_{s}"),
            F.avg(f"prob_{s}").alias(f"raw_{s}"),
            F.stddev_pop(f"prob_{s}").alias(f"std_{s}"),
        ]
    out = implied_probs(quotes).groupBy("match_id").agg(*aggs)
    total = F.col("raw_home") + F.col("raw_draw") + F.col("raw_away")
    return out.withColumns({
        f"prob_{s}": F.when(total > 0, F.col(f"raw_{s}") / total).otherwise(F.col(f"raw_{s}")) for s in SIDES
    })


def best_source(quotes: DataFrame, position: str = "source") -> DataFrame:
    """The source with the best positive price per outcome, first on ties."""
    aggs = []
    for s in SIDES:
        price = F.col(f"odds_{s}")
        rank = F.when(price > 0, F.struct((-price).alias("p"), F.col(position).alias("q")))
        aggs.append(F.coalesce(F.min_by("source", rank), F.lit("")).alias(f"source_{s}"))
    return quotes.groupBy("match_id").agg(*aggs)


def value_bets(predictions: DataFrame, odds: DataFrame, sources: DataFrame | None = None,
               p: ValueParams = VALUE) -> DataFrame:
    """One row per outcome whose model probability beats the market by the edge.

    `predictions` carry match_id and p_home/p_draw/p_away. Sort by `edge` where
    a ranked report is wanted; the operator itself keeps rows distributed.
    """
    joined = predictions.join(odds, "match_id")
    if sources is not None:
        joined = joined.join(sources, "match_id")
    rows = F.array(*[
        F.struct(
            F.lit(label).alias("outcome"), F.col(f"p_{s}").alias("model_prob"),
            F.col(f"prob_{s}").alias("market_prob"), F.col(f"best_{s}").alias("best_odds"),
            (F.col(f"source_{s}") if sources is not None else F.lit("")).alias("best_source"),
        ) for label, s in OUTCOMES
    ])
    bets = joined.select("match_id", F.explode(rows).alias("b")).select("match_id", "b.*")
    bets = bets.where((F.col("market_prob") > 0) & (F.col("best_odds") > 1.0))
    bets = bets.withColumn("edge", F.col("model_prob") - F.col("market_prob"))
    return kelly_confidence(bets.where(F.col("edge") >= p.min_edge), p)


def kelly_confidence(bets: DataFrame, p: ValueParams = VALUE) -> DataFrame:
    """Stake fraction, confidence band and the lowest price still of value."""
    prob = F.col("model_prob")
    return bets.withColumns({
        "kelly_fraction": kelly(prob, F.col("best_odds"), p.kelly_cap),
        "confidence": confidence_band(F.col("edge"), prob),
        "min_value_odds": F.round(F.lit(1.0) / F.when(prob > 0, prob), 2),
    })


def substrings(name: Column) -> Column:
    """Every non-empty substring of a short name."""
    n = F.length(name)
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(name, i, k)),
    )))


def containing_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (scope, l, r) of distinct names where one contains the other.

    Each longer name is expanded to its substrings, which turns containment into
    an equality join on (scope, name); no pair is formed that does not match.
    """
    def expand(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.length(name) > 0).select("scope", name, F.explode(substrings(F.col(name))).alias("_part"))

    left, right = left.distinct(), right.distinct()
    inside_right = expand(right, "r").withColumnRenamed("_part", "l").join(left, ["scope", "l"])
    inside_left = expand(left, "l").withColumnRenamed("_part", "r").join(right, ["scope", "r"])
    return inside_right.select("scope", "l", "r").union(inside_left.select("scope", "l", "r")).distinct()


def match_by_containment(predictions: DataFrame, odds: DataFrame) -> DataFrame:
    """First odds row whose names both contain (or lie in) the prediction's.

    Inputs carry league_code, match_date, home_team, away_team and an id
    (`match_id`, `odds_id`); `odds_id` is the position that decides 'first'.
    """
    fold = lambda c: F.lower(F.trim(F.col(c)))
    preds = predictions.select(
        "match_id", F.col("league_code").alias("scope"), "match_date",
        fold("home_team").alias("lh"), fold("away_team").alias("la"))
    # Only the first row of identical spellings can ever be the first hit.
    firsts = odds.groupBy(
        F.col("league_code").alias("scope"), "match_date",
        F.lower("home_team").alias("rh"), F.lower("away_team").alias("ra"),
    ).agg(F.min("odds_id").alias("odds_id"))
    l_names = preds.select("scope", F.explode(F.array("lh", "la")).alias("l"))
    r_names = firsts.select("scope", F.explode(F.array("rh", "ra")).alias("r"))
    pairs = containing_names(l_names, r_names)
    home = pairs.select("scope", F.col("l").alias("lh"), F.col("r").alias("rh"))
    away = pairs.select("scope", F.col("l").alias("la"), F.col("r").alias("ra"))
    hits = (
        preds.join(home, ["scope", "lh"]).join(away, ["scope", "la"])
        .join(firsts, ["scope", "match_date", "rh", "ra"])
    )
    return hits.groupBy("match_id").agg(F.min("odds_id").alias("odds_id"))


def divergence(df: DataFrame, ml: str = "p_", bk: str = "prob_", p: ValueParams = VALUE) -> DataFrame:
    """Gaps between a model triple and a market triple."""
    m = {s: F.col(f"{ml}{s}") for s in SIDES}
    b = {s: F.col(f"{bk}{s}") for s in SIDES}
    floor = lambda c: F.greatest(c, F.lit(p.floor))
    kl = F.lit(0.0)
    for s in SIDES:
        kl = kl + floor(m[s]) * F.ln(floor(m[s]) / floor(b[s]))
    out: dict[str, Column] = {"kl_div": kl}
    w = p.ml_weight + p.bookmaker_weight
    for s in SIDES:
        x = LABELS[s]
        out[f"divergence_{x}"] = m[s] - b[s]
        out[f"abs_divergence_{x}"] = F.abs(m[s] - b[s])
        out[f"blended_prob_{x}"] = (F.lit(p.ml_weight) * m[s] + F.lit(p.bookmaker_weight) * b[s]) / F.lit(w)
    out["max_divergence"] = F.greatest(*[F.abs(m[s] - b[s]) for s in SIDES])

    def top(t: dict[str, Column]) -> Column:
        h, d, a = (t[s] for s in SIDES)
        return F.when((h >= d) & (h >= a), 0).when(d >= a, 1).otherwise(2)

    out["sources_agree"] = (top(m) == top(b)).cast("double")
    return df.withColumns(out)


def multi_source_divergence(predictions: DataFrame, odds: DataFrame) -> DataFrame:
    """Divergence from the mean source plus how far the sources disagree."""
    joined = predictions.join(odds, "match_id")
    out = divergence(joined, bk="raw_")
    spread = (F.col("std_home") + F.col("std_draw") + F.col("std_away")) / F.lit(3.0)
    return out.withColumn("consensus", F.lit(1.0) - spread)


def report_summary(predictions: DataFrame, bets: DataFrame) -> DataFrame:
    """Counts of predictions and bets by confidence."""
    return bets.agg(
        F.count(F.lit(1)).alias("total_value_bets"),
        F.count_if(F.col("confidence") == "HIGH").alias("high_confidence"),
        F.count_if(F.col("confidence") == "MEDIUM").alias("medium_confidence"),
    ).withColumn("total_matches", predictions.agg(F.count(F.lit(1))).scalar())


def form_label(points: Column) -> Column:
    return F.when(points >= 2.0, "good").when(points >= 1.5, "average").otherwise("poor")


def fixture_overview(predictions: DataFrame, odds: DataFrame, bets: DataFrame, stats: DataFrame) -> DataFrame:
    """Prediction, market, bets and form of every fixture in one row.

    A fixture has at most three bets, so the collected list is bounded.
    """
    listed = bets.groupBy("match_id").agg(F.sort_array(F.collect_list(
        F.struct("outcome", F.round(F.col("edge") * 10000).cast("bigint").alias("edge"), "confidence"))).alias("bets"))
    text = F.array_join(F.transform("bets", lambda b: F.concat_ws(
        ":", b["outcome"], b["edge"].cast("string"), b["confidence"])), ";")

    def side(prefix: str) -> DataFrame:
        return stats.select(F.col("team").alias(f"{prefix}_team"), F.col("form_points").alias(f"{prefix}_form"))

    gap = {s: F.col(f"p_{s}") - F.col(f"prob_{s}") for s in SIDES}
    size = {s: F.abs(g) for s, g in gap.items()}
    home_top = (size["home"] >= size["draw"]) & (size["home"] >= size["away"])
    draw_top = size["draw"] >= size["away"]
    return (
        predictions.join(odds.select("match_id", *[f"prob_{s}" for s in SIDES]), "match_id", "left")
        .join(listed, "match_id", "left")
        .join(side("home"), "home_team", "left").join(side("away"), "away_team", "left")
        .select(
            "match_id", "home_team", "away_team", "predicted_outcome", "confidence",
            F.coalesce(text, F.lit("")).alias("value_bets"),
            F.when(home_top, "home").when(draw_top, "draw").otherwise("away").alias("gap_outcome"),
            F.when(home_top, gap["home"]).when(draw_top, gap["draw"]).otherwise(gap["away"]).alias("gap"),
            form_label(F.col("home_form")).alias("home_form"), form_label(F.col("away_form")).alias("away_form"),
        )
    )
