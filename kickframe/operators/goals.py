"""Score models: expected goals, grids, goal markets and 1X2 predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.functions import scoregrid as sg
from kickframe.functions.probability import blend, elo_expectation, favourite, from_expected_score, normalise
from kickframe.operators.features import team_matches
from kickframe.params import CROSS, ELO, INSIGHTS, SCORES, CrossLeagueParams, ScoreParams

MARKETS = ["home_win", "draw", "away_win", "over_15", "over_25", "over_35", "under_25", "btts_yes", "btts_no"]


def moment_strengths(matches: DataFrame, min_matches: int = 0) -> DataFrame:
    """Attack and defence from goal averages, a closed-form start for the fit.

    One pass; `home_advantage` is the log ratio of home to away goals.
    """
    base = matches.agg(
        (F.sum(F.col("fthg") + F.col("ftag")) / (F.lit(2.0) * F.count(F.lit(1)))).alias("mean"),
        F.ln(F.sum("fthg") / F.sum("ftag")).alias("home_advantage"),
    )
    teams = team_matches(matches, stats=("gf", "ga")).groupBy("team").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga")
    )
    mean = base.select("mean").scalar()
    ha = base.select("home_advantage").scalar()
    smooth = lambda c: F.ln((F.col(c) + 1) / (F.col("n") + 1) / mean)
    return teams.where(F.col("n") >= min_matches).select(
        "team", smooth("gf").alias("attack"), smooth("ga").alias("defence"), ha.alias("home_advantage")
    )


def dc_rates(fixtures: DataFrame, strengths: DataFrame, home_advantage: Column) -> DataFrame:
    """Expected goals of both sides; a team without strengths counts as average.

    The strengths table has one row per team; both joins are left to the
    optimiser, which broadcasts it when it is small.
    """
    home = strengths.select(F.col("team").alias("home_team"), F.col("attack").alias("_ah"), F.col("defence").alias("_dh"))
    away = strengths.select(F.col("team").alias("away_team"), F.col("attack").alias("_aa"), F.col("defence").alias("_da"))
    zero = F.lit(0.0)
    return (
        fixtures.join(home, "home_team", "left").join(away, "away_team", "left")
        .withColumns({
            "lambda_home": F.exp(F.coalesce("_ah", zero) + F.coalesce("_da", zero) + home_advantage),
            "lambda_away": F.exp(F.coalesce("_aa", zero) + F.coalesce("_dh", zero)),
            "knows_both": F.col("_ah").isNotNull() & F.col("_aa").isNotNull(),
        })
        .drop("_ah", "_dh", "_aa", "_da")
    )


def add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Append SQL expressions as columns."""
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in columns.items()])


def _sides(rates: DataFrame, rho: float, p: ScoreParams) -> DataFrame:
    """Per-side probabilities, then the corrected cells."""
    out = add(rates, sg.pmf_columns("lambda_home", "lambda_away", p.max_goals))
    return add(out, sg.corrected_cells("lambda_home", "lambda_away", f"({rho}D)"))


def _cells(rates: DataFrame, rho: float, p: ScoreParams) -> DataFrame:
    """Adds the mass of every cell, _m0, _m1, .., and their sum, _total.

    The cells are columns, each used in the sum and in a probability, so that the steps stay
    apart. Above `spark.sql.codegen.maxFields` columns a step is compiled as many small
    functions; in one function a whole grid is too long for HotSpot, which then interprets it.
    """
    masses = sg.cell_masses(p.max_goals)
    out = _sides(rates, rho, p).selectExpr(*rates.columns, *[f"{sql} AS _m{k}" for k, sql in enumerate(masses)])
    return add(out, {"_total": " + ".join(f"_m{k}" for k in range(len(masses)))})


def score_grid(rates: DataFrame, rho: float, p: ScoreParams = SCORES) -> DataFrame:
    """Adds `grid`: the normalised scoreline array in row-major order."""
    cells = ", ".join(
        f"named_struct('i', {i}, 'j', {j}, 'p', {prob})" for i, j, prob in sg.grid_cells(p.max_goals)
    )
    return _cells(rates, rho, p).selectExpr(*rates.columns, f"array({cells}) AS grid")


def goal_markets(rates: DataFrame, rho: float, p: ScoreParams = SCORES) -> DataFrame:
    """1X2, totals and both-teams-to-score from the corrected grid."""
    even = sg.uniform_share(p.max_goals)
    share = {name: f"CASE WHEN _total > 0 THEN {name} / _total ELSE {even[name]}D END" for name in even}
    markets = {
        "home_win": share["_home"], "draw": share["_draw"], "away_win": share["_away"],
        "over_15": f"1.0D - {share['_u15']}", "over_25": f"1.0D - {share['_u25']}",
        "over_35": f"1.0D - {share['_u35']}", "under_25": share["_u25"],
        "btts_yes": share["_btts"], "btts_no": f"1.0D - {share['_btts']}",
    }
    return add(_sides(rates, rho, p), sg.grid_masses(p.max_goals)).selectExpr(
        *rates.columns, *[f"{sql} AS {name}" for name, sql in markets.items()])


def top_scorelines(rates: DataFrame, rho: float, p: ScoreParams = SCORES) -> DataFrame:
    """The most likely scorelines, one row each; ties to the higher cell.

    Sorting plain numbers finds the cut-off; only the few cells that reach it are
    made into records and ranked.
    """
    size, n = p.max_goals + 1, p.top_scorelines
    probs = ", ".join(prob for _, _, prob in sg.grid_cells(p.max_goals))
    reach = f"filter(sequence(0, {size * size - 1}), k -> _ps[k] >= _cut)"
    best = f"slice(sort_array(transform({reach}, k -> named_struct('p', _ps[k], 'cell', k)), false), 1, {n})"
    return (
        _cells(rates, rho, p)
        .selectExpr(*rates.columns, f"array({probs}) AS _ps")
        .selectExpr("*", f"sort_array(_ps, false)[{n - 1}] AS _cut")
        .selectExpr(*rates.columns, f"posexplode({best}) AS (pos, s)")
        .selectExpr(*rates.columns, "pos + 1 AS rank", f"s.cell DIV {size} AS home_goals",
                    f"s.cell % {size} AS away_goals", "s.p AS prob")
    )


def _plain_markets(df: DataFrame, in_grid_over: bool) -> DataFrame:
    """Uncorrected 6x6 markets. Either over = in-grid sum, or 1 - in-grid under."""
    out = add(df, sg.pmf_columns("home_xg", "away_xg", 5))
    out = add(add(out, sg.plain_cells()), sg.grid_masses(5))
    if in_grid_over:
        markets = {f"over_{k}": f"_total - _u{k}" for k in (15, 25, 35)} | {
            "under_25": "1.0D - (_total - _u25)", "btts_yes": "_btts", "btts_no": "1.0D - _btts"}
    else:
        markets = {f"over_{k}": f"1.0D - _u{k}" for k in (15, 25, 35)} | {
            "under_25": "_u25", "btts_yes": "1.0D - (_total - _btts)", "btts_no": "_total - _btts"}
    return out.selectExpr(*df.columns, *[f"{sql} AS {name}" for name, sql in markets.items()])


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def indep_poisson_stats(fixtures: DataFrame, stats: DataFrame, league_goals: DataFrame) -> DataFrame:
    """Fallback markets from recent venue averages over the league average.

    `stats` holds the recent averages per team, `league_goals` one row per
    league; fixtures carry `league_code`.
    """
    def side(prefix: str, venue: str) -> DataFrame:
        return stats.select(
            F.col("team").alias(f"{prefix}_team"),
            F.col(f"avg_goals_scored_{venue}").alias(f"_{prefix}_for"),
            F.col(f"avg_goals_conceded_{venue}").alias(f"_{prefix}_against"),
        )

    joined = (
        fixtures.join(side("home", "home"), "home_team", "left")
        .join(side("away", "away"), "away_team", "left")
        .join(league_goals.select("league_code", "league_avg"), "league_code", "left")
        .withColumn("league_avg", F.coalesce("league_avg", F.lit(INSIGHTS.fallback_goals)))
    )
    avg = F.col("league_avg")
    rate = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(avg)
    home_raw = F.when(avg > 0, rate("_home_for") * rate("_away_against") / avg).otherwise(1.5)
    away_raw = F.when(avg > 0, rate("_away_for") * rate("_home_against") / avg).otherwise(1.0)
    xg = joined.withColumns({
        "home_xg": _clamp(home_raw, 0.3, 4.0), "away_xg": _clamp(away_raw, 0.2, 3.5),
    })
    return _plain_markets(xg.select(*fixtures.columns, "home_xg", "away_xg"), in_grid_over=False)


def plain_scorelines(priced: DataFrame, n: int | None = None, goals: int = 5) -> DataFrame:
    """The n most likely scorelines (all without n) of the uncorrected grid, one row each.

    `priced` carries home_xg and away_xg, as both plain models give them; ties go to the lower cell.
    """
    upto = F.sequence(F.lit(0), F.lit(goals))
    mass = lambda xg: F.transform(upto, lambda k: F.exp(-F.col(xg)) * F.pow(F.col(xg), k) / F.factorial(k))
    grid = priced.withColumns({"_h": mass("home_xg"), "_a": mass("away_xg")})
    cells = F.flatten(F.transform(upto, lambda i: F.transform(upto, lambda j: F.struct(
        F.round(F.get("_h", i) * F.get("_a", j), 12).alias("p"), (-(i * (goals + 1) + j)).alias("order"), i.alias("home_goals"), j.alias("away_goals")))))
    ranked = F.sort_array(cells, asc=False)
    rows = grid.select("match_id", F.posexplode(ranked if n is None else F.slice(ranked, 1, n)).alias("pos", "s"))
    return rows.select("match_id", (F.col("pos") + 1).alias("rank"), "s.home_goals", "s.away_goals", F.col("s.p").alias("prob"))


def scoring_rates(matches: DataFrame) -> DataFrame:
    """Goals for and against per team: at home, away and overall."""
    when = lambda home, c: F.avg(F.when(F.col("is_home") == home, F.col(c)))
    return team_matches(matches, stats=("gf", "ga")).groupBy("team").agg(
        when(True, "gf").alias("home_for"), when(True, "ga").alias("home_against"),
        when(False, "gf").alias("away_for"), when(False, "ga").alias("away_against"),
        F.avg("gf").alias("all_for"), F.avg("ga").alias("all_against"),
    )


def empirical_markets(fixtures: DataFrame, rates: DataFrame, league_goals: DataFrame) -> DataFrame:
    """Markets from venue rates, else overall rates, else the league average.

    `known` is false when either side has no match at all.
    """
    def side(prefix: str) -> DataFrame:
        return rates.select(
            F.col("team").alias(f"{prefix}_team"),
            F.coalesce(f"{prefix}_for", "all_for").alias(f"_{prefix}_for"),
            F.coalesce(f"{prefix}_against", "all_against").alias(f"_{prefix}_against"),
        )

    joined = (
        fixtures.join(side("home"), "home_team", "left").join(side("away"), "away_team", "left")
        .join(league_goals.select("league_code", "league_avg"), "league_code", "left")
        .withColumn("league_avg", F.coalesce("league_avg", F.lit(INSIGHTS.fallback_goals)))
    )
    avg = F.col("league_avg")
    safe = F.when(avg == 0, 1.0).otherwise(avg)
    rate = lambda c: F.coalesce(F.col(c), avg)
    xg = joined.withColumns({
        "home_xg": _clamp(rate("_home_for") * rate("_away_against") / safe, 0.2, 4.0),
        "away_xg": _clamp(rate("_away_for") * rate("_home_against") / safe, 0.2, 4.0),
        "known": F.col("_home_for").isNotNull() & F.col("_away_for").isNotNull(),
    })
    return _plain_markets(xg.select(*fixtures.columns, "home_xg", "away_xg", "known"), in_grid_over=True)


def market_choice(fitted: DataFrame, historical: DataFrame, key: str = "match_id") -> DataFrame:
    """Fitted markets when that model knows both teams, else historical, else none."""
    names = ["home_xg", "away_xg", "over_15", "over_25", "over_35", "under_25", "btts_yes", "btts_no"]
    first = fitted.select(key, "knows_both", *[F.col(
        {"home_xg": "lambda_home", "away_xg": "lambda_away"}.get(n, n)).alias(f"_f_{n}") for n in names])
    second = historical.select(key, "known", *[F.col(n).alias(f"_h_{n}") for n in names])
    joined = first.join(second, key)
    pick = lambda n: F.when(F.col("knows_both"), F.col(f"_f_{n}")).when(F.col("known"), F.col(f"_h_{n}"))
    source = F.when(F.col("knows_both"), "model").when(F.col("known"), "historical").otherwise("none")
    return joined.select(key, *[pick(n).alias(n) for n in names], source.alias("source"))


def match_counts(matches: DataFrame) -> DataFrame:
    """Appearances per team, home or away."""
    teams = matches.select(F.explode(F.array("home_team", "away_team")).alias("team"))
    return teams.groupBy("team").agg(F.count(F.lit(1)).alias("matches"))


def route_fixture(home_league: Column, away_league: Column) -> Column:
    """'cross' only when both leagues are stated and differ."""
    h = F.trim(F.coalesce(home_league, F.lit("")))
    a = F.trim(F.coalesce(away_league, F.lit("")))
    return F.when((h != "") & (a != "") & (h != a), "cross").otherwise("domestic")


def refusal_reason(fixtures: DataFrame, known: DataFrame, counts: DataFrame,
                   p: CrossLeagueParams = CROSS) -> DataFrame:
    """Adds `refusal`: why a fixture cannot be predicted, else null.

    The code names the side and whether it is unknown or has too few matches.
    The home side is asked first. A team without a count passes the minimum; the
    known-team test is what stops it.
    """
    def side(prefix: str) -> DataFrame:
        teams = known.select(F.col("team"), F.lit(True).alias(f"_{prefix}_known"))
        both = teams.join(counts.select("team", F.col("matches").alias(f"_{prefix}_n")), "team", "full")
        return both.withColumnRenamed("team", f"{prefix}_team")

    joined = fixtures.join(side("home"), "home_team", "left").join(side("away"), "away_team", "left")

    out = F.lit(None).cast("string")
    for prefix in ("away", "home"):
        unknown, n = F.col(f"_{prefix}_known").isNull(), F.col(f"_{prefix}_n")
        out = F.when(unknown, f"{prefix}_unknown").when(n < p.min_matches_per_team, f"{prefix}_thin").otherwise(out)
    return joined.withColumn("refusal", out).select(*fixtures.columns, "refusal")


def cross_league_predict(fixtures: DataFrame, ratings: DataFrame, goals_1x2: DataFrame | None = None,
                         p: CrossLeagueParams = CROSS, initial: float = ELO.initial_rating) -> DataFrame:
    """Elo, Dixon-Coles or their blend; a leg without weight is not planned.

    `goals_1x2` (match_id and a triple) is needed only for a positive weight.
    """
    w = p.dixon_coles_weight
    out = fixtures
    if w < 1.0:
        for prefix in ("home", "away"):
            side = ratings.select(F.col("team").alias(f"{prefix}_team"), F.col("rating").alias(f"_{prefix}_rating"))
            out = out.join(side, f"{prefix}_team", "left")
        start = F.lit(initial)
        expected = elo_expectation(
            F.coalesce("_home_rating", start), F.coalesce("_away_rating", start), ELO.home_advantage)
        elo = from_expected_score(expected, p.draw_rate)
    if w > 0.0:
        goal_cols = goals_1x2.select("match_id", *[F.col(c).alias(f"_g_{c}") for c in ("home_win", "draw", "away_win")])
        out = out.join(goal_cols, "match_id")
        goals = normalise(*[F.col(f"_g_{c}") for c in ("home_win", "draw", "away_win")])
    if w <= 0.0:
        triple, model = elo, "elo"
    elif w >= 1.0:
        triple, model = goals, "dixon-coles"
    else:
        triple, model = normalise(*[F.lit(w) * g + F.lit(1.0 - w) * e for g, e in zip(goals, elo)]), "dixon-coles+elo"
    h, d, a = triple
    return out.select(
        *fixtures.columns, h.alias("home_win"), d.alias("draw"), a.alias("away_win"), F.lit(model).alias("model")
    ).withColumns({
        "predicted_outcome": favourite(F.col("home_win"), F.col("draw"), F.col("away_win")),
        "confidence": F.greatest("home_win", "draw", "away_win"),
    })


def predict_from_odds(df: DataFrame, h: str = "b365h", d: str = "b365d", a: str = "b365a") -> DataFrame:
    """Prediction without a model: implied probabilities, or a fixed prior."""
    priced = (F.col(h) > 0) & (F.col(d) > 0) & (F.col(a) > 0)
    raw = [F.lit(1.0) / F.when(priced, F.col(c)) for c in (h, d, a)]
    total = raw[0] + raw[1] + raw[2]
    prior = (0.40, 0.25, 0.35)
    triple = [F.coalesce(x / total, F.lit(q)) for x, q in zip(raw, prior)]
    return df.withColumns(dict(zip(("p_home", "p_draw", "p_away"), triple))).withColumns({
        "predicted_outcome": favourite(F.col("p_home"), F.col("p_draw"), F.col("p_away")),
        "confidence": F.greatest("p_home", "p_draw", "p_away"),
    })


def blend_1x2(df: DataFrame, first: list[str], second: list[str], weight: float = SCORES.blend_weight) -> DataFrame:
    h, d, a = blend(tuple(F.col(c) for c in first), tuple(F.col(c) for c in second), weight)
    return df.withColumns({"blend_home": h, "blend_draw": d, "blend_away": a})
