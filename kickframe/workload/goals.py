"""Score model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.operators import goals as gl
from kickframe.operators import insights as ins
from kickframe.params import CROSS, SCORES
from kickframe.sources.synthetic import matches
from kickframe.workload import insights as wi
from kickframe.workload.common import big, r, sql, tidy
from kickframe.workload.ratings import LINKED, DOM, final_cte, linked_ratings

RHO = -0.05
KNOWN_MIN = 70
HISTORY_END = "1995-12-31"


def rates(m: DataFrame, min_matches: int = 0, priced: DataFrame | None = None) -> DataFrame:
    """Expected goals of the `priced` matches, by default all, from the strengths of all of `m`."""
    strengths = gl.moment_strengths(m, min_matches)
    ha = strengths.agg(F.max("home_advantage")).scalar()
    return gl.dc_rates((m if priced is None else priced).select("match_id", "league_code", "home_team", "away_team"), strengths, ha)


def dc_rates(spark, sf):
    return tidy(rates(matches(spark, sf)), "match_id", "lambda_home", "lambda_away")


def score_grid(spark, sf):
    """The grid of every match, reported as moments, corner cells and its peak.

    Sums are written out over the cells: a lambda is interpreted, and a sum that is one builds a record per cell.
    The lambda of the peak also keeps this step in small functions (see `gl._cells`).
    """
    g = gl.score_grid(rates(matches(spark, sf)), RHO)
    n = SCORES.max_goals + 1
    moment = lambda of: " + ".join(["0D", *[f"grid[{k}].p{of(k // n, k % n)}" for k in range(n * n)]])
    out = g.selectExpr(
        "match_id", f"{moment(lambda i, j: '')} AS mass", f"{moment(lambda i, j: f' * {i}')} AS mean_home",
        f"{moment(lambda i, j: f' * {j}')} AS mean_away", f"{moment(lambda i, j: f' * {i} * {j}')} AS mean_product",
        "grid[0].p AS p00", "grid[1].p AS p01", f"grid[{n}].p AS p10", f"grid[{n + 1}].p AS p11",
        "aggregate(grid, 0D, (top, c) -> greatest(top, c.p)) AS peak", "size(grid) AS cells")
    return tidy(out)


def goal_markets(spark, sf):
    return tidy(gl.goal_markets(rates(matches(spark, sf)), RHO), "match_id", *gl.MARKETS)


def top_scorelines(spark, sf):
    out = gl.top_scorelines(rates(matches(spark, sf)), RHO)
    return tidy(out, "match_id", "rank", "home_goals", "away_goals", "prob")


PLAIN = ["home_xg", "away_xg", "over_15", "over_25", "over_35", "under_25", "btts_yes", "btts_no"]


def fixtures(m: DataFrame) -> DataFrame:
    return m.select("match_id", "league_code", "home_team", "away_team")


def indep_poisson_stats(spark, sf):
    m = matches(spark, sf)
    out = gl.indep_poisson_stats(fixtures(m), ins.team_stats(m), ins.league_average_goals(m))
    return tidy(out, "match_id", *PLAIN)


def indep_scorelines(spark, sf):
    m = matches(spark, sf)
    out = gl.indep_poisson_stats(fixtures(m), ins.team_stats(m), ins.league_average_goals(m))
    return tidy(gl.plain_scorelines(out, 8))


def empirical_scorelines(spark, sf):
    return tidy(gl.plain_scorelines(historical(matches(spark, sf))))


def historical(m: DataFrame) -> DataFrame:
    return gl.empirical_markets(fixtures(m), gl.scoring_rates(m), ins.league_average_goals(m))


def empirical_markets(spark, sf):
    return tidy(historical(matches(spark, sf)), "match_id", "known", *PLAIN)


def chosen_markets(m: DataFrame) -> DataFrame:
    return gl.market_choice(gl.goal_markets(rates(m, KNOWN_MIN), RHO), historical(m))


def market_choice(spark, sf):
    return tidy(chosen_markets(matches(spark, sf)))


def odds_triple(m: DataFrame) -> DataFrame:
    return gl.predict_from_odds(m)


def normalise_1x2(spark, sf):
    from kickframe.functions.probability import normalise

    h, d, a = normalise(F.col("hst").cast("double"), F.col("hy").cast("double"), F.col("ast").cast("double"))
    return tidy(matches(spark, sf).select("match_id", h.alias("home_win"), d.alias("draw"), a.alias("away_win")))


def blend_1x2(spark, sf):
    m = matches(spark, sf)
    goals = gl.goal_markets(rates(m), RHO).select("match_id", "home_win", "draw", "away_win")
    both = odds_triple(m).join(goals, "match_id")
    out = gl.blend_1x2(both, ["p_home", "p_draw", "p_away"], ["home_win", "draw", "away_win"])
    return tidy(out, "match_id", "blend_home", "blend_draw", "blend_away")


def match_counts(spark, sf):
    return tidy(gl.match_counts(matches(spark, sf)))


def route_fixture(spark, sf):
    home = F.when(F.col("hy") == 4, F.lit(" ")).otherwise(F.col("home_league"))
    away = F.when(F.col("ay") != 4, F.col("away_league"))
    return tidy(matches(spark, sf).select("match_id", gl.route_fixture(home, away).alias("route")))


def refusal_reason(spark, sf):
    m = matches(spark, sf)
    history = m.where(F.col("match_date") <= HISTORY_END)
    known = history.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    out = gl.refusal_reason(fixtures(m), known, gl.match_counts(history))
    return tidy(out.withColumn("refusal", F.coalesce("refusal", F.lit("-"))), "match_id", "refusal")


def cross_league_predict(spark, sf):
    m = matches(spark, sf)
    out = gl.cross_league_predict(fixtures(m.where("is_cross")), linked_ratings(spark, sf))
    return tidy(out, "match_id", "home_win", "draw", "away_win", "model", "predicted_outcome", "confidence")


def predict_from_odds(spark, sf):
    m = matches(spark, sf).withColumn("b365d", F.when(F.col("hy") == 4, 0.0).otherwise(F.col("b365d")))
    return tidy(gl.predict_from_odds(m), "match_id", "p_home", "p_draw", "p_away", "predicted_outcome", "confidence")


QUERIES = {
    f.__name__: f
    for f in (dc_rates, score_grid, goal_markets, top_scorelines, indep_poisson_stats, indep_scorelines, empirical_scorelines, empirical_markets,
              market_choice, normalise_1x2, blend_1x2, match_counts, route_fixture, refusal_reason,
              cross_league_predict, predict_from_odds)
}

# --- oracles ---------------------------------------------------------------

FACT = "CAST(factorial(CAST({k} AS INTEGER)) AS DOUBLE)"


def strengths_cte(min_matches: int = 0, name: str = "strengths") -> str:
    return f"""{name} AS (SELECT team, n, ln(CAST(gf+1 AS DOUBLE)/(n+1)/mean) AS attack, ln(CAST(ga+1 AS DOUBLE)/(n+1)/mean) AS defence FROM (
SELECT team, count(*) AS n, sum(gf) AS gf, sum(ga) AS ga FROM (SELECT home_team AS team, fthg AS gf, ftag AS ga FROM matches
UNION ALL SELECT away_team, ftag, fthg FROM matches) u GROUP BY team) t,
(SELECT CAST(sum(fthg+ftag) AS DOUBLE)/(2.0*count(*)) AS mean FROM matches) b WHERE n >= {min_matches})"""


def rates_cte(strengths: str = "strengths", name: str = "rates") -> str:
    return f"""{name} AS (SELECT m.match_id, exp(coalesce(h.attack,0.0) + coalesce(a.defence,0.0) + ha) AS lam,
exp(coalesce(a.attack,0.0) + coalesce(h.defence,0.0)) AS mu, h.team IS NOT NULL AND a.team IS NOT NULL AS knows_both
FROM matches m LEFT JOIN {strengths} h ON h.team = m.home_team LEFT JOIN {strengths} a ON a.team = m.away_team,
(SELECT ln(CAST(sum(fthg) AS DOUBLE)/sum(ftag)) AS ha FROM matches) z)"""


def grid_cte(rates: str = "rates", size: int = 11, rho: str = str(RHO), name: str = "grid") -> str:
    """(match_id, i, j, p) with the low-score correction, normalised."""
    return f"""{name}_u AS (SELECT match_id, i, j, greatest(0.0, exp(-lam)*pow(lam,CAST(i AS DOUBLE))/{FACT.format(k='i')} * (exp(-mu)*pow(mu,CAST(j AS DOUBLE))/{FACT.format(k='j')})
 * CASE WHEN i=0 AND j=0 THEN 1.0 - lam*mu*({rho}) WHEN i=0 AND j=1 THEN 1.0 + lam*({rho}) WHEN i=1 AND j=0 THEN 1.0 + mu*({rho}) WHEN i=1 AND j=1 THEN 1.0 - ({rho}) ELSE 1.0 END) AS p
FROM {rates}, (SELECT unnest(range({size})) AS i) gi, (SELECT unnest(range({size})) AS j) gj),
{name} AS (SELECT match_id, i, j, p / sum(p) OVER (PARTITION BY match_id) AS p FROM {name}_u)"""


MARKET_AGG = """sum(p) FILTER (i > j) AS home_win, sum(p) FILTER (i = j) AS draw, sum(p) FILTER (i < j) AS away_win,
sum(p) FILTER (i + j >= 2) AS over_15, sum(p) FILTER (i + j >= 3) AS over_25, sum(p) FILTER (i + j >= 4) AS over_35,
sum(p) FILTER (i + j <= 2) AS under_25, sum(p) FILTER (i >= 1 AND j >= 1) AS btts_yes, 1.0 - sum(p) FILTER (i >= 1 AND j >= 1) AS btts_no"""


def plain_grid_cte(xg: str, in_grid_over: bool, name: str) -> str:
    """Uncorrected 6x6 markets per match."""
    if in_grid_over:
        agg = ", ".join(f"sum(p) FILTER (i + j > {k}.5) AS over_{k}5" for k in (1, 2, 3))
        agg += """, 1.0 - sum(p) FILTER (i + j > 2.5) AS under_25, sum(p) FILTER (i > 0 AND j > 0) AS btts_yes,
1.0 - sum(p) FILTER (i > 0 AND j > 0) AS btts_no"""
    else:
        agg = ", ".join(f"1.0 - sum(p) FILTER (i + j <= {k}) AS over_{k}5" for k in (1, 2, 3))
        agg += """, sum(p) FILTER (i + j <= 2) AS under_25, 1.0 - sum(p) FILTER (i = 0 OR j = 0) AS btts_yes,
sum(p) FILTER (i = 0 OR j = 0) AS btts_no"""
    return f"""{name} AS (SELECT match_id, any_value(home_xg) AS home_xg, any_value(away_xg) AS away_xg, {agg} FROM (
SELECT match_id, home_xg, away_xg, i, j, exp(-home_xg)*pow(home_xg,CAST(i AS DOUBLE))/{FACT.format(k='i')} * (exp(-away_xg)*pow(away_xg,CAST(j AS DOUBLE))/{FACT.format(k='j')}) AS p
FROM {xg}, (SELECT unnest(range(6)) AS i) gi, (SELECT unnest(range(6)) AS j) gj) g GROUP BY match_id)"""


SCORING = """scoring AS (SELECT team, avg(gf) FILTER (h=1) AS hf, avg(ga) FILTER (h=1) AS hg, avg(gf) FILTER (h=0) AS af, avg(ga) FILTER (h=0) AS ag, avg(gf) AS xf, avg(ga) AS xg FROM (
SELECT home_team AS team, 1 AS h, fthg AS gf, ftag AS ga FROM matches UNION ALL SELECT away_team, 0, ftag, fthg FROM matches) u GROUP BY team)"""
HIST = f"""{SCORING}, hist_xg AS (SELECT m.match_id, greatest(0.2, least(4.0, coalesce(h.hf, h.xf) * coalesce(a.ag, a.xg) / league_avg)) AS home_xg,
greatest(0.2, least(4.0, coalesce(a.af, a.xf) * coalesce(h.hg, h.xg) / league_avg)) AS away_xg
FROM matches m JOIN scoring h ON h.team = m.home_team JOIN scoring a ON a.team = m.away_team JOIN league_avg USING (league_code)),
{plain_grid_cte('hist_xg', True, 'hist')}"""
CHOICE = f"""{strengths_cte(KNOWN_MIN, 'seasoned')}, {rates_cte('seasoned', 'frates')}, {grid_cte('frates', name='fgrid')},
fitted AS (SELECT match_id, {MARKET_AGG} FROM fgrid GROUP BY match_id), {wi.LEAGUE_AVG}, {HIST},
choice AS (SELECT match_id, """ + ", ".join(
    f"CASE WHEN knows_both THEN {src} ELSE h.{n} END AS {n}" for n, src in
    [("home_xg", "lam"), ("away_xg", "mu")] + [(n, f"f.{n}") for n in PLAIN[2:]]
) + """, CASE WHEN knows_both THEN 'model' ELSE 'historical' END AS source FROM frates JOIN fitted f USING (match_id) JOIN hist h USING (match_id))"""
FAV = "CASE WHEN {h} >= {d} AND {h} >= {a} THEN 'Home Win' WHEN {d} >= {a} THEN 'Draw' ELSE 'Away Win' END"
ODDS3 = """odds3 AS (SELECT match_id, (1.0/b365h)/(1.0/b365h+1.0/b365d+1.0/b365a) AS p_home, (1.0/b365d)/(1.0/b365h+1.0/b365d+1.0/b365a) AS p_draw,
(1.0/b365a)/(1.0/b365h+1.0/b365d+1.0/b365a) AS p_away FROM matches)"""
GRID = f"{strengths_cte()}, {rates_cte()}, {grid_cte()}"
DR = CROSS.draw_rate
HIST_CUT = f"match_date <= DATE '{HISTORY_END}'"
COUNTS = "SELECT team, count(*) AS n FROM (SELECT home_team AS team FROM {src} UNION ALL SELECT away_team FROM {src}) u GROUP BY team"

INDEP_XG = """indep_xg AS (SELECT m.match_id,
greatest(0.3, least(4.0, CASE WHEN h.avg_goals_scored_home > 0 THEN h.avg_goals_scored_home ELSE league_avg END * CASE WHEN a.avg_goals_conceded_away > 0 THEN a.avg_goals_conceded_away ELSE league_avg END / league_avg)) AS home_xg,
greatest(0.2, least(3.5, CASE WHEN a.avg_goals_scored_away > 0 THEN a.avg_goals_scored_away ELSE league_avg END * CASE WHEN h.avg_goals_conceded_home > 0 THEN h.avg_goals_conceded_home ELSE league_avg END / league_avg)) AS away_xg
FROM matches m JOIN stats_ h ON h.team = m.home_team JOIN stats_ a ON a.team = m.away_team JOIN league_avg USING (league_code))"""
LINES = """SELECT match_id, CAST(rank AS BIGINT) AS rank, CAST(i AS BIGINT) AS home_goals, CAST(j AS BIGINT) AS away_goals, round(p, 6) AS prob FROM (
SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, i * 6 + j) AS rank FROM (
SELECT match_id, i, j, round(exp(-home_xg) * pow(home_xg, i) / factorial(CAST(i AS INTEGER)) * (exp(-away_xg) * pow(away_xg, j) / factorial(CAST(j AS INTEGER))), 12) AS p
FROM {src}, range(6) a(i), range(6) b(j)) c) d"""

ORACLES = {
    "dc_rates": sql("SELECT match_id, round(lam, 6) AS lambda_home, round(mu, 6) AS lambda_away FROM rates",
                    "matches", ctes=f"{strengths_cte()}, {rates_cte()}"),
    "score_grid": sql(
        f"""SELECT match_id, {r('mass', 'mean_home', 'mean_away', 'mean_product', 'p00', 'p01', 'p10', 'p11', 'peak')}, {big('cells')} FROM (
SELECT match_id, sum(p) AS mass, sum(p*i) AS mean_home, sum(p*j) AS mean_away, sum(p*i*j) AS mean_product, sum(p) FILTER (i=0 AND j=0) AS p00,
sum(p) FILTER (i=0 AND j=1) AS p01, sum(p) FILTER (i=1 AND j=0) AS p10, sum(p) FILTER (i=1 AND j=1) AS p11, max(p) AS peak, count(*) AS cells FROM grid GROUP BY match_id) t""",
        "matches", ctes=GRID),
    "goal_markets": sql(f"SELECT match_id, {r(*gl.MARKETS)} FROM (SELECT match_id, {MARKET_AGG} FROM grid GROUP BY match_id) t", "matches", ctes=GRID),
    "top_scorelines": sql(
        """SELECT match_id, CAST(rk AS BIGINT) AS rank, CAST(i AS BIGINT) AS home_goals, CAST(j AS BIGINT) AS away_goals, round(p, 6) AS prob FROM (
SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, i*11+j DESC) AS rk FROM grid) t WHERE rk <= 5""", "matches", ctes=GRID),
    "indep_scorelines": sql(
        LINES.format(src="indep_xg") + " WHERE rank <= 8", "matches", ctes=f"{wi.ROWS}, {wi.TEAM_STATS}, {wi.LEAGUE_AVG}, {INDEP_XG}"),
    "empirical_scorelines": sql(LINES.format(src="hist_xg"), "matches", ctes=f"{wi.LEAGUE_AVG}, {HIST}"),
    "indep_poisson_stats": sql(
        f"SELECT match_id, {r(*PLAIN)} FROM indep", "matches",
        ctes=f"""{wi.ROWS}, {wi.TEAM_STATS}, {wi.LEAGUE_AVG}, {INDEP_XG}, {plain_grid_cte('indep_xg', False, 'indep')}"""),
    "empirical_markets": sql(f"SELECT match_id, CAST(1 AS BIGINT) AS known, {r(*PLAIN)} FROM hist", "matches", ctes=f"{wi.LEAGUE_AVG}, {HIST}"),
    "market_choice": sql(f"SELECT match_id, source, {r(*PLAIN)} FROM choice", "matches", ctes=CHOICE),
    "normalise_1x2": sql(
        """SELECT match_id, round(CASE WHEN t > 0 THEN CAST(hst AS DOUBLE)/t ELSE 1.0/3.0 END, 6) AS home_win, round(CASE WHEN t > 0 THEN CAST(hy AS DOUBLE)/t ELSE 1.0/3.0 END, 6) AS draw,
round(CASE WHEN t > 0 THEN CAST(ast AS DOUBLE)/t ELSE 1.0/3.0 END, 6) AS away_win FROM (SELECT *, hst+hy+ast AS t FROM matches) m""", "matches"),
    "blend_1x2": sql(
        """SELECT match_id, round(0.6*p_home + 0.4*home_win, 6) AS blend_home, round(0.6*p_draw + 0.4*draw, 6) AS blend_draw, round(0.6*p_away + 0.4*away_win, 6) AS blend_away
FROM odds3 JOIN (SELECT match_id, """ + MARKET_AGG + " FROM grid GROUP BY match_id) g USING (match_id)", "matches", ctes=f"{GRID}, {ODDS3}"),
    "match_counts": sql(f"SELECT team, CAST(n AS BIGINT) AS matches FROM ({COUNTS.format(src='matches')}) c", "matches"),
    "route_fixture": sql(
        "SELECT match_id, CASE WHEN hy <> 4 AND ay <> 4 AND home_league <> away_league THEN 'cross' ELSE 'domestic' END AS route FROM matches", "matches"),
    "refusal_reason": sql(
        """SELECT match_id, CASE WHEN h.n IS NULL THEN 'home_unknown' WHEN h.n < 10 THEN 'home_thin' WHEN a.n IS NULL THEN 'away_unknown' WHEN a.n < 10 THEN 'away_thin' ELSE '-' END AS refusal
FROM matches m LEFT JOIN counts h ON h.team = m.home_team LEFT JOIN counts a ON a.team = m.away_team""", "matches",
        ctes=f"hist_m AS (SELECT * FROM matches WHERE {HIST_CUT}), counts AS ({COUNTS.format(src='hist_m')})"),
    "cross_league_predict": sql(
        f"""SELECT match_id, 'elo' AS model, round(h, 6) AS home_win, round(d, 6) AS draw, round(a, 6) AS away_win, {FAV.format(h='h', d='d', a='a')} AS predicted_outcome, round(greatest(h, d, a), 6) AS confidence
FROM (SELECT match_id, e*(1.0-{DR}) AS h, CAST({DR} AS DOUBLE) AS d, (1.0-e)*(1.0-{DR}) AS a FROM (
SELECT match_id, 1.0/(1.0+pow(10.0,(fa.rating-(fh.rating+65.0))/400.0)) AS e FROM matches m JOIN final fh ON fh.team = m.home_team JOIN final fa ON fa.team = m.away_team WHERE is_cross) x) y""",
        "matches", recursive=True, ctes=f"{LINKED}, {final_cte('matches')}"),
    "predict_from_odds": sql(
        f"""SELECT match_id, round(h, 6) AS p_home, round(d, 6) AS p_draw, round(a, 6) AS p_away, {FAV.format(h='h', d='d', a='a')} AS predicted_outcome, round(greatest(h, d, a), 6) AS confidence
FROM (SELECT match_id, CASE WHEN hy = 4 THEN CAST(0.4 AS DOUBLE) ELSE p_home END AS h, CASE WHEN hy = 4 THEN CAST(0.25 AS DOUBLE) ELSE p_draw END AS d, CASE WHEN hy = 4 THEN CAST(0.35 AS DOUBLE) ELSE p_away END AS a
FROM odds3 JOIN matches USING (match_id)) t""", "matches", ctes=ODDS3),
}
ORACLES["match_insights"] = sql(
    f"""SELECT match_id, home_team, away_team, CAST(coalesce(g.played, 0) AS BIGINT) AS played, CAST(coalesce(g.home_wins, 0) AS BIGINT) AS home_wins,
CAST(coalesce(g.draws, 0) AS BIGINT) AS draws, CAST(coalesce(g.away_wins, 0) AS BIGINT) AS away_wins, """
    + ", ".join(f"p{s[0]}.form AS {s}_form, " + ", ".join(
        f"round(p{s[0]}.{c}, 6) AS {s}_{c}" for c in ("points_per_game", "btts", "over_25", "avg_shots")) for s in ("home", "away"))
    + f""", {r('home_xg', 'away_xg')}, round(c.over_25, 6) AS over_25, source FROM matches m LEFT JOIN h2h g USING (home_team, away_team)
LEFT JOIN profile ph ON ph.team = m.home_team LEFT JOIN profile pa ON pa.team = m.away_team JOIN choice c USING (match_id)""",
    "matches", ctes=f"{wi.ROWS}, {wi.PROFILE}, {wi.H2H}, {CHOICE}")
