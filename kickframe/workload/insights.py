"""Team and head-to-head profile queries."""

from __future__ import annotations

from kickframe.operators import insights as ins
from kickframe.sources.synthetic import matches
from kickframe.workload.common import big, r, sql, tidy

RECORD = ["played", "wins", "draws", "losses", "goals_for", "goals_against", "points", "goal_difference"]
RATIOS = ["points_per_game", "win_pct", "draw_pct", "loss_pct", "avg_goals_for", "avg_goals_against"]
RATES = ["clean_sheets", "failed_to_score", "btts", "over_25"]
AVERAGES = ["avg_shots", "avg_sot", "avg_corners", "avg_cards"]
H2H_COUNTS = ["played", "home_wins", "draws", "away_wins", "home_goals", "away_goals", "btts_count", "over_25_count"]
H2H_RATIOS = ["avg_goals_home", "avg_goals_away", "avg_goals_total", "btts_pct", "over_25_pct"]


def team_record(spark, sf):
    return tidy(ins.team_record(matches(spark, sf)))


def recent_form(spark, sf):
    return tidy(ins.recent_form(matches(spark, sf)))


def team_rates(spark, sf):
    return tidy(ins.team_rates(matches(spark, sf)))


def team_averages(spark, sf):
    return tidy(ins.team_averages(matches(spark, sf)))


def head_to_head(spark, sf):
    return tidy(ins.head_to_head(matches(spark, sf)))


def league_average_goals(spark, sf):
    return tidy(ins.league_average_goals(matches(spark, sf)))


def team_stats(spark, sf):
    return tidy(ins.team_stats(matches(spark, sf)))


def match_insights(spark, sf):
    from kickframe.workload.goals import chosen_markets

    m = matches(spark, sf)
    out = ins.match_insights(
        m.select("match_id", "home_team", "away_team"), ins.head_to_head(m), ins.team_profile(m),
        chosen_markets(m).select("match_id", "home_xg", "away_xg", "over_25", "source"))
    return tidy(out)


QUERIES = {
    f.__name__: f
    for f in (team_record, recent_form, team_rates, team_averages, head_to_head, league_average_goals,
              team_stats, match_insights)
}

# --- oracles ---------------------------------------------------------------

ROWS = """rows_ AS (SELECT *, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' ELSE 'L' END AS letter,
CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS points,
row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS recency,
row_number() OVER (PARTITION BY team, is_home ORDER BY match_date DESC, match_id DESC) AS venue_recency,
row_number() OVER (PARTITION BY team, opponent ORDER BY match_date DESC, match_id DESC) AS pair_recency FROM (
SELECT match_id, match_date, home_team AS team, away_team AS opponent, 1 AS is_home, fthg AS gf, ftag AS ga, hs_shots AS shots, hst AS sot, hc AS corners, hy + hr AS cards FROM matches
UNION ALL SELECT match_id, match_date, away_team, home_team, 0, ftag, fthg, as_shots, ast, ac, ay + ar FROM matches) u)"""

REC_AGG = """count(*) AS played, count(*) FILTER (letter='W') AS wins, count(*) FILTER (letter='D') AS draws,
count(*) FILTER (letter='L') AS losses, sum(gf) AS goals_for, sum(ga) AS goals_against, sum(points) AS points, sum(gf) - sum(ga) AS goal_difference,
CAST(sum(points) AS DOUBLE)/count(*) AS points_per_game, CAST(count(*) FILTER (letter='W') AS DOUBLE)/count(*) AS win_pct,
CAST(count(*) FILTER (letter='D') AS DOUBLE)/count(*) AS draw_pct, CAST(count(*) FILTER (letter='L') AS DOUBLE)/count(*) AS loss_pct,
CAST(sum(gf) AS DOUBLE)/count(*) AS avg_goals_for, CAST(sum(ga) AS DOUBLE)/count(*) AS avg_goals_against"""
FORM_AGG = "string_agg(letter, '' ORDER BY recency) FILTER (recency <= 5) AS form"


def _share(cond: str, name: str) -> str:
    return f"CAST(count(*) FILTER ({cond}) AS DOUBLE)/count(*) AS {name}"


RATE_AGG = ", ".join([_share("ga = 0", "clean_sheets"), _share("gf = 0", "failed_to_score"),
                      _share("gf > 0 AND ga > 0", "btts"), _share("gf + ga > 2.5", "over_25")])
AVG_AGG = "avg(shots) AS avg_shots, avg(sot) AS avg_sot, avg(corners) AS avg_corners, avg(cards) AS avg_cards"
PROFILE = f"profile AS (SELECT team, {REC_AGG}, {FORM_AGG}, {RATE_AGG}, {AVG_AGG} FROM rows_ WHERE recency <= 10 GROUP BY team)"
H2H = f"""h2h AS (SELECT team AS home_team, opponent AS away_team, count(*) AS played, count(*) FILTER (letter='W') AS home_wins,
count(*) FILTER (letter='D') AS draws, count(*) FILTER (letter='L') AS away_wins, sum(gf) AS home_goals, sum(ga) AS away_goals,
count(*) FILTER (gf > 0 AND ga > 0) AS btts_count, count(*) FILTER (gf + ga > 2.5) AS over_25_count,
CAST(sum(gf) AS DOUBLE)/count(*) AS avg_goals_home, CAST(sum(ga) AS DOUBLE)/count(*) AS avg_goals_away,
CAST(sum(gf) + sum(ga) AS DOUBLE)/count(*) AS avg_goals_total, {_share('gf > 0 AND ga > 0', 'btts_pct')}, {_share('gf + ga > 2.5', 'over_25_pct')},
string_agg(strftime(match_date, '%d/%m/%Y') || ' ' || CASE WHEN is_home = 1 THEN 'home' ELSE 'away' END || ' ' || gf || '-' || ga || ' ' || letter, '; ' ORDER BY pair_recency)
 FILTER (pair_recency <= 10) AS meetings FROM rows_ GROUP BY team, opponent)"""
LEAGUE_AVG = "league_avg AS (SELECT league_code, (avg(fthg) + avg(ftag)) / 2.0 AS league_avg FROM matches GROUP BY league_code)"
STAT_AVG = ["avg_goals_scored_home", "avg_goals_conceded_home", "avg_goals_scored_away", "avg_goals_conceded_away"]
TEAM_STATS = f"""venue_ AS (SELECT team, coalesce(avg(gf) FILTER (is_home=1), 0.0) AS avg_goals_scored_home, coalesce(avg(ga) FILTER (is_home=1), 0.0) AS avg_goals_conceded_home,
coalesce(avg(gf) FILTER (is_home=0), 0.0) AS avg_goals_scored_away, coalesce(avg(ga) FILTER (is_home=0), 0.0) AS avg_goals_conceded_away FROM rows_ WHERE venue_recency <= 10 GROUP BY team),
stats_ AS (SELECT * FROM venue_ JOIN (SELECT team, count(*) AS matches_played, avg(shots) AS avg_shots, avg(sot) AS avg_sot, avg(corners) AS avg_corners,
{RATE_AGG}, CAST(sum(points) AS DOUBLE)/count(*) AS form_points FROM rows_ WHERE recency <= 10 GROUP BY team) o USING (team))"""

ORACLES = {
    "team_record": sql(
        f"""SELECT team, 'overall' AS venue, {big(*RECORD)}, {r(*RATIOS)} FROM (SELECT team, {REC_AGG} FROM rows_ GROUP BY team) t
UNION ALL SELECT team, CASE WHEN is_home = 1 THEN 'home' ELSE 'away' END, {big(*RECORD)}, {r(*RATIOS)} FROM (SELECT team, is_home, {REC_AGG} FROM rows_ GROUP BY team, is_home) t""",
        "matches", ctes=ROWS),
    "recent_form": sql(f"SELECT team, form, {big(*RECORD)}, {r(*RATIOS)} FROM profile", "matches", ctes=f"{ROWS}, {PROFILE}"),
    "team_rates": sql(f"SELECT team, {r(*RATES)} FROM profile", "matches", ctes=f"{ROWS}, {PROFILE}"),
    "team_averages": sql(f"SELECT team, {r(*AVERAGES)} FROM profile", "matches", ctes=f"{ROWS}, {PROFILE}"),
    "head_to_head": sql(f"SELECT home_team, away_team, meetings, {big(*H2H_COUNTS)}, {r(*H2H_RATIOS)} FROM h2h", "matches", ctes=f"{ROWS}, {H2H}"),
    "league_average_goals": sql(f"SELECT league_code, {r('league_avg')} FROM league_avg", "matches", ctes=LEAGUE_AVG),
    "team_stats": sql(
        f"""SELECT team, {big('matches_played')}, {r(*STAT_AVG, 'avg_shots', 'avg_sot', 'avg_corners', 'clean_sheets', 'btts', 'over_25', 'form_points')} FROM stats_""",
        "matches", ctes=f"{ROWS}, {TEAM_STATS}"),
}
