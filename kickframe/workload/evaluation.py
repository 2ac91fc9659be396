"""Fixture feature, evaluation and publishing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.operators import evaluation as ev
from kickframe.operators import features as feat
from kickframe.operators import fixtures as fx
from kickframe.operators import goals as gl
from kickframe.operators import ratings as rt
from kickframe.sources.synthetic import matches
from kickframe.workload import features as wf
from kickframe.workload import goals as wg
from kickframe.workload import ratings as wr
from kickframe.workload.common import big, r, sql, text, tidy

HORIZON = 45


def split(m):
    """(history, fixtures): the last weeks are still to be played."""
    cut = F.date_sub(m.agg(F.max("match_date")).scalar(), HORIZON)
    unplayed = m.where(F.col("match_date") > cut).select("match_id", "league_code", "home_team", "away_team", "hy")
    return m.where(F.col("match_date") <= cut), unplayed


SIDE_STATS = wf.AVGS + ["xg_rolling", "xga_rolling", "rest_days", "fatigued", "draw_pct"]
PAIR = ["xg_diff", "rest_advantage", "avg_draw_pct", *wf.SIM]
FIXTURE = [f"{p}_{s}" for s in SIDE_STATS for p in ("home", "away")] + [f"diff_{s}" for s in wf.AVGS] + PAIR + wf.H2H


ELO_COLUMNS = ["elo_home", "elo_away", "elo_diff", "elo_expected_home", "elo_expected_away"]


def fixture_features(spark, sf):
    history, fixtures = split(matches(spark, sf))
    ratings = rt.elo_final(rt.both_corpora(history.where(~F.col("is_cross")), history.where("is_cross")))
    out = fx.fixture_features(fixtures, feat.all_features(history), ratings)
    return tidy(out, "match_id", "is_midweek", *FIXTURE, *ELO_COLUMNS)


def fixture_h2h(spark, sf):
    history, fixtures = split(matches(spark, sf))
    return tidy(fx.fixture_h2h(fixtures, feat.h2h_last5(history)), "match_id", *wf.H2H)


INTL_STATS = ["avg_gf", "avg_ga", "form", "draw_pct"]
INTL = ([f"{p}_{s}" for s in INTL_STATS for p in ("home", "away")] + [f"diff_{s}" for s in INTL_STATS[:3]]
        + ["avg_draw_pct", *wf.SIM, *wf.H2H, "elo_home", "elo_away", "elo_diff", "elo_expected_home", "elo_expected_away"])


def intl_fixture_features(spark, sf):
    neutral = F.col("hy") == 0
    m = matches(spark, sf)
    history, fixtures = split(m.withColumn("neutral", neutral))
    rated = history.where(~F.col("is_cross")).withColumn("home_adv", rt.neutral_advantage(neutral))
    fixtures = fixtures.withColumn("neutral", neutral).withColumn("home_adv", rt.neutral_advantage(neutral))
    out = fx.intl_fixture_features(fixtures, feat.intl_features(history), rt.elo_final(rated))
    return tidy(out, "match_id", "is_neutral", *INTL)


def predictions(spark, sf):
    return gl.predict_from_odds(matches(spark, sf)).select(
        "match_id", "league_code", *ev.KEY, "p_home", "p_draw", "p_away", "predicted_outcome")


def results(spark, sf):
    """Reported outcomes; some matches were never reported."""
    m = matches(spark, sf).where(F.col("hy") != 4)
    return m.select("match_id", "league_code", *ev.KEY, ev.outcome_label().alias("actual"))


def today(spark, sf):
    return F.date_add(matches(spark, sf).agg(F.max("match_date")).scalar(), 1)


def score_predictions(spark, sf):
    return tidy(ev.score_predictions(predictions(spark, sf), results(spark, sf)))


def evaluation_metrics(spark, sf):
    return tidy(ev.evaluation_metrics(predictions(spark, sf), results(spark, sf), today(spark, sf), 60))


def stored(spark, sf):
    """Stored predictions, some of them settled already."""
    done = matches(spark, sf).select("match_id", F.when(F.col("hr") == 1, ev.outcome_label()).alias("actual"))
    return predictions(spark, sf).join(done, "match_id")


def settlement(spark, sf):
    out = ev.settlement(stored(spark, sf), results(spark, sf), today(spark, sf), window=30)
    return tidy(out.withColumn("actual", F.coalesce("actual", F.lit("-"))), "match_id", "actual", "settled_now")


def rolling_accuracy(spark, sf):
    return tidy(ev.rolling_accuracy(stored(spark, sf), 30))


def trained_until(spark, sf):
    return F.date_sub(matches(spark, sf).agg(F.max("match_date")).scalar(), 90)


def new_match_count(spark, sf):
    return tidy(ev.new_match_count(matches(spark, sf), trained_until(spark, sf)))


def retrain_decision(spark, sf):
    m = matches(spark, sf)
    newest = m.agg(F.max("match_date")).scalar()
    ages = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(e).alias("model_exists"), F.lit(a).alias("age"))
                     for n, e, a in (("fresh", True, 0), ("month", True, 30), ("old", True, 900),
                                     ("missing", False, 10), ("undated", True, None))])
    models = m.agg(F.max("match_date").alias("newest")).select("newest", F.explode(ages).alias("a")).select(
        "a.model", "a.model_exists", F.date_sub("newest", F.col("a.age")).alias("last_trained"))
    out = ev.retrain_decision(models, m)
    return tidy(out, "model", "new_matches", "has_new_data", "should_retrain", "reason")


def served_dates(spark, sf):
    m = matches(spark, sf)
    served = m.groupBy("league_code").agg(F.avg("fthg").alias("g")).where(F.col("g") > 2).select("league_code")
    return tidy(ev.served_dates(m, served))


def history_query(spark, sf):
    known = {f"L{i:02d}" for i in range(20)}
    return tidy(ev.history_query(matches(spark, sf), ["L03", "L07"], known),
                "match_id", "league_code", "match_date", "home_team", "away_team", "fthg", "ftag")


QUERIES = {
    f.__name__: f
    for f in (fixture_features, fixture_h2h, intl_fixture_features, score_predictions, evaluation_metrics,
              settlement, rolling_accuracy, new_match_count, retrain_decision, served_dates, history_query)
}

# --- oracles ---------------------------------------------------------------

CUT = f"(SELECT max(match_date) - {HORIZON} FROM matches)"
HIST = f"hist AS (SELECT * FROM matches WHERE match_date <= {CUT}), fixt AS (SELECT * FROM matches WHERE match_date > {CUT})"


def state_cte(src: str, stats: list[str], name: str = "state") -> str:
    home = ", ".join(f"home_{s} AS {s}" for s in stats)
    away = ", ".join(f"away_{s}" for s in stats)
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM (
SELECT home_team AS team, match_date, match_id, {home} FROM {src} UNION ALL SELECT away_team, match_date, match_id, {away} FROM {src}) u) v WHERE rn = 1)"""


def h2h_fix_cte(src: str, name: str = "hfix") -> str:
    return f"""{name}_l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(home_team, away_team), greatest(home_team, away_team) ORDER BY match_date DESC, match_id DESC) AS rn FROM {src}) t WHERE rn = 1),
{name} AS (SELECT f.match_id, CASE WHEN l.home_team IS NULL THEN 0.0 WHEN l.home_team = f.home_team THEN coalesce(l.h2h_home_wins, 0.0) ELSE greatest(0.0, 1.0 - coalesce(l.h2h_home_wins, 0.0) - coalesce(l.h2h_draws, 0.0)) END AS h2h_home_wins,
coalesce(l.h2h_draws, 0.0) AS h2h_draws, coalesce(l.h2h_total_goals_avg, 0.0) AS h2h_total_goals_avg FROM fixt f LEFT JOIN {name}_l l
ON least(l.home_team, l.away_team) = least(f.home_team, f.away_team) AND greatest(l.home_team, l.away_team) = greatest(f.home_team, f.away_team))"""


def sides_cte(src: str, stats: list[str], fallback: bool, name: str = "sides") -> str:
    cols, means = [], []
    for p in ("home", "away"):
        for s in stats:
            other = f"m_{p}_{s}" if fallback else "0.0"
            cols.append(f"coalesce(CASE WHEN {p[0]}.team IS NOT NULL THEN {p[0]}.{s} ELSE {other} END, 0.0) AS {p}_{s}")
            means.append(f"avg({p}_{s}) AS m_{p}_{s}")
    join = "LEFT JOIN" if fallback else "JOIN"
    tail = f", (SELECT {', '.join(means)} FROM {src}) mm" if fallback else ""
    return f"""{name} AS (SELECT f.match_id, f.hy, f.home_team, f.away_team, {', '.join(cols)} FROM fixt f {join} state h ON h.team = f.home_team {join} state a ON a.team = f.away_team{tail})"""


FIX_PAIR = f"""{', '.join(f'home_{s} - away_{s} AS diff_{s}' for s in wf.AVGS)}, home_xg_rolling - away_xg_rolling AS xg_diff, home_rest_days - away_rest_days AS rest_advantage,
(home_draw_pct + away_draw_pct)/2 AS avg_draw_pct, {wf.SIM_SQL}"""
PRED = f"""pred AS (SELECT match_id, league_code, match_date, home_team, away_team, p_home, p_draw, p_away, {wg.FAV.format(h='p_home', d='p_draw', a='p_away')} AS predicted_outcome FROM matches JOIN odds3 USING (match_id)),
res AS (SELECT league_code, match_date, home_team, away_team, match_id, CASE WHEN fthg > ftag THEN 'Home Win' WHEN fthg < ftag THEN 'Away Win' ELSE 'Draw' END AS actual FROM matches WHERE hy <> 4)"""
BRIER = "power(p_home - CASE WHEN actual = 'Home Win' THEN 1 ELSE 0 END, 2) + power(p_draw - CASE WHEN actual = 'Draw' THEN 1 ELSE 0 END, 2) + power(p_away - CASE WHEN actual = 'Away Win' THEN 1 ELSE 0 END, 2)"
SCORE_AGG = f"""round(CASE WHEN count(actual) > 0 THEN CAST(count(*) FILTER (predicted_outcome = actual) AS DOUBLE)/count(actual) ELSE 0.0 END, 4) AS accuracy,
round(CASE WHEN count(actual) > 0 THEN sum({BRIER}) FILTER (actual IS NOT NULL)/count(actual) ELSE 0.0 END, 4) AS brier_score, CAST(count(actual) AS BIGINT) AS scored_matches, CAST(count(*) AS BIGINT) AS total_predictions"""
TODAY = "(SELECT max(match_date) + 1 FROM matches)"
STORED = """stored AS (SELECT pred.*, CASE WHEN hr = 1 THEN CASE WHEN fthg > ftag THEN 'Home Win' WHEN fthg < ftag THEN 'Away Win' ELSE 'Draw' END END AS actual FROM pred JOIN (SELECT match_id, hr, fthg, ftag FROM matches) m USING (match_id))"""
LOSS = "-ln(greatest(CASE actual WHEN 'Home Win' THEN p_home WHEN 'Draw' THEN p_draw ELSE p_away END, 1e-15))"
ONE = "SELECT {key}, arg_max(actual, match_id) AS actual FROM res {where} GROUP BY {key}"
SUMS = ["brier_sum", "logloss_sum", "window_accuracy", "window_brier", "window_logloss"]

ORACLES = {
    "fixture_features": sql(
        f"""SELECT match_id, CAST(0 AS BIGINT) AS is_midweek, {r(*FIXTURE, *ELO_COLUMNS)} FROM (SELECT *, 1.0 - elo_expected_home AS elo_expected_away FROM (
SELECT *, elo_home - elo_away AS elo_diff, 1.0/(1.0+pow(10.0,(elo_away-(elo_home + 65.0))/400.0)) AS elo_expected_home FROM (
SELECT sides.*, {FIX_PAIR}, hfix.* EXCLUDE (match_id), coalesce(rh.rating, 1500.0) AS elo_home, coalesce(ra.rating, 1500.0) AS elo_away
FROM sides JOIN hfix USING (match_id) LEFT JOIN final rh ON rh.team = home_team LEFT JOIN final ra ON ra.team = away_team) a) b) t""",
        "matches", recursive=True, ctes=", ".join([
            HIST, wf.all_features_ctes("hist"), state_cte("feat", SIDE_STATS), sides_cte("feat", SIDE_STATS, True), h2h_fix_cte("feat"),
            wr.walk_ctes("hist", "'all'", 400, index=wr.LINKED_INDEX), wr.final_cte("hist")])),
    "fixture_h2h": sql(
        f"SELECT match_id, {r(*wf.H2H)} FROM hfix", "matches",
        ctes=f"{HIST}, {wf.h2h_cte('hist')}, hrows AS (SELECT hist.*, hh.* EXCLUDE (match_id) FROM hist JOIN hh USING (match_id)), {h2h_fix_cte('hrows')}"),
    "intl_fixture_features": sql(
        f"""SELECT match_id, CAST(hy = 0 AS BIGINT) AS is_neutral, {r(*INTL)} FROM (SELECT *, 1.0 - elo_expected_home AS elo_expected_away FROM (
SELECT *, elo_home - elo_away AS elo_diff, 1.0/(1.0+pow(10.0,(elo_away-(elo_home + CASE WHEN hy = 0 THEN 0.0 ELSE 65.0 END))/400.0)) AS elo_expected_home FROM (
SELECT sides.*, {', '.join(f'home_{s} - away_{s} AS diff_{s}' for s in INTL_STATS[:3])}, (home_draw_pct + away_draw_pct)/2 AS avg_draw_pct, {wf.SIM_SQL}, hfix.* EXCLUDE (match_id),
coalesce(rh.rating, 1500.0) AS elo_home, coalesce(ra.rating, 1500.0) AS elo_away FROM sides JOIN hfix USING (match_id) LEFT JOIN final rh ON rh.team = home_team LEFT JOIN final ra ON ra.team = away_team) a) b) c""",
        "matches", recursive=True, ctes=", ".join([
            HIST, wf.records_cte("hist"), wf.roll_cte(feat.GOAL_STATS), wf.c3_cte("hist", feat.GOAL_STATS), wf.team_pass_cte("c3"), wf.h2h_cte("c3"),
            "feat AS (SELECT c3.*, tp.* EXCLUDE (match_id), hh.* EXCLUDE (match_id) FROM c3 JOIN tp USING (match_id) JOIN hh USING (match_id))",
            state_cte("feat", INTL_STATS), sides_cte("feat", INTL_STATS, False), h2h_fix_cte("feat"),
            "dom AS (SELECT * FROM hist WHERE NOT is_cross)", wr.walk_ctes("dom", "league_code", 20, adv="CASE WHEN hy = 0 THEN 0.0 ELSE 65.0 END"), wr.final_cte("dom")])),
    "score_predictions": sql(
        f"SELECT {text('match_date')}, {SCORE_AGG} FROM pred LEFT JOIN ({ONE.format(key='match_date, home_team, away_team', where='')}) o USING (match_date, home_team, away_team) GROUP BY match_date",
        "matches", ctes=f"{wg.ODDS3}, {PRED}"),
    "evaluation_metrics": sql(
        f"""SELECT league_code, {text('match_date')}, accuracy, brier_score, scored_matches, total_predictions FROM (SELECT league_code, match_date, {SCORE_AGG} FROM pred
LEFT JOIN ({ONE.format(key='league_code, match_date, home_team, away_team', where='')}) o USING (league_code, match_date, home_team, away_team)
WHERE match_date BETWEEN {TODAY} - 60 AND {TODAY} - 1 GROUP BY league_code, match_date) t WHERE scored_matches > 0""",
        "matches", ctes=f"{wg.ODDS3}, {PRED}"),
    "settlement": sql(
        f"""SELECT match_id, coalesce(s.actual, o.actual, '-') AS actual, CAST(s.actual IS NULL AND o.actual IS NOT NULL AS BIGINT) AS settled_now FROM stored s
LEFT JOIN ({ONE.format(key='league_code, match_date, home_team, away_team', where=f'WHERE match_date BETWEEN {TODAY} - 30 AND {TODAY} - 1')}) o USING (league_code, match_date, home_team, away_team)""",
        "matches", ctes=f"{wg.ODDS3}, {PRED}, {STORED}"),
    "rolling_accuracy": sql(
        f"""SELECT {text('match_date')}, league_code, {big('settled', 'correct')}, {r(*SUMS)} FROM (SELECT *, CAST(sum(correct) OVER w AS DOUBLE)/sum(settled) OVER w AS window_accuracy,
sum(brier_sum) OVER w/sum(settled) OVER w AS window_brier, sum(logloss_sum) OVER w/sum(settled) OVER w AS window_logloss
FROM daily WINDOW w AS (PARTITION BY league_code ORDER BY match_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)) t""",
        "matches", ctes=f"""{wg.ODDS3}, {PRED}, {STORED}, scored AS (SELECT match_date, league_code, CASE WHEN predicted_outcome = actual THEN 1 ELSE 0 END AS hit, {BRIER} AS b, {LOSS} AS l FROM stored WHERE actual IS NOT NULL),
daily AS (SELECT match_date, league_code, count(*) AS settled, sum(hit) AS correct, sum(b) AS brier_sum, sum(l) AS logloss_sum FROM scored GROUP BY match_date, league_code
UNION ALL SELECT match_date, '_ALL_', count(*), sum(hit), sum(b), sum(l) FROM scored GROUP BY match_date)"""),
    "new_match_count": sql("SELECT CAST(count(*) AS BIGINT) AS new_matches FROM matches WHERE match_date > (SELECT max(match_date) - 90 FROM matches)", "matches"),
    "retrain_decision": sql(
        """SELECT model, CAST(n AS BIGINT) AS new_matches, CAST(lt IS NULL OR mx > lt AS BIGINT) AS has_new_data,
CAST(CASE WHEN model = 'missing' OR lt IS NULL THEN true WHEN mx <= lt THEN false ELSE n >= 800 END AS BIGINT) AS should_retrain,
CASE WHEN model = 'missing' THEN 'no_model' WHEN lt IS NULL THEN 'undated_model' WHEN mx <= lt THEN 'nothing_newer' WHEN n < 800 THEN 'too_few' ELSE 'enough' END AS reason
FROM (SELECT model, lt, mx, (SELECT count(*) FROM matches WHERE match_date > lt) AS n FROM (SELECT model, mx - CAST(age AS INT) AS lt, mx FROM (SELECT max(match_date) AS mx FROM matches) x,
(VALUES ('fresh', 0), ('month', 30), ('old', 900), ('missing', 10), ('undated', NULL)) v(model, age)) y) z""", "matches"),
    "served_dates": sql(
        f"SELECT DISTINCT {text('match_date')} FROM matches WHERE league_code IN (SELECT league_code FROM matches GROUP BY league_code HAVING avg(fthg) > 2)", "matches"),
    "history_query": sql(f"SELECT match_id, league_code, {text('match_date')}, home_team, away_team, fthg, ftag FROM matches WHERE league_code IN ('L03', 'L07')", "matches"),
}
