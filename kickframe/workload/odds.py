"""Odds and value queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.operators import goals as gl
from kickframe.operators import insights as ins
from kickframe.operators import odds as od
from kickframe.sources.synthetic import matches, quotes
from kickframe.workload import goals as wg
from kickframe.workload import insights as wi
from kickframe.workload.common import big, r, sql, tidy

PROBS = ["prob_home", "prob_draw", "prob_away"]


def predictions(spark, sf):
    """Model triple per match: the closing-price prediction."""
    return gl.predict_from_odds(matches(spark, sf)).select(
        "match_id", "league_code", "home_team", "away_team", "p_home", "p_draw", "p_away",
        "predicted_outcome", "confidence")


def triples(spark, sf):
    return predictions(spark, sf).select("match_id", "p_home", "p_draw", "p_away")


def bets(spark, sf):
    q = quotes(spark, sf)
    return od.value_bets(triples(spark, sf), od.aggregate_odds(q), od.best_source(q))


def implied_probs(spark, sf):
    return tidy(od.implied_probs(quotes(spark, sf)), "match_id", "source", *PROBS)


AGG = ["avg_home", "avg_draw", "avg_away", "best_home", "best_draw", "best_away"]


def aggregate_odds(spark, sf):
    return tidy(od.aggregate_odds(quotes(spark, sf)), "match_id", "sources", *AGG, *PROBS)


def best_source(spark, sf):
    return tidy(od.best_source(quotes(spark, sf)))


def value_bets(spark, sf):
    out = bets(spark, sf)
    return tidy(out, "match_id", "outcome", "model_prob", "market_prob", "edge", "best_odds", "best_source")


def kelly_confidence(spark, sf):
    return tidy(bets(spark, sf), "match_id", "outcome", "kelly_fraction", "confidence", "min_value_odds")


def spelled(team: str):
    """Raw spellings that a feed might use for a canonical name."""
    t = F.col(team)
    kind = F.pmod("match_id", F.lit(4))
    return (
        F.when(kind == 0, F.upper(t)).when(kind == 1, F.concat(F.lit("  "), t))
        .when(kind == 2, F.concat(F.lit("FC "), t)).otherwise(F.concat(t, F.lit("x")))
    )


def match_by_containment(spark, sf):
    m = matches(spark, sf)
    feed = m.select(F.col("match_id").alias("odds_id"), "league_code", "match_date",
                    spelled("home_team").alias("home_team"), spelled("away_team").alias("away_team"))
    return tidy(od.match_by_containment(m, feed))


DIV = ["kl_div", "max_divergence", "sources_agree"] + [
    f"{n}_{x}" for n in ("divergence", "abs_divergence", "blended_prob") for x in "hda"]


def divergence(spark, sf):
    joined = triples(spark, sf).join(od.aggregate_odds(quotes(spark, sf)), "match_id")
    return tidy(od.divergence(joined), "match_id", *DIV)


def multi_source_divergence(spark, sf):
    out = od.multi_source_divergence(triples(spark, sf), od.aggregate_odds(quotes(spark, sf)))
    return tidy(out, "match_id", *DIV, "std_home", "std_draw", "std_away", "consensus")


def report_summary(spark, sf):
    return tidy(od.report_summary(triples(spark, sf), bets(spark, sf)))


def fixture_overview(spark, sf):
    m = matches(spark, sf)
    return tidy(od.fixture_overview(
        predictions(spark, sf), od.aggregate_odds(quotes(spark, sf)), bets(spark, sf), ins.team_stats(m)))


QUERIES = {
    f.__name__: f
    for f in (implied_probs, aggregate_odds, best_source, value_bets, kelly_confidence, match_by_containment,
              divergence, multi_source_divergence, report_summary, fixture_overview)
}

# --- oracles ---------------------------------------------------------------

IMPLIED = """imp AS (SELECT match_id, source, odds_home, odds_draw, odds_away, CASE WHEN t > 0 THEN rh/t ELSE 0.0 END AS prob_home,
CASE WHEN t > 0 THEN rd/t ELSE 0.0 END AS prob_draw, CASE WHEN t > 0 THEN ra/t ELSE 0.0 END AS prob_away FROM (
SELECT *, rh+rd+ra AS t FROM (SELECT *, CASE WHEN odds_home > 0 THEN 1.0/odds_home ELSE 0.0 END AS rh, CASE WHEN odds_draw > 0 THEN 1.0/odds_draw ELSE 0.0 END AS rd,
CASE WHEN odds_away > 0 THEN 1.0/odds_away ELSE 0.0 END AS ra FROM quotes) a) b)"""
AGGREGATE = """agg_o AS (SELECT match_id, count(*) AS sources, """ + ", ".join(
    f"coalesce(avg(odds_{s}) FILTER (odds_{s} > 0), 0.0) AS avg_{s}, coalesce(max(odds_{s}) FILTER (odds_{s} > 0), 0.0) AS best_{s}, "
    f"avg(prob_{s}) AS raw_{s}, stddev_pop(prob_{s}) AS std_{s}" for s in od.SIDES
) + """ FROM imp GROUP BY match_id), odds_a AS (SELECT *, """ + ", ".join(
    f"CASE WHEN raw_home+raw_draw+raw_away > 0 THEN raw_{s}/(raw_home+raw_draw+raw_away) ELSE raw_{s} END AS prob_{s}" for s in od.SIDES
) + " FROM agg_o)"
BEST = "best_s AS (SELECT match_id, " + ", ".join(
    f"coalesce(arg_min(source, ROW(-odds_{s}, source)) FILTER (odds_{s} > 0), '') AS source_{s}" for s in od.SIDES
) + " FROM quotes GROUP BY match_id)"
BETS = f"""{IMPLIED}, {AGGREGATE}, {BEST}, {wg.ODDS3}, bets AS (SELECT *, CASE WHEN best_odds - 1 <= 0 THEN 0.0 ELSE greatest(0.0, least(((best_odds-1)*model_prob-(1-model_prob))/(best_odds-1), 0.25)) END AS kelly_fraction,
CASE WHEN edge >= 0.10 AND model_prob >= 0.50 THEN 'HIGH' WHEN edge >= 0.05 AND model_prob >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, round(1.0/model_prob, 2) AS min_value_odds FROM (
SELECT *, model_prob - market_prob AS edge FROM (""" + " UNION ALL ".join(
    f"SELECT match_id, '{label}' AS outcome, p_{s} AS model_prob, prob_{s} AS market_prob, best_{s} AS best_odds, source_{s} AS best_source FROM odds3 JOIN odds_a USING (match_id) JOIN best_s USING (match_id)"
    for label, s in od.OUTCOMES) + ") u) v WHERE market_prob > 0 AND best_odds > 1.0 AND edge >= 0.03)"


def _div(bk: str) -> str:
    f = lambda c: f"greatest({c}, 1e-6)"
    kl = " + ".join(f"{f(f'p_{s}')} * ln({f(f'p_{s}')}/{f(f'{bk}{s}')})" for s in od.SIDES)
    top = lambda p: f"CASE WHEN {p}home >= {p}draw AND {p}home >= {p}away THEN 0 WHEN {p}draw >= {p}away THEN 1 ELSE 2 END"
    cols = [f"{kl} AS kl_div", "greatest(" + ", ".join(f"abs(p_{s}-{bk}{s})" for s in od.SIDES) + ") AS max_divergence",
            f"CAST(CASE WHEN {top('p_')} = {top(bk)} THEN 1 ELSE 0 END AS DOUBLE) AS sources_agree"]
    for s in od.SIDES:
        x = od.LABELS[s]
        cols += [f"p_{s}-{bk}{s} AS divergence_{x}", f"abs(p_{s}-{bk}{s}) AS abs_divergence_{x}",
                 f"(0.5*p_{s} + 0.3*{bk}{s})/0.8 AS blended_prob_{x}"]
    return ", ".join(cols)


ODDS = f"{IMPLIED}, {AGGREGATE}, {wg.ODDS3}"
LABEL = "CASE WHEN {c} >= 2.0 THEN 'good' WHEN {c} >= 1.5 THEN 'average' ELSE 'poor' END"
SPELL = """CASE match_id % 4 WHEN 0 THEN upper({t}) WHEN 1 THEN '  ' || {t} WHEN 2 THEN 'FC ' || {t} ELSE {t} || 'x' END"""

ORACLES = {
    "implied_probs": sql(f"SELECT match_id, source, {r(*PROBS)} FROM imp", "quotes", ctes=IMPLIED),
    "aggregate_odds": sql(f"SELECT match_id, {big('sources')}, {r(*AGG, *PROBS)} FROM odds_a", "quotes", ctes=f"{IMPLIED}, {AGGREGATE}"),
    "best_source": sql("SELECT * FROM best_s", "quotes", ctes=BEST),
    "value_bets": sql(f"SELECT match_id, outcome, best_source, {r('model_prob', 'market_prob', 'edge', 'best_odds')} FROM bets", "matches", "quotes", ctes=BETS),
    "kelly_confidence": sql(f"SELECT match_id, outcome, confidence, {r('kelly_fraction', 'min_value_odds')} FROM bets", "matches", "quotes", ctes=BETS),
    "match_by_containment": sql(
        """SELECT p.match_id, min(o.match_id) AS odds_id FROM matches p JOIN feed o USING (league_code, match_date)
WHERE (contains(lower(trim(p.home_team)), oh) OR contains(oh, lower(trim(p.home_team)))) AND (contains(lower(trim(p.away_team)), oa) OR contains(oa, lower(trim(p.away_team)))) GROUP BY p.match_id""",
        "matches", ctes=f"feed AS (SELECT match_id, league_code, match_date, lower({SPELL.format(t='home_team')}) AS oh, lower({SPELL.format(t='away_team')}) AS oa FROM matches)"),
    "divergence": sql(f"SELECT match_id, {r(*DIV)} FROM (SELECT match_id, {_div('prob_')} FROM odds3 JOIN odds_a USING (match_id)) t", "matches", "quotes", ctes=ODDS),
    "multi_source_divergence": sql(
        f"""SELECT match_id, {r(*DIV, 'std_home', 'std_draw', 'std_away', 'consensus')} FROM (SELECT match_id, {_div('raw_')}, std_home, std_draw, std_away,
1.0 - (std_home+std_draw+std_away)/3.0 AS consensus FROM odds3 JOIN odds_a USING (match_id)) t""", "matches", "quotes", ctes=ODDS),
    "report_summary": sql(
        """SELECT CAST(count(*) AS BIGINT) AS total_value_bets, CAST(count(*) FILTER (confidence='HIGH') AS BIGINT) AS high_confidence,
CAST(count(*) FILTER (confidence='MEDIUM') AS BIGINT) AS medium_confidence, (SELECT count(*) FROM matches) AS total_matches FROM bets""", "matches", "quotes", ctes=BETS),
    "fixture_overview": sql(
        f"""SELECT match_id, home_team, away_team, predicted_outcome, round(confidence, 6) AS confidence, value_bets, gap_outcome, round(CASE gap_outcome WHEN 'home' THEN gh WHEN 'draw' THEN gd ELSE ga END, 6) + 0.0 AS gap,
home_form, away_form FROM (SELECT *, CASE WHEN abs(gh) >= abs(gd) AND abs(gh) >= abs(ga) THEN 'home' WHEN abs(gd) >= abs(ga) THEN 'draw' ELSE 'away' END AS gap_outcome FROM (
SELECT m.match_id, m.home_team, m.away_team, {wg.FAV.format(h='p_home', d='p_draw', a='p_away')} AS predicted_outcome, greatest(p_home, p_draw, p_away) AS confidence,
coalesce(l.t, '') AS value_bets, p_home - prob_home AS gh, p_draw - prob_draw AS gd, p_away - prob_away AS ga, {LABEL.format(c='sh.form_points')} AS home_form, {LABEL.format(c='sa.form_points')} AS away_form
FROM matches m JOIN odds3 USING (match_id) LEFT JOIN odds_a o USING (match_id) LEFT JOIN (SELECT match_id, string_agg(outcome || ':' || CAST(round(edge*10000) AS BIGINT) || ':' || confidence, ';' ORDER BY outcome) AS t FROM bets GROUP BY match_id) l USING (match_id)
LEFT JOIN stats_ sh ON sh.team = m.home_team LEFT JOIN stats_ sa ON sa.team = m.away_team) a) b""",
        "matches", "quotes", ctes=f"{BETS}, {wi.ROWS}, {wi.TEAM_STATS}"),
}
