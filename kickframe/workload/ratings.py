"""Rating queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kickframe.operators import ratings as rt
from kickframe.params import CROSS
from kickframe.sources.synthetic import domestic, matches
from kickframe.workload.common import r, sql, tidy

WALK = ["elo_home", "elo_away", "elo_diff", "elo_expected_home", "elo_expected_away"]


def supplementary(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).where("is_cross")


def linked_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return rt.elo_final(rt.both_corpora(domestic(spark, sf), supplementary(spark, sf)))


def elo_walk(spark, sf):
    return tidy(rt.elo_walk(domestic(spark, sf)), "match_id", "pool", *WALK)


def neutral_matches(spark, sf):
    neutral = F.col("hy") == 0
    return domestic(spark, sf).withColumn("neutral", neutral).withColumn("home_adv", rt.neutral_advantage(neutral))


def elo_neutral(spark, sf):
    return tidy(rt.elo_walk(neutral_matches(spark, sf)), "match_id", *WALK)


def elo_cross_competition(spark, sf):
    return tidy(rt.shared_walk(domestic(spark, sf), supplementary(spark, sf)), "match_id", "source", *WALK)


def elo_final_top_n(spark, sf):
    return tidy(rt.top_rated(rt.elo_final(domestic(spark, sf))), "team", "rating")


def league_of_team(spark, sf):
    return tidy(rt.league_of_team(matches(spark, sf)))


def league_strata(spark, sf):
    return tidy(rt.league_strata(linked_ratings(spark, sf), rt.league_of_team(domestic(spark, sf))))


def elo_to_1x2(spark, sf):
    h, d, a = rt.elo_to_1x2(F.col("elo_expected_home"))
    walked = rt.elo_walk(domestic(spark, sf))
    return tidy(walked.select("match_id", h.alias("home_win"), d.alias("draw"), a.alias("away_win")))


def rating_pools(spark, sf):
    m = matches(spark, sf)
    ends = [F.col("home_league").alias("league_a"), F.col("away_league").alias("league_b")]
    every = rt.rating_pools(m.select(*ends)).withColumn("scope", F.lit("all"))
    sealed = rt.rating_pools(m.where(~F.col("is_cross")).select(*ends)).withColumn("scope", F.lit("domestic"))
    return tidy(every.unionByName(sealed))


QUERIES = {
    f.__name__: f
    for f in (elo_walk, elo_neutral, elo_cross_competition, elo_final_top_n, league_of_team,
              league_strata, elo_to_1x2, rating_pools)
}


# --- oracles ---------------------------------------------------------------

SEALED_INDEX = "CAST(right({c},2) AS INT)+1"
LINKED_INDEX = "CAST(substr({c},2,2) AS INT)*20 + CAST(right({c},2) AS INT)+1"


def walk_ctes(src: str, pool: str, size: int, adv: str = "65.0", index: str = SEALED_INDEX, name: str = "walk") -> str:
    """Recursive walk holding one list of ratings per pool.

    `{name}` has one row per match (match_id, pool, rh, ra, exph, d);
    `{name}_end` the final (pool, slot, rating).
    """
    hi, ai = index.format(c="home_team"), index.format(c="away_team")
    return f"""{name}_m AS MATERIALIZED (SELECT match_id, match_date, fthg, ftag, {pool} AS pool, CAST({adv} AS DOUBLE) AS adv, {hi} AS hi, {ai} AS ai,
 row_number() OVER (PARTITION BY {pool} ORDER BY match_date, is_cross, match_id) AS k FROM {src}),
{name}_w(pool,k,match_id,rh,ra,exph,d,hi,ai,st) AS (
 SELECT DISTINCT pool, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
  CAST(NULL AS INT), CAST(NULL AS INT), list_transform(range({size}), lambda x: CAST(1500.0 AS DOUBLE)) FROM {name}_m
 UNION ALL
 SELECT pool,k,match_id,rh,ra,exph,d,hi,ai, list_transform(st, lambda x, i: CASE WHEN i=hi THEN x+d WHEN i=ai THEN x-d ELSE x END) FROM (
  SELECT *, CAST(32.0 AS DOUBLE)*mm*(s-exph) AS d FROM (SELECT *, 1.0/(1.0+pow(10.0,(ra-(rh+adv))/400.0)) AS exph FROM (
   SELECT w.pool, m.k, m.match_id, m.hi, m.ai, w.st, m.adv, w.st[m.hi] AS rh, w.st[m.ai] AS ra,
     CAST(CASE WHEN fthg>ftag THEN 1.0 WHEN fthg<ftag THEN 0.0 ELSE 0.5 END AS DOUBLE) AS s,
     CASE WHEN fthg=ftag THEN CAST(1.0 AS DOUBLE) ELSE ln(abs(fthg-ftag)+1) END AS mm
   FROM {name}_w w JOIN {name}_m m ON m.pool=w.pool AND m.k=w.k+1) a) b) c),
{name} AS (SELECT pool, match_id, rh AS elo_home, ra AS elo_away, rh-ra AS elo_diff, exph AS elo_expected_home, 1.0-exph AS elo_expected_away, d FROM {name}_w WHERE k>0)"""


def final_cte(src: str, walk: str = "walk", name: str = "final") -> str:
    """Final rating per team: pre-match rating plus the step of its last match."""
    return f"""{name} AS (SELECT team, arg_max(post, ROW(match_date, is_cross, match_id)) AS rating FROM (
SELECT m.match_date, m.is_cross, m.match_id, m.home_team AS team, w.elo_home + w.d AS post FROM {walk} w JOIN {src} m USING (match_id)
UNION ALL SELECT m.match_date, m.is_cross, m.match_id, m.away_team, w.elo_away - w.d FROM {walk} w JOIN {src} m USING (match_id)) t GROUP BY team)"""


DOM = "dom AS (SELECT * FROM matches WHERE NOT is_cross)"
SEALED = walk_ctes("dom", "league_code", 20)
LINKED = walk_ctes("matches", "'all'", 400, index=LINKED_INDEX)
LEAGUE_OF = """league_of AS (SELECT team, arg_max(league_code, ROW(match_date, match_id)) AS league_code FROM (
SELECT home_team AS team, match_date, match_id, league_code FROM {src} UNION ALL SELECT away_team, match_date, match_id, league_code FROM {src}) t GROUP BY team)"""


def _reach(tag: str, where: str) -> str:
    return f"""e_{tag} AS (SELECT DISTINCT home_league AS a, away_league AS b FROM matches {where} UNION SELECT DISTINCT away_league, home_league FROM matches {where}),
r_{tag}(a, b) AS (SELECT a, b FROM e_{tag} UNION SELECT r.a, e.b FROM r_{tag} r JOIN e_{tag} e ON e.a = r.b)"""


ORACLES = {
    "elo_walk": sql(f"SELECT match_id, pool, {r(*WALK)} FROM walk", "matches", recursive=True, ctes=f"{DOM}, {SEALED}"),
    "elo_neutral": sql(
        f"SELECT match_id, {r(*WALK)} FROM walk", "matches", recursive=True,
        ctes=f"{DOM}, " + walk_ctes("dom", "league_code", 20, adv="CASE WHEN hy = 0 THEN 0.0 ELSE 65.0 END")),
    "elo_cross_competition": sql(
        f"SELECT w.match_id, CASE WHEN is_cross THEN 'supplementary' ELSE 'domestic' END AS source, {r(*WALK)} FROM walk w JOIN matches USING (match_id)",
        "matches", recursive=True, ctes=LINKED),
    "elo_final_top_n": sql(
        "SELECT team, round(rating, 6) AS rating FROM final ORDER BY rating DESC, team LIMIT 10",
        "matches", recursive=True, ctes=f"{DOM}, {SEALED}, " + final_cte("dom")),
    "league_of_team": sql("SELECT team, league_code FROM league_of", "matches", ctes=LEAGUE_OF.format(src="matches")),
    "league_strata": sql(
        """SELECT league_code, round(mean_rating, 6) AS mean_rating, round(max_rating, 6) AS max_rating, CAST(teams AS BIGINT) AS teams,
round(max(mean_rating) OVER () - min(mean_rating) OVER (), 6) AS spread,
CAST(sum(CASE WHEN round(mean_rating, 1) = 1500.0 THEN 1 ELSE 0 END) OVER () AS BIGINT) AS pinned
FROM (SELECT league_code, avg(rating) AS mean_rating, max(rating) AS max_rating, count(*) AS teams FROM final JOIN league_of USING (team) GROUP BY league_code) t""",
        "matches", recursive=True,
        ctes=f"{DOM}, {LINKED}, {final_cte('matches')}, " + LEAGUE_OF.format(src="dom")),
    "elo_to_1x2": sql(
        f"""SELECT match_id, round(elo_expected_home * (1.0 - {CROSS.draw_rate}), 6) AS home_win, round(CAST({CROSS.draw_rate} AS DOUBLE), 6) AS draw,
round((1.0 - elo_expected_home) * (1.0 - {CROSS.draw_rate}), 6) AS away_win FROM walk""",
        "matches", recursive=True, ctes=f"{DOM}, {SEALED}"),
    "rating_pools": sql(
        """SELECT a AS league, min(b) AS pool, 'all' AS scope FROM r_all GROUP BY a
UNION ALL SELECT a, min(b), 'domestic' FROM r_dom GROUP BY a""",
        "matches", recursive=True, ctes=_reach("all", "") + ", " + _reach("dom", "WHERE NOT is_cross")),
}
