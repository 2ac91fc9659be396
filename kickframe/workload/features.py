"""Feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kickframe.operators import features as feat
from kickframe.operators.windows import hot_keys
from kickframe.params import FEATURES, TRAINING
from kickframe.sources.synthetic import matches
from kickframe.workload.common import big, r, sql, text, tidy

STATS = list(feat.ALL_STATS)
AVGS = [f"avg_{s}" for s in STATS] + ["form"]
SIDES = [f"{side}_{n}" for n in AVGS for side in ("home", "away", "diff")]


def _hot(m: DataFrame) -> DataFrame | None:
    return hot_keys(feat.team_matches(m, stats=()), ["team"])


def team_matches(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(feat.team_matches(matches(spark, sf)))


def rolling_team_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = matches(spark, sf)
    out = feat.rolling_team_stats(feat.team_matches(m), hot=_hot(m))
    return tidy(out, "match_id", "team", "is_home", *AVGS)


def match_features(spark: SparkSession, sf: str) -> DataFrame:
    m = matches(spark, sf)
    return tidy(feat.match_features(m, hot=_hot(m)), "match_id", *SIDES)


def odds_features(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(feat.odds_features(matches(spark, sf)), "match_id", *feat.ODDS_COLUMNS)


XG = ["home_xg_rolling", "away_xg_rolling", "home_xga_rolling", "away_xga_rolling", "xg_diff"]
REST = ["home_rest_days", "away_rest_days", "rest_advantage", "home_fatigued", "away_fatigued", "is_midweek"]
H2H = ["h2h_home_wins", "h2h_draws", "h2h_total_goals_avg"]
DRAW = ["home_draw_pct", "away_draw_pct", "avg_draw_pct"]
SIM = ["form_gap", "attack_similarity", "defense_similarity", "combined_defensive"]


def xg_rolling(spark: SparkSession, sf: str) -> DataFrame:
    m = matches(spark, sf)
    return tidy(feat.form_features(m, (feat.XG,), hot=_hot(m)), "match_id", *XG)


def fatigue(spark: SparkSession, sf: str) -> DataFrame:
    m = matches(spark, sf)
    return tidy(feat.form_features(m, (feat.FATIGUE,), hot=_hot(m)), "match_id", *REST)


def h2h_last5(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(feat.h2h_last5(matches(spark, sf)), "match_id", *H2H)


def draw_features(spark: SparkSession, sf: str) -> DataFrame:
    m = matches(spark, sf)
    hot = _hot(m)
    out = feat.form_features(feat.match_features(m, hot=hot), (feat.DRAWS,), hot=hot)
    return tidy(out, "match_id", *DRAW, *SIM)


ALL = SIDES + list(feat.ODDS_COLUMNS) + XG + REST + H2H + DRAW + SIM


def all_features(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(feat.all_features(matches(spark, sf)), "match_id", *ALL)


INTL = [f"{s}_{n}" for n in ("avg_gf", "avg_ga", "form") for s in ("home", "away", "diff")] + H2H + DRAW + SIM + ["is_neutral"]


def intl_features(spark: SparkSession, sf: str) -> DataFrame:
    m = matches(spark, sf).withColumn("neutral", F.col("is_cross"))
    return tidy(feat.intl_features(m), "match_id", *INTL)


def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(feat.feature_matrix(feat.all_features(matches(spark, sf))))


def time_decay_weights(spark: SparkSession, sf: str) -> DataFrame:
    out = feat.time_decay_weights(matches(spark, sf), TRAINING.half_life_days)
    return tidy(out, "match_id", "weight")


QUERIES = {
    f.__name__: f
    for f in (team_matches, rolling_team_stats, match_features, odds_features, xg_rolling, fatigue,
              h2h_last5, draw_features, all_features, intl_features, feature_matrix, time_decay_weights)
}


# --- oracles ---------------------------------------------------------------

def records_cte(src: str, name: str = "rec") -> str:
    home = ", ".join(f"{h} AS {s}" for s, (h, _) in feat.MIRRORED.items())
    away = ", ".join(f"{a} AS {s}" for s, (_, a) in feat.MIRRORED.items())
    return f"""{name} AS (
SELECT match_id, match_date, home_team AS team, away_team AS opponent, 1 AS is_home, {home} FROM {src}
UNION ALL SELECT match_id, match_date, away_team, home_team, 0, {away} FROM {src})"""


def roll_cte(stats=STATS, rec: str = "rec", name: str = "roll") -> str:
    cols = [f"CASE WHEN count({s}) OVER w >= 3 THEN avg({s}) OVER w END AS avg_{s}" for s in stats]
    return f"""{name} AS (SELECT match_id, team, is_home, {', '.join(cols)},
CASE WHEN count(*) OVER w >= 3 THEN avg(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) OVER w END AS form
FROM {rec} WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


def c3_cte(src: str, stats=STATS, roll: str = "roll", name: str = "c3") -> str:
    names = [f"avg_{s}" for s in stats] + ["form"]
    cols = ", ".join(
        f"h.{n} AS home_{n}, a.{n} AS away_{n}, h.{n} - a.{n} AS diff_{n}" for n in names
    )
    keep = " AND ".join(f"h.{n} IS NOT NULL AND a.{n} IS NOT NULL" for n in names)
    return f"""{name} AS (SELECT m.*, {cols} FROM {src} m JOIN {roll} h ON h.match_id = m.match_id AND h.is_home = 1
JOIN {roll} a ON a.match_id = m.match_id AND a.is_home = 0 WHERE {keep})"""


ODDS_SQL = """1.0/b365h AS odds_prob_h, 1.0/b365d AS odds_prob_d, 1.0/b365a AS odds_prob_a,
(1.0/b365h)/(1.0/b365h+1.0/b365d+1.0/b365a) AS norm_prob_h, (1.0/b365d)/(1.0/b365h+1.0/b365d+1.0/b365a) AS norm_prob_d,
(1.0/b365a)/(1.0/b365h+1.0/b365d+1.0/b365a) AS norm_prob_a,
(1.0/b365h - 1.0/b365a)/(1.0/b365h+1.0/b365d+1.0/b365a) AS odds_spread"""


def team_pass_cte(src: str, name: str = "tp") -> str:
    """xG, rest and draw share per side, folded to one row per match."""
    hx = "CAST(0.30 AS DOUBLE)*hst + CAST(0.03 AS DOUBLE)*greatest(hs_shots-hst,0)"
    ax = "CAST(0.30 AS DOUBLE)*ast + CAST(0.03 AS DOUBLE)*greatest(as_shots-ast,0)"
    return f"""{name}_rec AS (
SELECT match_id, match_date, home_team AS team, 1 AS is_home, {hx} AS xg, {ax} AS xga, CASE WHEN fthg=ftag THEN 1 ELSE 0 END AS dr FROM {src}
UNION ALL SELECT match_id, match_date, away_team, 0, {ax}, {hx}, CASE WHEN fthg=ftag THEN 1 ELSE 0 END FROM {src}),
{name}_w AS (SELECT match_id, is_home, coalesce(avg(xg) OVER w, 0.0) AS xg_rolling, coalesce(avg(xga) OVER w, 0.0) AS xga_rolling,
coalesce(avg(dr) OVER w, 0.0) AS draw_pct,
coalesce(least(match_date - lag(match_date) OVER (PARTITION BY team ORDER BY match_date, match_id), 30), 14) AS rest_days
FROM {name}_rec WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT h.match_id, h.xg_rolling AS home_xg_rolling, a.xg_rolling AS away_xg_rolling, h.xga_rolling AS home_xga_rolling,
a.xga_rolling AS away_xga_rolling, h.xg_rolling - a.xg_rolling AS xg_diff,
h.rest_days AS home_rest_days, a.rest_days AS away_rest_days, h.rest_days - a.rest_days AS rest_advantage,
CASE WHEN h.rest_days <= 3 THEN 1 ELSE 0 END AS home_fatigued, CASE WHEN a.rest_days <= 3 THEN 1 ELSE 0 END AS away_fatigued,
h.draw_pct AS home_draw_pct, a.draw_pct AS away_draw_pct, (h.draw_pct + a.draw_pct)/2 AS avg_draw_pct
FROM {name}_w h JOIN {name}_w a ON a.match_id = h.match_id AND a.is_home = 0 WHERE h.is_home = 1)"""


def h2h_cte(src: str, name: str = "hh") -> str:
    return f"""{name}_j AS (SELECT m.match_id, p.fthg + p.ftag AS g,
CASE WHEN p.fthg = p.ftag THEN 1 ELSE 0 END AS d,
CASE WHEN (p.home_team = m.home_team AND p.fthg > p.ftag) OR (p.home_team <> m.home_team AND p.fthg < p.ftag) THEN 1 ELSE 0 END AS w,
row_number() OVER (PARTITION BY m.match_id ORDER BY p.match_date DESC, p.match_id DESC) AS rn
FROM {src} m JOIN {src} p ON least(m.home_team, m.away_team) = least(p.home_team, p.away_team)
 AND greatest(m.home_team, m.away_team) = greatest(p.home_team, p.away_team) AND p.match_date < m.match_date),
{name}_a AS (SELECT match_id, count(*) AS n, sum(w) AS w, sum(d) AS d, sum(g) AS g FROM {name}_j WHERE rn <= 5 GROUP BY match_id),
{name} AS (SELECT m.match_id, CASE WHEN n >= 2 THEN CAST(w AS DOUBLE)/n END AS h2h_home_wins,
CASE WHEN n >= 2 THEN CAST(d AS DOUBLE)/n END AS h2h_draws, CASE WHEN n >= 2 THEN CAST(g AS DOUBLE)/n END AS h2h_total_goals_avg
FROM {src} m LEFT JOIN {name}_a USING (match_id))"""


SIM_SQL = """abs(home_form - away_form) AS form_gap, 1/(1+abs(home_avg_gf-away_avg_gf)) AS attack_similarity,
1/(1+abs(home_avg_ga-away_avg_ga)) AS defense_similarity, 1/(1+home_avg_ga) + 1/(1+away_avg_ga) AS combined_defensive"""
MIDWEEK = "CASE WHEN isodow(match_date) IN (2,3) THEN 1 ELSE 0 END AS is_midweek"


def all_features_ctes(src: str = "matches", name: str = "feat", stats=STATS) -> str:
    """The whole chain; `name` ends up with the match columns and every feature."""
    return ", ".join([
        records_cte(src), roll_cte(stats), c3_cte(src, stats), team_pass_cte("c3"), h2h_cte("c3"),
        f"""{name} AS (SELECT c3.*, {ODDS_SQL}, {SIM_SQL}, {MIDWEEK},
tp.* EXCLUDE (match_id), hh.* EXCLUDE (match_id) FROM c3 JOIN tp USING (match_id) JOIN hh USING (match_id))""",
    ])


INT_FEATURES = set(REST)


def _listed(columns) -> str:
    ints = [c for c in columns if c in INT_FEATURES or c == "is_neutral"]
    return ", ".join(x for x in (r(*[c for c in columns if c not in ints]), big(*ints)) if x)


# The model's columns in the order the operator produces them.
MATRIX = [c for c in ALL if c not in feat.ODDS_COLUMNS]

ORACLES = {
    "team_matches": sql(
        f"SELECT match_id, {text('match_date')}, team, opponent, {big('is_home', *STATS)} FROM rec",
        "matches", ctes=records_cte("matches")),
    "rolling_team_stats": sql(
        f"SELECT match_id, team, {big('is_home')}, {r(*AVGS)} FROM roll",
        "matches", ctes=records_cte("matches") + ", " + roll_cte()),
    "match_features": sql(
        f"SELECT match_id, {r(*SIDES)} FROM c3",
        "matches", ctes=", ".join([records_cte("matches"), roll_cte(), c3_cte("matches")])),
    "odds_features": sql(
        f"SELECT match_id, {r(*feat.ODDS_COLUMNS)} FROM (SELECT match_id, {ODDS_SQL} FROM matches) t", "matches"),
    "xg_rolling": sql(f"SELECT match_id, {r(*XG)} FROM tp", "matches", ctes=team_pass_cte("matches")),
    "fatigue": sql(
        f"SELECT match_id, {big(*REST)} FROM (SELECT tp.*, {MIDWEEK} FROM tp JOIN matches USING (match_id)) t",
        "matches", ctes=team_pass_cte("matches")),
    "h2h_last5": sql(f"SELECT match_id, {r(*H2H)} FROM hh", "matches", ctes=h2h_cte("matches")),
    "draw_features": sql(
        f"SELECT match_id, {r(*DRAW, *SIM)} FROM (SELECT *, {SIM_SQL} FROM c3 JOIN tp USING (match_id)) t",
        "matches", ctes=", ".join([records_cte("matches"), roll_cte(), c3_cte("matches"), team_pass_cte("c3")])),
    "all_features": sql(f"SELECT match_id, {_listed(ALL)} FROM feat", "matches", ctes=all_features_ctes()),
    "intl_features": sql(
        f"""SELECT match_id, {_listed(INTL)} FROM (SELECT c3.*, {SIM_SQL}, tp.* EXCLUDE (match_id), hh.* EXCLUDE (match_id),
CAST(is_cross AS INT) AS is_neutral FROM c3 JOIN tp USING (match_id) JOIN hh USING (match_id)) t""",
        "matches", ctes=", ".join([records_cte("matches"), roll_cte(feat.GOAL_STATS), c3_cte("matches", feat.GOAL_STATS),
                                   team_pass_cte("c3"), h2h_cte("c3")])),
    "feature_matrix": sql(
        f"""SELECT match_id, {text('match_date')}, {_listed(MATRIX)},
CAST(CASE WHEN fthg > ftag THEN 2 WHEN fthg < ftag THEN 0 ELSE 1 END AS BIGINT) AS label FROM feat""",
        "matches", ctes=all_features_ctes()),
    "time_decay_weights": sql(
        "SELECT match_id, round(pow(0.5, ((SELECT max(match_date) FROM matches) - match_date) / 540.0), 6) + 0.0 AS weight FROM matches",
        "matches"),
}
