"""Training, scoring and backtest queries.

Score-model fits run to convergence, and the ensemble's learners use the
published settings of `params.TRAINING`. Neither settings nor data are reduced.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.operators import features as feat
from kickframe.operators import fixtures as fx
from kickframe.operators import goals as gl
from kickframe.operators import ratings as rt
from kickframe.operators import scoring as sc
from kickframe.operators.windows import chronological_index
from kickframe.params import CROSS, TRAINING
from kickframe.plans import backtest as bt
from kickframe.plans import modelstore as ms
from kickframe.plans import training as tr
from kickframe.plans.dixoncoles import dc_fit as fit_dixon_coles
from kickframe.session import scratch_path, stage
from kickframe.sources.synthetic import domestic, matches
from kickframe.workload import evaluation as wev
from kickframe.workload import features as wf
from kickframe.workload import goals as wg
from kickframe.workload import ratings as wr
from kickframe.workload.common import big, r, sql, text, tidy


def training_rows(spark, sf):
    """Feature matrix of domestic matches with the shared walk's ratings and a chronological index.

    The index reads its input twice, and fits read the result many times.
    """
    home = domestic(spark, sf)
    walked = rt.shared_walk(home, wr.supplementary(spark, sf)).where("source = 'domestic'").select("match_id", *wr.WALK)
    matrix = stage(feat.feature_matrix(feat.all_features(home)).join(walked, "match_id"), "matrix")
    return stage(chronological_index(matrix), "training")


def model_columns(rows):
    return [c for c in rows.columns if c not in tr.KEEP]


def impute_scale(spark, sf):
    rows = training_rows(spark, sf)
    cols = model_columns(rows)
    train = tr.chrono_split(rows).where("part = 'base'")
    pre = tr.fit_preprocessor(tr.as_double(train, cols), cols)
    out = list(zip(pre.columns, pre.median, pre.mean, pre.deviation))
    return tidy(spark.createDataFrame(out, "feature string, median double, mean double, std double"))


def time_series_folds(spark, sf):
    out = tr.time_series_folds(chronological_index(matches(spark, sf)))
    return tidy(out, "match_id", "idx", "test_fold")


def chrono_split(spark, sf):
    out = tr.chrono_split(chronological_index(matches(spark, sf).withColumn("label", feat.encoded_result())))
    return tidy(out, "match_id", "part")


def cross_validate(spark, sf):
    rows = training_rows(spark, sf)
    return tidy(tr.cross_validate(rows, model_columns(rows), TRAINING))


def base_models(spark, sf):
    rows = tr.chrono_split(training_rows(spark, sf), TRAINING)
    ensemble = tr.fit_ensemble(rows.where("part = 'base'"), model_columns(rows.drop("part")), TRAINING)
    return tidy(tr.model_probabilities(ensemble, rows.where("part = 'test'"), ["match_id"]))


def soft_vote(spark, sf):
    rows = tr.chrono_split(training_rows(spark, sf), TRAINING)
    ensemble = tr.fit_ensemble(rows.where("part = 'base'"), model_columns(rows.drop("part")), TRAINING)
    return tidy(tr.soft_vote(ensemble, rows.where("part = 'test'")), "match_id", "p_away", "p_draw", "p_home")


def calibrate(spark, sf):
    rows = training_rows(spark, sf)
    _, metrics = tr.build_ensemble(rows, model_columns(rows), TRAINING)
    return tidy(metrics)


def feature_importance(spark, sf):
    rows = training_rows(spark, sf)
    ensemble = tr.fit_ensemble(rows, model_columns(rows), TRAINING, names=("forest",))
    return tidy(tr.feature_importance(ensemble, spark))


def hyper_search(spark, sf):
    rows = training_rows(spark, sf)
    return tidy(tr.hyper_search(rows, model_columns(rows), TRAINING))


def predict_fixtures(spark, sf):
    """Unplayed domestic fixtures, scored by a model that was published and loaded again.

    Model, features, ratings and score strengths know the matches before the fixtures only.
    """
    m = matches(spark, sf)
    history, unplayed = wev.split(m)
    known = history.agg(F.max("match_date")).first()[0]
    rows = training_rows(spark, sf).where(F.col("match_date") <= F.lit(known))
    ensemble = tr.fit_ensemble(rows, model_columns(rows), TRAINING)
    root = scratch_path(spark, "models")
    ms.publish(ensemble, root, "domestic", known)

    past = stage(history, "history")
    home, linked = past.where("NOT is_cross"), past.where("is_cross")
    fixtures = unplayed.join(domestic(spark, sf).select("match_id"), "match_id", "left_semi")
    # Each is read several times below.
    featured = stage(feat.all_features(home), "featured")
    ratings = stage(rt.elo_final(rt.both_corpora(home, linked)), "ratings")
    strengths = stage(gl.moment_strengths(past, 0), "strengths")
    ready = stage(fx.fixture_features(fixtures, featured, ratings), "ready")
    rates = gl.dc_rates(fixtures.drop("hy"), strengths, strengths.agg(F.max("home_advantage")).scalar())
    return tidy(tr.predict_fixtures(ms.load(spark, root, "domestic"), ready, gl.goal_markets(rates, wg.RHO), 0.4))


def dc_fit(spark, sf):
    model = fit_dixon_coles(matches(spark, sf))
    out = model.strengths(spark).withColumns({
        "converged": F.lit(model.converged),
        "home_advantage": F.lit(model.home_advantage), "rho": F.lit(model.rho), "loss": F.lit(model.loss)})
    return tidy(out)


def odds_scored(spark, sf, which="true"):
    """Closing-price triple against the outcome, with the score model of all matches as q_*, of those that `which` holds for."""
    m = matches(spark, sf)
    chosen = m.where(which)
    priced = gl.predict_from_odds(chosen).select("match_id", "league_code", "p_away", "p_draw", "p_home", feat.encoded_result().alias("label"))
    goals = gl.goal_markets(wg.rates(m, priced=chosen), wg.RHO).select(
        "match_id", F.col("away_win").alias("q_away"), F.col("draw").alias("q_draw"), F.col("home_win").alias("q_home"))
    return priced.join(goals, "match_id")


def priced_only(spark, sf):
    return gl.predict_from_odds(matches(spark, sf)).withColumn("label", feat.encoded_result())


def metrics_1x2(spark, sf):
    return tidy(sc.metrics_1x2(priced_only(spark, sf), ("league_code",)))


def class_report(spark, sf):
    return tidy(sc.class_report(priced_only(spark, sf)))


def calibration_curve(spark, sf):
    return tidy(sc.calibration_curve(priced_only(spark, sf)))


def blend_sweep(spark, sf):
    return tidy(sc.blend_sweep(odds_scored(spark, sf)))


def cross_scored(spark, sf):
    """Cross-league matches: shared-walk expectation and score-model triple.

    Ratings and strengths come from all matches; only cross-league ones are moved on to be priced and joined.
    """
    dom, sup = domestic(spark, sf), wr.supplementary(spark, sf)
    walked = rt.shared_walk(dom, sup, only="supplementary").select("match_id", "elo_expected_home")
    return odds_scored(spark, sf, "is_cross").join(walked, "match_id").select(
        "match_id", "elo_expected_home", "q_away", "q_draw", "q_home", "label")


def blend_grid_2d(spark, sf):
    return tidy(sc.blend_grid_2d(stage(cross_scored(spark, sf), "cross")))


def baselines(spark, sf):
    return tidy(sc.baselines(stage(cross_scored(spark, sf), "cross"), weight=0.6))


def bootstrap_interval(spark, sf):
    """Elo alone against an even blend, per cross-league match."""
    rows = stage(cross_scored(spark, sf), "cross")
    elo = sc.elo_triple(F.col("elo_expected_home"), CROSS.draw_rate)
    mixed = sc._mix(elo, sc.triple_of("q_"), F.lit(0.5))
    diff = sc.loss(F.col("label"), *mixed) - sc.loss(F.col("label"), *elo)
    return tidy(sc.bootstrap_interval(rows.select("match_id", diff.alias("diff"))))


def season_folds(spark, sf):
    return tidy(bt.season_folds(wr.supplementary(spark, sf)))


def rolling_origin(spark, sf):
    rows, folds = bt.rolling_origin(domestic(spark, sf), wr.supplementary(spark, sf))
    if rows is None:
        return tidy(folds)
    return tidy(rows)


def heldout_rows(spark, sf):
    """Rows of the rolling-origin backtest: every match priced by models of what was before its season."""
    rows, _ = bt.rolling_origin(domestic(spark, sf), wr.supplementary(spark, sf))
    if rows is None:
        rows = spark.createDataFrame([], "match_id long, elo_expected_home double, q_away double, q_draw double, q_home double, label int")
    return stage(rows, "heldout")


def heldout_grid(spark, sf):
    return tidy(sc.blend_grid_2d(heldout_rows(spark, sf)))


def heldout_baselines(spark, sf):
    return tidy(sc.baselines(heldout_rows(spark, sf)))


def heldout_bootstrap(spark, sf):
    """The best cell, chosen anew in every resample, against the configured one."""
    return tidy(sc.selection_bootstrap(heldout_rows(spark, sf)))


def calibration_effect(spark, sf):
    return tidy(bt.calibration_effect(domestic(spark, sf), wr.supplementary(spark, sf)))


def domestic_blend_tune(spark, sf):
    """Ensemble on the head, score model before the boundary, sweep on the tail."""
    rows = tr.chrono_split(training_rows(spark, sf), TRAINING)
    head, tail = rows.where("part = 'base'"), rows.where("part = 'test'")
    ensemble = tr.fit_ensemble(head, model_columns(rows.drop("part")), TRAINING)
    boundary = tail.agg(F.min("match_date")).first()[0]
    m = matches(spark, sf)
    model = fit_dixon_coles(m.where(F.col("match_date") < F.lit(boundary)))
    rates = gl.dc_rates(m.select("match_id", "home_team", "away_team"), model.strengths(spark), F.lit(model.home_advantage))
    goals = gl.goal_markets(rates, model.rho).select(
        "match_id", F.col("away_win").alias("q_away"), F.col("draw").alias("q_draw"), F.col("home_win").alias("q_home"))
    return tidy(sc.blend_sweep(tr.soft_vote(ensemble, tail).join(goals, "match_id")))


QUERIES = {
    f.__name__: f
    for f in (dc_fit, impute_scale, time_series_folds, cross_validate, base_models, soft_vote, chrono_split, calibrate,
              metrics_1x2, class_report, calibration_curve, feature_importance, hyper_search, predict_fixtures,
              season_folds, rolling_origin, blend_sweep, blend_grid_2d, baselines, bootstrap_interval,
              heldout_grid, heldout_baselines, heldout_bootstrap,
              calibration_effect, domestic_blend_tune)
}

# --- oracles ---------------------------------------------------------------

INDEX = "ix AS (SELECT match_id, row_number() OVER (ORDER BY match_date, match_id) - 1 AS idx, count(*) OVER () AS n FROM matches)"
LABEL = "CASE WHEN fthg > ftag THEN 2 WHEN fthg < ftag THEN 0 ELSE 1 END"
PRICED = f"{wg.ODDS3}, priced AS (SELECT match_id, league_code, p_away, p_draw, p_home, {LABEL} AS label FROM matches JOIN odds3 USING (match_id))"
GOALS3 = f"{wg.GRID}, goals3 AS (SELECT match_id, sum(p) FILTER (i < j) AS q_away, sum(p) FILTER (i = j) AS q_draw, sum(p) FILTER (i > j) AS q_home FROM grid GROUP BY match_id)"


def metric_sql(a: str = "p_away", d: str = "p_draw", h: str = "p_home") -> str:
    p = f"CASE label WHEN 0 THEN {a} WHEN 1 THEN {d} ELSE {h} END"
    sq = " + ".join(f"power({c} - CASE WHEN label = {i} THEN 1 ELSE 0 END, 2)" for i, c in enumerate((a, d, h)))
    return f"""round(avg(CASE WHEN label = CASE WHEN {a} >= {d} AND {a} >= {h} THEN 0 WHEN {d} >= {h} THEN 1 ELSE 2 END THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
round(avg(-ln(greatest(2.220446049250313e-16, least(1.0, {p})))), 6) AS log_loss, round(avg({sq}), 6) AS brier, CAST(count(*) AS BIGINT) AS matches"""


CROSS_ROWS = f"""{wr.LINKED}, {PRICED}, {GOALS3}, crossed AS (SELECT match_id, label, elo_expected_home AS e, q_away, q_draw, q_home FROM priced JOIN goals3 USING (match_id) JOIN walk USING (match_id)
JOIN (SELECT match_id FROM matches WHERE is_cross) c USING (match_id))"""
DR = CROSS.draw_rate
ELO3 = f"(1.0-e)*(1.0-{DR}) AS e_away, CAST({DR} AS DOUBLE) AS e_draw, e*(1.0-{DR}) AS e_home"
POINTS = ", ".join(f"({i}, {d}, {w})" for i, (d, w) in enumerate((d, w) for d in CROSS.draw_grid for w in CROSS.weight_grid))

TRAINED = [c for c in wf.MATRIX if c not in tr.KEEP] + wr.WALK

ORACLES = {
    "impute_scale": sql(
        f"""SELECT feature, round(any_value(med), 6) + 0.0 AS median, round(avg(coalesce(v, med)), 6) + 0.0 AS mean, round(stddev_pop(coalesce(v, med)), 6) + 0.0 AS std
FROM (SELECT feature, v, median(v) OVER (PARTITION BY feature) AS med FROM (
SELECT feature, v FROM (SELECT {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in TRAINED)} FROM base) UNPIVOT INCLUDE NULLS (v FOR feature IN ({", ".join(TRAINED)})))) t
GROUP BY feature HAVING count(v) > 0""",
        "matches", recursive=True, ctes=", ".join([
            wr.DOM, wf.all_features_ctes("dom"), wr.LINKED,
            """numbered AS (SELECT feat.*, walk.* EXCLUDE (pool, match_id, d), row_number() OVER (ORDER BY match_date, match_id) - 1 AS idx, count(*) OVER () AS n FROM feat JOIN walk USING (match_id))""",
            "base AS (SELECT * FROM numbered WHERE idx < n - floor(n*0.2) - floor(n*0.15))"])),
    "time_series_folds": sql(
        "SELECT match_id, idx, CAST(CASE WHEN idx >= n - 5*(n//6) THEN (idx - (n - 5*(n//6)))//(n//6) + 1 ELSE 0 END AS BIGINT) AS test_fold FROM ix", "matches", ctes=INDEX),
    "chrono_split": sql(
        "SELECT match_id, CASE WHEN idx < n - floor(n*0.2) - floor(n*0.15) THEN 'base' WHEN idx < n - floor(n*0.2) THEN 'calibration' ELSE 'test' END AS part FROM ix", "matches", ctes=INDEX),
    "metrics_1x2": sql(f"SELECT league_code, {metric_sql()} FROM priced GROUP BY league_code", "matches", ctes=PRICED),
    "class_report": sql(
        f"""SELECT CAST(k AS BIGINT) AS klass, CAST(support AS BIGINT) AS support, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2*pr*rc/(pr+rc) ELSE 0.0 END, 6) AS f1
FROM (SELECT k, support, CASE WHEN said > 0 THEN CAST(hits AS DOUBLE)/said ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN CAST(hits AS DOUBLE)/support ELSE 0.0 END AS rc FROM (
SELECT k, count(*) FILTER (label = k) AS support, count(*) FILTER (y = k) AS said, count(*) FILTER (label = k AND y = k) AS hits
FROM (SELECT label, CASE WHEN p_away >= p_draw AND p_away >= p_home THEN 0 WHEN p_draw >= p_home THEN 1 ELSE 2 END AS y FROM priced) s, (VALUES (0), (1), (2)) v(k) GROUP BY k) a) b WHERE support > 0 OR pr > 0""",
        "matches", ctes=PRICED),
    "calibration_curve": sql(
        "SELECT CAST(klass AS BIGINT) AS klass, CAST(bin AS BIGINT) AS bin, round(avg(p), 6) AS predicted, round(avg(hit), 6) AS observed, CAST(count(*) AS BIGINT) AS n FROM ("
        + " UNION ALL ".join(f"SELECT {i} AS klass, p_{c} AS p, CASE WHEN label = {i} THEN 1.0 ELSE 0.0 END AS hit, least(9, floor(p_{c}*10)) AS bin FROM priced" for i, c in enumerate(sc.CLASSES))
        + ") t GROUP BY klass, bin", "matches", ctes=PRICED),
    "blend_sweep": sql(
        """SELECT CAST(pos AS BIGINT) AS pos, weight, round(ll, 6) AS log_loss, CAST(pos = first(pos) OVER (ORDER BY ll, pos) AS BIGINT) AS is_best FROM (
SELECT pos, CAST(weight AS DOUBLE) AS weight, avg(-ln(greatest(2.220446049250313e-16, (1.0-weight)*CASE label WHEN 0 THEN p_away WHEN 1 THEN p_draw ELSE p_home END + weight*CASE label WHEN 0 THEN q_away WHEN 1 THEN q_draw ELSE q_home END))) AS ll
FROM priced JOIN goals3 USING (match_id), (SELECT i AS pos, i/10.0 AS weight FROM range(11) g(i)) w GROUP BY pos, weight) t""", "matches", ctes=f"{PRICED}, {GOALS3}"),
    "blend_grid_2d": sql(
        f"""SELECT CAST(pos AS BIGINT) AS pos, round(weight, 6) AS weight, round(draw_rate, 6) AS draw_rate, accuracy, log_loss, brier, matches, CAST(pos = first(pos) OVER (ORDER BY ll, pos) AS BIGINT) AS is_best FROM (
SELECT pos, weight, draw_rate, {metric_sql()}, avg(-ln(greatest(2.220446049250313e-16, CASE label WHEN 0 THEN p_away WHEN 1 THEN p_draw ELSE p_home END))) AS ll FROM (
SELECT pos, weight, draw_rate, label, (1.0-weight)*(1.0-e)*(1.0-draw_rate) + weight*q_away AS p_away, (1.0-weight)*draw_rate + weight*q_draw AS p_draw, (1.0-weight)*e*(1.0-draw_rate) + weight*q_home AS p_home
FROM crossed, (SELECT pos, CAST(d AS DOUBLE) AS draw_rate, CAST(w AS DOUBLE) AS weight FROM (VALUES {POINTS}) v(pos, d, w)) g) m GROUP BY pos, weight, draw_rate) t""",
        "matches", recursive=True, ctes=CROSS_ROWS),
    "baselines": sql(
        f"""SELECT 'elo only' AS name, {metric_sql('e_away', 'e_draw', 'e_home')} FROM b UNION ALL SELECT 'dixon-coles only', {metric_sql('q_away', 'q_draw', 'q_home')} FROM b
UNION ALL SELECT 'base rate', {metric_sql('f0', 'f1', 'f2')} FROM b
UNION ALL SELECT 'current config', {metric_sql('(0.4*e_away+0.6*q_away)', '(0.4*e_draw+0.6*q_draw)', '(0.4*e_home+0.6*q_home)')} FROM b""",
        "matches", recursive=True, ctes=CROSS_ROWS + f""", b AS (SELECT *, {ELO3}, avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) OVER () AS f0,
avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) OVER () AS f1, avg(CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END) OVER () AS f2 FROM crossed)"""),
    "season_folds": sql(
        """SELECT CAST(y AS BIGINT) AS season_start, CAST(make_date(y, 7, 1) AS VARCHAR) AS cut, CAST(make_date(y + 1, 7, 1) AS VARCHAR) AS "end" FROM (
SELECT DISTINCT year(match_date) - CASE WHEN month(match_date) < 7 THEN 1 ELSE 0 END AS y FROM matches WHERE is_cross ORDER BY y DESC LIMIT 5) t""", "matches"),
    "calibration_effect": sql(
        "SELECT ratings, " + metric_sql() + """ FROM (SELECT ratings, label, (1.0-e)*(1.0-{d}) AS p_away, CAST({d} AS DOUBLE) AS p_draw, e*(1.0-{d}) AS p_home FROM (
SELECT 'linked' AS ratings, {l} AS label, 1.0/(1.0+pow(10.0,(a.rating-(h.rating+65.0))/400.0)) AS e FROM matches m JOIN final h ON h.team = home_team JOIN final a ON a.team = away_team WHERE is_cross
UNION ALL SELECT 'isolated', {l}, 1.0/(1.0+pow(10.0,(coalesce(a.rating, 1500.0)-(coalesce(h.rating, 1500.0)+65.0))/400.0)) FROM matches m LEFT JOIN dfinal h ON h.team = home_team LEFT JOIN dfinal a ON a.team = away_team WHERE is_cross) x) y GROUP BY ratings""".format(d=0.26, l=LABEL),
        "matches", recursive=True, ctes=f"{wr.DOM}, {wr.LINKED}, {wr.final_cte('matches')}, " + wr.walk_ctes("dom", "league_code", 20, name="dwalk") + ", " + wr.final_cte("dom", "dwalk", "dfinal")),
}
