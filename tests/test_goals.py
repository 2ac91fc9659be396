"""Score model fit and grids."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kickframe.operators import goals as gl
from kickframe.params import ScoreParams
from kickframe.plans import dixoncoles as dc


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    n = 4
    pairs = pd.DataFrame([(h, a, *rng.uniform(0.5, 3, 3), *rng.uniform(0, 1, 4)) for h in range(n) for a in range(n) if h != a],
                         columns=["h", "a", *dc.SUMS])
    x = rng.normal(0, 0.1, 2 * n + 2)
    out = dc._value_and_gradient(pairs, x, n, 1e-10)
    for i in range(len(x)):
        up, down = x.copy(), x.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (dc._value_and_gradient(pairs, up, n, 1e-10)[0] - dc._value_and_gradient(pairs, down, n, 1e-10)[0]) / 2e-6
        assert out[1 + i] == pytest.approx(slope, rel=1e-4, abs=1e-5)


def test_fit_ranks_simulated_strengths(spark):
    rng = np.random.default_rng(7)
    strength = {"weak": -0.6, "mid": 0.0, "strong": 0.6}
    data = []
    for i in range(900):
        h, a = rng.choice(list(strength), 2, replace=False)
        data.append((i, "2020-01-01", str(h), str(a), int(rng.poisson(np.exp(strength[h] + 0.3))), int(rng.poisson(np.exp(strength[a])))))
    df = spark.createDataFrame(data, "match_id long, match_date string, home_team string, away_team string, fthg long, ftag long")
    model = dc.dc_fit(df.withColumn("match_date", F.to_date("match_date")), max_iter=25)
    attack = dict(zip(model.teams, model.attack))
    assert attack["weak"] < attack["mid"] < attack["strong"]
    assert 0.1 < model.home_advantage < 0.5


def test_markets_agree_with_the_grid(spark):
    rates = spark.createDataFrame([(1, 1.4, 0.9), (2, 3.8, 0.2), (3, 0.3, 2.7)], "match_id long, lambda_home double, lambda_away double")
    markets = {r.match_id: r for r in gl.goal_markets(rates, -0.08).collect()}
    for row in gl.score_grid(rates, -0.08).collect():
        m = markets[row.match_id]
        cell = {(c.i, c.j): c.p for c in row.grid}
        assert len(cell) == 121 and sum(cell.values()) == pytest.approx(1.0)
        assert m.home_win == pytest.approx(sum(p for (i, j), p in cell.items() if i > j))
        assert m.draw == pytest.approx(sum(p for (i, j), p in cell.items() if i == j))
        assert m.over_35 == pytest.approx(sum(p for (i, j), p in cell.items() if i + j >= 4))
        assert m.btts_yes == pytest.approx(sum(p for (i, j), p in cell.items() if i and j))
        assert m.over_15 >= m.over_25 >= m.over_35


def test_no_step_of_a_grid_is_too_long_to_be_compiled(spark, capsys):
    """HotSpot interprets methods above 8000 bytes, whatever a session's limit for generated code is."""
    rates = spark.range(5).selectExpr("id AS match_id", "0.4D + id AS lambda_home", "1.3D AS lambda_away")
    for out in (gl.score_grid(rates, -0.05), gl.top_scorelines(rates, -0.05)):
        out.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) <= 8000


def test_refusal_asks_for_history_and_enough_matches(spark):
    fixtures = spark.createDataFrame([(1, "a", "b"), (2, "a", "x"), (3, "c", "a"), (4, "d", "a")], "match_id int, home_team string, away_team string")
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "team string")
    counts = spark.createDataFrame([("a", 50), ("b", 10), ("c", 9)], "team string, matches long")
    out = {r.match_id: r.refusal for r in gl.refusal_reason(fixtures, known, counts).collect()}
    assert out[1] is None and out[4] is None
    assert out[2] == "away_unknown" and out[3] == "home_thin"


def test_zero_weight_needs_no_score_model(spark):
    fixtures = spark.createDataFrame([(1, "a", "b")], "match_id int, home_team string, away_team string")
    ratings = spark.createDataFrame([("a", 1600.0), ("b", 1500.0)], "team string, rating double")
    row = gl.cross_league_predict(fixtures, ratings).first()
    assert row.model == "elo" and row.home_win + row.draw + row.away_win == pytest.approx(1.0)
    assert row.predicted_outcome == "Home Win"
