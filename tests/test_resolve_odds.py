"""Name resolution, odds rules, bootstrap and folds."""

import random
from difflib import get_close_matches

import pytest
from pyspark.sql import functions as F

from conftest import rows
from kickframe.operators import odds as od
from kickframe.operators import resolve as rs
from kickframe.operators import scoring as sc
from kickframe.plans import training as tr

ALIAS = "league_code string, raw_name string, canonical_name string, status string"


def test_exact_beats_alias_and_stale_alias_resolves_nothing(spark):
    cands = spark.createDataFrame([("L", "Porto"), ("L", "Benfica")], "search string, team string")
    aliases = spark.createDataFrame([("L", "porto", "Benfica", "approved"), ("L", "SLB", "Benfica", "approved"), ("L", "old", "Gone", "approved"),
                                     ("W", "old", "Porto", "approved"), ("L", "new", "Porto", "pending"), ("W", "wide", "Porto", "approved")], ALIAS)
    names = spark.createDataFrame([(" PORTO ",), ("slb",), ("old",), ("new",), ("wide",)], "raw_name string").withColumns(
        {"search": F.lit("L"), "scopes": F.array(F.lit("L"), F.lit("W"))})
    got = {r.raw_name: (r.canonical, r.status) for r in rs.resolve_names(names, cands, aliases).collect()}
    assert got == {" PORTO ": ("Porto", "exact"), "slb": ("Benfica", "alias"), "old": (None, "unresolved"),
                   "new": (None, "unresolved"), "wide": ("Porto", "alias")}


def test_suggestions_equal_comparing_all_pairs(spark):
    rng = random.Random(5)
    pool = sorted({"".join(rng.choice("abcde fg") for _ in range(rng.randint(1, 9))) for _ in range(90)})
    teams = [t.title() for t in pool[:40] if t.strip()] + ["Benfika", "Benfica B", "Porto", "Luan", "Sp Lisbon", " ", "\u0130zmir"]
    raw = pool[40:] + [" BENFICA", "", None, "Lyon", "Sporting CP", "z" * 300, "aaaaaaaaaaaaaaaaaaaa"]
    scopes = {"L": teams, "M": teams[::3], "N": []}
    cands = spark.createDataFrame([(s, t) for s, ts in scopes.items() for t in ts + ts[:3]] + [("L", None)], "search string, team string")
    names = spark.createDataFrame([(n, s, 1) for s in scopes for n in raw + raw[:2]], "raw_name string, search string, score int")
    out = {(r.search, r.raw_name, r["rank"]): r.suggestion for r in rs.suggest_names(names, cands).collect()}
    fold = lambda t: t.strip(" ").lower()
    want = {}
    for s, ts in scopes.items():
        by = {fold(t): t for t in sorted(ts)}
        for n in {n for n in raw if n and fold(n)}:
            close = get_close_matches(fold(n), [t for t in by if t], n=5, cutoff=0.4)
            want |= {(s, n, i + 1): by[t] for i, t in enumerate(close)}
    assert out == want and want["L", "Lyon", 1] == "Luan" and want["L", " BENFICA", 1] == "Benfica B"


def test_suggestions_of_nothing(spark):
    empty = spark.createDataFrame([], "raw_name string, search string, team string")
    assert rs.suggest_names(empty, empty).columns == ["raw_name", "search", "rank", "suggestion", "score"]
    assert rs.suggest_names(empty, empty).count() == 0


def test_containment_equals_brute_force(spark):
    left = [("s", n) for n in ("porto", "benfica", "sporting", "ac")]
    right = [("s", n) for n in ("fc porto", "enfica", "sporting cp", "academica", "zzz")]
    out = od.containing_names(spark.createDataFrame(left, "scope string, l string"), spark.createDataFrame(right, "scope string, r string"))
    want = {(a, b) for _, a in left for _, b in right if a in b or b in a}
    assert {(r.l, r.r) for r in out.collect()} == want


def test_best_source_takes_the_first_on_ties(spark):
    df = spark.createDataFrame([(1, "b", 2.0, 0.0, 3.0), (1, "a", 2.0, 0.0, 2.0)], "match_id int, source string, odds_home double, odds_draw double, odds_away double")
    row = od.best_source(df).first()
    assert (row.source_home, row.source_draw, row.source_away) == ("a", "", "b")


def test_averages_skip_unpriced_sources_but_probabilities_do_not(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 0.0, 4.0), (1, "b", 2.0, 4.0, 4.0)], "match_id int, source string, odds_home double, odds_draw double, odds_away double")
    row = od.aggregate_odds(df).first()
    assert row.avg_draw == 4.0 and row.best_draw == 4.0
    assert row.prob_draw == pytest.approx(0.125) and row.prob_home == pytest.approx((2 / 3 + 0.5) / 2)


def test_cross_source_pairs_only_unique_hits(spark):
    schema = "match_id int, match_date string, league_code string, home_team string, away_team string, fthg int, ftag int"
    corpus = spark.createDataFrame([(1, "2020-01-02", "L", "Bayern", "Porto", 1, 1), (2, "2020-01-05", "L", "Alphas", "Betas", 0, 0)], schema)
    api = spark.createDataFrame([("2020-01-01", "L", "FC Bayern", "FC Porto", 2, 1, True), ("2020-01-05", "L", "Alphas A", "Betas", 0, 0, False),
                                 ("2020-01-05", "L", "Alphas B", "Betas", 0, 0, False)],
                                "match_date string, league_code string, home_team string, away_team string, home_goals int, away_goals int, extra_time boolean")
    day = lambda df: df.withColumn("match_date", F.to_date("match_date"))
    assert [(r.match_id, r["rank"], r.verdict) for r in rs.cross_source_check(day(corpus), day(api)).collect()] == [(1, 1, "extra_time")]


def test_folds_hold_out_equal_blocks_at_the_end():
    assert tr.fold_bounds(23, 5) == [(8, 11), (11, 14), (14, 17), (17, 20), (20, 23)]
    assert tr.split_bounds(100, 3) == (65, 80) and tr.split_bounds(30, 3) == (24, 24)


def test_bootstrap_does_not_depend_on_partitioning(spark):
    df = spark.range(500).select(F.col("id").alias("match_id"), (F.col("id") % 7 - 2.5).cast("double").alias("diff"))
    one = sc.bootstrap_interval(df.coalesce(1), samples=200).first()
    many = sc.bootstrap_interval(df.repartition(4), samples=200).first()
    assert one.low == pytest.approx(many.low) and one.high == pytest.approx(many.high)
    assert one.low < one.improvement < one.high and one.conclusive


def test_bootstrap_counts_are_poisson_like():
    import numpy as np

    counts = sc._multiplicities(np.arange(2000), 50, 42)
    assert counts.mean() == pytest.approx(1.0, abs=0.02) and counts.var() == pytest.approx(1.0, abs=0.03)


def test_names_that_never_meet_are_not_searched(spark):
    """A row is compared with pairs of teams that the other source has, not with all pairs of names that fit."""
    from datetime import date

    from kickframe.operators import resolve as rs

    day = date(2020, 1, 2)
    corpus = spark.createDataFrame([(1, day, "L", "Ashton", "Burnley", 1, 0), (2, day, "L", "Carlow", "Ashton", 2, 2)],
                                   "match_id long, match_date date, league_code string, home_team string, away_team string, fthg long, ftag long")
    other = spark.createDataFrame([("L", date(2020, 1, 1), "FC Ashton", "Burnley FC", 1, 0, False), ("L", day, "Ashton Town", "Carlow", 0, 0, False)],
                                  "league_code string, match_date date, home_team string, away_team string, home_goals long, away_goals long, extra_time boolean")
    out = rs.cross_source_check(corpus, other)
    assert [tuple(r) for r in out.collect()] == [(1, 1, "same")]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_bootstrap_counts_equal_the_search_over_all_bits():
    import math

    import numpy as np

    ids = np.array([-3, 0, 7, 2**40 + 1])
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = x + (np.arange(50_000, dtype=np.uint64) + np.uint64(42) * np.uint64(1_000_003))[None, :] * np.uint64(0xBF58476D1CE4E5B9)
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
        x = x ^ (x >> np.uint64(31))
    cdf = np.cumsum(np.exp(-1.0) / np.array([math.factorial(k) for k in range(19)], dtype=float))
    expected = np.searchsorted(cdf, (x >> np.uint64(11)).astype(np.float64) / float(1 << 53))
    assert (sc._multiplicities(ids, 50_000, 42) == expected).all()


def test_bootstrap_is_spread_over_all_cores(spark):
    """Rows of one file are multiplied by all samples in as many tasks as there are cores."""
    df = spark.range(500).select(F.col("id").alias("match_id"), F.lit(0.5).alias("diff")).coalesce(1)
    plan = sc.bootstrap_interval(df, samples=20)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan


def test_only_cross_league_matches_are_priced_for_their_blend(spark, small):
    from kickframe.workload import modelling as wm

    some = rows(wm.odds_scored(spark, small, "is_cross"))
    every = rows(wm.odds_scored(spark, small).where("match_id % 10 = 0"))
    assert some == every and some
