"""Hot keys are split by day without changing a value."""

from pyspark.sql import functions as F

from conftest import rows
from kickframe.operators import features as feat
from kickframe.operators.windows import chronological_index, hot_keys
from kickframe.session import stage
from kickframe.workload.features import AVGS


def _hot(matches):
    hot = hot_keys(feat.team_matches(matches, stats=()), ["team"], min_rows=9)
    assert hot is not None
    return hot


def test_no_hot_key_at_default_size(matches):
    assert hot_keys(feat.team_matches(matches, stats=()), ["team"]) is None


def test_one_team_owning_most_rows_is_hot(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "big").otherwise(F.col("id").cast("string")).alias("team"))
    assert [r.team for r in hot_keys(df, ["team"], min_rows=10).collect()] == ["big"]


def test_rolling_stats_equal_on_the_split_path(matches):
    records = feat.team_matches(matches)
    cols = ["match_id", "team", *AVGS]
    plain = feat.rolling_team_stats(records).select(cols)
    split = feat.rolling_team_stats(records, hot=_hot(matches)).select(cols)
    assert rows(plain) == rows(split)


def test_form_features_equal_on_the_split_path(matches):
    cols = ["match_id", "home_xg_rolling", "away_xga_rolling", "home_rest_days", "away_rest_days", "avg_draw_pct"]
    plain = feat.form_features(matches).select([F.round(c, 9).alias(c) for c in cols])
    split = feat.form_features(matches, hot=_hot(matches)).select([F.round(c, 9).alias(c) for c in cols])
    assert rows(plain) == rows(split)


def test_rolling_counts_observations_not_rows(spark, matches):
    gaps = matches.withColumn("hst", F.when(F.col("match_id") % 97 != 0, F.col("hst")))
    out = feat.rolling_team_stats(feat.team_matches(gaps))
    got = {(r.team, r.match_id): r.avg_sot for r in out.select("team", "match_id", "avg_sot").collect()}
    history = {}
    for r in sorted(feat.team_matches(gaps).collect(), key=lambda r: (r.match_date, r.match_id)):
        last = [x for x in history.get(r.team, [])[-5:] if x is not None]
        want = sum(last) / len(last) if len(last) >= 3 else None
        assert got[r.team, r.match_id] == want
        history.setdefault(r.team, []).append(r.sot)


def test_features_do_not_see_later_matches(matches):
    cut = "1998-06-30"
    cols = ["match_id", "h2h_home_wins", "home_xg_rolling", "home_avg_gf", "away_rest_days"]
    whole = feat.all_features(matches).where(F.col("match_date") <= cut).select(cols)
    early = feat.all_features(matches.where(F.col("match_date") <= cut)).select(cols)
    assert rows(whole) == rows(early)


def test_head_to_head_is_strict_on_the_day(spark):
    data = [(1, "2020-01-01", "a", "b", 1, 0), (2, "2020-02-01", "b", "a", 2, 0),
            (3, "2020-03-01", "a", "b", 0, 0), (4, "2020-03-01", "b", "a", 5, 5)]
    df = spark.createDataFrame(data, "match_id long, match_date string, home_team string, away_team string, fthg long, ftag long")
    out = {r.match_id: r for r in feat.h2h_last5(df.withColumn("match_date", F.to_date("match_date"))).collect()}
    assert out[1].h2h_draws is None and out[2].h2h_draws is None
    assert out[3].h2h_home_wins == 0.5 and out[3].h2h_total_goals_avg == 1.5
    assert out[4].h2h_home_wins == 0.5 and out[4].h2h_draws == 0.0


def test_chronological_index_matches_a_sort(matches):
    got = {r.match_id: r.idx for r in chronological_index(matches).select("match_id", "idx").collect()}
    order = sorted(matches.select("match_date", "match_id").collect())
    assert got == {r.match_id: i for i, r in enumerate(order)}


def test_chronological_index_with_wide_ids(spark):
    df = spark.createDataFrame([("2020-01-0%d" % (1 + i % 2), i << 21) for i in range(50)], "match_date string, match_id long")
    got = [r.idx for r in chronological_index(df).orderBy("match_date", "match_id").collect()]
    assert got == list(range(50))


def test_split_path_across_the_epoch(spark):
    days = ["1969-12-29", "1969-12-30", "1969-12-31", "1970-01-01", "1970-01-02", "1970-01-03"]
    data = [(i, d, "a", f"o{i}", i, 0) for i, d in enumerate(days)]
    df = spark.createDataFrame(data, "match_id long, match_date string, home_team string, away_team string, fthg long, ftag long")
    records = feat.team_matches(df.withColumn("match_date", F.to_date("match_date")), stats=("gf", "ga"))
    hot = hot_keys(records, ["team"], min_rows=3)
    cols = ["team", "match_id", "avg_gf", "form"]
    plain = feat.rolling_team_stats(records, ("gf", "ga")).select(cols)
    assert rows(plain) == rows(feat.rolling_team_stats(records, ("gf", "ga"), hot=hot).select(cols))


def test_later_features_move_keys_and_values_only(spark, matches):
    """The wide rows go through no later window; a row without id stays, one without date drops, as step by step."""
    survivors = feat.match_features(matches).cache()
    odd = survivors.orderBy("match_id").limit(2).collect()
    rest = survivors.where(~F.col("match_id").isin([r.match_id for r in odd]))
    changed = [(None, odd[0].match_date), (odd[1].match_id, None)]
    base = [r.asDict() for r in odd]
    for r, (i, d) in zip(base, changed):
        r.update(match_id=i, match_date=d)
    survivors = stage(rest.unionByName(spark.createDataFrame(base, survivors.schema)), "odd-survivors")
    for families in ((feat.XG, feat.FATIGUE, feat.DRAWS), (feat.DRAWS,)):
        step_by_step = feat.h2h_last5(feat.form_features(survivors, families))
        got = feat._later_steps(survivors, families, feat.FEATURES, None)
        assert got.columns == step_by_step.columns and rows(got) == rows(step_by_step)
        assert got.where("match_id IS NULL").count() == 1 and got.where("match_date IS NULL").count() == 0
    assert "payload" not in feat.all_features(matches)._jdf.queryExecution().optimizedPlan().toString()
