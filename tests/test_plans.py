"""Physical plans: no pair products, filters and columns reach the scan."""

import pytest

import __spark_entry__ as entry
from kickframe.sources import seasonfiles as sf
from kickframe.sources import synthetic

# Queries whose plan joins, sweeps or attaches summary values.
KEYS = [
    "h2h_last5", "match_features", "league_strata", "goal_markets", "indep_poisson_stats", "market_choice", "match_insights",
    "value_bets", "match_by_containment", "fixture_overview", "resolve_alias", "name_review", "cross_source_check",
    "live_events", "live_board", "in_play_board", "fixture_features", "evaluation_metrics", "settlement", "retrain_decision",
    "blend_sweep", "metrics_1x2", "time_series_folds", "first_non_empty_source", "division_guard",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_pair_products(spark, small, key):
    text = plan(entry.queries()[key](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_league_and_season_filters_reach_the_files(spark, matches, tmp_path):
    from kickframe.workload.sources import season_rows

    path = str(tmp_path / "leagues")
    sf.write_league_parquet(season_rows(matches), path)
    text = plan(sf.read_league_parquet(spark, path, ["L01"], ["9596"]).select("match_id"))
    assert "league_code" in text.split("PartitionFilters")[1][:120]
    assert "PushedFilters" in text and "season" in text.split("PushedFilters")[1][:120]


def test_a_narrow_query_reads_few_columns(spark, small):
    text = plan(synthetic.matches(spark, small).groupBy("home_team").count())
    # The given file is read, and of it two columns.
    assert "orders.parquet" in text and "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text
