"""Registered queries against DuckDB on the smallest tables.

A spread of quick keys runs by default; KICKFRAME_ALL=1 runs every key that has
an oracle.
"""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL

QUICK = [
    "team_matches", "match_features", "all_features", "h2h_last5", "elo_walk", "elo_final_top_n", "rating_pools",
    "goal_markets", "top_scorelines", "market_choice", "team_record", "head_to_head", "team_stats", "value_bets",
    "match_by_containment", "multi_source_divergence", "resolve_alias", "name_review", "alias_merge_report",
    "live_events", "live_board", "in_play_price", "fixture_features", "rolling_accuracy", "retrain_decision",
    "parse_match_text", "parse_odds_events", "read_international", "dedupe_sources", "blend_sweep", "time_series_folds",
]
KEYS = sorted(entry.oracle_sql()) if os.environ.get("KICKFRAME_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_agrees_with_its_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    result = duck.execute(entry.oracle_sql()[key])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in result.fetchall()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
