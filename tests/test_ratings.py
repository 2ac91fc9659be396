"""The era-parallel walk equals the sequential one."""

from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from conftest import rows
from kickframe.operators import ratings as rt


def linked(matches):
    return matches.withColumn("pool", F.lit("all"))


def test_eras_give_the_sequential_ratings(matches):
    cols = ["match_id", "elo_home", "elo_away", "post_home"]
    whole = rt.elo_walk(linked(matches)).select(cols)
    eras = rt.elo_walk(linked(matches), era_rows=200).select(cols)
    assert rows(whole) == rows(eras)
    assert rows(rt.elo_final(linked(matches))) == rows(rt.elo_final(linked(matches), era_rows=200))


def test_ratings_in_a_pool_sum_to_the_start(matches):
    final = rt.elo_final(linked(matches))
    total, n = final.agg(F.sum("rating"), F.count("*")).first()
    assert abs(total - 1500.0 * n) < 1e-6


def test_unplayed_rows_get_ratings_but_move_none(spark):
    data = [(1, "2020-01-01", "a", "b", 2, 0), (2, "2020-01-02", "a", "b", None, None), (3, "2020-01-03", "a", "b", 0, 0)]
    df = spark.createDataFrame(data, "match_id long, match_date string, home_team string, away_team string, fthg long, ftag long")
    out = {r.match_id: r for r in rt.elo_walk(df.withColumn("pool", F.lit("x"))).collect()}
    assert out[2].elo_home == out[3].elo_home == out[1].post_home
    assert out[1].elo_home == 1500.0


def test_neutral_ground_removes_the_advantage(spark):
    df = spark.createDataFrame([(1, "2020-01-01", "a", "b", 1, 1)], "match_id long, match_date string, home_team string, away_team string, fthg long, ftag long")
    flat = df.withColumn("pool", F.lit("x")).withColumn("home_adv", rt.neutral_advantage(F.lit(True)))
    assert rt.elo_walk(flat).first().elo_expected_home == 0.5


def test_pools_follow_links(spark):
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "d"), ("e", "f"), ("f", "g"), ("g", "h"), ("h", "i")], "league_a string, league_b string")
    pools = {r.league: r.pool for r in rt.rating_pools(links).collect()}
    assert pools == {"a": "a", "b": "a", "c": "a", "d": "d", **{x: "e" for x in "efghi"}}


def test_corpora_whose_ids_overlap(spark):
    schema = "match_id long, match_date string, home_team string, away_team string, fthg long, ftag long, home_league string, away_league string"
    domestic = spark.createDataFrame([(i, "2020-01-01", "a", "b", 1, 0, "A", "A") for i in range(1, 6)] + [(9, "2020-01-01", "x", "y", 1, 1, "X", "X")], schema)
    other = spark.createDataFrame([(i, "2020-01-01", "a", "c", 0, 2, "A", "C") for i in range(1, 4)] + [(4, "2020-01-01", "a", "c", None, None, "A", "C")], schema)
    out = rt.shared_walk(domestic, other)
    assert {(r.source, r["count"]) for r in out.groupBy("source").count().collect()} == {("domestic", 6), ("supplementary", 3)}
    rows_ = {(r.source, r.match_id): r for r in out.collect()}
    # Domestic rows of the day come first, so the other corpus starts from where they ended.
    assert rows_["supplementary", 1].elo_home == rows_["domestic", 5].post_home
    assert rows_["domestic", 9].pool == "X" and rows_["domestic", 1].pool == rows_["supplementary", 1].pool == "A"


def test_every_match_is_walked_once(matches, monkeypatch):
    """Eras come one after the other; none is walked again."""
    walked, run = [], rt._run
    monkeypatch.setattr(rt, "_run", lambda rows_, *a, **k: walked.append(rows_.count()) or run(rows_, *a, **k))
    rt.elo_walk(linked(matches), era_rows=400)
    assert len(walked) > 2 and sum(walked) == matches.count()


def test_a_pool_is_a_stream_of_batches():
    """A batch's ratings leave before the next batch is read, and pools don't mix."""
    read = []

    def batches():
        for i, pools in enumerate((["x", "x"], ["x", "y"], [None, None])):
            read.append(i)
            yield pa.RecordBatch.from_pydict({
                "pool": pa.array(pools, pa.string()), "source": pa.array(["", ""]), "match_id": pa.array([2 * i, None], pa.int64()),
                "home_team": ["a", "a"], "away_team": ["b", "b"], "fthg": pa.array([1.0, None]), "ftag": pa.array([0.0, None], pa.float64()),
                "home_adv": pa.array([65.0, None]), "start": [False, False]})

    out = rt._walker(rt.ELO, True, True)(batches())
    first = next(out).to_pylist()
    assert read == [0] and first[1]["elo_home"] == first[0]["post_home"] > 1500.0
    assert first[1]["match_id"] is None and first[1]["elo_expected_home"] is None
    rest = [r for b in out for r in b.to_pylist()]
    assert [r["elo_home"] == 1500.0 for r in rest if not r["ended"]] == [False, True, True, False]
    assert [(r["pool"], r["team"]) for r in rest if r["ended"]] == [(p, t) for p in ("x", "y", None) for t in "ab"]


def test_one_source_of_a_shared_walk_is_the_same_rows(spark):
    """Only the named source is written and returned, eras or not, and both sources move the ratings."""
    schema = "match_id long, match_date date, home_team string, away_team string, fthg long, ftag long, home_league string, away_league string"
    day = lambda i: None if i % 29 == 5 else date(2020, 1, 1) + timedelta(days=i // 3)
    made = [(i, day(i), f"T{i % 4}", f"T{(i + 1 + i // 4 % 3) % 4}", None if i % 11 == 3 else i % 3, i % 2, "A", "A") for i in range(60)]
    home = spark.createDataFrame(made, schema)
    linked = spark.createDataFrame([(i, day(i), f"T{i % 4}", "X", i % 4, 1, "A", "B") for i in range(0, 60, 7)], schema)
    for era_rows in (1000, 10):
        every = rt.shared_walk(home, linked, era_rows=era_rows)
        some = rt.shared_walk(home, linked, era_rows=era_rows, only="supplementary")
        expected = rows(every.where("source = 'supplementary'"))
        assert len(expected) == 9 and rows(some) == expected
    assert rows(rt.shared_walk(home, linked, era_rows=10)) == rows(rt.shared_walk(home, linked))


def test_eras_and_pools_are_found_without_moving_the_matches(spark, small):
    """The rows meet their pool and era by broadcast: they are shuffled once to be written and no more."""
    from kickframe.sources import synthetic as sy

    out = rt.both_corpora(sy.domestic(spark, small), sy.matches(spark, small).where("is_cross"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
