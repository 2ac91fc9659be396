"""Events, clocks, boards: batch rules and their streaming forms."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import rows
from kickframe.session import scratch_path
from kickframe.sources import synthetic
from kickframe.streaming import live as lv
from kickframe.workload import live

POLL = "match_slot long, poll_seq long, status string, home_goals int, away_goals int, ts timestamp, league_code string"


def polls(spark, data):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(s, q, st, h, a, start + timedelta(minutes=q), "L") for s, q, st, h, a in data], POLL)


RUN = [(1, 1, "scheduled", None, None), (1, 2, "live", 0, 0), (1, 3, "live", 1, 0), (1, 4, "live", 0, 0), (1, 5, "finished", 0, 0),
       (2, 1, "live", 3, 0), (2, 3, "live", 4, 0)]
WANT = [("full_time", 1, 5), ("goal", 1, 3), ("kickoff", 1, 2)]


def test_events_need_adjacent_polls_and_rising_scores(spark):
    assert rows(lv.live_events(polls(spark, RUN))) == WANT


def test_stream_equals_batch_across_micro_batches(spark):
    source = polls(spark, RUN).repartitionByRange(3, "poll_seq")
    out = lv.run_available(source, lv.live_events_stream, "test-events")
    assert rows(out) == WANT


def test_stream_equals_batch_on_the_poll_table(spark, small):
    table = synthetic.live_polls(spark, small)
    out = lv.run_available(table, lv.live_events_stream, "test-polls")
    assert rows(out) == rows(lv.live_events(table))


def test_elapsed_minutes_rules(spark):
    now = datetime(2024, 1, 1, 20, 0)
    data = [("scheduled", "", 10, 0), ("paused", "12", 10, 45), ("finished", "", 1, 90), ("live", "67'", 5, 67), ("live", "45+2", 5, 45),
            ("live", "", 30, 30), ("live", "", 55, 45), ("live", "", 61, 46), ("live", None, 300, 90), ("live", "", -5, 0)]
    df = spark.createDataFrame([(s, m, now - timedelta(minutes=ago), now, want) for s, m, ago, want in data],
                               "status string, minute string, kickoff timestamp, now timestamp, want int")
    out = df.withColumn("got", lv.elapsed_minutes(F.col("status"), F.col("minute"), F.col("kickoff"), F.col("now")))
    assert [r.got for r in out.collect()] == [d[3] for d in data]


def test_in_play_price_is_certain_at_full_time(spark):
    df = spark.createDataFrame([(1.5, 1.0, 2, 1, 95), (1.5, 1.0, 0, 0, 0), (1.5, 1.0, 12, 0, 0)], "lambda_home double, lambda_away double, home_goals int, away_goals int, elapsed int")
    done, start, far = lv.in_play_price(df).collect()
    assert (done.home_win, done.draw, done.away_win) == (1.0, 0.0, 0.0)
    assert abs(start.home_win + start.draw + start.away_win - 1.0) < 1e-12 and start.home_win > start.away_win
    assert far.home_win > 0.999999


def test_empty_poll_keeps_the_board(spark, tmp_path):
    path = str(tmp_path / "board")
    write = lv.board_upsert(path)
    write(polls(spark, [(1, 1, "live", 0, 0), (2, 1, "live", 1, 1)]), 0)
    write(polls(spark, []), 1)
    assert spark.read.parquet(path).count() == 2
    write(polls(spark, [(1, 2, "live", 1, 0)]), 2)
    assert [r.poll_seq for r in spark.read.parquet(path).collect()] == [2]


def test_late_batches_do_not_move_a_board_back(spark):
    path = scratch_path(spark, "board-test")
    write = lv.board_upsert(path)

    def batch(rows):
        return spark.createDataFrame(rows, "league_code string, poll_seq long, match_slot long, home_goals int")
    write(batch([("A", 5, 1, 2), ("B", 3, 7, 0)]), 0)
    write(batch([("A", 4, 1, 1), ("B", 4, 7, 1)]), 1)
    write(batch([("A", 5, 1, 2)]), 2)
    assert {(r.league_code, r.poll_seq, r.home_goals) for r in spark.read.parquet(path).collect()} == {("A", 5, 2), ("B", 4, 1)}


def test_a_poll_in_several_batches_is_one_board(spark):
    path = scratch_path(spark, "board-test")
    write = lv.board_upsert(path)
    for k, data in enumerate(([(1, 2, "live", 0, 0)], [(2, 2, "live", 1, 1)], [(2, 2, "live", 1, 1)], [(3, 1, "live", 0, 0)])):
        write(polls(spark, data), k)
    assert sorted((r.match_slot, r.poll_seq) for r in spark.read.parquet(path).collect()) == [(1, 2), (2, 2)]


def test_streamed_prices_follow_the_board(spark):
    names = spark.createDataFrame([("L", n, n.title()) for n in ("a", "b")], "league_code string, raw_name string, canonical string")
    stored = spark.createDataFrame([("L", 1, "A", "B", 1.5, 1.0)], "league_code string, match_date int, home_team string, away_team string, lambda_home double, lambda_away double")

    def live_rows(rows):
        return rows.withColumns({"raw_home": F.lit("a"), "raw_away": F.when(F.col("match_slot") == 1, "b").otherwise("x"),
                                 "match_date": F.lit(1), "elapsed": F.lit(30)})

    board, priced = scratch_path(spark, "board-test"), scratch_path(spark, "priced-test")
    write = lv.in_play_upsert(board, priced, live_rows, names, stored)
    got = lambda: sorted((r.match_slot, r.reason, r.home_goals) for r in spark.read.parquet(priced).where("reason IS NOT NULL").collect())
    write(polls(spark, [(1, 1, "live", 0, 0), (2, 1, "live", 1, 1)]), 0)
    assert got() == [(1, "priced", 0), (2, "unknown_team", 1)]
    write(polls(spark, []), 1)
    write(polls(spark, [(1, 0, "live", 9, 0)]), 2)
    assert got() == [(1, "priced", 0), (2, "unknown_team", 1)]
    write(polls(spark, [(1, 2, "live", 1, 0)]), 3)
    assert got() == [(1, "priced", 1)]
    write(polls(spark, [(1, 3, "finished", 1, 0)]), 4)
    assert got() == []


def test_streamed_boards_equal_batch_boards(spark, small):
    for one, other in ((live.live_board, live.live_board_stream), (live.in_play_board, live.in_play_board_stream)):
        assert rows(one(spark, small)) == rows(other(spark, small))


def test_running_ratings_leave_a_task_in_pieces(spark, monkeypatch):
    """Ratings of a pool come a piece at a time and equal the batch walk; ids, dates and teams may be missing."""
    from datetime import date

    from kickframe.operators import ratings as rt

    monkeypatch.setattr(lv, "EMITTED", 4)
    teams = ["a", "b", "c", "d", None]
    data = [("xy"[i % 2], None if i == 39 else i, None if i >= 38 else date(2020, 1, 1 + i % 7), teams[i % 5], teams[(i + 1 + i // 5 % 4) % 5], i % 4, i % 3)
            for i in range(40)]
    m = spark.createDataFrame(data, "pool string, match_id long, match_date date, home_team string, away_team string, fthg long, ftag long")
    out = lv.run_available(m.repartition(3), lv.elo_stream, "elo-pieces")
    walked = rt.elo_walk(m)
    want = walked.alias("w").join(m.alias("m"), F.col("w.match_id").eqNullSafe(F.col("m.match_id")))
    sides = F.explode(F.array(*[F.struct(F.col(f"m.{s}_team").alias("team"), F.col(f"w.post_{s}").alias("rating")) for s in ("home", "away")]))
    want = want.select("w.pool", "w.match_id", "m.match_date", sides.alias("s")).select("pool", "match_id", "match_date", "s.*")
    assert rows(out) == rows(want) and out.count() == 80
