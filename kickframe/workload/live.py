"""Live match queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.operators import resolve as rs
from kickframe.session import scratch_path, stage
from kickframe.sources.synthetic import domestic, live_polls, matches, quotes
from kickframe.streaming import live as lv
from kickframe.workload import goals as wg
from kickframe.workload import ratings as wr
from kickframe.workload import resolve as wres
from kickframe.workload.common import big, r, sql, tidy


def provider_rows(spark, sf):
    """Polls with a provider code, a stage text, a clock and a kick-off."""
    code = (F.when(F.col("status") == "scheduled", "TIMED").when(F.col("status") == "paused", "SUSPENDED")
            .when(F.col("status") == "finished", "AWARDED").when(F.col("match_slot") % 7 == 0, "UNKNOWN").otherwise("IN_PLAY"))
    stage = (F.when(F.col("status") == "paused", "Half Time").when(F.col("status") == "finished", "After Penalties")
             .otherwise("17'"))
    minute = F.when(F.col("match_slot") % 3 == 0, "").when(F.col("match_slot") % 3 == 1, "67'").otherwise(" 45+2")
    ago = F.make_dt_interval(mins=(F.col("poll_seq") % 130).cast("int"))
    return live_polls(spark, sf).withColumns({
        "code": code, "stage": stage, "minute": minute, "kickoff": F.col("ts") - ago})


def normalise_status(spark, sf):
    rows = provider_rows(spark, sf).drop("status")
    out = lv.normalise_status(rows).withColumn(
        "stage_status", lv.stage_status(F.col("stage"), F.col("home_goals"), F.col("away_goals")))
    return tidy(out, "match_slot", "poll_seq", "status", "stage_status")


def elapsed_minutes(spark, sf):
    out = provider_rows(spark, sf).withColumn(
        "elapsed", lv.elapsed_minutes(F.col("status"), F.col("minute"), F.col("kickoff"), F.col("ts")))
    return tidy(out, "match_slot", "poll_seq", "elapsed")


def live_events(spark, sf):
    return tidy(lv.live_events(live_polls(spark, sf)))


def live_events_stream(spark, sf):
    return tidy(lv.run_available(live_polls(spark, sf), lv.live_events_stream, "events"))


def live_board(spark, sf):
    polls = live_polls(spark, sf)
    now = polls.agg(F.max("ts")).scalar()
    return tidy(lv.live_board(polls, now), "league_code", "match_slot", "poll_seq", "status", "stale")


def first_non_empty_source(spark, sf):
    answers = quotes(spark, sf).withColumn("provider_rank", F.substring("source", 3, 1).cast("bigint"))
    return tidy(lv.first_non_empty_source(answers, ["match_id"]), "match_id", "source", "odds_home", "provider_rank")


def in_play_rows(spark, sf):
    """Each match as if it were being played: its score and a clock."""
    m = matches(spark, sf)
    clock = m.select("match_id", "fthg", "ftag", F.col("hf").alias("_hf"), F.col("af").alias("_af"))
    return wg.rates(m).join(clock, "match_id").select(
        "match_id", "lambda_home", "lambda_away", F.col("fthg").alias("home_goals"), F.col("ftag").alias("away_goals"),
        (F.col("_hf") * 5 + F.col("_af")).alias("elapsed"))


PRICE = ["remaining", "home_win", "draw", "away_win", "expected_home_goals", "expected_away_goals"]


def in_play_price(spark, sf):
    return tidy(lv.in_play_price(in_play_rows(spark, sf)), "match_id", *PRICE)


def live_board_stream(spark, sf):
    """The board as a stream of polls leaves it, three micro-batches in any order."""
    polls = live_polls(spark, sf)
    path = scratch_path(spark, "board")
    lv.run_batches(polls.repartitionByRange(3, "poll_seq"), lv.board_upsert(path), "board")
    now = polls.agg(F.max("ts")).scalar()
    board = lv.live_board(spark.read.schema(polls.schema).parquet(path), now)
    return tidy(board, "league_code", "match_slot", "poll_seq", "status", "stale")


def as_live(rows, raw):
    """Board rows as matches in play; a match slot stands for the match with that number."""
    elapsed = lv.elapsed_minutes(F.col("status"), F.col("minute"), F.col("kickoff"), F.col("ts"))
    board = rows.select(F.col("league_code").alias("board"), F.col("match_slot").alias("match_id"), "status", "home_goals", "away_goals", elapsed.alias("elapsed"))
    return board.join(raw, "match_id")


def in_play_tables(m):
    """(names, predictions): spellings with their team, and expected goals with some gaps."""
    names = rs.resolve_names(wres.raw_names(m), rs.candidates_by_league(rs.registry_of(m)), wres.aliases(m)).select(
        F.col("search").alias("league_code"), "raw_name", "canonical")
    gaps = m.select("match_id", "match_date", "hy", "ay")
    stored = wg.rates(m).join(gaps, "match_id").where(F.col("hy") != 4)
    keep = lambda c: F.when(F.col("ay") != 4, F.col(c)).alias(c)
    stored = stored.groupBy("league_code", "match_date", "home_team", "away_team").agg(
        F.min_by("ay", "match_id").alias("ay"), F.min_by("lambda_home", "match_id").alias("lambda_home"),
        F.min_by("lambda_away", "match_id").alias("lambda_away"),
    ).select("league_code", "match_date", "home_team", "away_team", keep("lambda_home"), keep("lambda_away"))
    return names, stored


def in_play_board(spark, sf):
    m = matches(spark, sf)
    polls = provider_rows(spark, sf)
    board = lv.live_board(polls, polls.agg(F.max("ts")).scalar())
    out = lv.in_play_board(as_live(board, wres.raw_fixtures(m)), *in_play_tables(m))
    return tidy(out, "match_id", "reason", "home_win", "draw", "away_win")


def in_play_board_stream(spark, sf):
    """Prices as a stream of polls leaves them; what the stream is joined with is staged once."""
    m = matches(spark, sf)
    raw = stage(wres.raw_fixtures(m), "raw")
    names, stored = (stage(t, name) for t, name in zip(in_play_tables(m), ("names", "stored")))
    board, priced = scratch_path(spark, "board"), scratch_path(spark, "priced")
    polls = provider_rows(spark, sf)
    live_rows = lambda rows: as_live(rows, raw)
    lv.run_batches(polls.repartitionByRange(3, "poll_seq"), lv.in_play_upsert(board, priced, live_rows, names, stored), "in-play")
    return tidy(spark.read.parquet(priced).where("reason IS NOT NULL"), "match_id", "reason", "home_win", "draw", "away_win")


def finished(spark, sf):
    return domestic(spark, sf).select(
        F.col("league_code").alias("pool"), "match_id", "match_date", "home_team", "away_team", "fthg", "ftag")


def elo_stream(spark, sf):
    out = lv.run_available(finished(spark, sf), lv.elo_stream, "elo")
    return tidy(out, "team", "match_id", "rating")


QUERIES = {
    f.__name__: f
    for f in (normalise_status, elapsed_minutes, live_events, live_events_stream, live_board,
              live_board_stream, first_non_empty_source, in_play_price, in_play_board, in_play_board_stream, elo_stream)
}

# --- oracles ---------------------------------------------------------------

EVENTS = """adj AS (SELECT * FROM (SELECT *, lag(home_goals) OVER w AS ph, lag(away_goals) OVER w AS pa, lag(status) OVER w AS ps, lag(poll_seq) OVER w AS pq
FROM live_polls WINDOW w AS (PARTITION BY match_slot ORDER BY poll_seq)) t WHERE pq = poll_seq - 1)"""
EVENT_ROWS = """SELECT match_slot, poll_seq, 'goal' AS event FROM adj WHERE home_goals > ph OR away_goals > pa
UNION ALL SELECT match_slot, poll_seq, 'kickoff' FROM adj WHERE ps = 'scheduled' AND status = 'live'
UNION ALL SELECT match_slot, poll_seq, 'full_time' FROM adj WHERE ps <> 'finished' AND status = 'finished'"""
BOARD = """board AS (SELECT *, max(ts) OVER (PARTITION BY league_code) AS fetched_at FROM live_polls
WHERE (league_code, poll_seq) IN (SELECT league_code, max(poll_seq) FROM live_polls GROUP BY league_code))"""
ELAPSED = """CASE status WHEN 'scheduled' THEN 0 WHEN 'paused' THEN 45 WHEN 'finished' THEN 90 ELSE CASE match_slot % 3 WHEN 1 THEN 67 WHEN 2 THEN 45
ELSE least(90, CASE WHEN poll_seq % 130 > 60 THEN poll_seq % 130 - 15 WHEN poll_seq % 130 > 45 THEN 45 ELSE poll_seq % 130 END) END END"""


def price_ctes(src: str) -> str:
    """`price` from (match_id, lam, mu, hg, ag, elapsed) rows in `src`."""
    f = wg.FACT
    return f"""p_in AS (SELECT *, (90.0 - greatest(0, least(90, elapsed)))/90.0 AS remaining FROM {src}),
p_cell AS (SELECT match_id, hg - ag + i - j AS final, exp(-lam*remaining)*pow(lam*remaining,CAST(i AS DOUBLE))/{f.format(k='i')} * (exp(-mu*remaining)*pow(mu*remaining,CAST(j AS DOUBLE))/{f.format(k='j')}) AS p
FROM p_in, (SELECT unnest(range(11)) AS i) gi, (SELECT unnest(range(11)) AS j) gj),
p_sum AS (SELECT match_id, coalesce(sum(p) FILTER (final > 0), 0.0)/sum(p) AS home_win, coalesce(sum(p) FILTER (final = 0), 0.0)/sum(p) AS draw, coalesce(sum(p) FILTER (final < 0), 0.0)/sum(p) AS away_win FROM p_cell GROUP BY match_id),
price AS (SELECT match_id, remaining, home_win, draw, away_win, hg + lam*remaining AS expected_home_goals, ag + mu*remaining AS expected_away_goals FROM p_in JOIN p_sum USING (match_id))"""


BOARD_ROWS = sql(
    """SELECT league_code, match_slot, poll_seq, status, CAST(floor(epoch((SELECT max(ts) FROM live_polls))) - floor(epoch(fetched_at)) >= 300 AS BIGINT) AS stale FROM board""",
    "live_polls", ctes=BOARD)
IN_PLAY = sql(
    f"""SELECT match_id, reason, CASE WHEN reason = 'priced' THEN round(home_win, 6) END AS home_win, CASE WHEN reason = 'priced' THEN round(draw, 6) END AS draw,
CASE WHEN reason = 'priced' THEN round(away_win, 6) + 0.0 END AS away_win FROM placed LEFT JOIN price USING (match_id)""",
    "matches", "live_polls", ctes=f"""{wres.RESOLVE}, {wg.strengths_cte()}, {wg.rates_cte()}, {BOARD},
stored AS (SELECT league_code, match_date, home_team, away_team, arg_min(ay, match_id) AS say, arg_min(lam, match_id) AS lam, arg_min(mu, match_id) AS mu
FROM matches JOIN rates USING (match_id) WHERE hy <> 4 GROUP BY 1, 2, 3, 4),
placed AS (SELECT w.match_id, b.home_goals AS hg, b.away_goals AS ag, s.lam, s.mu, {ELAPSED.replace('CASE status', 'CASE b.status')} AS elapsed, CASE WHEN h.canonical IS NULL OR a.canonical IS NULL THEN 'unknown_team' WHEN s.say IS NULL THEN 'no_prediction'
WHEN s.say = 4 THEN 'no_expected_goals' ELSE 'priced' END AS reason FROM board b JOIN raw w ON w.match_id = b.match_slot
LEFT JOIN found h ON h.league_code = w.league_code AND h.raw_name = w.raw_home LEFT JOIN found a ON a.league_code = w.league_code AND a.raw_name = w.raw_away
LEFT JOIN stored s ON s.league_code = w.league_code AND s.match_date = w.match_date AND s.home_team = h.canonical AND s.away_team = a.canonical
WHERE b.status IN ('live', 'paused') AND b.home_goals IS NOT NULL AND b.away_goals IS NOT NULL),
src AS (SELECT * FROM placed WHERE reason = 'priced'), {price_ctes('src')}""")

ORACLES = {
    "normalise_status": sql(
        """SELECT match_slot, poll_seq, status, CASE WHEN status = 'paused' THEN 'paused' WHEN status = 'finished' THEN 'finished' WHEN home_goals IS NULL OR away_goals IS NULL THEN 'scheduled' ELSE 'live' END AS stage_status
FROM live_polls WHERE NOT (status = 'live' AND match_slot % 7 = 0)""", "live_polls"),
    "elapsed_minutes": sql(
        f"SELECT match_slot, poll_seq, CAST({ELAPSED} AS BIGINT) AS elapsed FROM live_polls", "live_polls"),
    "live_events": sql(EVENT_ROWS, "live_polls", ctes=EVENTS),
    "live_events_stream": sql(EVENT_ROWS, "live_polls", ctes=EVENTS),
    "live_board": BOARD_ROWS,
    "live_board_stream": BOARD_ROWS,
    "first_non_empty_source": sql(
        """SELECT match_id, source, round(odds_home, 6) AS odds_home, CAST(substr(source, 3, 1) AS BIGINT) AS provider_rank FROM quotes q
WHERE source = (SELECT min(source) FROM quotes x WHERE x.match_id = q.match_id)""", "quotes"),
    "in_play_price": sql(
        f"SELECT match_id, {r(*PRICE)} FROM price", "matches",
        ctes=f"{wg.strengths_cte()}, {wg.rates_cte()}, src AS (SELECT match_id, lam, mu, fthg AS hg, ftag AS ag, hf*5 + af AS elapsed FROM rates JOIN matches USING (match_id)), {price_ctes('src')}"),
    "in_play_board": IN_PLAY,
    "in_play_board_stream": IN_PLAY,
    "elo_stream": sql(
        """SELECT home_team AS team, match_id, round(elo_home + d, 6) AS rating FROM walk JOIN matches USING (match_id)
UNION ALL SELECT away_team, match_id, round(elo_away - d, 6) FROM walk JOIN matches USING (match_id)""",
        "matches", recursive=True, ctes=f"{wr.DOM}, {wr.SEALED}"),
}
