"""Reader, parser, sink and cleaning queries.

Each query first lays the given tables out in the format its reader expects, in
the shared folder or as text columns, then reads that back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.functions import seasons as sn
from kickframe.operators import cleaning as cl
from kickframe.operators import goals as gl
from kickframe.operators.features import result_of
from kickframe.session import scratch_path, stage
from kickframe.sources import feeds as fd
from kickframe.sources import international as intl
from kickframe.sources import matchtext as mt
from kickframe.sources import seasonfiles as sf_
from kickframe.sources import stores as st
from kickframe.sources.synthetic import live_polls, matches, quotes
from kickframe.workload.common import big, r, sql, text, tidy

SHORT = {v: k for k, v in sf_.RENAME.items()}


def season_rows(m):
    return m.withColumn("season", sn.code("match_date")).withColumn("ftr", result_of())


def raw_csv(m):
    """Match rows under the season files' own column names, dates as DD/MM/YYYY."""
    cols = ["fthg", "ftag", "ftr", "hs_shots", "as_shots", "hst", "ast", "hf", "af", "hc", "ac", "hy", "ay", "hr", "ar",
            "b365h", "b365d", "b365a"]
    return season_rows(m).select(
        "season", "league_code", "is_cross", F.col("away_league").alias("Div"), F.date_format("match_date", "dd/MM/yyyy").alias("Date"),
        F.col("home_team").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"),
        *[F.col(c).alias(SHORT[c]) for c in cols], F.col("match_id").alias("MatchId"))


def read_season_csv(spark, sf):
    """Full files for league play, goals-only files with another header for the rest."""
    path = scratch_path(spark, "season-csv")
    rows = raw_csv(matches(spark, sf))
    def write(df, name):
        df.repartition("season", "league_code").write.option("header", "true").partitionBy(
            "season", "league_code").csv(f"{path}/{name}")
    write(rows.where(~F.col("is_cross")).drop("is_cross"), "full")
    write(rows.where("is_cross").select("season", "league_code", "MatchId", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR"), "goals")
    out = sf_.read_season_csv(spark, path)
    return tidy(out.withColumn("match_id", F.col("MatchId").cast("bigint")).select(
        "match_id", "season", "league_code", "match_date", "home_team", "away_team", "fthg", "ftag", "ftr",
        F.coalesce("hst", F.lit("-")).alias("hst"), F.coalesce("div", F.lit("-")).alias("div")))


def guarded(m):
    # A file holds one league and month; away-league rows make it a mixed file.
    return m.withColumns({
        "file": F.concat_ws("/", "league_code", F.date_format("match_date", "yyyy-MM")),
        "div": F.when(F.col("hy") == 4, " ").otherwise(F.col("away_league"))})


def division_guard(spark, sf):
    return tidy(sf_.division_guard(guarded(matches(spark, sf))), "match_id", "file")


WANTED = ["match_id", "match_date", "home_team", "away_team", "fthg", "ftag", "ftr", "hst", "not_there"]


def project_required(spark, sf):
    m = matches(spark, sf).withColumn("ftr", F.when(F.col("hy") != 4, result_of()))
    return tidy(sf_.project_required(m, WANTED))


def league_tables(spark, sf):
    path = scratch_path(spark, "leagues")
    sf_.write_league_parquet(season_rows(matches(spark, sf)), path)
    return path


def read_league_parquet(spark, sf):
    out = sf_.read_league_parquet(spark, league_tables(spark, sf), seasons=["9596", "9900"], names={"L01": "First", "L02": "Second"})
    return tidy(out, "match_id", "league_code", "season", "league")


def write_league_parquet(spark, sf):
    """Written twice for two leagues: the second write must not add or lose rows."""
    path = league_tables(spark, sf)
    again = season_rows(matches(spark, sf)).where(F.col("league_code").isin("L01", "L02"))
    sf_.write_league_parquet(again, path)
    return tidy(spark.read.parquet(path), "match_id", "league_code", "season", "home_team", "fthg")


def source_priority(spark, sf):
    m = season_rows(matches(spark, sf)).withColumn("source_rank", F.col("hy").cast("bigint"))
    return tidy(sf_.source_priority(m), "match_id", "source_rank")


def unify_dtypes(spark, sf):
    mixed = F.when((F.col("hr") == 1) & (F.col("ar") == 1) & (F.col("hy") == 4), F.lit("n/a")).otherwise(F.col("hst").cast("string"))
    m = matches(spark, sf).select("match_id", F.col("fthg").cast("string").alias("goals"), mixed.alias("shots"),
                                  F.when(F.col("hy") != 4, F.col("ay").cast("string")).alias("gaps"))
    return tidy(cl.unify_dtypes(m))


def read_international(spark, sf):
    raw = matches(spark, sf).select(
        "match_id", F.when(F.col("ay") == 4, "not a date").otherwise(F.col("match_date").cast("string")).alias("date"),
        "home_team", "away_team", F.when(F.col("hy") == 4, "?").otherwise(F.col("fthg").cast("string")).alias("home_score"),
        F.col("ftag").cast("string").alias("away_score"), F.concat(F.lit("T"), (F.col("hc") % 3).cast("string")).alias("tournament"),
        F.when(F.col("hr") == 1, F.lit(" TRUE ")).otherwise(F.lit("no")).alias("neutral"))
    out = intl.read_international(raw, "1996-01-01", ["T0", "T2"])
    return tidy(out, "match_id", "match_date", "home_team", "away_team", "fthg", "ftag", "ftr", "neutral", "tournament")


def match_documents(m):
    """One document per league and month, in the sectioned text format."""
    score = F.concat_ws("-", "fthg", "ftag")
    half = F.concat_ws("-", F.floor(F.col("fthg") / 2).cast("string"), F.floor(F.col("ftag") / 2).cast("string"))
    late = F.concat_ws("-", (F.col("fthg") + 1).cast("string"), "ftag")
    note = (
        F.when(F.col("hy") == 0, F.concat(score, F.lit(" ("), half, F.lit(")")))
        .when(F.col("hy") == 1, score)
        .when(F.col("hy") == 2, F.concat(late, F.lit(" a.e.t. ("), score, F.lit(", "), half, F.lit(")")))
        .when(F.col("hy") == 3, F.concat(F.lit("5-4 pen. "), late, F.lit(" a.e.t. ("), score, F.lit(")")))
        .when(F.col("ay") == 4, F.lit("3-0 awarded")).otherwise(F.concat(late, F.lit(" a.e.t. ("), score, F.lit(")"))))
    home = F.when(F.col("hr") == 1, F.concat("home_team", F.lit(" (ENG)"))).otherwise(F.col("home_team"))
    line = F.concat(F.when(F.col("ar") == 1, F.lit("  20:45  ")).otherwise(F.lit("    ")), home, F.lit(" v "), F.col("away_team"), F.lit("  "), note)
    rows = m.select("league_code", "match_date", F.date_trunc("month", "match_date").cast("date").alias("month"), "match_id", line.alias("line"))
    day = F.concat(F.date_format("match_date", "EEE MMM d"), F.when(F.dayofmonth("match_date") % 2 == 0, F.date_format("match_date", " yyyy")).otherwise(F.lit("")))
    days = rows.select("league_code", "month", "match_date", F.lit(-1).cast("bigint").alias("match_id"), day.alias("line")).distinct()
    every = days.unionByName(rows)
    # A league-month is one file; its lines are what the file holds.
    docs = every.groupBy("league_code", "month").agg(F.sort_array(F.collect_list(F.struct("match_date", "match_id", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    start = sn.start_year("month")
    return docs.select(
        F.concat_ws("/", "league_code", F.col("month").cast("string")).alias("doc_id"), F.col("league_code").alias("competition"),
        sn.label(start).alias("season"), start.alias("start_year"), (start + 1).alias("end_year"),
        F.concat(F.lit("= League\n# comment\n\n▪ Round 1\n"), body).alias("text"))


def parse_match_text(spark, sf):
    out = mt.parse_match_text(match_documents(matches(spark, sf)))
    fill = {c: F.coalesce(F.col(c), F.lit(-1)) for c in ("hthg", "htag")}
    return tidy(out.withColumns(fill).withColumn("home_country", F.coalesce("home_country", F.lit("-"))),
                "doc_id", "season", "match_date", "home_team", "away_team", "home_country", "fthg", "ftag", "hthg", "htag")


def odds_events(spark, sf):
    """One event per match; its books are gathered as prices and spelled out beside the teams."""
    # A match has at most one book per source.
    prices = quotes(spark, sf).groupBy("match_id").agg(
        F.collect_list(F.struct("source", "odds_home", "odds_draw", "odds_away")).alias("prices"))
    m = matches(spark, sf).select("match_id", "match_date", "home_team", "away_team").join(prices, "match_id", "left")

    def book(q):
        return F.struct(q["source"].alias("key"), F.array(
            F.struct(F.lit("h2h").alias("key"), F.array(
                F.struct(F.col("home_team").alias("name"), q["odds_home"].alias("price")),
                F.struct(F.lit("Draw").alias("name"), q["odds_draw"].alias("price")),
                F.struct(F.col("away_team").alias("name"), q["odds_away"].alias("price"))).alias("outcomes")),
            F.struct(F.lit("totals").alias("key"), F.array(F.struct(F.lit("Over").alias("name"), F.lit(1.9).alias("price"))).alias("outcomes"))).alias("markets"))
    event = F.struct(F.col("match_id").cast("string").alias("id"), F.concat(F.col("match_date").cast("string"), F.lit("T18:30:00Z")).alias("commence_time"),
                     "home_team", "away_team", F.coalesce(F.transform("prices", book), F.array()).alias("bookmakers"))
    return m.select(F.to_json(event).alias("payload"))


AVG = [f"{k}_{s}" for k in ("avg", "best") for s in ("home", "draw", "away")]


def parse_odds_events(spark, sf):
    _, fixtures = fd.parse_odds_events(odds_events(spark, sf))
    return tidy(fixtures.withColumn("match_id", F.col("id").cast("bigint")), "match_id", "kickoff", "home_team", "away_team", *AVG)


LEAGUES = {f"C{i:02d}": f"L{i:02d}" for i in range(15)}


def parse_provider_matches(spark, sf):
    m = matches(spark, sf)
    code = (F.when(F.col("hy") == 0, "TIMED").when(F.col("hy") == 1, "IN_PLAY").when(F.col("hy") == 2, "AWARDED")
            .when(F.col("hy") == 3, "CANCELED").otherwise("ODD"))
    short = F.when(F.col("hr") == 1, F.lit(" ")).otherwise(F.col("home_team"))
    payload = F.to_json(F.struct(
        F.col("match_id").alias("id"), F.concat(F.col("match_date").cast("string"), F.lit("T20:00:00Z")).alias("utcDate"), code.alias("status"),
        F.struct(F.concat(F.lit("FC "), "home_team").alias("name"), short.alias("shortName")).alias("homeTeam"),
        F.struct(F.col("away_team").alias("name"), F.lit(None).cast("string").alias("shortName")).alias("awayTeam"),
        F.struct(F.struct(F.col("fthg").alias("home"), F.col("ftag").alias("away")).alias("fullTime")).alias("score"),
        F.struct(F.concat(F.lit("C"), F.substring("league_code", 2, 2)).alias("code")).alias("competition")))
    out = fd.parse_provider_matches(m.select(payload.alias("payload")), LEAGUES)
    goals = {c: F.coalesce(F.col(c), F.lit(-1)) for c in ("home_goals", "away_goals")}
    return tidy(out.withColumns(goals).withColumn("match_id", F.col("source_id").cast("bigint")),
                "match_id", "league_code", "kickoff", "home_team", "away_team", "status", "home_goals", "away_goals")


def parse_board_rows(spark, sf):
    stage = (F.when(F.col("hy") == 0, "Half Time").when(F.col("hy") == 1, "After Pen.").when(F.col("hy") == 2, "Postponed")
             .when(F.col("hy") == 3, "").otherwise("67'"))
    m = matches(spark, sf).select(
        "match_id", F.concat(F.lit(" "), "home_team").alias("home_team"), "away_team", stage.alias("stage"),
        F.when(F.col("hy") == 3, "-").otherwise(F.col("fthg").cast("string")).alias("home_score"), F.col("ftag").cast("string").alias("away_score"),
        F.concat(F.lit("new-land/"), F.lower("league_code"), F.lit("-league")).alias("slug"))
    out = fd.parse_board_rows(m).withColumn("home_goals", F.coalesce("home_goals", F.lit(-1)))
    return tidy(out, "match_id", "home_team", "status", "minute", "home_goals", "away_goals", "country", "league")


def history_results(spark, sf):
    m = matches(spark, sf).select(
        "match_id", F.when(F.col("hr") == 1, F.date_format("match_date", "dd/MM/yy")).otherwise(F.date_format("match_date", "dd/MM/yyyy")).alias("date"),
        F.when(F.col("ar") == 1, "19:45").otherwise("").alias("time"), "home_team", "away_team",
        F.when(F.col("hy") == 4, "").otherwise(F.col("fthg").cast("string")).alias("fthg"), F.col("ftag").cast("string").alias("ftag"))
    out = fd.history_results(m)
    return tidy(out, "match_id", "kickoff", "home_goals", "away_goals", "status")


def fixture_rows(m):
    price = lambda c: F.when(F.col("hy") == 4, "n/a").when(F.col("hr") == 1, "-1").otherwise(F.col(c).cast("string"))
    return m.select("match_id", "match_date", "league_code", price("b365h").alias("odds_home"),
                    F.col("b365d").cast("string").alias("odds_draw"), F.col("b365a").cast("string").alias("odds_away"))


def read_fixtures(spark, sf):
    m = matches(spark, sf)
    out = fd.read_fixtures(fixture_rows(m), leagues=["L02", "L05", "L11"])
    return tidy(out.withColumn("odds_home", F.coalesce("odds_home", F.lit(-1.0))), "match_id", "match_date", "odds_home", "odds_draw", "has_odds")


def fixture_window(spark, sf):
    m = matches(spark, sf)
    kick = m.withColumn("kickoff", F.col("match_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hc").cast("int") + 12))
    start = F.date_sub(m.agg(F.max("match_date")).scalar(), 30)
    return tidy(fd.fixture_window(kick, start, 14), "match_id", "match_date")


PAYLOAD = "match_id bigint, home_team string, away_team string, p_home double, p_draw double, p_away double, predicted_outcome string"


def predicted(spark, sf):
    return gl.predict_from_odds(matches(spark, sf)).select(
        "league_code", "match_date", *[c.split()[0] for c in PAYLOAD.split(", ")])


def write_predictions(spark, sf):
    """Payloads written, some keys of a month again, then read back per match."""
    path = scratch_path(spark, "payloads")
    rows = predicted(spark, sf)
    st.write_predictions(rows, path)
    st.write_predictions(rows.where(F.col("match_date").between("1997-05-01", "1997-05-20") & (F.col("league_code") < "L07")), path)
    return tidy(st.read_predictions(spark, path, PAYLOAD))


def prediction_store(spark, sf):
    path = scratch_path(spark, "store")
    rows = predicted(spark, sf)
    early = F.col("match_date") < F.lit("1998-01-01").cast("date")
    st.store_predictions(rows.where(early), path)
    st.store_predictions(rows.where(~early), path)
    return tidy(st.load_predictions(spark, path), "match_id", "match_date", "predicted_outcome", "p_home")


# --- cleaning --------------------------------------------------------------

def raw_matches(m):
    """Untyped rows with bad cells."""
    return m.select(
        "match_id", F.when(F.col("ay") == 4, "32/13/1997").when(F.col("hr") == 1, F.col("match_date").cast("string"))
        .otherwise(F.date_format("match_date", "dd/MM/yyyy")).alias("match_date"), "home_team", "away_team",
        F.col("fthg").cast("string").alias("fthg"), F.col("ftag").cast("string").alias("ftag"),
        F.when(F.col("hc") == 3, "x").otherwise(F.col("hst").cast("string")).alias("hst"),
        F.when(F.col("hy") == 4, "?").otherwise(result_of()).alias("ftr"))


def clean_matches(spark, sf):
    out = cl.clean_matches(raw_matches(matches(spark, sf)))
    return tidy(out.withColumn("hst", F.coalesce("hst", F.lit(-1.0))), "match_id", "match_date", "fthg", "ftag", "hst", "result")


def corpus_raw(m):
    return m.select(
        F.col("match_id").alias("row_id"), F.col("hr").alias("source_rank"), F.concat(F.lit(" "), "league_code").alias("div"), "match_date",
        F.concat("home_team", F.lit(" ")).alias("home_team"), F.when(F.col("ay") == 4, " ").otherwise(F.col("away_team")).alias("away_team"),
        F.when(F.col("hy") == 4, "x").otherwise(F.col("fthg").cast("string")).alias("fthg"), F.col("ftag").cast("string").alias("ftag"),
        F.when(F.col("hc") == 1, " h ").when(F.col("hc") == 2, "?").alias("ftr"))


def normalise_corpus(spark, sf):
    return tidy(cl.normalise_corpus(corpus_raw(matches(spark, sf))), "row_id", "div", "match_date", "home_team", "away_team", "fthg", "ftag", "ftr")


def dedupe_sources(spark, sf):
    """The same league days reported twice: identity is (div, date, home, away)."""
    rows = cl.normalise_corpus(corpus_raw(matches(spark, sf)))
    second = rows.withColumn("source_rank", F.col("source_rank") + 1).withColumn("row_id", F.col("row_id") + 10_000_000)
    return tidy(cl.dedupe_sources(rows.unionByName(second)), "row_id", "source_rank", "div", "match_date", "home_team", "away_team")


def union_goals(spark, sf):
    m = matches(spark, sf)
    return tidy(cl.union_goals(m.where(~F.col("is_cross")), m.where("is_cross")))


def season_of_date(spark, sf):
    first, second = sn.code_years(F.col("code"))
    out = matches(spark, sf).select("match_id", sn.start_year("match_date").alias("start_year"), sn.code("match_date").alias("code"))
    return tidy(out.withColumns({"label": sn.label(F.col("start_year")), "first_year": first, "second_year": second}))


def load_all_seasons(spark, sf):
    return tidy(cl.season_counts(season_rows(matches(spark, sf))))


QUERIES = {
    f.__name__: f
    for f in (read_season_csv, division_guard, project_required, read_league_parquet, source_priority, write_league_parquet,
              unify_dtypes, read_international, parse_match_text, parse_odds_events, parse_provider_matches, parse_board_rows,
              history_results, read_fixtures, fixture_window, write_predictions, prediction_store,
              clean_matches, normalise_corpus, dedupe_sources, union_goals, season_of_date, load_all_seasons)
}

# --- oracles ---------------------------------------------------------------

FTR = "CASE WHEN fthg > ftag THEN 'H' WHEN fthg < ftag THEN 'A' ELSE 'D' END"
START = "(year(match_date) - CASE WHEN month(match_date) < 7 THEN 1 ELSE 0 END)"
CODE = f"lpad(CAST({START} % 100 AS VARCHAR), 2, '0') || lpad(CAST(({START} + 1) % 100 AS VARCHAR), 2, '0')"
FAV = "CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'Home Win' WHEN p_draw >= p_away THEN 'Draw' ELSE 'Away Win' END"
TRIPLE = """(SELECT *, (1.0/b365h)/(1.0/b365h+1.0/b365d+1.0/b365a) AS p_home, (1.0/b365d)/(1.0/b365h+1.0/b365d+1.0/b365a) AS p_draw, (1.0/b365a)/(1.0/b365h+1.0/b365d+1.0/b365a) AS p_away FROM matches) t"""
CORPUS = f"""corpus AS (SELECT match_id AS row_id, hr AS source_rank, league_code AS div, match_date, home_team, away_team, fthg, ftag, CASE WHEN hc = 1 THEN 'H' ELSE {FTR} END AS ftr FROM matches WHERE ay <> 4 AND hy <> 4)"""

ORACLES = {
    "read_season_csv": sql(
        f"""SELECT match_id, {CODE} AS season, league_code, strftime(match_date, '%d/%m/%Y') AS match_date, home_team, away_team, CAST(fthg AS VARCHAR) AS fthg, CAST(ftag AS VARCHAR) AS ftag, {FTR} AS ftr,
CASE WHEN is_cross THEN '-' ELSE CAST(hst AS VARCHAR) END AS hst, CASE WHEN is_cross THEN '-' ELSE away_league END AS div FROM matches""", "matches"),
    "division_guard": sql(
        """SELECT match_id, file FROM g WHERE file IN (SELECT file FROM g GROUP BY file, league_code HAVING count(div) = 0 OR (min(div) = max(div) AND min(div) = league_code))""",
        "matches", ctes="g AS (SELECT match_id, league_code, league_code || '/' || strftime(match_date, '%Y-%m') AS file, CASE WHEN hy <> 4 THEN away_league END AS div FROM matches)"),
    "project_required": sql(f"SELECT match_id, {text('match_date')}, home_team, away_team, fthg, ftag, {FTR} AS ftr, hst FROM matches WHERE hy <> 4", "matches"),
    "read_league_parquet": sql(
        f"SELECT match_id, league_code, {CODE} AS season, CASE league_code WHEN 'L01' THEN 'First' WHEN 'L02' THEN 'Second' ELSE league_code END AS league FROM matches WHERE {CODE} IN ('9596', '9900')", "matches"),
    "write_league_parquet": sql(f"SELECT match_id, league_code, {CODE} AS season, home_team, fthg FROM matches", "matches"),
    "source_priority": sql(
        f"SELECT match_id, hy AS source_rank FROM (SELECT *, min(hy) OVER (PARTITION BY league_code, {CODE}) AS best FROM matches) t WHERE hy = best", "matches"),
    "unify_dtypes": sql(
        "SELECT match_id, CAST(fthg AS DOUBLE) AS goals, CASE WHEN hr = 1 AND ar = 1 AND hy = 4 THEN 'n/a' ELSE CAST(hst AS VARCHAR) END AS shots, CASE WHEN hy <> 4 THEN CAST(ay AS DOUBLE) END AS gaps FROM matches", "matches"),
    "read_international": sql(
        f"""SELECT match_id, {text('match_date')}, home_team, away_team, fthg, ftag, {FTR} AS ftr, hr AS neutral, 'T' || (hc % 3) AS tournament FROM matches
WHERE ay <> 4 AND hy <> 4 AND match_date >= DATE '1996-01-01' AND hc % 3 IN (0, 2)""", "matches"),
    "parse_match_text": sql(
        f"""SELECT league_code || '/' || strftime(date_trunc('month', match_date), '%Y-%m-%d') AS doc_id, {START} || '-' || lpad(CAST(({START} + 1) % 100 AS VARCHAR), 2, '0') AS season, {text('match_date')}, home_team, away_team,
CASE WHEN hr = 1 THEN 'ENG' ELSE '-' END AS home_country, fthg, ftag, CASE WHEN hy IN (0, 2) THEN fthg // 2 ELSE -1 END AS hthg, CASE WHEN hy IN (0, 2) THEN ftag // 2 ELSE -1 END AS htag FROM matches WHERE NOT (hy = 4 AND ay = 4)""", "matches"),
    "parse_odds_events": sql(
        "SELECT match_id, CAST(match_date AS VARCHAR) || ' 18:30:00' AS kickoff, home_team, away_team, " + ", ".join(
            f"round(coalesce({k}_{s}, 0.0), 6) AS {k}_{s}" for k in ("avg", "best") for s in ("home", "draw", "away"))
        + " FROM matches LEFT JOIN (SELECT match_id, " + ", ".join(f"avg(odds_{s}) AS avg_{s}, max(odds_{s}) AS best_{s}" for s in ("home", "draw", "away"))
        + " FROM quotes GROUP BY match_id) q USING (match_id)", "matches", "quotes"),
    "parse_provider_matches": sql(
        """SELECT match_id, league_code, CAST(match_date AS VARCHAR) || ' 20:00:00' AS kickoff, CASE WHEN hr = 1 THEN 'FC ' || home_team ELSE home_team END AS home_team, away_team,
CASE hy WHEN 0 THEN 'scheduled' WHEN 1 THEN 'live' WHEN 2 THEN 'finished' ELSE 'cancelled' END AS status, CASE WHEN hy = 0 THEN -1 ELSE fthg END AS home_goals, CASE WHEN hy = 0 THEN -1 ELSE ftag END AS away_goals
FROM matches WHERE hy <> 4 AND CAST(substr(league_code, 2) AS INT) < 15""", "matches"),
    "parse_board_rows": sql(
        """SELECT match_id, home_team, CASE hy WHEN 0 THEN 'paused' WHEN 1 THEN 'finished' WHEN 2 THEN 'postponed' WHEN 3 THEN 'scheduled' ELSE 'live' END AS status, CASE WHEN hy = 4 THEN '67''' ELSE '' END AS minute,
CASE WHEN hy = 3 THEN -1 ELSE fthg END AS home_goals, ftag AS away_goals, 'New Land' AS country, league_code || ' League' AS league FROM matches""", "matches"),
    "history_results": sql(
        """SELECT match_id, CAST((CASE WHEN hr = 1 THEN match_date + INTERVAL (CASE WHEN year(match_date) < 2000 THEN 100 ELSE 0 END) YEAR ELSE match_date END) AS DATE) || CASE WHEN ar = 1 THEN ' 19:45:00' ELSE ' 00:00:00' END AS kickoff,
fthg AS home_goals, ftag AS away_goals, 'finished' AS status FROM matches WHERE hy <> 4""", "matches"),
    "read_fixtures": sql(
        f"SELECT match_id, {text('match_date')}, CASE WHEN hy = 4 OR hr = 1 THEN -1.0 ELSE b365h END AS odds_home, b365d AS odds_draw, CAST(NOT (hy = 4 OR hr = 1) AS BIGINT) AS has_odds FROM matches WHERE league_code IN ('L02', 'L05', 'L11')", "matches"),
    "fixture_window": sql(
        f"SELECT match_id, {text('match_date')} FROM matches, (SELECT max(match_date) - 30 AS s FROM matches) x WHERE CAST(match_date + to_hours(CAST(hc + 12 AS INT)) AS DATE) BETWEEN s AND s + 14", "matches"),
    "write_predictions": sql(f"SELECT league_code, {text('match_date')}, match_id, home_team, away_team, {r('p_home', 'p_draw', 'p_away')}, {FAV} AS predicted_outcome FROM {TRIPLE}", "matches"),
    "prediction_store": sql(f"SELECT match_id, {text('match_date')}, {FAV} AS predicted_outcome, {r('p_home')} FROM {TRIPLE}", "matches"),
    "clean_matches": sql(
        f"SELECT match_id, {text('match_date')}, CAST(fthg AS DOUBLE) AS fthg, CAST(ftag AS DOUBLE) AS ftag, CASE WHEN hc = 3 THEN -1.0 ELSE CAST(hst AS DOUBLE) END AS hst, CAST(CASE WHEN fthg > ftag THEN 2 WHEN fthg < ftag THEN 0 ELSE 1 END AS BIGINT) AS result FROM matches WHERE ay <> 4 AND hy <> 4", "matches"),
    "normalise_corpus": sql(f"SELECT row_id, div, {text('match_date')}, home_team, away_team, fthg, ftag, ftr FROM corpus", "matches", ctes=CORPUS),
    "dedupe_sources": sql(
        f"""SELECT row_id, source_rank, div, {text('match_date')}, home_team, away_team FROM (SELECT *, row_number() OVER (PARTITION BY div, match_date, home_team, away_team ORDER BY source_rank, row_id) AS rn FROM (
SELECT * FROM corpus UNION ALL SELECT row_id + 10000000, source_rank + 1, div, match_date, home_team, away_team, fthg, ftag, ftr FROM corpus) u) v WHERE rn = 1""", "matches", ctes=CORPUS),
    "union_goals": sql(f"SELECT {text('match_date')}, home_team, away_team, fthg, ftag FROM matches", "matches"),
    "season_of_date": sql(
        f"SELECT match_id, {START} AS start_year, {CODE} AS code, {START} || '-' || lpad(CAST(({START} + 1) % 100 AS VARCHAR), 2, '0') AS label, {START} AS first_year, {START} + 1 AS second_year FROM matches", "matches"),
    "load_all_seasons": sql(f"SELECT league_code, {CODE} AS season, count(*) AS n FROM matches GROUP BY ALL", "matches"),
}
