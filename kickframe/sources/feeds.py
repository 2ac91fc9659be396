"""Provider payloads: odds events, match lists, score boards, fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.operators.cleaning import day_first
from kickframe.streaming.live import provider_status, stage_status

EVENT = (
    "id string, commence_time string, home_team string, away_team string, "
    "bookmakers array<struct<key: string, markets: array<struct<key: string, "
    "outcomes: array<struct<name: string, price: double>>>>>>"
)
PROVIDER = (
    "id bigint, utcDate string, status string, minute string, "
    "homeTeam struct<name: string, shortName: string>, awayTeam struct<name: string, shortName: string>, "
    "score struct<fullTime: struct<home: int, away: int>>, competition struct<code: string>"
)


def iso_utc(text: Column) -> Column:
    """Naive UTC time of an ISO text; null when it is not one."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def parse_odds_events(raw: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(quotes, fixtures) of nested odds events.

    Quotes have one row per price of the match-winner market. Fixtures carry the
    mean and best price per outcome, zero where there is none; every price seen
    counts in the mean.
    """
    events = raw.select(F.from_json(column, EVENT).alias("e")).select("e.*")
    prices = (
        events.select("id", "home_team", "away_team", F.explode("bookmakers").alias("b"))
        .select("id", "home_team", "away_team", F.col("b.key").alias("source"), F.explode("b.markets").alias("m"))
        .where(F.col("m.key") == "h2h")
        .select("id", "source", "home_team", "away_team", F.explode("m.outcomes").alias("o"))
        .select("id", "source", F.col("o.price").alias("price"),
                F.when(F.col("o.name") == F.col("home_team"), "home")
                .when(F.col("o.name") == F.col("away_team"), "away")
                .when(F.col("o.name") == "Draw", "draw").alias("outcome"))
        .where(F.col("outcome").isNotNull())
    )
    # An event is one row, so its means and maxima need no shuffle.
    h2h = F.transform("bookmakers", lambda b: F.flatten(F.transform(
        F.filter(b["markets"], lambda m: m["key"] == "h2h"), lambda m: F.filter(m["outcomes"], lambda o: o.isNotNull()))))
    seen = F.flatten(F.filter(h2h, lambda x: x.isNotNull()))
    timed = events.select("id", "home_team", "away_team", iso_utc(F.col("commence_time")).alias("kickoff"), seen.alias("_o"))
    home, away = F.col("home_team"), F.col("away_team")
    sides = {
        "home": lambda o: o["name"] == home,
        "draw": lambda o: (o["name"] == "Draw") & ~F.coalesce(o["name"].isin(home, away), F.lit(False)),
        "away": lambda o: (o["name"] == away) & ~F.coalesce(o["name"] == home, F.lit(False)),
    }
    summary = []
    for side, which in sides.items():
        found = F.transform(F.filter("_o", which), lambda o: F.coalesce(o["price"], F.lit(0.0)))
        total = F.aggregate(found, F.lit(0.0), lambda x, y: x + y)
        summary += [F.when(F.size(found) > 0, total / F.size(found)).otherwise(0.0).alias(f"avg_{side}"),
                    F.coalesce(F.array_max(found), F.lit(0.0)).alias(f"best_{side}")]
    fixtures = timed.where(F.col("kickoff").isNotNull()).select("id", "home_team", "away_team", "kickoff", *summary)
    return prices, fixtures


def parse_provider_matches(raw: DataFrame, leagues: dict[str, str], column: str = "payload") -> DataFrame:
    """Typed rows of a provider's match list for the wanted competitions.

    The short name is preferred; a match not started has no score; rows without
    teams, time or a known status drop.
    """
    m = raw.select(F.from_json(column, PROVIDER).alias("m")).select("m.*")
    wanted = F.create_map(*[F.lit(x) for pair in leagues.items() for x in pair])
    def team(col: str) -> Column:
        blank = lambda c: F.nullif(F.trim(c), F.lit(""))
        return F.coalesce(blank(F.col(f"{col}.shortName")), blank(F.col(f"{col}.name")))
    started = F.col("state") != "scheduled"
    rows = m.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("source_id"),
        F.try_element_at(wanted, F.coalesce("competition.code", F.lit(""))).alias("league_code"),
        iso_utc(F.col("utcDate")).alias("kickoff"), team("homeTeam").alias("home_team"),
        team("awayTeam").alias("away_team"), provider_status(F.col("status")).alias("state"),
        F.coalesce("minute", F.lit("")).alias("minute"), F.col("score.fullTime").alias("ft"))
    return rows.select(
        "source_id", "league_code", "kickoff", "home_team", "away_team", F.col("state").alias("status"), "minute",
        F.when(started, F.col("ft.home")).alias("home_goals"), F.when(started, F.col("ft.away")).alias("away_goals"),
    ).na.drop(subset=["league_code", "kickoff", "home_team", "away_team", "status"])


def parse_board_rows(rows: DataFrame) -> DataFrame:
    """Score-board text rows: typed score, state by stage, labels from the slug.

    `slug` is country/league; the minute is kept only while the match is live.
    """
    goals = {f"{s}_goals": F.trim(f"{s}_score").try_cast("int") for s in ("home", "away")}
    typed = rows.withColumns(goals).withColumns({"home_team": F.trim("home_team"), "away_team": F.trim("away_team")})
    status = stage_status(F.col("stage"), F.col("home_goals"), F.col("away_goals"))
    part = lambda i: F.initcap(F.translate(F.get(F.split("slug", "/"), F.lit(i)), "-", " "))
    return (
        typed.where((F.col("home_team") != "") & (F.col("away_team") != "")).withColumn("status", status)
        .withColumns({"minute": F.when(F.col("status") == "live", F.trim("stage")).otherwise(""),
                      "country": part(0), "league": part(1)})
    )


def history_results(rows: DataFrame) -> DataFrame:
    """Finished matches of a season file: two date formats, optional time."""
    time = F.coalesce(F.nullif(F.trim("time"), F.lit("")), F.lit("00:00"))
    day = day_first(F.col("date"))
    kickoff = F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), time), F.lit("yyyy-MM-dd HH:mm"))
    kickoff = F.coalesce(kickoff, day.cast("timestamp")).cast("timestamp_ntz")
    return rows.withColumns({
        "kickoff": kickoff, "home_goals": F.col("fthg").try_cast("int"), "away_goals": F.col("ftag").try_cast("int"),
        "status": F.lit("finished"),
    }).na.drop(subset=["kickoff", "home_goals", "away_goals"])


def parse_price(text: Column) -> Column:
    """A price above zero, else null."""
    value = text.try_cast("double")
    return F.when(value > 0, value)


def read_fixtures(rows: DataFrame, date: Column | None = None, leagues: list[str] | None = None) -> DataFrame:
    """Fixtures of a day and set of leagues with usable prices."""
    out = rows
    if date is not None:
        out = out.where(F.col("match_date") == date)
    if leagues:
        out = out.where(F.col("league_code").isin(leagues))
    out = out.withColumns({c: parse_price(F.col(c)) for c in ("odds_home", "odds_draw", "odds_away")})
    priced = F.col("odds_home").isNotNull() & F.col("odds_draw").isNotNull() & F.col("odds_away").isNotNull()
    return out.withColumn("has_odds", priced)


def available_dates(rows: DataFrame, leagues: list[str] | None = None) -> DataFrame:
    out = rows.where(F.col("league_code").isin(leagues)) if leagues else rows
    return out.select("match_date").distinct().orderBy("match_date")


def fixture_window(rows: DataFrame, start: Column, lookahead_days: int) -> DataFrame:
    """Kick-offs from `start` to `lookahead_days` later by calendar date, both included."""
    return rows.where(F.to_date("kickoff").between(start, F.date_add(start, lookahead_days)))
