"""Sectioned match text: date lines followed by the matches of that date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kickframe.functions.seasons import START_MONTH

# Marks of the text and names of months.
EXTRA_TIME = "a.e.t."
NOT_PLAYED = ("awarded", "cancelled", "abandoned")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _line_date(line: Column) -> Column:
    """Date of a line of weekday, month, day and perhaps year; a bare day takes its year from the season."""
    words = F.split(F.trim(line), " +")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.get(words, F.lit(1))).cast("int")
    day, named = F.get(words, F.lit(2)).try_cast("int"), F.get(words, F.lit(3))
    by_season = F.when(month >= START_MONTH, F.col("start_year")).otherwise(F.col("end_year"))
    year = F.when(named.isNull(), by_season).otherwise(named.try_cast("int"))
    text = F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string"))
    fits = (F.length(F.get(words, F.lit(0))) == 3) & (month > 0) & day.isNotNull() & year.isNotNull() & (F.size(words) <= 4)
    return F.when(fits, F.try_to_timestamp(text, F.lit("y-M-d")).cast("date"))


def _sides(line: Column) -> tuple[Column, Column, Column]:
    """Home text, away text and score text of a line `[time] home v away  score`."""
    text = F.trim(line)
    first = F.substring_index(text, " ", 1)
    timed = first.contains(":") & F.try_to_timestamp(first, F.lit("H:mm")).isNotNull()
    halves = F.split(F.when(timed, F.ltrim(F.substr(text, F.length(first) + 1))).otherwise(text), " +v +", 2)
    right = F.split(F.get(halves, F.lit(1)), " {2,}", 2)
    return F.get(halves, F.lit(0)), F.get(right, F.lit(0)), F.coalesce(F.trim(F.get(right, F.lit(1))), F.lit(""))


def _numbers(text: Column) -> Column:
    """The whole numbers of a text in order."""
    return F.transform(F.split(F.trim(F.regexp_replace(text, "[^0-9]+", " ")), " "), lambda x: x.try_cast("int"))


def _team(text: Column) -> tuple[Column, Column]:
    """Name and country code of a side; the code stands last, in brackets."""
    text = F.trim(text)
    code = F.substring(text, -4, 3)
    tagged = (F.substring(text, -5, 1) == "(") & text.endswith(")") & code.rlike("^[A-Z]{3}$")
    return F.when(tagged, F.trim(F.substr(text, F.lit(1), F.length(text) - 5))).otherwise(text), F.when(tagged, code)


def parse_match_text(docs: DataFrame) -> DataFrame:
    """Match rows of whole documents.

    `docs` carry doc_id, competition, season, start_year, end_year and text. A
    date applies to the lines after it, so lines are windowed per document; a
    partition holds one document, which already was a single value.
    """
    lines = docs.select(
        "doc_id", "competition", "season", "start_year", "end_year",
        F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "line"))
    # A tab parts like two blanks, and so does other white space within a line.
    lines = lines.withColumn("line", F.regexp_replace("line", r"[\t\x0b\f\u00a0]", "  "))
    lines = lines.where((F.trim("line") != "") & ~F.trim("line").rlike("^[=#▪]"))
    in_order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    dated = lines.withColumn("_own", _line_date(F.col("line"))).withColumn(
        "match_date", F.last("_own", ignorenulls=True).over(in_order))
    home_text, away_text, score_text = _sides(F.col("line"))
    rows = dated.where(F.col("_own").isNull() & F.col("match_date").isNotNull())
    rows = rows.select("*", home_text.alias("_home"), away_text.alias("_away"), score_text.alias("_score"))
    unplayed = F.lit(False)
    for mark in NOT_PLAYED:
        unplayed = unplayed | F.lower("_score").contains(mark)
    rows = rows.where(F.col("_away").isNotNull() & (F.col("_score") != "") & ~unplayed).select(
        "*", _numbers(F.substring_index("_score", "(", 1)).alias("_out"),
        _numbers(F.when(F.col("_score").contains("("), F.substring_index(F.substring_index("_score", "(", -1), ")", 1)).otherwise("")).alias("_in"))
    # After extra time the brackets hold the score at 90 minutes, then at half time.
    extra = F.col("_score").contains(EXTRA_TIME)
    at = lambda c, i: F.get(c, F.lit(i))
    goals = {
        name: F.when(extra, at("_in", i)).otherwise(at("_out", i)) for i, name in enumerate(("fthg", "ftag"))
    } | {
        name: F.when(extra, at("_in", 2 + i)).otherwise(at("_in", i)) for i, name in enumerate(("hthg", "htag"))
    }
    (home, hc), (away, ac) = _team(F.col("_home")), _team(F.col("_away"))
    return rows.select(
        "doc_id", F.col("competition").alias("div"), "season", "match_date",
        home.alias("home_team"), away.alias("away_team"), hc.alias("home_country"), ac.alias("away_country"),
        *[c.alias(n) for n, c in goals.items()],
    ).where(F.col("ftag").isNotNull() & (F.col("home_team") != "") & (F.col("away_team") != ""))
