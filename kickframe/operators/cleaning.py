"""Cleaning and set operations on match rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = ["fthg", "ftag", "hthg", "htag", "hs_shots", "as_shots", "hst", "ast", "hf", "af", "hc", "ac",
           "hy", "ay", "hr", "ar", "b365h", "b365d", "b365a"]
CORPUS = ["div", "season", "match_date", "home_team", "away_team", "home_country", "away_country",
          "fthg", "ftag", "ftr", "hthg", "htag"]
GOALS = ["match_date", "home_team", "away_team", "fthg", "ftag"]
RESULT = {"H": 2, "D": 1, "A": 0}


def day_first(text: Column) -> Column:
    """Date from DD/MM/YYYY, DD/MM/YY or ISO text; null when none fits."""
    t = F.trim(text)
    parsed = [F.try_to_timestamp(t, F.lit(f)) for f in ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd")]
    long_form = t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    short_form = t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$")
    return F.when(long_form, parsed[0]).when(short_form, parsed[1]).otherwise(parsed[2]).cast("date")


def clean_matches(raw: DataFrame) -> DataFrame:
    """Typed matches with an encoded result; undated or unknown-result rows drop.

    Bad numbers become null. Chronological order is a property of the consumer's
    window or sink, so no global sort is planned here.
    """
    numeric = {c: F.col(c).try_cast("double") for c in NUMERIC if c in raw.columns}
    result = F.when(F.lit(False), 0)
    for letter, code in RESULT.items():
        result = result.when(F.col("ftr") == letter, code)
    return (
        raw.withColumn("match_date", day_first(F.col("match_date"))).withColumns(numeric)
        .withColumn("result", result).na.drop(subset=["match_date", "result"])
    )


def normalise_corpus(raw: DataFrame) -> DataFrame:
    """Any frame in the canonical goals-only shape; untrusted rows drop.

    A valid supplied result is kept even where the goals say otherwise.
    """
    have = set(raw.columns)
    out = raw.withColumns({c: F.lit(None).cast("string") for c in CORPUS if c not in have})
    if not isinstance(raw.schema["match_date"].dataType, T.DateType):
        out = out.withColumn("match_date", day_first(F.col("match_date")))
    out = out.withColumns({
        "home_team": F.trim("home_team"), "away_team": F.trim("away_team"), "div": F.trim("div"),
        **{g: F.col(g).cast("string").try_cast("double").cast("int") for g in ("fthg", "ftag", "hthg", "htag")},
    })
    derived = (F.when(F.col("fthg") > F.col("ftag"), "H").when(F.col("fthg") < F.col("ftag"), "A").otherwise("D"))
    given = F.upper(F.trim("ftr"))
    out = out.withColumn("ftr", F.when(given.isin("H", "D", "A"), given).otherwise(derived))
    keep = out.na.drop(subset=["match_date", "home_team", "away_team", "fthg", "ftag"])
    return keep.where((F.col("home_team") != "") & (F.col("away_team") != "")).select(
        *[c for c in ("row_id", "source_rank") if c in have], *CORPUS)


def dedupe_sources(rows: DataFrame) -> DataFrame:
    """Same (div, date, home, away) in several sources: the earliest wins.

    A minimum, not a window: each task keeps one row per key before the shuffle.
    """
    key = ["div", "match_date", "home_team", "away_team"]
    rest = [c for c in rows.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct("source_rank", "row_id")).alias("r")
    return rows.groupBy(*key).agg(first).select(*key, "r.*").select(*rows.columns)


def union_goals(domestic: DataFrame, supplementary: DataFrame | None = None) -> DataFrame:
    """Both corpora as one goals-only frame."""
    out = domestic.select(*GOALS)
    return out if supplementary is None else out.unionByName(supplementary.select(*GOALS))


def season_counts(matches: DataFrame) -> DataFrame:
    """Rows per league and season; combinations without rows do not appear."""
    return matches.groupBy("league_code", "season").agg(F.count(F.lit(1)).alias("n"))


def unify_dtypes(df: DataFrame) -> DataFrame:
    """String columns become double where every non-null value converts.

    One aggregate over all columns decides; it returns a single row.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    checks = df.agg(*[
        (F.count(c) == F.count(F.col(c).try_cast("double"))).alias(c) for c in texts
    ]).first()
    return df.withColumns({c: F.col(c).cast("double") for c in texts if checks[c]})
