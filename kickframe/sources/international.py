"""International results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.operators.features import result_of

RENAME = {"date": "match_date", "home_score": "fthg", "away_score": "ftag"}
TRUTHY = ("true", "1", "yes", "t")


def parse_flag(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*TRUTHY), F.lit(False))


def read_international(raw: DataFrame, min_date: str | None = None, tournaments: list[str] | None = None) -> DataFrame:
    """Typed rows with a derived result; incomplete rows drop."""
    out = raw.withColumnsRenamed(RENAME).withColumns({
        "match_date": F.try_to_timestamp(F.col("date" if "date" in raw.columns and "match_date" in raw.columns else "match_date"),
                                         F.lit("yyyy-MM-dd")).cast("date"),
        "fthg": F.col("fthg").try_cast("int"), "ftag": F.col("ftag").try_cast("int"),
        "neutral": parse_flag(F.col("neutral")) if "neutral" in raw.columns else F.lit(False),
    }).na.drop(subset=["match_date", "home_team", "away_team", "fthg", "ftag"])
    if min_date:
        out = out.where(F.col("match_date") >= F.lit(min_date).cast("date"))
    if tournaments:
        out = out.where(F.col("tournament").isin(tournaments))
    return out.withColumn("ftr", result_of())
