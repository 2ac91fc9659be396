"""Season files and league tables."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kickframe.streaming.live import first_non_empty_source

HEADER_MARK = "HomeTeam"
TAGS = {
    "season": r"(?:season=|/)(\d{4})(?:_[A-Z0-9]+\.csv|/)",
    "league_code": r"(?:league_code=|/\d{4}_)([A-Za-z0-9]+)(?:\.csv|/)",
}
RENAME = {
    "Div": "div", "Date": "match_date", "HomeTeam": "home_team", "AwayTeam": "away_team", "FTR": "ftr",
    "FTHG": "fthg", "FTAG": "ftag", "HTHG": "hthg", "HTAG": "htag", "HS": "hs_shots", "AS": "as_shots",
    "HST": "hst", "AST": "ast", "HF": "hf", "AF": "af", "HC": "hc", "AC": "ac", "HY": "hy", "AY": "ay",
    "HR": "hr", "AR": "ar", "B365H": "b365h", "B365D": "b365d", "B365A": "b365a",
}


def read_season_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every season file under `path` as strings, tagged with league and season.

    Files are grouped by header line and encoding (UTF-8, else Latin-1) so that
    no file is read under another's header. The header is the first line that names
    the home team; lines with more fields than it drop, where a quoted comma ends
    no field. The driver sees one header per file, never rows.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    files = lines.groupBy("file").agg(
        F.min_by(F.when(F.col("value").contains(HEADER_MARK), F.col("value")),
                 F.when(F.col("value").contains(HEADER_MARK), F.col("place"))).alias("header"),
        F.max(~F.is_valid_utf8("value")).alias("latin"),
    ).where(F.col("header").isNotNull())
    groups: dict[tuple[str, bool], list[str]] = defaultdict(list)
    for row in files.toLocalIterator():
        groups[row.header.lstrip("﻿").strip(), row.latin].append(row.file)
    out = None
    for (header, latin), members in sorted(groups.items()):
        names = [h.strip() or f"_blank{i}" for i, h in enumerate(header.split(","))]
        schema = ", ".join(f"`{n}` string" for n in [*names, "_corrupt"])
        part = (
            spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", "true")
            .option("encoding", "ISO-8859-1" if latin else "UTF-8").csv(sorted(members))
        )
        too_long = F.size(F.split(F.regexp_replace("_corrupt", '"[^"]*"', ""), ",")) > len(names)
        part = part.withColumn("file", F.col("_metadata.file_path")).where(
            F.col("_corrupt").isNull() | ~too_long).drop("_corrupt")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    for tag, pattern in TAGS.items():
        out = out.withColumn(tag, F.regexp_extract("file", pattern, 1))
    return out.withColumnsRenamed(RENAME)


def division_guard(rows: DataFrame, file: str = "file", league: str = "league_code") -> DataFrame:
    """Drop files whose divisions are not exactly the requested league.

    A file without any division value is accepted. Only the smallest and largest
    value per file are needed, and they combine map-side.
    """
    div = F.when(F.trim("div") != "", F.trim("div"))
    seen = rows.groupBy(file, league).agg(F.min(div).alias("_lo"), F.max(div).alias("_hi"))
    good = seen.where(F.col("_lo").isNull() | ((F.col("_lo") == F.col("_hi")) & (F.col("_lo") == F.col(league))))
    return rows.join(good.select(file, league), [file, league], "left_semi")


def project_required(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist; rows need both teams and a result."""
    return rows.select(*[c for c in wanted if c in rows.columns]).na.drop(subset=["home_team", "away_team", "ftr"])


def write_league_parquet(matches: DataFrame, path: str) -> None:
    """One directory per league; only leagues present are replaced.

    Rows are clustered by league and season; the rebalance hint lets AQE split a
    large league over tasks, and sorting lets a season filter skip row groups.
    """
    (
        matches.hint("rebalance", "league_code").sortWithinPartitions("league_code", "season")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("league_code").parquet(path)
    )


def read_league_parquet(spark: SparkSession, path: str, leagues: list[str] | None = None,
                        seasons: list[str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """League tables filtered at the scan; a missing display name is filled in."""
    out = spark.read.parquet(path)
    if leagues:
        out = out.where(F.col("league_code").isin(leagues))
    if seasons:
        out = out.where(F.col("season").isin(seasons))
    label = F.col("league_code")
    for code, name in (names or {}).items():
        label = F.when(F.col("league_code") == code, name).otherwise(label)
    known = F.col("league") if "league" in out.columns else F.lit(None).cast("string")
    return out.withColumn("league", F.coalesce(known, label))


def source_priority(rows: DataFrame) -> DataFrame:
    """Per league and season the rows of the first source that has any."""
    return first_non_empty_source(rows, ["league_code", "season"], "source_rank")
