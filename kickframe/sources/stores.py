"""Prediction sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kickframe.session import stage

def payloads(rows: DataFrame) -> DataFrame:
    """A JSON payload per match, keyed by (league, date, match).

    A league-day is the set of its rows, at any size; nothing is gathered.
    """
    key = ["league_code", "match_date", "match_id"]
    item = F.struct("match_id", *[c for c in rows.columns if c not in key])
    return rows.select(*key, F.to_json(item).alias("payload"))


def _by_month(rows: DataFrame) -> DataFrame:
    """Rows clustered by month for writing.

    The rebalance hint lets AQE split a hot month over several tasks and merge
    small ones, so file sizes stay even whatever the spread of dates.
    """
    month = rows.withColumn("match_month", F.date_format("match_date", "yyyy-MM"))
    return month.hint("rebalance", "match_month").sortWithinPartitions("match_month", "match_date")


def write_predictions(rows: DataFrame, path: str) -> None:
    """Upsert payloads on (league, date).

    Only the months touched are rewritten: what they hold under other keys is
    merged with the new rows, staged in the shared folder, then swapped in. The
    payloads are made once.
    """
    fresh = stage(_by_month(payloads(rows)), "payloads")
    spark = rows.sparkSession
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        old = None
    if old is not None:
        touched = fresh.select("match_month").distinct()
        kept = old.join(touched, "match_month", "left_semi").join(
            fresh.select("league_code", "match_date").distinct(), ["league_code", "match_date"], "left_anti")
        fresh = stage(fresh.unionByName(kept), "upsert").hint("rebalance", "match_month")
    (
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("match_month").parquet(path)
    )


def read_predictions(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """Payloads back as one row per match."""
    stored = spark.read.parquet(path)
    item = F.from_json("payload", f"struct<{item_schema}>").alias("m")
    return stored.select("league_code", "match_date", item).select("league_code", "match_date", "m.*")


def store_predictions(rows: DataFrame, path: str) -> None:
    """Append predictions under the month of their match date."""
    _by_month(rows).write.mode("append").partitionBy("match_month").parquet(path)


def load_predictions(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Stored predictions, to be filtered by match_month and match_date."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)
