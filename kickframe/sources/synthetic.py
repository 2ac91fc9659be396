"""Football-shaped views over the test tables.

`matches` is a projection of `orders`, `quotes` groups `lineitem`, `live_polls`
keeps the newest event per poll and match slot. Written once in Spark SQL; the
DuckDB spelling is derived for the oracles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHES = """
SELECT match_id, league_code, league_code AS home_league, is_cross,
  CASE WHEN is_cross THEN 'L' || lpad(CAST((lg + 1 + c % 19) % 20 AS STRING), 2, '0') ELSE league_code END AS away_league,
  match_date,
  league_code || '-T' || lpad(CAST(hs AS STRING), 2, '0') AS home_team,
  CASE WHEN is_cross THEN 'L' || lpad(CAST((lg + 1 + c % 19) % 20 AS STRING), 2, '0') ELSE league_code END
    || '-T' || lpad(CAST((hs + 1 + (c DIV 20) % 19) % 20 AS STRING), 2, '0') AS away_team,
  (c DIV 400) % 5 AS fthg, (c DIV 2000) % 4 AS ftag,
  (c DIV 400) % 5 + (c DIV 97) % 6 AS hst, (c DIV 2000) % 4 + (c DIV 89) % 6 AS ast,
  (c DIV 400) % 5 + (c DIV 97) % 6 + (c DIV 83) % 10 AS hs_shots, (c DIV 2000) % 4 + (c DIV 89) % 6 + (c DIV 79) % 10 AS as_shots,
  (c DIV 73) % 12 AS hc, (c DIV 71) % 12 AS ac, (c DIV 67) % 18 AS hf, (c DIV 61) % 18 AS af,
  (c DIV 59) % 5 AS hy, (c DIV 53) % 5 AS ay, (c DIV 47) % 2 AS hr, (c DIV 43) % 2 AS ar,
  CAST(120 + (c DIV 41) % 500 AS DOUBLE) / 100 AS b365h, CAST(250 + (c DIV 37) % 200 AS DOUBLE) / 100 AS b365d, CAST(120 + (c DIV 31) % 500 AS DOUBLE) / 100 AS b365a
FROM (SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, o_custkey % 20 AS lg,
   'L' || lpad(CAST(o_custkey % 20 AS STRING), 2, '0') AS league_code, o_orderkey % 10 = 0 AS is_cross,
   CAST(round(o_totalprice * 100) AS BIGINT) AS c, CAST(round(o_totalprice * 100) AS BIGINT) % 20 AS hs FROM {orders}) t
"""

QUOTES = """
SELECT l_orderkey AS match_id, source, CAST(max(105 + c % 400) AS DOUBLE)/100 AS odds_home,
  CASE WHEN max(c) % 17 = 0 THEN 0.0E0 ELSE CAST(max(220 + c % 250) AS DOUBLE)/100 END AS odds_draw,
  CAST(max(105 + (c DIV 7) % 500) AS DOUBLE)/100 AS odds_away
FROM (SELECT l_orderkey, 'bk' || CAST(l_suppkey % 8 AS STRING) AS source,
  CAST(round(l_extendedprice*100) AS BIGINT) AS c FROM {lineitem}) t GROUP BY l_orderkey, source
"""

LIVE_POLLS = """
SELECT poll_seq, league_code, match_slot, status, home_goals, away_goals, ts FROM (
 SELECT *, row_number() OVER (PARTITION BY poll_seq, match_slot ORDER BY ts DESC, event_id DESC) AS rn FROM (
  SELECT event_id, ts, CAST(floor((EPOCH(ts) - 1704067200) / 21600) AS BIGINT) AS poll_seq, user_id AS match_slot,
   'L' || lpad(CAST(user_id % 20 AS STRING), 2, '0') AS league_code,
   CASE event_type WHEN 'signup' THEN 'scheduled' WHEN 'error' THEN 'paused' WHEN 'purchase' THEN 'finished' ELSE 'live' END AS status,
   CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(event_id % 4 AS INT) END AS home_goals,
   CASE WHEN event_type = 'signup' THEN NULL ELSE CAST((event_id DIV 4) % 3 AS INT) END AS away_goals FROM {events}) e) r WHERE rn = 1
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MATCHES, orders=table(spark, sf_dir, "orders"))


def domestic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).where(~F.col("is_cross"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(QUOTES, lineitem=table(spark, sf_dir, "lineitem"))


def live_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = LIVE_POLLS.replace("EPOCH(ts)", "unix_timestamp(ts)")
    return spark.sql(text, events=table(spark, sf_dir, "events"))


def duckdb_sql(text: str) -> str:
    """The DuckDB spelling of one of the view texts."""
    out = text.replace(" DIV ", " // ").replace("STRING", "VARCHAR")
    out = out.replace("EPOCH(ts)", "floor(epoch(ts))")
    return re.sub(r"\{(\w+)\}", r"\1", out)


def oracle_prefix(*names: str) -> str:
    """`WITH` clause defining the named views for an oracle query."""
    known = {"matches": MATCHES, "quotes": QUOTES, "live_polls": LIVE_POLLS}
    return ", ".join(f"{n} AS ({duckdb_sql(known[n])})" for n in names)
