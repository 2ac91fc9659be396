"""Shared helpers for registering queries and writing their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kickframe.sources.synthetic import oracle_prefix

DIGITS = 6
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)


def tidy(df: DataFrame, *columns: str) -> DataFrame:
    """Plain result types: bigint, double rounded to six places, string."""
    picked = []
    for field in df.schema.fields if not columns else [df.schema[c] for c in columns]:
        col = F.col(field.name)
        if isinstance(field.dataType, INTEGERS):
            col = col.cast("bigint")
        elif isinstance(field.dataType, T.DoubleType):
            # Adding 0.0 turns a rounded -0.0 into 0.0.
            col = F.round(col, DIGITS) + F.lit(0.0)
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            col = col.cast("string")
        picked.append(col.alias(field.name))
    return df.select(*picked)


def r(*columns: str) -> str:
    """Rounded columns for an oracle's select list."""
    return ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in columns)


def big(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


def text(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)


def sql(body: str, *views: str, recursive: bool = False, ctes: str = "") -> str:
    """An oracle: view definitions, further CTEs, then the body."""
    parts = [p for p in (oracle_prefix(*views), ctes) if p]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ", ".join(parts) + " " if parts else "") + body
