"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, target: str, usable: Column, rows: int, longest: int, salt: int = 0) -> DataFrame:
    """At most `rows` labelled documents of at most `longest` characters: `doc_id`, `text`, `y`.

    `usable` is a condition on `labels`. The choice follows a hash of the id, so it doesn't
    depend on order or partitions. Ids that recur count once, with their highest label and
    smallest text.
    """
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col(target).cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64(F.lit(salt), "__id"), "__id").limit(rows)
    # At most `rows` ids are sent to the tasks.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest)
    found = found.join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
