"""Connected components of an undirected graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.session import stage


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"),
                    F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row.n, int(row.h)


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """`node`, `component` of every node with an edge; the component is its smallest node.

    Alternates large-star and small-star steps until the edges stop changing. Both
    steps are a minimum per node, combined before the shuffle, and a join that the
    optimiser may split, so a hub with very many neighbours is never gathered. Each
    round is a table in the shared folder. Loops and rows with a null end are ignored;
    no edges give no rows.
    """
    a, b = F.col(src), F.col(dst)
    now = stage(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _signature(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _signature(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
