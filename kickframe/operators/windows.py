"""Window evaluation that does not hand one hot key to one task.

A team, pair or league may own a large share of all rows. Look-back windows are
therefore evaluated per (key, day) for hot keys, each day primed with the last
rows of the days before it; ordinary keys keep the plain single-shuffle plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kickframe import params


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = params.HOT_KEY_ROWS) -> DataFrame | None:
    """Keys with too many rows for one task, or None when there is none.

    The count reads only the key columns and combines map-side.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > min_rows).select(*keys)
    return None if hot.isEmpty() else hot


def over_recent(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int,
    exprs: dict[str, Callable[[WindowSpec], Column]],
    hot: DataFrame | None = None,
    piece: Column | None = None,
) -> DataFrame:
    """Add window columns that look back at most `lookback` rows per key.

    `order` must be a total order within a key. Hot keys are split by `piece`, a
    number that never falls along that order; the day by default.
    """
    if hot is None:
        spec = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: make(spec) for name, make in exprs.items()})

    marked = df.join(hot.withColumn("_hot", F.lit(True)), list(keys), "left")
    chunked = marked.withColumn(
        "_chunk", F.when(F.col("_hot"), F.unix_date("match_date") if piece is None else piece)
    ).drop("_hot")
    columns = chunked.columns
    halo = _halo(chunked.where(F.col("_chunk").isNotNull()), keys, order, lookback, columns)
    primed = chunked.withColumn("_halo", F.lit(False)).unionByName(
        halo.withColumn("_halo", F.lit(True))
    )
    spec = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    out = primed.withColumns({name: make(spec) for name, make in exprs.items()})
    return out.where(~F.col("_halo")).drop("_halo", "_chunk")


def _halo(
    chunked: DataFrame, keys: Sequence[str], order: Sequence[str], lookback: int, columns: list[str]
) -> DataFrame:
    """For each (key, day): the last `lookback` rows of that key's earlier days.

    Only `lookback` rows survive per (key, day), so the window over a key's days
    holds at most days x lookback rows however hot the key is.
    """
    newest_first = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(c).desc() for c in order])
    rest = [c for c in columns if c not in order]
    tails = (
        chunked.withColumn("_rn", F.row_number().over(newest_first))
        .where(F.col("_rn") <= lookback)
        .groupBy(*keys, "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("_tail"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-lookback, -1)
    gathered = F.flatten(F.collect_list("_tail").over(earlier))
    return (
        tails.select(*keys, F.col("_chunk"), gathered.alias("_all"))
        .select("_chunk", F.explode(last_n("_all", lookback)).alias("_row"))
        .select(*[F.col("_chunk") if c == "_chunk" else F.col(f"_row.{c}") for c in columns])
    )


def last_n(array: str | Column, n: int) -> Column:
    """The last n elements of an array (all of them when shorter)."""
    col = F.col(array) if isinstance(array, str) else array
    return F.slice(col, F.greatest(F.size(col) - (n - 1), F.lit(1)), F.lit(n))


def chronological_index(
    df: DataFrame, date: str = "match_date", row_id: str = "match_id", out: str = "idx"
) -> DataFrame:
    """0-based position in (date, id) order without a global single-task sort.

    Offsets come from per-day counts, then from counts per id block within a
    day; only the last step ranks rows, inside one (day, block).
    """
    block = F.shiftright(F.col(row_id), 20)
    blocks = df.groupBy(date, block.alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    in_day = Window.partitionBy(date).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    days = blocks.groupBy(date).agg(F.sum("_n").alias("_n"))
    # One row per calendar day: the only unpartitioned window, bounded by dates.
    before = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    day_offset = days.select(date, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_day_off"))
    offsets = blocks.withColumn(
        "_block_off", F.coalesce(F.sum("_n").over(in_day), F.lit(0))
    ).join(day_offset, date)
    ranked = df.withColumn("_block", block).withColumn(
        "_r", F.row_number().over(Window.partitionBy(date, "_block").orderBy(row_id)) - 1
    )
    return (
        ranked.join(offsets.select(date, "_block", "_block_off", "_day_off"), [date, "_block"])
        .withColumn(out, F.col("_day_off") + F.col("_block_off") + F.col("_r"))
        .drop("_block", "_block_off", "_day_off", "_r")
    )
