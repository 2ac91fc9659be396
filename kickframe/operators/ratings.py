"""Elo ratings over pools of linked leagues.

A rating walk is sequential inside a pool. Pools run side by side, each as a
sorted stream of matches, so a task holds a batch and one pool's ratings. A pool
too large for one task is cut into eras by day, which are walked one after the
other: an era starts from the ratings the era before it ended with, so every
match is walked once and a task reads an era at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kickframe import params
from kickframe.functions.probability import elo_expectation, from_expected_score
from kickframe.params import CROSS, ELO, EloParams
from kickframe.session import cut, scratch_path, shuffles_freed

INPUT = ["pool", "source", "match_id", "match_date", "home_team", "away_team", "fthg", "ftag", "home_adv"]
TYPES = {"pool": "string", "source": "string", "match_id": "bigint", "home_team": "string", "away_team": "string",
         "fthg": "double", "ftag": "double", "home_adv": "double"}
MATCH_COLUMNS = ["pool", "source", "match_id", "elo_home", "elo_away", "elo_expected_home", "post_home", "post_away"]
END_COLUMNS = ["pool", "team", "rating"]
#: A row is a match or, marked by `ended`, the rating that a team ends with.
WALK_SCHEMA = (
    "pool string, source string, match_id bigint, elo_home double, elo_away double, "
    "elo_expected_home double, post_home double, post_away double, team string, rating double, ended boolean"
)


def _walker(p: EloParams, played: bool, ends: bool, only: str | None = None):
    """The walk over batches sorted by pool, starting ratings first and then matches in order."""
    schema = pa.schema([(c, pa.string() if c in ("pool", "source", "team") else pa.int64() if c == "match_id" else pa.bool_() if c == "ended" else pa.float64())
                        for c in [*MATCH_COLUMNS, "team", "rating", "ended"]])

    def matches(rows: pa.RecordBatch, values: list[np.ndarray]) -> pa.RecordBatch:
        if only is not None:
            wanted = pc.fill_null(pc.equal(rows.column("source"), only), False)
            rows, values = rows.filter(wanted), [v[wanted.to_numpy(zero_copy_only=False)] for v in values]
        n = rows.num_rows
        return pa.RecordBatch.from_arrays(
            [rows.column("pool"), rows.column("source"), rows.column("match_id"), *[pa.array(v, from_pandas=True) for v in values],
             pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.array(np.zeros(n, bool))], schema=schema)

    def ended(pool: str | None, rating: dict) -> pa.RecordBatch:
        n = len(rating)
        return pa.RecordBatch.from_arrays(
            [pa.array([pool] * n, pa.string()), *[pa.nulls(n, field.type) for field in list(schema)[1:8]],
             pa.array(list(rating), pa.string()), pa.array(list(rating.values()), pa.float64(), from_pandas=True), pa.array(np.ones(n, bool))], schema=schema)

    def names(column: pa.Array) -> list:
        """The names, each distinct one made once."""
        coded = column.dictionary_encode(null_encoding="encode")
        known = coded.dictionary.to_pylist()
        return [known[i] for i in coded.indices.to_numpy().tolist()]

    def moves(hg: np.ndarray, ag: np.ndarray) -> tuple[list, list]:
        """The step at full surprise, None without a score, and the home side's share of the points."""
        gap = hg - ag
        margins = {g: 1.0 if g == 0 else math.log(g + 1) for g in np.unique(np.abs(gap)).tolist()}
        given = (~np.isnan(hg) & ~np.isnan(ag)).tolist()
        size = [p.k_factor * margins.get(g, math.nan) if known else None for g, known in zip(np.abs(gap).tolist(), given)]
        return size, np.where(gap > 0, 1.0, np.where(gap < 0, 0.0, 0.5)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rating, pool, begun, initial = {}, None, False, p.initial_rating
        for batch in batches:
            before_home, before_away, expectation, after_home, after_away, done = [], [], [], [], [], []
            goals = batch.column("fthg").to_numpy(zero_copy_only=False)
            size, share = moves(goals, batch.column("ftag").to_numpy(zero_copy_only=False))
            plain = ("start", "home_adv")
            for name, home, away, start, adv, hg, full, scored in zip(
                    *[names(batch.column(c)) for c in ("pool", "home_team", "away_team")],
                    *[batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in plain], goals.tolist(), size, share):
                if name != pool or not begun:
                    if begun:
                        done.append((pool, rating))
                    rating, pool, begun = {}, name, True
                if start:
                    rating[home] = hg
                    continue
                rh, ra = rating.get(home, initial), rating.get(away, initial)
                expected = 1.0 / (1.0 + 10.0 ** ((ra - (rh + adv)) / 400.0))
                nh, na = rh, ra
                if full is not None:
                    step = full * (scored - expected)
                    nh, na = rh + step, ra - step
                rating[home], rating[away] = nh, na
                if played:
                    before_home.append(rh)
                    before_away.append(ra)
                    expectation.append(expected)
                    after_home.append(nh)
                    after_away.append(na)
            if before_home:
                yield matches(batch.filter(pc.invert(batch.column("start"))),
                              [np.array(v, np.float64) for v in (before_home, before_away, expectation, after_home, after_away)])
            if ends:
                yield from (ended(*one) for one in done)
        if ends and begun:
            yield ended(pool, rating)

    return run


def _run(rows: DataFrame, starts: DataFrame | None, p: EloParams, played: bool, ends: bool, only: str | None = None) -> DataFrame:
    every = rows.select(*INPUT, F.lit(False).alias("start"))
    if starts is not None:
        given = {"pool": F.col("pool"), "home_team": F.col("team"), "fthg": F.col("rating")}
        types = dict(rows.dtypes)
        every = every.unionByName(starts.select(
            *[given.get(c, F.lit(None)).cast(types[c]).alias(c) for c in INPUT], F.lit(True).alias("start")))
    order = [F.col("pool"), F.col("start").desc(), *[F.col(c).asc_nulls_last() for c in ("match_date", "source", "match_id")]]
    return every.repartition("pool").sortWithinPartitions(*order).mapInArrow(_walker(p, played, ends, only), WALK_SCHEMA)


def _with_eras(rows: DataFrame, era_rows: int) -> tuple[DataFrame, int]:
    """Number the eras of each pool; (frame, highest era).

    Boundaries fall between days and come from per-day counts, so the only
    window runs over a pool's days. More than one era are kept in a folder each.
    """
    days = rows.groupBy("pool", "match_date").agg(F.count(F.lit(1)).alias("_n"))
    largest = days.groupBy("pool").agg(F.sum("_n").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= era_rows:
        return rows, 0
    before = Window.partitionBy("pool").orderBy(F.col("match_date").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    numbered = days.select("pool", "match_date", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / era_rows).cast("int").alias("era"))
    # A pool has a bound per era but the first, so the table is far smaller than its days.
    bounds = numbered.groupBy("pool", "era").agg(F.min("match_date").alias("_day")).where("era > 0").groupBy(
        F.col("pool").alias("_pool")).agg(F.collect_list("_day").alias("_bounds"))
    passed = F.size(F.filter("_bounds", lambda day: F.col("match_date").isNull() | (day <= F.col("match_date"))))
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "eras")
    out = rows.join(F.broadcast(bounds), F.col("pool").eqNullSafe(F.col("_pool")), "left").withColumn(
        "era", F.coalesce(F.greatest(passed, F.lit(0)), F.lit(0))).drop("_pool", "_bounds")
    with shuffles_freed(spark):
        out.hint("rebalance", "era").write.partitionBy("era").parquet(path)
    # Folders give the column that is not in the files.
    out = spark.read.schema(out.schema).parquet(path)
    return out, out.agg(F.max("era")).first()[0]


def _walk(matches: DataFrame, p: EloParams, era_rows: int, played: bool, only: str | None = None) -> DataFrame:
    """Every match walked (`played`), or the rating each team ends with; `only` names the source whose matches are given back."""
    rows, last = _with_eras(_prepare(matches, p), era_rows)
    if last == 0:
        return _run(rows, None, p, played=played, ends=not played, only=only)
    spark, path, starts = rows.sparkSession, scratch_path(rows.sparkSession, "walked"), None
    for era in range(last + 1):
        part = f"{path}/era={era}"
        with shuffles_freed(spark):
            _run(rows.where(F.col("era") == era), starts, p, played=played, ends=True, only=only).write.parquet(part)
        ended = spark.read.schema(WALK_SCHEMA).parquet(part).where("ended")
        starts = ended.select(*END_COLUMNS)
    return spark.read.schema(WALK_SCHEMA).parquet(path).where("NOT ended") if played else ended


def _prepare(matches: DataFrame, p: EloParams) -> DataFrame:
    cols = matches.columns
    out = matches if "pool" in cols else matches.withColumn("pool", F.col("league_code"))
    if "source" not in cols:
        out = out.withColumn("source", F.lit(""))
    if "home_adv" not in cols:
        out = out.withColumn("home_adv", F.lit(p.home_advantage))
    return out.select(*[F.col(c).cast(TYPES[c]) if c in TYPES else F.col(c) for c in INPUT])


def elo_walk(matches: DataFrame, p: EloParams = ELO, era_rows: int = params.ERA_ROWS, only: str | None = None) -> DataFrame:
    """Pre- and post-match ratings and the home expectation of every match.

    Rows without a score get ratings but move none. With `only` all matches are
    walked and those of that source are returned.
    """
    return _walk(matches, p, era_rows, played=True, only=only).select(*MATCH_COLUMNS).withColumns({
        "elo_diff": F.col("elo_home") - F.col("elo_away"),
        "elo_expected_away": F.lit(1.0) - F.col("elo_expected_home"),
    })


def elo_final(matches: DataFrame, p: EloParams = ELO, era_rows: int = params.ERA_ROWS) -> DataFrame:
    """Rating of each team after its last match: (pool, team, rating)."""
    return _walk(matches, p, era_rows, played=False).select(*END_COLUMNS)


def top_rated(ratings: DataFrame, n: int = 10) -> DataFrame:
    return ratings.orderBy(F.col("rating").desc(), "team").limit(n)


def neutral_advantage(neutral: Column, p: EloParams = ELO) -> Column:
    """Home advantage of a match, scaled down on a neutral ground."""
    return F.when(neutral, F.lit(p.home_advantage * p.neutral_factor)).otherwise(
        F.lit(p.home_advantage)
    )


def shared_walk(domestic: DataFrame, supplementary: DataFrame, p: EloParams = ELO,
                era_rows: int = params.ERA_ROWS, only: str | None = None) -> DataFrame:
    """One walk over both corpora; `source` tells the outputs apart, as ids may overlap.

    On one day domestic rows come first. Supplementary rows need both teams and both goals.
    `only` names the source whose rows are returned; rows of both move the ratings.
    """
    return elo_walk(both_corpora(domestic, supplementary), p, era_rows, only)


def both_corpora(domestic: DataFrame, supplementary: DataFrame) -> DataFrame:
    """The rows of both corpora with their `source` and the pool of linked leagues they belong to.

    Without the leagues of both sides there is one pool.
    """
    cols = ["match_id", "match_date", "home_team", "away_team", "fthg", "ftag"]
    sides = ["home_league", "away_league"]
    known = all(c in df.columns for df in (domestic, supplementary) for c in sides)
    keep = [*cols, *sides] if known else cols
    both = domestic.select(*keep, F.lit("domestic").alias("source")).unionByName(
        supplementary.na.drop(subset=cols[2:]).select(*keep, F.lit("supplementary").alias("source")))
    if not known:
        return both.withColumn("pool", F.lit("all"))
    pools = rating_pools(both.select(F.col("home_league").alias("league_a"), F.col("away_league").alias("league_b")))
    # A row per league.
    out = both.join(F.broadcast(pools.withColumnRenamed("league", "home_league")), "home_league", "left")
    return out.withColumn("pool", F.coalesce("pool", F.lit("none")))


def rating_pools(links: DataFrame) -> DataFrame:
    """Connected components of leagues: (league, pool), pool = smallest member.

    `links` holds (league_a, league_b); it is reduced to distinct leagues and
    pairs first, so each round joins tables the size of the league list.
    """
    pairs = links.where(F.col("league_a").isNotNull() & F.col("league_b").isNotNull())
    pairs = pairs.select(F.least("league_a", "league_b").alias("a"), F.greatest("league_a", "league_b").alias("b"))
    edges = pairs.distinct()
    edges = cut(edges.union(edges.select("b", "a")).distinct())
    labels = edges.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("league"), F.least("a", "m").alias("pool")
    )
    labels = cut(labels)
    while True:
        near = edges.join(labels, edges.b == labels.league).groupBy("a").agg(F.min("pool").alias("near"))
        hop = labels.select(F.col("league").alias("_l"), F.col("pool").alias("hop"))
        stepped = labels.join(near, labels.league == near.a, "left").join(hop, labels.pool == hop._l, "left")
        fresh = cut(stepped.select("league", F.least("pool", "near", "hop").alias("pool"), F.col("pool").alias("old")))
        labels = fresh.select("league", "pool")
        if fresh.where(F.col("pool") != F.col("old")).isEmpty():
            return labels


def league_of_team(matches: DataFrame) -> DataFrame:
    """The league each team last played in."""
    sides = matches.select(
        "match_date", "match_id", "league_code", F.explode(F.array("home_team", "away_team")).alias("team")
    )
    return sides.groupBy("team").agg(
        F.max_by("league_code", F.struct("match_date", "match_id")).alias("league_code")
    )


def league_strata(ratings: DataFrame, leagues: DataFrame, initial: float = ELO.initial_rating) -> DataFrame:
    """Mean, maximum and count of ratings per league, with the overall spread.

    `pinned` counts leagues whose mean never left the starting value.
    """
    per_league = (
        ratings.join(leagues, "team").groupBy("league_code")
        .agg(F.avg("rating").alias("mean_rating"), F.max("rating").alias("max_rating"),
             F.count(F.lit(1)).alias("teams"))
    )
    overall = per_league.agg(F.struct(
        (F.max("mean_rating") - F.min("mean_rating")).alias("spread"),
        F.count_if(F.round("mean_rating", 1) == initial).alias("pinned"),
    )).scalar()
    return per_league.withColumn("_o", overall).select("*", "_o.spread", "_o.pinned").drop("_o")


def elo_to_1x2(expected_home: Column, draw_rate: float = CROSS.draw_rate):
    return from_expected_score(expected_home, draw_rate)


def expectation_between(home: Column, away: Column, p: EloParams = ELO) -> Column:
    return elo_expectation(home, away, p.home_advantage)
