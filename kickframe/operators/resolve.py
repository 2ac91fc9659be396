"""Canonical team names: exact and alias resolution, review, cross-checks.

Names are resolved once per distinct spelling and joined back, so a spelling
that fills a third of the table is still one row in the resolution itself.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kickframe.operators.odds import containing_names
from kickframe.operators.windows import hot_keys, over_recent
from kickframe.params import SUGGESTION_COUNT, SUGGESTION_CUTOFF

APPROVED, PENDING = "approved", "pending"


def name_key(name: str | Column) -> Column:
    col = F.col(name) if isinstance(name, str) else name
    return F.lower(F.trim(col))


def registry_of(matches: DataFrame) -> DataFrame:
    """Distinct (league_code, team) of both sides."""
    sides = F.array(
        F.struct(F.col("home_league").alias("league_code"), F.col("home_team").alias("team")),
        F.struct(F.col("away_league").alias("league_code"), F.col("away_team").alias("team")),
    )
    return matches.select(F.explode(sides).alias("s")).select("s.*").distinct()


def candidates_by_league(registry: DataFrame) -> DataFrame:
    """Candidate teams when a name is searched in its own league."""
    return registry.select(F.col("league_code").alias("search"), "team")


def candidates_by_country(registry: DataFrame, countries: DataFrame) -> DataFrame:
    """Candidate teams of a country: all teams of its tracked leagues."""
    return registry.join(countries, "league_code").select(F.col("country").alias("search"), "team").distinct()


def resolve_exact(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds `canonical` where the folded spelling equals a candidate's.

    `names` carry raw_name and search; several equal candidates give the first
    in name order.
    """
    keyed = candidates.groupBy("search", name_key("team").alias("_key")).agg(F.min("team").alias("canonical"))
    return names.withColumn("_key", name_key("raw_name")).join(keyed, ["search", "_key"], "left").drop("_key")


def resolve_alias(names: DataFrame, candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds `canonical` from the approved alias of the first scope that has one.

    `names` carry an array `scopes` in priority order. The chosen alias counts
    only if its target is a candidate; a stale one is not replaced by a later
    scope.
    """
    # One target per scope and spelling; where two rows fold alike the last name wins.
    approved = aliases.where(F.col("status") == APPROVED).groupBy(
        F.col("league_code").alias("_scope"), name_key("raw_name").alias("_key")
    ).agg(F.max("canonical_name").alias("_target"))
    distinct = names.select("raw_name", "search", "scopes").distinct()
    looked_up = (
        distinct.select("*", F.posexplode("scopes").alias("_rank", "_scope"))
        .withColumn("_key", name_key("raw_name")).join(approved, ["_scope", "_key"])
        .groupBy("raw_name", "search", "scopes").agg(F.min_by("_target", "_rank").alias("team"))
        .join(candidates, ["search", "team"], "left_semi")
        .withColumnRenamed("team", "canonical")
    )
    return names.join(looked_up, ["raw_name", "search", "scopes"], "left")


def resolve_names(names: DataFrame, candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """`canonical` and `status` (exact, alias, unresolved) per distinct name."""
    distinct = names.select("raw_name", "search", "scopes").distinct()
    exact = resolve_exact(distinct, candidates).withColumnRenamed("canonical", "_exact")
    both = resolve_alias(exact, candidates, aliases).withColumnRenamed("canonical", "_alias")
    return both.select(
        "raw_name", "search", "scopes",
        F.coalesce("_exact", "_alias").alias("canonical"),
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alias").isNotNull(), "alias")
        .otherwise("unresolved").alias("status"),
    )


def _letters(name: Column) -> Column:
    """The letters of a name as distinct elements: the letter and how often it came before in the sorted name."""
    chars = F.array_sort(F.split(name, ""))
    return F.transform(chars, lambda c, i: F.concat(c, (i + 1 - F.array_position(chars, c)).cast("string")))


def _by_rarity(names: DataFrame, column: str, counts: DataFrame, cutoff: float) -> DataFrame:
    """Adds `letters`, rarest of the scope first, and `head`: one of them is in every name that is close enough.

    A ratio of `cutoff` takes cutoff * (own + other) / 2 common letters and the other name has at least
    that many, so cutoff / (2 - cutoff) of the own letters must be shared.
    """
    one = names.select("search", column, F.explode(_letters(F.col(column))).alias("letter"))
    lists = one.join(counts, ["search", "letter"]).groupBy("search", column).agg(
        F.sort_array(F.collect_list(F.struct("n", "letter"))).alias("_l"))  # a name's own letters
    shared = F.ceil(F.size("letters") * F.lit(cutoff / (2 - cutoff)) - F.lit(1e-9))
    return lists.select("search", column, F.col("_l.letter").alias("letters")).withColumn(
        "head", F.slice("letters", 1, (F.size("letters") - F.greatest(shared, F.lit(1)) + 1).cast("int")))


@F.pandas_udf(DoubleType())
def _block_ratio(hit: pd.Series, key: pd.Series) -> pd.Series:
    """Twice the letters in longest matching blocks over the letters of both names."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(hit, key)], dtype="float64")


def suggest_names(unresolved: DataFrame, candidates: DataFrame,
                  count: int = SUGGESTION_COUNT, cutoff: float = SUGGESTION_CUTOFF) -> DataFrame:
    """Close candidate spellings of each unresolved name; advisory only.

    The score is the ratio of longest matching blocks; the closest `count` from `cutoff` (above 0) on
    are ranked, ties by the later folded name. Pairs are met on their rarest letters, tested by common
    letters, and only what can reach the cutoff is scored; no pair above it is lost. Of candidates
    that fold alike the last name stands for all. Null and blank names and candidates give no rows.
    """
    names = unresolved.select("raw_name", "search", name_key("raw_name").alias("key")).where("key <> ''").distinct()
    teams = candidates.groupBy("search", name_key("team").alias("hit")).agg(F.max("team").alias("team")).where("hit <> ''")
    asked = names.select("search", "key").distinct()
    counts = (asked.withColumnRenamed("key", "name").unionByName(teams.select("search", F.col("hit").alias("name")))
              .select("search", F.explode(_letters(F.col("name"))).alias("letter")).groupBy("search", "letter").agg(F.count("*").alias("n")))
    left, right = _by_rarity(asked, "key", counts, cutoff), _by_rarity(teams, "hit", counts, cutoff)
    met = left.withColumn("at", F.explode("head")).join(
        right.select("search", "hit", F.col("letters").alias("_letters"), F.col("head").alias("_head"), F.explode("head").alias("at")),
        ["search", "at"])
    # A pair counts where its heads meet first, so it comes once.
    met = met.where(F.element_at(F.array_intersect("head", "_head"), 1) == F.col("at"))
    both = F.size("letters") + F.size("_letters")
    able = met.where(F.lit(2.0) * F.size(F.array_intersect("letters", "_letters")) / both >= cutoff).select("search", "key", "hit")
    scored = able.withColumn("score", _block_ratio("hit", "key")).where(F.col("score") >= cutoff)
    best = Window.partitionBy("search", "key").orderBy(F.col("score").desc(), F.col("hit").desc())
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)
    return names.join(ranked, ["search", "key"]).join(teams, ["search", "hit"]).select(
        "raw_name", "search", "rank", F.col("team").alias("suggestion"), "score")


def resolve_fixtures(fixtures: DataFrame, candidates: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fixtures with both sides resolved, queue of unresolved spellings).

    Fixtures carry raw_home, raw_away, search and scopes.
    """
    sides = fixtures.select("search", "scopes", F.explode(F.array("raw_home", "raw_away")).alias("raw_name"))
    found = resolve_names(sides, candidates, aliases)
    def side(prefix: str) -> DataFrame:
        return found.select(
            F.col("raw_name").alias(f"raw_{prefix}"), "search", "scopes",
            F.col("canonical").alias(f"{prefix}_team"))
    resolved = (
        fixtures.join(side("home"), ["raw_home", "search", "scopes"])
        .join(side("away"), ["raw_away", "search", "scopes"])
        .where(F.col("home_team").isNotNull() & F.col("away_team").isNotNull())
    )
    queue = found.where(F.col("status") == "unresolved").select(
        F.get("scopes", 0).alias("scope"), "raw_name"
    ).distinct()
    return resolved, queue


def corpus_names(corpus: DataFrame) -> DataFrame:
    """Every distinct spelling once, with the country and competition it came with first.

    Home sides are scanned before away sides, each in (date, id) order.
    """
    def side(prefix: str, pos: int) -> Column:
        return F.struct(F.trim(f"raw_{prefix}").alias("raw_name"), F.col(f"{prefix}_country").alias("country"),
                        F.lit(pos).alias("pos"))
    rows = corpus.select("match_date", "match_id", F.col("league_code").alias("competition"),
                         F.explode(F.array(side("home", 0), side("away", 1))).alias("s"))
    rows = rows.select("s.*", "match_date", "match_id", "competition").where(F.col("raw_name") != "")
    first = F.min(F.struct("pos", "match_date", "match_id", "country", "competition"))
    return rows.groupBy("raw_name").agg(first.alias("f"), F.count(F.lit(1)).alias("appearances")).select(
        "raw_name", "f.country", "f.competition", "appearances")


def name_review(names: DataFrame, registry: DataFrame, countries: DataFrame, aliases: DataFrame,
                scope: str = "EU") -> DataFrame:
    """Resolved, reviewable (country tracked) or untrackable per spelling."""
    scoped = F.when(F.col("country").isNull(), F.lit(scope)).otherwise(F.concat(F.lit(f"{scope}-"), "country"))
    asked = names.withColumns({"search": F.coalesce("country", F.lit("")), "scopes": F.array(scoped)})
    candidates = candidates_by_country(registry, countries)
    found = resolve_names(asked, candidates, aliases)
    tracked = countries.select(F.col("country").alias("search"), F.lit(True).alias("_tracked")).distinct()
    return (
        asked.join(found, ["raw_name", "search", "scopes"]).join(tracked, "search", "left")
        .withColumn("bucket", F.when(F.col("canonical").isNotNull(), "resolved")
                    .when(F.col("_tracked"), "reviewable").otherwise("untrackable"))
        .select("raw_name", "country", "competition", "appearances", "canonical", "status", "bucket")
    )


def translate_corpus(corpus: DataFrame, review: DataFrame) -> DataFrame:
    """Corpus rows with names replaced by canonical keys where there is one."""
    mapping = review.where(F.col("canonical").isNotNull()).select("raw_name", "canonical")
    out = corpus
    for prefix in ("home", "away"):
        side = mapping.select(F.col("raw_name").alias("_raw"), F.col("canonical").alias("_canonical"))
        out = (
            out.join(side, F.trim(F.col(f"raw_{prefix}")) == F.col("_raw"), "left")
            .withColumn(f"{prefix}_name", F.coalesce("_canonical", f"raw_{prefix}")).drop("_raw", "_canonical")
        )
    return out


def translate_report(review: DataFrame) -> DataFrame:
    """One row: names translated, left alone, linkable, and appearances lost."""
    return review.agg(
        F.count_if(F.col("bucket") == "resolved").alias("translated"),
        F.count_if(F.col("bucket") != "resolved").alias("untranslated"),
        F.count_if(F.col("bucket") == "reviewable").alias("linkable"),
        F.coalesce(F.sum(F.when(F.col("bucket") == "reviewable", F.col("appearances"))), F.lit(0))
        .alias("unlinked_appearances"),
    )


def team_registry(team_seasons: DataFrame, newest_only: bool) -> DataFrame:
    """Sorted distinct teams per league, of the newest season or of all.

    `team_seasons` carry league_code, season and team; duplicates are removed
    before the list of a league is gathered.
    """
    distinct = team_seasons.where(F.trim("team") != "").distinct()
    if newest_only:
        newest = distinct.groupBy("league_code").agg(F.max("season").alias("season"))
        distinct = distinct.join(newest, ["league_code", "season"], "left_semi")
    return distinct.groupBy("league_code").agg(
        F.array_join(F.sort_array(F.collect_set("team")), ",").alias("teams"),
        F.count_distinct("team").alias("n"),
    )


def alias_upsert(existing: DataFrame, pending: DataFrame, approved: DataFrame, revoked: DataFrame) -> DataFrame:
    """Alias table after approvals, new pending names and revocations.

    An approval replaces any row; a pending name never replaces one.
    """
    cols = ["league_code", "raw_name", "canonical_name", "status"]
    ranked = (
        approved.select("league_code", "raw_name", "canonical_name", F.lit(APPROVED).alias("status"), F.lit(0).alias("_p"))
        .unionByName(existing.select(*cols, F.lit(1).alias("_p")))
        .unionByName(pending.select("league_code", "raw_name", F.lit(None).cast("string").alias("canonical_name"),
                                    F.lit(PENDING).alias("status"), F.lit(2).alias("_p")))
    )
    best = ranked.groupBy("league_code", "raw_name").agg(
        F.min(F.struct("_p", "canonical_name", "status")).alias("b"))
    merged = best.select("league_code", "raw_name", "b.canonical_name", "b.status")
    return merged.join(revoked.select("league_code", "raw_name"), ["league_code", "raw_name"], "left_anti")


def alias_merge_report(seed: DataFrame, incoming: DataFrame) -> DataFrame:
    """Added, updated and unchanged entries when `incoming` is written in order.

    Both carry scope, raw_name, canonical_name; incoming also `position`.
    """
    clean = incoming.withColumns({c: F.trim(c) for c in ("scope", "raw_name", "canonical_name")})
    clean = clean.where((F.col("scope") != "") & (F.col("raw_name") != "") & (F.col("canonical_name") != ""))
    key = ["scope", "raw_name"]
    ordered = over_recent(
        clean, key, ["position"], 1, {"_before": lambda w: F.lag("canonical_name").over(w)},
        hot_keys(clean, key), piece=F.shiftright("position", 20))
    old = seed.select("scope", "raw_name", F.col("canonical_name").alias("_seed"))
    compared = (
        ordered.join(old, key, "left")
        .withColumn("_prev", F.coalesce("_before", "_seed"))
    )
    total = seed.select("scope", "raw_name").union(clean.select("scope", "raw_name")).distinct()
    return compared.agg(
        F.count_if(F.col("_prev").isNull()).alias("added"),
        F.count_if(F.col("_prev") != F.col("canonical_name")).alias("updated"),
        F.count_if(F.col("_prev") == F.col("canonical_name")).alias("unchanged"),
    ).withColumn("total", total.agg(F.count(F.lit(1))).scalar())


def display_names(df: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    """Human-facing label of a canonical key, the key itself when there is none."""
    named = labels.select(F.col("canonical").alias(column), F.col("label").alias("_label"))
    return df.join(named, column, "left").withColumn(out, F.coalesce("_label", column)).drop("_label")


def loose_key(name: str) -> Column:
    return F.regexp_replace(F.lower(F.col(name)), r"[^\p{L}\p{N}]", "")


def cross_source_check(corpus: DataFrame, other: DataFrame, min_overlap: int = 5) -> DataFrame:
    """Compare the scores of two sources that spell clubs differently.

    A row is paired on its own date, else the day before, else the day after,
    and only where exactly one fixture of that day fits. `verdict` is same,
    extra_time (expected) or differs; unpaired rows are left out.
    """
    left = corpus.select("match_id", "match_date", F.col("league_code").alias("scope"), "fthg", "ftag",
                         loose_key("home_team").alias("lh"), loose_key("away_team").alias("la"))
    theirs = other.select(
        F.col("league_code").alias("scope"), F.col("match_date").alias("day"),
        loose_key("home_team").alias("rh"), loose_key("away_team").alias("ra"), "home_goals", "away_goals", "extra_time")
    right = theirs.groupBy("scope", "day", "rh", "ra").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("home_goals", "away_goals", "extra_time")).alias("api"))
    # Names are paired, then the teams that meet in both sources; rows are joined with what both sides are called once.
    meeting = left.select("scope", "lh", "la").distinct()
    pairs = containing_names(
        meeting.select("scope", F.explode(F.array("lh", "la")).alias("l")),
        theirs.select("scope", F.explode(F.array("rh", "ra")).alias("r")),
    ).where((F.col("l") == F.col("r")) | (F.least(F.length("l"), F.length("r")) >= min_overlap))
    # Fixed search order: same day, day before, day after.
    offsets = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(d).alias("shift")) for i, d in enumerate((0, -1, 1))])
    called = (
        meeting.join(pairs.select("scope", F.col("l").alias("lh"), F.col("r").alias("rh")), ["scope", "lh"])
        .join(pairs.select("scope", F.col("l").alias("la"), F.col("r").alias("ra")), ["scope", "la"])
        .join(theirs.select("scope", "rh", "ra").distinct(), ["scope", "rh", "ra"], "left_semi")
    )
    hits = (
        left.join(called, ["scope", "lh", "la"])
        .select("*", F.explode(offsets).alias("o"))
        .withColumn("day", F.date_add("match_date", F.col("o.shift")))
        .join(right, ["scope", "day", "rh", "ra"])
    )
    unique = (
        hits.groupBy("match_id", F.col("o.rank").alias("rank"))
        .agg(F.sum("n").alias("n"), F.min("api").alias("api"), F.min(F.struct("fthg", "ftag")).alias("own"))
        .where(F.col("n") == 1)
    )
    found = unique.groupBy("match_id").agg(F.min(F.struct("rank", "api", "own")).alias("f"))
    same = (F.col("f.api.home_goals") == F.col("f.own.fthg")) & (F.col("f.api.away_goals") == F.col("f.own.ftag"))
    return found.select(
        "match_id", F.col("f.rank").alias("rank"),
        F.when(same, "same").when(F.col("f.api.extra_time"), "extra_time").otherwise("differs").alias("verdict"))
