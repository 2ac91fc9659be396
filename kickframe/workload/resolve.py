"""Name resolution queries over raw spellings of the teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.operators import resolve as rs
from kickframe.sources.synthetic import matches
from kickframe.workload.common import sql, tidy
from kickframe.workload.odds import SPELL, spelled

TEAM_NO = "CAST(right({t}, 2) AS INT)"


def countries(m):
    """C0-C4 cover leagues L00-L09 two by two; other leagues are untracked."""
    number = F.substring("league_code", 2, 2).cast("int")
    leagues = rs.registry_of(m).select("league_code").distinct()
    return leagues.where(number < 10).withColumn(
        "country", F.concat(F.lit("C"), F.floor(number / 2).cast("string")))


def country_of(league: str):
    number = F.substring(league, 2, 2).cast("int")
    return F.when(number < 10, F.concat(F.lit("C"), F.floor(number / 2).cast("string")))


def aliases(m):
    """'FC ' spellings: approved in the league, approved in the country, stale, or pending."""
    reg = rs.registry_of(m).withColumn("no", F.substring("team", -2, 2).cast("int"))
    raw = F.concat(F.lit("FC "), F.col("team")).alias("raw_name")
    status = F.when(F.col("no") % 2 == 1, rs.PENDING).otherwise(rs.APPROVED).alias("status")
    target = F.when(F.col("no") == 4, "Ghost").when(F.col("no") % 2 == 0, F.col("team")).alias("canonical_name")
    league = reg.where(F.col("no") % 4 != 2).select("league_code", raw, target, status)
    scope = F.concat(F.lit("EU-"), country_of("league_code")).alias("league_code")
    country = reg.where((F.col("no") % 2 == 0) & country_of("league_code").isNotNull()).select(
        scope, raw, F.when(F.col("no") == 8, "Ghost").otherwise(F.col("team")).alias("canonical_name"),
        F.lit(rs.APPROVED).alias("status"))
    return league.unionByName(country)


def raw_fixtures(m):
    scopes = F.array_compact(F.array(F.col("league_code"), F.concat(F.lit("EU-"), country_of("league_code"))))
    return m.select("match_id", "match_date", "league_code", spelled("home_team").alias("raw_home"),
                    spelled("away_team").alias("raw_away"), F.col("league_code").alias("search"),
                    scopes.alias("scopes"))


def raw_names(m):
    return raw_fixtures(m).select(
        "search", "scopes", F.explode(F.array("raw_home", "raw_away")).alias("raw_name")).distinct()


def resolve_exact(spark, sf):
    m = matches(spark, sf)
    out = rs.resolve_exact(raw_names(m), rs.candidates_by_league(rs.registry_of(m)))
    return tidy(out.select(F.col("search").alias("league_code"), "raw_name", F.coalesce("canonical", F.lit("-")).alias("canonical")))


def resolve_alias(spark, sf):
    m = matches(spark, sf)
    out = rs.resolve_names(raw_names(m), rs.candidates_by_league(rs.registry_of(m)), aliases(m))
    return tidy(out.select(F.col("search").alias("league_code"), "raw_name",
                           F.coalesce("canonical", F.lit("-")).alias("canonical"), "status"))


def suggest_names(spark, sf):
    m = matches(spark, sf)
    cands = rs.candidates_by_league(rs.registry_of(m))
    open_ = rs.resolve_names(raw_names(m), cands, aliases(m)).where("status = 'unresolved'")
    return tidy(rs.suggest_names(open_, cands))


def resolve_fixtures(spark, sf):
    m = matches(spark, sf)
    ok, queue = rs.resolve_fixtures(raw_fixtures(m), rs.candidates_by_league(rs.registry_of(m)), aliases(m))
    done = ok.select(F.lit("fixture").alias("kind"), F.col("match_id").cast("string").alias("id"), "home_team", "away_team")
    todo = queue.select(F.lit("queue").alias("kind"), F.col("scope").alias("id"),
                        F.col("raw_name").alias("home_team"), F.lit("").alias("away_team"))
    return tidy(done.unionByName(todo))


def corpus(m):
    return m.select("match_id", "match_date", "league_code", spelled("home_team").alias("raw_home"),
                    spelled("away_team").alias("raw_away"), country_of("home_league").alias("home_country"),
                    country_of("away_league").alias("away_country"))


def review(m):
    return rs.name_review(rs.corpus_names(corpus(m)), rs.registry_of(m), countries(m), aliases(m))


def name_review(spark, sf):
    out = review(matches(spark, sf)).select(
        "raw_name", F.coalesce("country", F.lit("-")).alias("country"), "competition", "appearances",
        F.coalesce("canonical", F.lit("-")).alias("canonical"), "bucket")
    return tidy(out)


def translate_corpus(spark, sf):
    m = matches(spark, sf)
    return tidy(rs.translate_corpus(corpus(m), review(m)), "match_id", "home_name", "away_name")


def translate_report(spark, sf):
    return tidy(rs.translate_report(review(matches(spark, sf))))


def team_seasons(m):
    season = F.year("match_date") - F.when(F.month("match_date") < 7, 1).otherwise(0)
    return m.select("league_code", season.alias("season"), F.explode(F.array("home_team", "away_team")).alias("team"))


def team_registry(spark, sf):
    ts = team_seasons(matches(spark, sf))
    newest = rs.team_registry(ts, True).withColumn("scope", F.lit("newest"))
    return tidy(newest.unionByName(rs.team_registry(ts, False).withColumn("scope", F.lit("all"))))


def alias_upsert(spark, sf):
    m = matches(spark, sf)
    table = aliases(m)
    pending = rs.registry_of(m).select("league_code", F.concat(F.lit("FC "), F.col("team")).alias("raw_name"))
    no = F.substring("raw_name", -2, 2).cast("int")
    approved = table.where(no == 3).select("league_code", "raw_name", F.substring("raw_name", 4, 20).alias("canonical_name"))
    revoked = table.where(no == 6)
    out = rs.alias_upsert(table, pending, approved, revoked)
    return tidy(out.withColumn("canonical_name", F.coalesce("canonical_name", F.lit("-"))))


def alias_merge_report(spark, sf):
    m = matches(spark, sf)
    seed = aliases(m).where("status = 'approved'").select(F.col("league_code").alias("scope"), "raw_name", "canonical_name")
    incoming = m.select(F.col("match_id").alias("position"), F.col("league_code").alias("scope"),
                        F.concat(F.lit("FC "), F.col("home_team")).alias("raw_name"),
                        F.when(F.col("hy") == 4, " ").when(F.col("hr") == 1, F.concat("home_team", F.lit(" FC")))
                        .otherwise(F.col("home_team")).alias("canonical_name"))
    return tidy(rs.alias_merge_report(seed, incoming))


def display_names(spark, sf):
    m = matches(spark, sf)
    labels = rs.registry_of(m).where(F.substring("team", -2, 2).cast("int") % 2 == 0).select(
        F.col("team").alias("canonical"), F.concat(F.lit("Club "), "team").alias("label"))
    out = rs.display_names(m.select("match_id", "home_team", "away_team"), labels, "home_team", "home_label")
    return tidy(rs.display_names(out, labels, "away_team", "away_label"), "match_id", "home_label", "away_label")


def other_source(m):
    """The same matches as another source reports them: other spelling, day and score."""
    return m.select(
        "league_code", F.date_add("match_date", (F.pmod(F.col("hf"), F.lit(3)) - 1).cast("int")).alias("match_date"),
        spelled("home_team").alias("home_team"), spelled("away_team").alias("away_team"),
        (F.col("fthg") + F.col("hr")).alias("home_goals"), F.col("ftag").alias("away_goals"),
        (F.col("ar") == 1).alias("extra_time"))


def cross_source_check(spark, sf):
    m = matches(spark, sf)
    return tidy(rs.cross_source_check(m, other_source(m)))


QUERIES = {
    f.__name__: f
    for f in (resolve_exact, resolve_alias, suggest_names, resolve_fixtures, name_review, translate_corpus,
              translate_report, team_registry, alias_upsert, alias_merge_report, display_names, cross_source_check)
}

# --- oracles ---------------------------------------------------------------

REG = "reg AS (SELECT DISTINCT home_league AS league_code, home_team AS team FROM matches UNION SELECT DISTINCT away_league, away_team FROM matches)"
COUNTRY = "CASE WHEN CAST(substr({c}, 2, 2) AS INT) < 10 THEN 'C' || (CAST(substr({c}, 2, 2) AS INT) // 2) END"
NO = "CAST(right(team, 2) AS INT)"
ALIASES = f"""aliases AS (SELECT league_code, 'FC ' || team AS raw_name, CASE WHEN {NO} = 4 THEN 'Ghost' WHEN {NO} % 2 = 0 THEN team END AS canonical_name,
CASE WHEN {NO} % 2 = 1 THEN 'pending' ELSE 'approved' END AS status FROM reg WHERE {NO} % 4 <> 2
UNION ALL SELECT 'EU-' || {COUNTRY.format(c='league_code')}, 'FC ' || team, CASE WHEN {NO} = 8 THEN 'Ghost' ELSE team END, 'approved' FROM reg
WHERE {NO} % 2 = 0 AND {COUNTRY.format(c='league_code')} IS NOT NULL)"""
RAW = f"""raw AS (SELECT match_id, match_date, league_code, home_league, away_league, {SPELL.format(t='home_team')} AS raw_home, {SPELL.format(t='away_team')} AS raw_away FROM matches),
names AS (SELECT DISTINCT league_code, n AS raw_name, 'EU-' || {COUNTRY.format(c='league_code')} AS eu FROM (SELECT league_code, raw_home AS n FROM raw UNION ALL SELECT league_code, raw_away FROM raw) u)"""
FOUND = """found AS (SELECT n.league_code, n.raw_name, coalesce(x.team, t.team) AS canonical, CASE WHEN x.team IS NOT NULL THEN 'exact' WHEN t.team IS NOT NULL THEN 'alias' ELSE 'unresolved' END AS status
FROM names n LEFT JOIN reg x ON x.league_code = n.league_code AND lower(trim(x.team)) = lower(trim(n.raw_name))
LEFT JOIN aliases a1 ON a1.status = 'approved' AND a1.league_code = n.league_code AND lower(trim(a1.raw_name)) = lower(trim(n.raw_name))
LEFT JOIN aliases a2 ON a2.status = 'approved' AND a2.league_code = n.eu AND lower(trim(a2.raw_name)) = lower(trim(n.raw_name))
LEFT JOIN reg t ON t.league_code = n.league_code AND t.team = coalesce(a1.canonical_name, a2.canonical_name))"""
RESOLVE = f"{REG}, {ALIASES}, {RAW}, {FOUND}"
REVIEW = f"""{REG}, {ALIASES}, {RAW}, sides AS (SELECT trim(raw_home) AS raw_name, {COUNTRY.format(c='home_league')} AS country, league_code AS competition, 0 AS pos, match_date, match_id FROM raw
UNION ALL SELECT trim(raw_away), {COUNTRY.format(c='away_league')}, league_code, 1, match_date, match_id FROM raw),
cnames AS (SELECT raw_name, country, competition, n AS appearances FROM (SELECT *, row_number() OVER (PARTITION BY raw_name ORDER BY pos, match_date, match_id) AS rn, count(*) OVER (PARTITION BY raw_name) AS n FROM sides) s WHERE rn = 1),
creg AS (SELECT DISTINCT {COUNTRY.format(c='league_code')} AS country, team FROM reg WHERE {COUNTRY.format(c='league_code')} IS NOT NULL),
review AS (SELECT c.*, coalesce(x.team, t.team) AS canonical, CASE WHEN coalesce(x.team, t.team) IS NOT NULL THEN 'resolved' WHEN c.country IS NOT NULL THEN 'reviewable' ELSE 'untrackable' END AS bucket
FROM cnames c LEFT JOIN creg x ON x.country = c.country AND lower(x.team) = lower(c.raw_name)
LEFT JOIN aliases a ON a.status = 'approved' AND a.league_code = 'EU-' || c.country AND lower(a.raw_name) = lower(c.raw_name)
LEFT JOIN creg t ON t.country = c.country AND t.team = a.canonical_name)"""
SEASON = "(year(match_date) - CASE WHEN month(match_date) < 7 THEN 1 ELSE 0 END)"
TS = f"ts AS (SELECT league_code, {SEASON} AS season, home_team AS team FROM matches UNION SELECT league_code, {SEASON}, away_team FROM matches)"
CLUB = "CASE WHEN CAST(right({t}, 2) AS INT) % 2 = 0 THEN 'Club ' || {t} ELSE {t} END"
LOOSE = "regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
FITS = "({a} = {b} OR (least(length({a}), length({b})) >= 5 AND (contains({a}, {b}) OR contains({b}, {a}))))"

ORACLES = {
    "resolve_exact": sql(
        "SELECT n.league_code, n.raw_name, coalesce(r.team, '-') AS canonical FROM names n LEFT JOIN reg r ON r.league_code = n.league_code AND lower(trim(r.team)) = lower(trim(n.raw_name))",
        "matches", ctes=f"{REG}, {RAW}"),
    "resolve_alias": sql("SELECT league_code, raw_name, coalesce(canonical, '-') AS canonical, status FROM found", "matches", ctes=RESOLVE),
    # Each step cuts a stretch of both names at its longest common block (the earliest of several); all pairs of a scope are compared.
    "suggest_names": sql(
        """SELECT raw_name, search, CAST(rank AS BIGINT) AS rank, team AS suggestion, round(score, 6) AS score FROM (
SELECT raw_name, search, team, score, row_number() OVER (PARTITION BY raw_name, search ORDER BY score DESC, a DESC) AS rank
FROM asked JOIN hits USING (search) JOIN (SELECT a, b, 2.0 * sum(m) / (length(a) + length(b)) AS score FROM seg GROUP BY a, b) r USING (a, b) WHERE score >= 0.4) t WHERE rank <= 5""",
        "matches", recursive=True, ctes=RESOLVE + """, asked AS (SELECT DISTINCT raw_name, league_code AS search, lower(trim(raw_name)) AS b FROM found WHERE status = 'unresolved'),
hits AS (SELECT league_code AS search, lower(trim(team)) AS a, max(team) AS team FROM reg GROUP BY 1, 2),
seg AS (SELECT DISTINCT a, b, 0 AS a0, length(a) AS a1, 0 AS b0, length(b) AS b1, CAST(0 AS BIGINT) AS m FROM asked JOIN hits USING (search)
UNION ALL SELECT a, b, CASE side WHEN 0 THEN a0 ELSE i + k END, CASE side WHEN 0 THEN i ELSE a1 END, CASE side WHEN 0 THEN b0 ELSE j + k END, CASE side WHEN 0 THEN j ELSE b1 END, CASE side WHEN 0 THEN k ELSE 0 END
FROM (SELECT *, top.k AS k, -top.i AS i, -top.j AS j FROM (SELECT *, list_max(flatten(list_transform(range(a0, a1), lambda i: list_transform(range(b0, b1), lambda j: {
  'k': len(list_filter(range(1, least(a1 - i, b1 - j) + 1), lambda z: substr(a, i + 1, z) = substr(b, j + 1, z))), 'i': -i, 'j': -j})))) AS top
FROM seg WHERE a0 < a1 AND b0 < b1) x WHERE top.k > 0) y, (VALUES (0), (1)) v(side))"""),
    "resolve_fixtures": sql(
        """SELECT 'fixture' AS kind, CAST(match_id AS VARCHAR) AS id, h.canonical AS home_team, a.canonical AS away_team FROM raw r JOIN found h ON h.league_code = r.league_code AND h.raw_name = r.raw_home
JOIN found a ON a.league_code = r.league_code AND a.raw_name = r.raw_away WHERE h.canonical IS NOT NULL AND a.canonical IS NOT NULL
UNION ALL SELECT 'queue', league_code, raw_name, '' FROM found WHERE status = 'unresolved'""", "matches", ctes=RESOLVE),
    "name_review": sql("SELECT raw_name, coalesce(country, '-') AS country, competition, CAST(appearances AS BIGINT) AS appearances, coalesce(canonical, '-') AS canonical, bucket FROM review", "matches", ctes=REVIEW),
    "translate_corpus": sql(
        """SELECT match_id, coalesce(h.canonical, raw_home) AS home_name, coalesce(a.canonical, raw_away) AS away_name FROM raw LEFT JOIN review h ON h.raw_name = trim(raw_home) LEFT JOIN review a ON a.raw_name = trim(raw_away)""",
        "matches", ctes=REVIEW),
    "translate_report": sql(
        """SELECT CAST(count(*) FILTER (bucket = 'resolved') AS BIGINT) AS translated, CAST(count(*) FILTER (bucket <> 'resolved') AS BIGINT) AS untranslated,
CAST(count(*) FILTER (bucket = 'reviewable') AS BIGINT) AS linkable, CAST(coalesce(sum(appearances) FILTER (bucket = 'reviewable'), 0) AS BIGINT) AS unlinked_appearances FROM review""",
        "matches", ctes=REVIEW),
    "team_registry": sql(
        """SELECT league_code, string_agg(DISTINCT team, ',' ORDER BY team) AS teams, CAST(count(DISTINCT team) AS BIGINT) AS n, 'all' AS scope FROM ts GROUP BY league_code
UNION ALL SELECT league_code, string_agg(team, ',' ORDER BY team), CAST(count(*) AS BIGINT), 'newest' FROM ts WHERE (league_code, season) IN (SELECT league_code, max(season) FROM ts GROUP BY league_code) GROUP BY league_code""",
        "matches", ctes=TS),
    "alias_upsert": sql(
        """SELECT league_code, raw_name, coalesce(canonical_name, '-') AS canonical_name, status FROM (
SELECT *, row_number() OVER (PARTITION BY league_code, raw_name ORDER BY p) AS rn FROM (
SELECT league_code, raw_name, substr(raw_name, 4) AS canonical_name, 'approved' AS status, 0 AS p FROM aliases WHERE CAST(right(raw_name, 2) AS INT) = 3
UNION ALL SELECT *, 1 FROM aliases UNION ALL SELECT league_code, 'FC ' || team, NULL, 'pending', 2 FROM reg) u) v
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM aliases r WHERE CAST(right(r.raw_name, 2) AS INT) = 6 AND r.league_code = v.league_code AND r.raw_name = v.raw_name)""",
        "matches", ctes=f"{REG}, {ALIASES}"),
    "alias_merge_report": sql(
        """SELECT CAST(count(*) FILTER (prev IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (prev <> canonical_name) AS BIGINT) AS updated, CAST(count(*) FILTER (prev = canonical_name) AS BIGINT) AS unchanged,
(SELECT count(*) FROM (SELECT scope, raw_name FROM inc UNION SELECT league_code, raw_name FROM aliases WHERE status = 'approved') d) AS total
FROM (SELECT i.*, coalesce(lag(i.canonical_name) OVER (PARTITION BY i.scope, i.raw_name ORDER BY i.position), s.canonical_name) AS prev FROM inc i
LEFT JOIN aliases s ON s.status = 'approved' AND s.league_code = i.scope AND s.raw_name = i.raw_name) t""",
        "matches", ctes=f"""{REG}, {ALIASES}, inc AS (SELECT match_id AS position, league_code AS scope, 'FC ' || home_team AS raw_name,
CASE WHEN hr = 1 THEN home_team || ' FC' ELSE home_team END AS canonical_name FROM matches WHERE hy <> 4)"""),
    "display_names": sql(f"SELECT match_id, {CLUB.format(t='home_team')} AS home_label, {CLUB.format(t='away_team')} AS away_label FROM matches", "matches"),
    "cross_source_check": sql(
        f"""SELECT match_id, CAST(rank AS BIGINT) AS rank, CASE WHEN hg = fthg AND ag = ftag THEN 'same' WHEN et THEN 'extra_time' ELSE 'differs' END AS verdict FROM (
SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY rank) AS rn FROM (
SELECT m.match_id, o.rank, count(*) AS n, min(m.fthg) AS fthg, min(m.ftag) AS ftag, min(p.hg) AS hg, min(p.ag) AS ag, bool_or(p.et) AS et
FROM matches m, (VALUES (0, 0), (1, -1), (2, 1)) o(rank, shift), other p WHERE p.league_code = m.league_code AND p.day = m.match_date + o.shift
AND {FITS.format(a=LOOSE.format(c='m.home_team'), b='p.oh')} AND {FITS.format(a=LOOSE.format(c='m.away_team'), b='p.oa')} GROUP BY m.match_id, o.rank HAVING count(*) = 1) u) v WHERE rn = 1""",
        "matches", ctes=f"""other AS (SELECT league_code, match_date + CAST(hf % 3 - 1 AS INT) AS day, {LOOSE.format(c=SPELL.format(t='home_team'))} AS oh, {LOOSE.format(c=SPELL.format(t='away_team'))} AS oa,
fthg + hr AS hg, ftag AS ag, ar = 1 AS et FROM matches)"""),
}
