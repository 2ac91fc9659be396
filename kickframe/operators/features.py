"""Leakage-free match features built from window functions.

Every frame ends before the current match. The order within a team is always
(match_date, match_id), which is total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kickframe.functions.probability import normalise
from kickframe.operators.windows import hot_keys, last_n, over_recent
from kickframe.params import FEATURES, FeatureParams
from kickframe.session import stage

ORDER = ["match_date", "match_id"]

# stat -> (home side column, away side column); "against" stats mirror them.
MIRRORED = {
    "gf": ("fthg", "ftag"),
    "ga": ("ftag", "fthg"),
    "shots": ("hs_shots", "as_shots"),
    "shots_against": ("as_shots", "hs_shots"),
    "sot": ("hst", "ast"),
    "sot_against": ("ast", "hst"),
    "corners": ("hc", "ac"),
    "corners_against": ("ac", "hc"),
    "fouls": ("hf", "af"),
    "fouls_against": ("af", "hf"),
}
GOAL_STATS = ("gf", "ga")
ALL_STATS = tuple(MIRRORED)

ODDS_COLUMNS = (
    "odds_prob_h", "odds_prob_d", "odds_prob_a",
    "norm_prob_h", "norm_prob_d", "norm_prob_a", "odds_spread",
)
MODEL_PREFIXES = (
    "home_", "away_", "diff_", "elo_", "h2h_", "rest_", "is_midweek", "xg_diff",
    "avg_draw_pct", "form_gap", "attack_similarity", "defense_similarity",
    "combined_defensive", "is_neutral",
)
NON_FEATURES = ("home_team", "away_team", "home_league", "away_league")


def result_of(home: str = "fthg", away: str = "ftag") -> Column:
    return (
        F.when(F.col(home) > F.col(away), "H").when(F.col(home) < F.col(away), "A")
        .when(F.col(home) == F.col(away), "D")
    )


def pair_key() -> list[Column]:
    """The two teams of a match without regard to venue."""
    return [
        F.least("home_team", "away_team").alias("team_a"),
        F.greatest("home_team", "away_team").alias("team_b"),
    ]


def team_matches(matches: DataFrame, stats=ALL_STATS, payload: bool = False, extra=()) -> DataFrame:
    """One row per team and match, statistics seen from that team's side.

    With `payload` the whole match travels on the home row, so that the two
    sides can be folded back by match without another join.
    """
    def side(home: bool) -> Column:
        fields = [
            F.col("match_id"),
            F.col("match_date"),
            F.col("home_team" if home else "away_team").alias("team"),
            F.col("away_team" if home else "home_team").alias("opponent"),
            F.lit(home).alias("is_home"),
            *[F.col(MIRRORED[s][0 if home else 1]).alias(s) for s in stats],
            *[pick(home).alias(name) for name, pick in extra],
        ]
        if payload:
            whole = F.struct(*[F.col(c) for c in matches.columns])
            fields.append((whole if home else F.when(F.lit(False), whole)).alias("payload"))
        return F.struct(*fields)

    sides = matches.select(F.explode(F.array(side(True), side(False))).alias("r"))
    return sides.select("r.*")


def _mean_if(col: str, minimum: int, window: int):
    def make(spec: WindowSpec) -> Column:
        frame = spec.rowsBetween(-window, -1)
        return F.when(F.count(col).over(frame) >= minimum, F.avg(col).over(frame))

    return make


def rolling_team_stats(
    records: DataFrame, stats=ALL_STATS, p: FeatureParams = FEATURES, hot: DataFrame | None = None
) -> DataFrame:
    """Mean of the previous `window` records per statistic, and points (form)."""
    points = (
        F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    )
    exprs = {f"avg_{s}": _mean_if(s, p.min_observations, p.window) for s in stats}
    exprs["form"] = _mean_if("points", p.min_observations, p.window)
    return over_recent(
        records.withColumn("points", points), ["team"], ORDER, p.window, exprs, hot
    )


def _match() -> Column:
    """A join key that a row without an id has too."""
    return F.struct("match_id").alias("_match")


def _fold_sides(stats: DataFrame, names: list[str]) -> DataFrame:
    """Bring the two records of each match back into one row: the match they carry, or else its `_match`."""
    carried = "payload" in stats.columns
    aggs = [F.first("payload", ignorenulls=True).alias("payload")] if carried else []
    for name in names:
        aggs.append(F.max(F.when(F.col("is_home"), F.col(name))).alias(f"home_{name}"))
        aggs.append(F.max(F.when(~F.col("is_home"), F.col(name))).alias(f"away_{name}"))
    if not carried:
        return stats.groupBy(_match()).agg(*aggs)
    folded = stats.groupBy("match_id").agg(*aggs)
    sides = [f"{s}_{n}" for n in names for s in ("home", "away")]
    return folded.select("payload.*", *sides)


def match_features(
    matches: DataFrame, stats=ALL_STATS, p: FeatureParams = FEATURES, hot: DataFrame | None = None
) -> DataFrame:
    """Home, away and difference of the rolling stats; incomplete rows dropped."""
    rolled = rolling_team_stats(team_matches(matches, stats), stats, p, hot)
    names = [f"avg_{s}" for s in stats] + ["form"]
    # The whole match moves once, beside the windows; of rows with one id one stays.
    whole = matches.groupBy(_match()).agg(F.first(F.struct(*matches.columns)).alias("payload"))
    sides = [f"{s}_{n}" for n in names for s in ("home", "away")]
    folded = whole.join(_fold_sides(rolled.select("match_id", "is_home", *names), names), "_match").select("payload.*", *sides)
    with_diff = folded.withColumns(
        {f"diff_{n}": F.col(f"home_{n}") - F.col(f"away_{n}") for n in names}
    )
    return with_diff.na.drop(subset=[f"{s}_{n}" for n in names for s in ("home", "away")])


def odds_features(df: DataFrame) -> DataFrame:
    """Raw and normalised implied probabilities and the home-away spread."""
    raw = {f"odds_prob_{o}": F.lit(1.0) / F.col(f"b365{o}") for o in "hda"}
    total = F.col("odds_prob_h") + F.col("odds_prob_d") + F.col("odds_prob_a")
    norm = {f"norm_prob_{o}": F.col(f"odds_prob_{o}") / total for o in "hda"}
    return (
        df.withColumns(raw).withColumns(norm)
        .withColumn("odds_spread", F.col("norm_prob_h") - F.col("norm_prob_a"))
    )


def _xg(sot: str, shots: str, p: FeatureParams) -> Column:
    off_target = F.greatest(F.col(shots) - F.col(sot), F.lit(0))
    return F.col(sot) * F.lit(p.sot_conversion) + off_target * F.lit(p.shot_conversion)


def _recent_mean(col: str, window: int):
    def make(spec: WindowSpec) -> Column:
        return F.coalesce(F.avg(col).over(spec.rowsBetween(-window, -1)), F.lit(0.0))

    return make


def _rest_days(p: FeatureParams):
    def make(spec: WindowSpec) -> Column:
        gap = F.datediff(F.col("match_date"), F.lag("match_date").over(spec))
        return F.coalesce(F.least(gap, F.lit(p.max_rest_days)), F.lit(p.default_rest_days))

    return make


XG, FATIGUE, DRAWS = "xg", "fatigue", "draws"


def form_features(
    df: DataFrame,
    families=(XG, FATIGUE, DRAWS),
    p: FeatureParams = FEATURES,
    hot: DataFrame | None = None,
) -> DataFrame:
    """xG proxy, rest days and draw share in one pass over the team windows."""
    return _form_columns(_form_values(df, families, p, hot, payload=True), families, p)


def _form_values(df: DataFrame, families, p: FeatureParams, hot: DataFrame | None, payload: bool) -> DataFrame:
    """Window values of both sides of each match, beside its columns or its key alone."""
    extra, exprs = [], {}
    if XG in families:
        extra += [
            ("xg", lambda home: _xg("hst", "hs_shots", p) if home else _xg("ast", "as_shots", p)),
            ("xga", lambda home: _xg("ast", "as_shots", p) if home else _xg("hst", "hs_shots", p)),
        ]
        exprs |= {
            "xg_rolling": _recent_mean("xg", p.window),
            "xga_rolling": _recent_mean("xga", p.window),
        }
    if FATIGUE in families:
        exprs["rest_days"] = _rest_days(p)
    if DRAWS in families:
        extra.append(
            ("is_draw", lambda home: F.when(F.col("fthg") == F.col("ftag"), 1).otherwise(0))
        )
        exprs["draw_pct"] = _recent_mean("is_draw", p.window)
    records = team_matches(df, stats=(), payload=payload, extra=extra)
    return _fold_sides(over_recent(records, ["team"], ORDER, p.window, exprs, hot), list(exprs))


def _form_columns(out: DataFrame, families, p: FeatureParams) -> DataFrame:
    """What follows from a match's columns and the window values of its sides."""
    if XG in families:
        out = out.withColumn("xg_diff", F.col("home_xg_rolling") - F.col("away_xg_rolling"))
    if FATIGUE in families:
        out = out.withColumns({
            "rest_advantage": F.col("home_rest_days") - F.col("away_rest_days"),
            "home_fatigued": (F.col("home_rest_days") <= p.fatigue_days).cast("int"),
            "away_fatigued": (F.col("away_rest_days") <= p.fatigue_days).cast("int"),
            "is_midweek": F.weekday("match_date").isin(1, 2).cast("int"),
        })
    if DRAWS in families:
        out = out.withColumn("avg_draw_pct", (F.col("home_draw_pct") + F.col("away_draw_pct")) / 2)
        out = out.withColumns(_similarity(out.columns))
    return out


def _similarity(columns: list[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    one = F.lit(1.0)
    if "home_form" in columns:
        out["form_gap"] = F.abs(F.col("home_form") - F.col("away_form"))
    if "home_avg_gf" in columns:
        out["attack_similarity"] = one / (one + F.abs(F.col("home_avg_gf") - F.col("away_avg_gf")))
        out["defense_similarity"] = one / (one + F.abs(F.col("home_avg_ga") - F.col("away_avg_ga")))
        out["combined_defensive"] = (
            one / (one + F.col("home_avg_ga")) + one / (one + F.col("away_avg_ga"))
        )
    return out


def h2h_last5(df: DataFrame, p: FeatureParams = FEATURES) -> DataFrame:
    """Shares over the last meetings strictly before the match date.

    A pair's day is the unit: at most `h2h_last` meetings are kept per day, the
    window runs over a pair's days, and the result is joined back per day. No
    task sees more than days x `h2h_last` rows of a pair.
    """
    return _h2h_values(df, df.select("*", *pair_key()), p).drop("team_a", "team_b")


def _h2h_values(df: DataFrame, keyed: DataFrame, p: FeatureParams) -> DataFrame:
    """`keyed`, rows with a pair, date and home team, with the shares over what `df` has before."""
    n = p.h2h_last
    meetings = df.select("*", *pair_key())
    meeting = F.struct(
        "match_date", "match_id", "home_team",
        result_of().alias("result"), (F.col("fthg") + F.col("ftag")).alias("goals"),
    )
    per_day = Window.partitionBy("team_a", "team_b", "match_date").orderBy(F.col("match_id").desc())
    days = (
        meetings.select("team_a", "team_b", "match_date", "match_id", meeting.alias("m"))
        .withColumn("_rn", F.row_number().over(per_day)).where(F.col("_rn") <= n)
        .groupBy("team_a", "team_b", "match_date")
        .agg(F.sort_array(F.collect_list("m")).alias("tail"))
    )
    earlier = Window.partitionBy("team_a", "team_b").orderBy("match_date").rowsBetween(-n, -1)
    history = days.select(
        "team_a", "team_b", "match_date",
        F.flatten(F.collect_list("tail").over(earlier)).alias("before"),
    ).select("team_a", "team_b", "match_date", last_n("before", n).alias("prev"))
    joined = keyed.join(history, ["team_a", "team_b", "match_date"])

    def won(m: Column) -> Column:
        at_home = m["home_team"] == F.col("home_team")
        return (at_home & (m["result"] == "H")) | (~at_home & (m["result"] == "A"))

    size = F.size("prev")
    def share(total: Column) -> Column:
        return F.when(size >= p.h2h_min, total.cast("double") / size)

    return joined.withColumns({
        "h2h_home_wins": share(F.size(F.filter("prev", won))),
        "h2h_draws": share(F.size(F.filter("prev", lambda m: m["result"] == "D"))),
        "h2h_total_goals_avg": share(
            F.aggregate("prev", F.lit(0).cast("bigint"), lambda acc, m: acc + m["goals"])
        ),
    }).drop("prev")


def _later_steps(survivors: DataFrame, families, p: FeatureParams, hot: DataFrame | None) -> DataFrame:
    """`h2h_last5(form_features(...))` of staged rows, one per match.

    Only keys and values go through the windows, and the wide rows are moved once, to be joined with them.
    """
    form = _form_values(survivors, families, p, hot, payload=False)
    keyed = survivors.select("match_id", "match_date", "home_team", *pair_key())
    pairs = _h2h_values(survivors, keyed, p)
    names = [c for c in pairs.columns if c.startswith("h2h_")]
    joined = survivors.select("*", _match()).join(form, "_match")
    out = _form_columns(joined, families, p).join(pairs.select(_match(), *names), "_match")
    rest = [c for c in out.columns if c not in ("_match", "match_date", *names)]
    return out.select("match_date", *rest, *names)


def all_features(
    matches: DataFrame, p: FeatureParams = FEATURES, hot: DataFrame | None = None
) -> DataFrame:
    """The full feature chain; later steps see only rows that survived C3.

    The rolling pass feeds a second team pass and the pair pass, so it is staged
    once in the shared folder rather than recomputed for each.
    """
    if hot is None:
        hot = hot_keys(team_matches(matches, stats=()), ["team"])
    survivors = stage(odds_features(match_features(matches, p=p, hot=hot)), "survivors")
    return _later_steps(survivors, (XG, FATIGUE, DRAWS), p, hot)


def intl_features(
    matches: DataFrame, p: FeatureParams = FEATURES, hot: DataFrame | None = None
) -> DataFrame:
    """Goals-only variant with a neutral-venue flag."""
    if hot is None:
        hot = hot_keys(team_matches(matches, stats=()), ["team"])
    survivors = stage(match_features(matches, GOAL_STATS, p, hot), "intl-survivors")
    out = _later_steps(survivors, (DRAWS,), p, hot)
    return out.withColumn("is_neutral", F.col("neutral").cast("int"))


def encoded_result() -> Column:
    """Away win 0, draw 1, home win 2."""
    return (
        F.when(F.col("fthg") > F.col("ftag"), 2).when(F.col("fthg") < F.col("ftag"), 0)
        .when(F.col("fthg") == F.col("ftag"), 1)
    )


def model_columns(df: DataFrame) -> list[str]:
    return [
        c for c in df.columns
        if c.startswith(MODEL_PREFIXES) and c not in ODDS_COLUMNS and c not in NON_FEATURES
    ]


def feature_matrix(df: DataFrame) -> DataFrame:
    """The model's columns plus the encoded label."""
    return df.select("match_id", "match_date", *model_columns(df), encoded_result().alias("label"))


def time_decay_weights(
    df: DataFrame, half_life: float, date: str = "match_date", enabled: bool = True
) -> DataFrame:
    """0.5^(age / half-life); a missing date counts as the oldest."""
    if not enabled or half_life <= 0:
        return df.withColumn("weight", F.lit(1.0))
    newest = df.agg(F.max(date)).scalar()
    oldest = df.agg(F.min(date)).scalar()
    age = F.datediff(newest, F.coalesce(F.col(date), oldest))
    return df.withColumn("weight", F.pow(F.lit(0.5), age / F.lit(float(half_life))))
