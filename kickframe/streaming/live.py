"""Live match operators.

Each operator works on a batch of polls; where state spans micro-batches there
is a Structured Streaming form whose output equals the batch form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kickframe.functions import scoregrid as sg
from kickframe.operators.goals import add
from kickframe.params import ELO, STALE_AFTER_SECONDS, EloParams
from kickframe.session import stage

# Provider status codes and their canonical state.
PROVIDER_STATUS = {
    "SCHEDULED": "scheduled", "TIMED": "scheduled", "IN_PLAY": "live", "LIVE": "live",
    "PAUSED": "paused", "SUSPENDED": "paused", "FINISHED": "finished", "AWARDED": "finished",
    "POSTPONED": "postponed", "CANCELLED": "cancelled", "CANCELED": "cancelled",
}
# Score-board stage prefixes and their canonical state.
STAGE_PREFIX = {
    "half time": "paused", "ht": "paused", "break": "paused", "finished": "finished",
    "after et": "finished", "after pen": "finished", "ft": "finished",
    "postponed": "postponed", "cancelled": "cancelled", "abandoned": "cancelled",
}
# Minutes implied by a status.
FIXED_MINUTES = {"scheduled": 0, "postponed": 0, "cancelled": 0, "paused": 45, "finished": 90}
HALF, BREAK, FULL = 45, 15, 90


def provider_status(code: Column) -> Column:
    """Canonical state of a provider code; null for an unknown one."""
    known = F.create_map(*[F.lit(x) for pair in PROVIDER_STATUS.items() for x in pair])
    return F.try_element_at(known, F.coalesce(code, F.lit("")))


def stage_status(stage: Column, home: Column, away: Column) -> Column:
    """State by stage prefix; else scheduled without a score, live with one."""
    text = F.lower(F.trim(F.coalesce(stage, F.lit(""))))
    out = F.when(F.lit(False), "")
    for prefix, status in STAGE_PREFIX.items():
        out = out.when(text.startswith(prefix), status)
    return out.when(home.isNull() | away.isNull(), "scheduled").otherwise("live")


def normalise_status(rows: DataFrame, code: str = "code") -> DataFrame:
    """Canonical status per row; rows with an unknown code are dropped."""
    return rows.withColumn("status", provider_status(F.col(code))).where(F.col("status").isNotNull())


def elapsed_minutes(status: Column, minute: Column, kickoff: Column, now: Column) -> Column:
    """Minutes played in [0, 90]: by status, else the clock, else wall time."""
    fixed = F.when(F.lit(False), 0)
    for name, minutes in FIXED_MINUTES.items():
        fixed = fixed.when(status == name, minutes)
    digits = F.regexp_extract(F.coalesce(minute, F.lit("")), r"^\s*(\d{1,3})", 1)
    clock = F.when(digits != "", digits.cast("int"))
    wall = F.floor((F.unix_timestamp(now) - F.unix_timestamp(kickoff)) / 60)
    played = (
        F.when(wall > HALF + BREAK, wall - BREAK).when(wall > HALF, F.lit(HALF)).otherwise(wall)
    )
    # greatest/least skip nulls, so a missing reading must stay missing.
    clamp = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(FULL), c)))
    return F.coalesce(fixed, clamp(clock), clamp(played))


def _changes(cur: dict[str, Column], prev: dict[str, Column]) -> Column:
    scored = F.coalesce((cur["home"] > prev["home"]), F.lit(False)) | F.coalesce(
        (cur["away"] > prev["away"]), F.lit(False))
    return F.array_compact(F.array(
        F.when(scored, "goal"),
        F.when((prev["status"] == "scheduled") & (cur["status"] == "live"), "kickoff"),
        F.when((prev["status"] != "finished") & (cur["status"] == "finished"), "full_time"),
    ))


def live_events(polls: DataFrame) -> DataFrame:
    """Events between adjacent polls of a match.

    Adjacent means the poll before, so it is an equality join on (match, poll):
    no window gathers a match's whole history. A first sight is silent, and so is
    a match that skipped a poll.
    """
    prev = polls.select(
        "match_slot", (F.col("poll_seq") + 1).alias("poll_seq"), F.col("home_goals").alias("_ph"),
        F.col("away_goals").alias("_pa"), F.col("status").alias("_ps"))
    joined = polls.join(prev, ["match_slot", "poll_seq"])
    events = _changes(
        {"home": F.col("home_goals"), "away": F.col("away_goals"), "status": F.col("status")},
        {"home": F.col("_ph"), "away": F.col("_pa"), "status": F.col("_ps")})
    return joined.select("match_slot", "poll_seq", F.explode(events).alias("event"))


EVENT_SCHEMA = "match_slot bigint, poll_seq bigint, event string"
STATE_SCHEMA = "poll_seq bigint, home int, away int, status string"


def _track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Diff one match's new polls against its stored last poll."""
    if state.hasTimedOut:
        state.remove()
        return
    seen = {}
    newest = 0
    for batch in batches:
        for seq, hg, ag, status, ts in zip(
            batch.poll_seq, batch.home_goals, batch.away_goals, batch.status, batch.ts
        ):
            seen[int(seq)] = (None if pd.isna(hg) else int(hg), None if pd.isna(ag) else int(ag), status)
            newest = max(newest, int(pd.Timestamp(ts).timestamp() * 1000))
    last = state.get if state.exists else None
    out = []
    for seq in sorted(seen):
        if last is not None and seq <= last[0]:
            continue
        hg, ag, status = seen[seq]
        if last is not None and seq == last[0] + 1:
            _, ph, pa, ps = last
            if (ph is not None and hg is not None and hg > ph) or (pa is not None and ag is not None and ag > pa):
                out.append((key[0], seq, "goal"))
            if ps == "scheduled" and status == "live":
                out.append((key[0], seq, "kickoff"))
            if ps != "finished" and status == "finished":
                out.append((key[0], seq, "full_time"))
        last = (seq, hg, ag, status)
    if last is not None:
        state.update(last)
        # State goes a day after the match's newest poll.
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 86_400_000)
    yield pd.DataFrame(out, columns=["match_slot", "poll_seq", "event"])


def live_events_stream(polls: DataFrame, delay: str = "1 day") -> DataFrame:
    """Streaming form of `live_events`: state is one poll per match."""
    stamped = polls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return stamped.groupBy("match_slot").applyInPandasWithState(
        _track, EVENT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def live_board(polls: DataFrame, now: Column, stale_after: int = STALE_AFTER_SECONDS) -> DataFrame:
    """Newest non-empty poll of each league, flagged stale by age.

    Empty polls leave no rows, so they neither replace nor advance a board.
    """
    latest = polls.groupBy("league_code").agg(F.max("poll_seq").alias("poll_seq"))
    rows = polls.join(latest, ["league_code", "poll_seq"])
    fetched = rows.groupBy("league_code").agg(F.max("ts").alias("fetched_at"))
    age = F.unix_timestamp(now) - F.unix_timestamp("fetched_at")
    return rows.join(fetched, "league_code").withColumn("stale", age >= stale_after)


def _replace_parts(rows: DataFrame, path: str, key: str, name: str) -> None:
    """Replace the partitions of the keys that `rows` hold; staged first, since the rows may come from `path`."""
    stage(rows, name).repartition(key).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def board_upsert(path: str):
    """foreachBatch writer keeping the newest poll of each league under `path`.

    A league's partition is replaced only when the batch has its newest poll, so neither an
    empty poll nor a late batch moves a board back. A poll that comes in several batches is put
    together, a repeated batch changes nothing. One writer per path; readers may see some
    leagues a batch older than others.
    """
    def write(batch: DataFrame, _epoch: int) -> None:
        spark, order = batch.sparkSession, ["league_code", "poll_seq", "match_slot"]
        try:
            stored = spark.read.schema(batch.schema).parquet(path)
        except AnalysisException:  # nothing stored yet
            stored = batch.limit(0)
        touched = batch.select("league_code").distinct()
        # Of a row that is stored and sent again, either one.
        both = batch.unionByName(stored.join(touched, "league_code", "left_semi").select(*batch.columns)).dropDuplicates(order)
        newest = both.groupBy("league_code").agg(F.max("poll_seq").alias("poll_seq"))
        _replace_parts(both.join(newest, ["league_code", "poll_seq"]).select(*batch.columns), path, "league_code", "boards")

    return write


def in_play_upsert(board: str, priced: str, live_rows: Callable[[DataFrame], DataFrame], names: DataFrame, predictions: DataFrame):
    """foreachBatch writer keeping the newest board under `board` and its prices under `priced`.

    Only boards of the batch are priced anew: `live_rows` turns their rows into what `in_play_board`
    takes and keeps the board's league as `board`, as a match may belong to another one. A board
    without a match in play keeps one row of nulls, so that old prices go.
    """
    keep = board_upsert(board)

    def write(batch: DataFrame, epoch: int) -> None:
        keep(batch, epoch)
        if batch.isEmpty():
            return
        touched = batch.select(F.col("league_code").alias("board")).distinct()
        rows = batch.sparkSession.read.schema(batch.schema).parquet(board).withColumn("board", F.col("league_code"))
        found = in_play_board(live_rows(rows.join(touched, "board", "left_semi")), names, predictions)
        _replace_parts(touched.join(found, "board", "left"), priced, "board", "prices")

    return write


def run_batches(source: DataFrame, write, name: str, files_per_batch: int = 1) -> None:
    """Stream a batch frame to completion through a foreachBatch writer, `files_per_batch` files at a time."""
    from kickframe.session import scratch_path

    spark = source.sparkSession
    inbox, log = (scratch_path(spark, f"{name}-{part}") for part in ("in", "log"))
    source.write.parquet(inbox)
    reader = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files_per_batch)
    query = reader.parquet(inbox).writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()


def first_non_empty_source(answers: DataFrame, request: list[str], rank: str = "provider_rank") -> DataFrame:
    """Rows of the first provider with any row for a request; no merging."""
    winner = answers.groupBy(*request).agg(F.min(rank).alias(rank))
    return answers.join(winner, [*request, rank])


def in_play_price(rows: DataFrame, max_goals: int = 10) -> DataFrame:
    """Outcome probabilities given the score, the minute and expected goals.

    Rows carry lambda_home, lambda_away, home_goals, away_goals and elapsed.
    """
    n = max_goals
    out = add(rows, {"remaining": f"({FULL}.0D - greatest(0, least({FULL}, elapsed))) / {FULL}.0D"})
    out = add(out, {"_rh": "lambda_home * CAST(lambda_home > 0 AS DOUBLE) * remaining",
                    "_ra": "lambda_away * CAST(lambda_away > 0 AS DOUBLE) * remaining",
                    "_lead": "CAST(home_goals - away_goals AS INT)"})
    out = add(out, sg.pmf_columns("_rh", "_ra", n))
    away = ", ".join(f"_a{k}" for k in range(n + 1))
    cum = ", ".join("+".join(f"_a{x}" for x in range(k + 1)) for k in range(n + 1))
    out = add(out, {"_pa": f"array({away})", "_ca": f"array({cum})"})
    # The away side may add fewer than i + lead goals for a home win.
    wins = " + ".join(f"_h{i} * coalesce(get(_ca, least({i} + _lead - 1, {n})), 0.0D)" for i in range(n + 1))
    level = " + ".join(f"_h{i} * coalesce(get(_pa, {i} + _lead), 0.0D)" for i in range(n + 1))
    home_mass = "(" + " + ".join(f"_h{i}" for i in range(n + 1)) + ")"
    out = add(out, {"_win": wins, "_level": level, "_all": f"{home_mass} * get(_ca, {n})"})
    return out.selectExpr(
        *rows.columns, "remaining", "_win / _all AS home_win", "_level / _all AS draw",
        "(_all - _win - _level) / _all AS away_win",
        "home_goals + _rh AS expected_home_goals", "away_goals + _ra AS expected_away_goals")


def in_play_board(live: DataFrame, names: DataFrame, predictions: DataFrame) -> DataFrame:
    """Price matches in progress or say why not.

    `live` carries league_code, match_date, raw_home, raw_away, status, goals and
    elapsed; `names` map (league_code, raw_name) to a canonical team;
    `predictions` hold expected goals per (league_code, match_date, pair). Both
    are static tables when `live` is a stream.
    """
    playing = live.where(
        F.col("status").isin("live", "paused") & F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())
    out = playing
    for side in ("home", "away"):
        lookup = names.select("league_code", F.col("raw_name").alias(f"raw_{side}"), F.col("canonical").alias(f"{side}_team"))
        out = out.join(lookup, ["league_code", f"raw_{side}"], "left")
    stored = predictions.select("league_code", "match_date", "home_team", "away_team", "lambda_home",
                                "lambda_away", F.lit(True).alias("_found"))
    out = out.join(stored, ["league_code", "match_date", "home_team", "away_team"], "left")
    priced = in_play_price(out)
    reason = (
        F.when(F.col("home_team").isNull() | F.col("away_team").isNull(), "unknown_team")
        .when(F.col("_found").isNull(), "no_prediction")
        .when(F.col("lambda_home").isNull() | F.col("lambda_away").isNull(), "no_expected_goals")
        .otherwise("priced")
    )
    return priced.withColumn("reason", reason).drop("_found")


#: Matches of a pool whose ratings leave a task together.
EMITTED = 20_000
RATING_SCHEMA = "pool string, team string, rating double, match_date date, match_id bigint"


def elo_stream(finished: DataFrame, p: EloParams = ELO) -> DataFrame:
    """Running ratings of finished matches; state is one rating per team and pool.

    A micro-batch is walked in (date, id) order; batches must arrive in time
    order, as results do. Emits a team's rating after each of its matches.
    """
    import math

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, rating = list(state.get[0]) if state.exists else [], list(state.get[1]) if state.exists else []
        number = {name: i for i, name in enumerate(names)}

        def place(name: str) -> int:
            if name not in number:
                number[name] = len(names)
                names.append(name)
                rating.append(p.initial_rating)
            return number[name]

        # A micro-batch comes in any order, so it is held whole, but as numbers.
        parts = [[] for _ in range(7)]
        for batch in batches:
            teams = [np.fromiter(map(place, batch[c]), np.int32, len(batch)) for c in ("home_team", "away_team")]
            days, missing = batch.match_date.to_numpy().astype("datetime64[D]"), batch.match_id.isna().to_numpy()
            ids = batch.match_id.fillna(0).to_numpy(np.int64)
            for part, values in zip(parts, (days, ids, missing, *teams, batch.fthg.to_numpy(np.float64), batch.ftag.to_numpy(np.float64))):
                part.append(values)
        # One column at a time gives its pieces back.
        days, ids, missing, home, away, hg, ag = (np.concatenate(parts.pop(0)) for _ in range(7))
        order = np.lexsort((ids, missing, days))
        for at in range(0, len(order), EMITTED):
            rows, out = order[at:at + EMITTED], []
            for h, a, x, y in zip(home[rows].tolist(), away[rows].tolist(), hg[rows].tolist(), ag[rows].tolist()):
                rh, ra = rating[h], rating[a]
                expected = 1.0 / (1.0 + 10.0 ** ((ra - (rh + p.home_advantage)) / 400.0))
                scored = 1.0 if x > y else (0.0 if x < y else 0.5)
                move = p.k_factor * (1.0 if x == y else math.log(abs(x - y) + 1)) * (scored - expected)
                rating[h], rating[a] = rh + move, ra - move
                out += (rh + move, ra - move)
            sides = np.stack([home[rows], away[rows]], 1).ravel()
            twice = np.repeat(rows, 2)
            yield pd.DataFrame({
                "pool": key[0], "team": [names[t] for t in sides.tolist()], "rating": out, "match_date": days[twice].astype(object),
                "match_id": pd.arrays.IntegerArray(ids[twice], missing[twice])})
        state.update((names, rating))

    return finished.groupBy("pool").applyInPandasWithState(
        step, RATING_SCHEMA, "teams array<string>, ratings array<double>", "append", GroupStateTimeout.NoTimeout)


def run_available(source: DataFrame, transform, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream a batch frame through `transform` to completion and read the result.

    Source, checkpoint and sink live in the shared folder, so a restarted query
    resumes where it stopped.
    """
    from kickframe.session import scratch_path

    spark = source.sparkSession
    inbox, sink, log = (scratch_path(spark, f"{name}-{part}") for part in ("in", "out", "log"))
    source.write.parquet(inbox)
    reader = spark.readStream.schema(source.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    out = transform(reader.parquet(inbox))
    query = (
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", log)
        .trigger(availableNow=True).start(sink)
    )
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)
