"""Scores of predicted triples, sweeps over blends, bootstrap intervals.

`scored` frames carry p_away, p_draw, p_home and label (0 away, 1 draw, 2 home).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.functions.probability import from_expected_score
from kickframe.params import CROSS, SCORES, CrossLeagueParams

# Probabilities are clipped before the logarithm, as the usual log-loss does.
EPS = 2.220446049250313e-16
CLASSES = ("away", "draw", "home")


def p_actual(label: Column, away: Column, draw: Column, home: Column) -> Column:
    return F.when(label == 0, away).when(label == 1, draw).otherwise(home)


def loss(label: Column, away: Column, draw: Column, home: Column) -> Column:
    p = p_actual(label, away, draw, home)
    return -F.ln(F.greatest(F.lit(EPS), F.least(F.lit(1.0 - EPS), p)))


def brier(label: Column, away: Column, draw: Column, home: Column) -> Column:
    total = F.lit(0.0)
    for i, p in enumerate((away, draw, home)):
        gap = p - F.when(label == i, 1.0).otherwise(0.0)
        total = total + gap * gap
    return total


def argmax(away: Column, draw: Column, home: Column) -> Column:
    """Class of the largest probability; ties go away, draw, home."""
    return F.when((away >= draw) & (away >= home), 0).when(draw >= home, 1).otherwise(2)


def metric_aggs(label: Column, triple: tuple[Column, Column, Column]) -> list[Column]:
    hit = F.when(argmax(*triple) == label, 1.0).otherwise(0.0)
    return [F.avg(hit).alias("accuracy"), F.avg(loss(label, *triple)).alias("log_loss"),
            F.avg(brier(label, *triple)).alias("brier"), F.count(F.lit(1)).alias("matches")]


def triple_of(prefix: str = "p_") -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in CLASSES)


def metrics_1x2(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    aggs = metric_aggs(F.col("label"), triple_of())
    return scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)


def confusion(scored: DataFrame) -> DataFrame:
    """Counts per (label, predicted) class."""
    return scored.groupBy("label", argmax(*triple_of()).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, from the nine counts."""
    cells = confusion(scored).select(
        F.explode(F.array(
            F.struct(F.col("label").alias("klass"), F.lit("actual").alias("side"), (F.col("label") == F.col("predicted")).alias("hit")),
            F.struct(F.col("predicted").alias("klass"), F.lit("said").alias("side"), (F.col("label") == F.col("predicted")).alias("hit")),
        )).alias("c"), "n")
    total = lambda side: F.coalesce(F.sum(F.when(F.col("c.side") == side, F.col("n"))), F.lit(0))
    hits = F.coalesce(F.sum(F.when((F.col("c.side") == "actual") & F.col("c.hit"), F.col("n"))), F.lit(0))
    out = cells.groupBy(F.col("c.klass").alias("klass")).agg(
        total("actual").alias("support"), total("said").alias("said"), hits.alias("hits"))
    ratio = lambda d: F.when(F.col(d) > 0, F.col("hits") / F.col(d)).otherwise(0.0)
    out = out.withColumns({"precision": ratio("said"), "recall": ratio("support")})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).drop("said", "hits")


def calibration_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Mean predicted against observed share per class and bin; empty bins absent."""
    rows = scored.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("klass"), F.col(f"p_{c}").alias("p"), F.when(F.col("label") == i, 1.0).otherwise(0.0).alias("hit"))
        for i, c in enumerate(CLASSES)])).alias("r")).select("r.*")
    index = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins))
    return rows.groupBy("klass", index.alias("bin")).agg(
        F.avg("p").alias("predicted"), F.avg("hit").alias("observed"), F.count(F.lit(1)).alias("n"))


def _mix(first, second, weight: Column):
    mixed = [(F.lit(1.0) - weight) * x + weight * y for x, y in zip(first, second)]
    total = mixed[0] + mixed[1] + mixed[2]
    return tuple(m / total for m in mixed)


def blend_sweep(scored: DataFrame, weights=SCORES.blend_grid) -> DataFrame:
    """Log-loss of each weight on the second triple (q_*); the first minimum is best.

    The grid is a short literal list exploded inside the scan's stage and summed
    map-side: what is shuffled is one row per weight and task.
    """
    grid = F.posexplode(F.array(*[F.lit(float(w)) for w in weights])).alias("pos", "weight")
    cells = scored.select("label", *[f"{p}_{c}" for p in "pq" for c in CLASSES], grid)
    mixed = _mix(triple_of("p_"), triple_of("q_"), F.col("weight"))
    swept = cells.groupBy("pos", "weight").agg(F.avg(loss(F.col("label"), *mixed)).alias("log_loss"))
    best = swept.agg(F.min(F.struct("log_loss", "pos"))["pos"].alias("b")).scalar()
    return swept.withColumn("is_best", F.col("pos") == best)


def elo_triple(expected: Column, draw_rate: Column | float) -> tuple[Column, Column, Column]:
    h, d, a = from_expected_score(expected, draw_rate)
    return a, d, h


def blend_grid_2d(scored: DataFrame, p: CrossLeagueParams = CROSS) -> DataFrame:
    """Log-loss, Brier and accuracy of every (weight, draw rate) cell.

    `scored` carries elo_expected_home, the score model's triple q_* and label.
    """
    points = [(d, w) for d in p.draw_grid for w in p.weight_grid]
    grid = F.posexplode(F.array(*[
        F.struct(F.lit(float(w)).alias("weight"), F.lit(float(d)).alias("draw_rate")) for d, w in points])).alias("pos", "g")
    cells = scored.select("label", "elo_expected_home", *[f"q_{c}" for c in CLASSES], grid)
    # Each triple becomes columns once; nested expressions would repeat it per metric.
    elo = elo_triple(F.col("elo_expected_home"), F.col("g.draw_rate"))
    cells = cells.select("label", "pos", "g", *[f"q_{c}" for c in CLASSES], *[e.alias(f"e_{c}") for e, c in zip(elo, CLASSES)])
    mixed = _mix(triple_of("e_"), triple_of("q_"), F.col("g.weight"))
    cells = cells.select("label", "pos", "g", *[m.alias(f"p_{c}") for m, c in zip(mixed, CLASSES)])
    swept = cells.groupBy("pos", F.col("g.weight").alias("weight"), F.col("g.draw_rate").alias("draw_rate")).agg(
        *metric_aggs(F.col("label"), triple_of()))
    best = swept.agg(F.min(F.struct("log_loss", "pos"))["pos"].alias("b")).scalar()
    return swept.withColumn("is_best", F.col("pos") == best)


def baselines(scored: DataFrame, weight: float = CROSS.dixon_coles_weight, draw_rate: float = CROSS.draw_rate) -> DataFrame:
    """Elo alone, score model alone, class frequencies, and the configured blend.

    All four are scored in one pass over the rows; only the frequencies are
    needed beforehand.
    """
    share = scored.agg(*[F.avg(F.when(F.col("label") == i, 1.0).otherwise(0.0)).alias(c) for i, c in enumerate(CLASSES)])
    elo = elo_triple(F.col("elo_expected_home"), draw_rate)
    q = triple_of("q_")
    named = {
        "elo only": elo, "dixon-coles only": q,
        "base rate": tuple(share.select(c).scalar() for c in CLASSES),
        "current config": _mix(elo, q, F.lit(float(weight))),
    }
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), *[x.alias(f"p_{c}") for x, c in zip(t, CLASSES)]) for n, t in named.items()]))
    cells = scored.select("label", rows.alias("b")).select("label", "b.*")
    return metrics_1x2(cells, ("name",))


_CDF = np.cumsum(np.exp(-1.0) / np.array([math.factorial(k) for k in range(19)], dtype=float))  # beyond, under 2^-53
#: The count by the first 12 bits of a hash; NaN where a step of the distribution lies between them.
_BITS = 12
_FIRST, _LAST = (np.searchsorted(_CDF, u) for u in (np.arange(1 << _BITS) / (1 << _BITS), (np.arange(1, (1 << _BITS) + 1) - 2.0**(_BITS - 53)) / (1 << _BITS)))
_COUNT = np.where(_FIRST == _LAST, _FIRST, np.nan)


def _multiplicities(ids: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """Poisson(1) counts per (row, sample) as doubles, a pure function of id, sample and seed."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = x + (np.arange(samples, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))[None, :] * np.uint64(0xBF58476D1CE4E5B9)
        high = np.empty_like(x)
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            np.right_shift(x, np.uint64(shift), out=high)
            np.bitwise_xor(x, high, out=x)
            np.multiply(x, np.uint64(mult), out=x)
        np.right_shift(x, np.uint64(31), out=high)
        np.bitwise_xor(x, high, out=x)
    np.right_shift(x, np.uint64(64 - _BITS), out=high)
    counts = _COUNT.take(high.view(np.int64))
    # A few in a thousand need all bits.
    near = np.flatnonzero(np.isnan(counts))
    counts.ravel()[near] = np.searchsorted(_CDF, (x.ravel()[near] >> np.uint64(11)).astype(np.float64) / float(1 << 53))
    return counts


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores: narrow ones make few files, and each is multiplied by all samples."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def bootstrap_interval(differences: DataFrame, samples: int = CROSS.bootstrap_samples,
                       seed: int = CROSS.bootstrap_seed, level: float = CROSS.confidence_level) -> DataFrame:
    """Percentile interval of the mean of `diff`, one row per match.

    Resampling is by Poisson counts hashed from the match id. Each task adds its
    rows into `samples` running sums and emits those, so nothing the size of
    rows x samples is ever formed; a retried task gives the same numbers.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(samples), np.zeros(samples)
        step = max(1, (1 << 16) // max(samples, 1))  # what a core keeps close
        for batch in batches:
            ids, diff = batch.match_id.to_numpy(), batch["diff"].to_numpy()
            for at in range(0, len(ids), step):
                counts = _multiplicities(ids[at:at + step], samples, seed)
                total += diff[at:at + step] @ counts
                weight += counts.sum(axis=0)
        yield pd.DataFrame({"sample": np.arange(samples), "total": total, "weight": weight})

    sums = _spread(differences.select("match_id", "diff")).mapInPandas(partial, "sample bigint, total double, weight double")
    means = sums.groupBy("sample").agg((F.sum("total") / F.sum("weight")).alias("mean"))
    tail = (1.0 - level) / 2.0
    # One row per sample: `samples` rows.
    out = means.agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1.0 - tail)).alias("high"),
                    F.count(F.lit(1)).alias("samples"))
    return out.withColumn("improvement", differences.agg(F.avg("diff")).scalar()).withColumn("conclusive", F.col("low") > 0)


def _cell_losses(batch: pd.DataFrame, cells: np.ndarray) -> np.ndarray:
    """Log-loss of each row (down) in each cell of weight and draw rate (across)."""
    label, e = batch.label.to_numpy(), batch.elo_expected_home.to_numpy()[:, None]
    weight, draw = cells[:, 0], cells[:, 1]
    elo = np.where((label == 0)[:, None], (1 - e) * (1 - draw), np.where((label == 1)[:, None], draw + 0 * e, e * (1 - draw)))
    q = np.choose(label, [batch[f"q_{c}"].to_numpy() for c in CLASSES])[:, None]
    total = sum(batch[f"q_{c}"].to_numpy() for c in CLASSES)[:, None]
    mixed = ((1 - weight) * elo + weight * q) / ((1 - weight) + weight * total)
    return -np.log(np.clip(mixed, EPS, 1 - EPS))


def selection_bootstrap(scored: DataFrame, p: CrossLeagueParams = CROSS, samples: int = CROSS.bootstrap_samples,
                        seed: int = CROSS.bootstrap_seed) -> DataFrame:
    """How much better the best cell of the grid is than the configured one, with the choice made anew in every resample.

    `scored` carries match_id, elo_expected_home, q_* and label. One row: `improvement` (on all rows), its percentile
    interval `low`, `high`, `agreement` (share of resamples that pick the same cell), the best `weight` and `draw_rate`,
    `samples`, `matches`. A task multiplies blocks of Poisson counts and losses and sends one sum per sample and cell;
    sample -1 is the rows themselves. No rows give one row of nulls.
    """
    points = [(float(w), float(d)) for d in p.draw_grid for w in p.weight_grid]
    points.append((float(p.dixon_coles_weight), float(p.draw_rate)))  # the configured cell, in the grid or not
    cells = np.array(points)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros((samples + 1, len(cells))), np.zeros(samples + 1)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000]
                counts = np.column_stack([np.ones(len(part)), _multiplicities(part.match_id.to_numpy(), samples, seed)])
                total += counts.T @ _cell_losses(part, cells)
                weight += counts.sum(axis=0)
        for j in range(len(cells)):
            yield pd.DataFrame({"sample": np.arange(-1, samples), "cell": j, "total": total[:, j], "weight": weight})

    sums = _spread(scored.select("match_id", "elo_expected_home", "label", *[f"q_{c}" for c in CLASSES])).mapInPandas(
        partial, "sample int, cell int, total double, weight double")
    means = sums.groupBy("sample", "cell").agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("mean"), F.sum("weight").alias("n"))
    last = len(cells) - 1
    picked = means.groupBy("sample").agg(
        F.min(F.when(F.col("cell") < last, F.struct("mean", "cell"))).alias("best"), F.max(F.when(F.col("cell") == last, F.col("mean"))).alias("configured"),
        F.max("n").alias("n")).where("n > 0").select("sample", F.col("best.cell").alias("cell"), (F.col("configured") - F.col("best.mean")).alias("gain"), "n")
    whole = F.max(F.when(F.col("sample") == -1, F.struct("cell", "gain", "n")))
    drawn = F.when(F.col("sample") >= 0, F.col("gain"))
    tail = (1.0 - p.confidence_level) / 2.0
    # A row per sample from here.
    out = picked.agg(whole.alias("whole"), F.percentile(drawn, F.lit(tail)).alias("low"), F.percentile(drawn, F.lit(1.0 - tail)).alias("high"),
                     F.collect_list(F.when(F.col("sample") >= 0, F.col("cell"))).alias("cells"), F.count(drawn).alias("samples"))
    grid = F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(d).alias("draw_rate")) for w, d in points])
    best = F.get(grid, F.col("whole.cell"))
    same = F.size(F.filter("cells", lambda c: c == F.col("whole.cell"))) / F.nullif(F.col("samples"), F.lit(0))
    return out.select(F.col("whole.gain").alias("improvement"), "low", "high", same.alias("agreement"), best["weight"].alias("weight"),
                      best["draw_rate"].alias("draw_rate"), "samples", F.coalesce(F.col("whole.n"), F.lit(0.0)).cast("long").alias("matches"))
