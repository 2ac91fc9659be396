"""Training queries use the published settings; shared preparation gives the results of separate fits."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kickframe.params import TRAINING
from kickframe.plans import training as tr
from kickframe.workload import modelling

KEYS = ["cross_validate", "base_models", "soft_vote", "calibrate", "feature_importance", "hyper_search", "predict_fixtures", "domestic_blend_tune"]


class Seen(Exception):
    pass


def tiny(spark):
    rows = spark.range(240).select(
        F.col("id").alias("match_id"), F.expr("date_add(date'2020-01-01', cast(id AS int))").alias("match_date"),
        F.pmod(F.xxhash64("id"), F.lit(3)).cast("int").alias("label"), F.col("id").alias("idx"))
    return rows.withColumn("a", F.col("label") + F.rand(3)).withColumn("b", F.rand(4))


@pytest.mark.parametrize("key", KEYS)
def test_queries_use_the_published_settings(spark, small, monkeypatch, key):
    def seen(*args, **named):
        raise Seen(*[a for a in (*args, *named.values()) if isinstance(a, tr.TrainingParams)])
    monkeypatch.setattr(modelling, "training_rows", lambda spark, sf: tiny(spark))
    for name in ("fit_ensemble", "cross_validate", "build_ensemble", "hyper_search"):
        monkeypatch.setattr(tr, name, seen)
    with pytest.raises(Seen) as error:
        modelling.QUERIES[key](spark, small)
    assert error.value.args == (TRAINING,)


def test_a_search_scores_draws_as_separate_validations_do(spark):
    p = replace(TRAINING, folds=2, search_draws=2, search_grid={
        "n_estimators": [1, 3], "max_depth": [2], "learning_rate": [0.1], "subsample": [0.8], "colsample_bytree": [1.0]})
    rows = tr.cut(tiny(spark))
    got = tr.hyper_search(rows, ["a", "b"], p).collect()
    assert len(got) == 2 and sum(r.is_best for r in got) == 1
    for r in got:
        tuned = replace(p, gbt_rounds=int(r.n_estimators), gbt_depth=2, gbt_rate=0.1, gbt_subsample=0.8, gbt_columns=1.0)
        want = tr.cross_validate(rows, ["a", "b"], tuned, names=("boosted",)).first()
        assert r.log_loss_mean == pytest.approx(want.log_loss_mean, abs=1e-9)


def test_the_forest_keeps_node_numbers_and_grows_the_same_trees(spark):
    ready = tr.prepare(tr.cut(tiny(spark).withColumn("c", F.rand(5))), ["a", "b", "c"])
    forest = tr.base_models(ready.total_weight, replace(TRAINING, rf_trees=5, rf_depth=4))["forest"]
    assert forest.getCacheNodeIds()
    kept = forest.fit(ready.rows)
    walked = forest.copy().setCacheNodeIds(False).fit(ready.rows)
    assert kept.toDebugString == walked.toDebugString
