"""Registered queries run the reference's whole settings."""

import datetime
import inspect

from pyspark.sql import functions as F

from barline.operators import kernels, learning, regimes, trees
from barline.plans import frames, registry


def test_walk_forward_queries_use_all_folds_and_the_boosted_trees(monkeypatch):
    asked = []
    monkeypatch.setattr(learning, "models", lambda df, **given: asked.append((df, given)) or "models")
    monkeypatch.setattr(frames, "featured", lambda s, f: "bars")
    for name in ("predictions", "importances"):
        monkeypatch.setattr(learning, name, lambda made, name=name: (name, made))
    for name in ("fold_report", "threshold_sweep", "importance_report"):
        monkeypatch.setattr(learning, name, lambda df, *_, name=name, **__: (name, df[0]))
    made = {n: registry.ALL[n].make(None, "") for n in ("ml_05_walk_forward", "ml_07_fold_report_model", "ml_07_importance_report", "ml_08_threshold_sweep_model")}
    assert list(made.values()) == [("predictions", "models"), ("fold_report", "predictions"), ("importance_report", "importances"), ("threshold_sweep", "predictions")]
    assert asked == [("bars", {})] * 4 and learning.Folds().n_folds == 5
    assert (trees.MODELS["xgboost"].n, trees.MODELS["xgboost"].depth, trees.MODELS["random_forest"].least) == (200, 4, 20)


def test_hmm_queries_fit_up_to_the_kernels_own_steps(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(frames, "featured", lambda s, f: "bars")
    monkeypatch.setattr(regimes, "hmm", lambda df, **given: asked.append(given))
    for name in ("reg_04_hmm_smoothed", "reg_06_hmm_online"):
        registry.ALL[name].make(None, "")
    monkeypatch.undo()
    assert asked == [{"online": False}, {}]
    assert inspect.signature(regimes.hmm).parameters["steps"].default == kernels.GaussianHMM().steps == 100


def test_pooled_walk_forward_predicts_every_test_row_of_every_fold(spark):
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))
    bars = spark.range(400).select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("symbol"), day.alias("d"), (F.col("id") % 7).cast("double").alias("known"), F.when(F.col("id") % 11 > 0, F.rand(1)).alias("noise"))
    bars = bars.withColumn("returns_fwd_5", F.when(F.col("d") < "2021-01-30", F.col("known") / 100))
    predictions, importances = learning.pooled_walk_forward(bars, estimator=learning.model("xgboost").setMaxIter(3))
    told = predictions.toPandas()
    assert told.groupby(["fold_id", "symbol"]).size().to_dict() == {(k, s): 63 for k in (0, 1) for s in "AB"}
    known = told.dropna(subset=["target"])
    assert known["prediction"].corr(known["target"]) > 0.9 and told["prediction"].notna().all()
    weights = importances.toPandas().pivot(index="fold_id", columns="feature", values="importance")
    assert weights.index.tolist() == [0, 1] and (weights.sum(axis=1).round(6) == 1).all() and (weights["known"] > weights["noise"]).all()


def test_pooled_walk_forward_without_enough_bars_predicts_nothing(spark):
    few = spark.createDataFrame([("A", datetime.date(2020, 1, 1), 1.0, 0.1)], "symbol string, d date, known double, returns_fwd_5 double")
    predictions, importances = learning.pooled_walk_forward(few)
    assert predictions.count() == importances.count() == 0
