"""Training: models are fitted side by side on rows that are read once, with the areas of MLlib's cross-validation."""

import threading

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from driftwell.operators import modelling as md


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    x = spark.range(300).select(
        i.alias("key"), (i % 2).cast("int").alias("y"), F.when(i % 11 > 0, (i * 37 % 101) / 100 + (i % 2) * 0.3).alias("a"), ((i * 53 % 97) / 90).alias("b"),
        F.when(i % 10 < 7, "train").when(i % 10 == 7, "val").otherwise("test").alias("split"), F.when(i % 3 > 0, 1).otherwise(0).alias("present_one"), F.lit(1).alias("present_two"),
    )
    return x.localCheckpoint()


@pytest.fixture
def together(monkeypatch):
    """The largest number of pipelines that were fitted at the same time."""
    real, lock, seen = Pipeline.fit, threading.Lock(), {"now": 0, "most": 0, "all": 0}

    def fit(self, *args):
        with lock:
            seen["now"] += 1
            seen["all"] += 1
            seen["most"] = max(seen["most"], seen["now"])
        try:
            return real(self, *args)
        finally:
            with lock:
                seen["now"] -= 1

    monkeypatch.setattr(Pipeline, "fit", fit)
    return seen


def test_candidates_and_folds_are_fitted_side_by_side(spark, rows, together):
    model, report = md.train_modality(rows, "key", "y", ["a", "b"], folds=3, trees=3, rounds=2)
    assert together["all"] == 12 and together["most"] > 2
    train = md.with_folds(rows.where("split = 'train'"), "key", "y", 3)
    evaluator = BinaryClassificationEvaluator(labelCol="y", metricName="areaUnderROC")
    areas = []
    for (name, estimator), row in zip(md.candidates("y", trees=3, rounds=2).items(), report, strict=True):
        cv = CrossValidator(estimator=Pipeline(stages=[*md.feature_stages(["a", "b"]), estimator]), estimatorParamMaps=ParamGridBuilder().build(), evaluator=evaluator, numFolds=3, foldCol="fold")
        fitted = cv.fit(train)
        areas.append(evaluator.evaluate(fitted.bestModel.transform(rows.where("split = 'val'"))))
        # Forests draw their rows by partition, so their areas follow the layout a little.
        near = {"abs": 0.15} if name == "random_forest" else {}
        assert row == (name, pytest.approx(fitted.avgMetrics[0], **near), pytest.approx(areas[-1], **near))
    assert evaluator.evaluate(model.transform(rows.where("split = 'val'"))) == pytest.approx(max(r[2] for r in report))


def test_an_empty_fold_is_refused(spark, rows):
    with pytest.raises(ValueError):
        md.train_modality(rows.where("key < 3"), "key", "y", ["a"], folds=5, trees=2, rounds=2)


def test_training_rows_are_spread_and_none_is_lost(spark, rows, monkeypatch):
    monkeypatch.setattr(md, "ROWS", 50)
    one = rows.coalesce(1)
    held = md.dealt(one.unionByName(one.limit(5)))
    assert held.count() == 305 and held.rdd.getNumPartitions() == 7
    held.unpersist()
