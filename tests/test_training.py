"""Training by folds: no row is scored by a model that has seen it, boosting stops early, scaling is the training folds' own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.operators import models, reports
from leafgrid.operators.metrics import best_threshold, ranking_metrics

FOLDS = 3


@pytest.fixture(scope="module")
def noise(spark):
    """Labels that nothing tells but the row itself."""
    r = np.random.default_rng(12)
    rows = [(i, r.normal(size=4).tolist(), int(r.random() < 0.4)) for i in range(360)] + [(360, None, 1), (361, [1.0, None, 0.0, 0.0], 0), (362, [0.0] * 4, None)]
    return spark.createDataFrame(rows, "id long, features array<double>, y_true int").cache()


def test_each_row_is_scored_once_by_a_stranger(spark, noise):
    stop = F.col("id") % 4 == 0
    model, threshold, scores = reports.train_by_folds(noise, F.col("id") % FOLDS, FOLDS, stop, maxIter=25, maxDepth=4)
    got = scores.collect()
    assert sorted(r.id for r in got) == list(range(360)) and all(r.fold == r.id % FOLDS for r in got)
    ap = ranking_metrics(scores.select("y_true", "y_prob")).first()["average_precision"]
    seen = ranking_metrics(models.fit_classifier(noise, "boosted", maxIter=25, maxDepth=4).scores(noise).select("y_true", "y_prob")).first()["average_precision"]
    assert ap < 0.55 and seen > 0.8  # a model that has seen a row knows it by heart
    assert threshold == best_threshold(scores.select("y_true", "y_prob")).first()["threshold"]
    trees = {r.fold: r.trees for r in got}
    assert all(n < 25 for n in trees.values()) and model.info["trees"] == max(1, round(sum(trees.values()) / FOLDS)) and model.info["rows"] == 360


def test_scaling_is_of_the_rows_that_are_fitted(spark, noise):
    rows = noise.withColumn("stop", F.col("id") % 2 == 0)
    one = models.fit_classifier(rows, "boosted", stop_on="stop", maxIter=3)
    own = rows.where("id % 2 = 1 and id < 360")
    assert (one.median, one.iqr) == models.scaling(own) and one.info["rows"] == 180
    with pytest.raises(ValueError, match="can't be stopped early"):
        models.fit_classifier(rows, "logistic", stop_on="stop")
    same = models.fit_classifier(noise, "logistic", scale=models.scaling(noise))
    plain = models.fit_classifier(noise, "logistic")
    assert (same.median, same.iqr) == (plain.median, plain.iqr) and models.fit_classifier(noise, "tree", scale=False).iqr == [1.0] * 4
