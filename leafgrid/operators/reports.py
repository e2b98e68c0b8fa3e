"""Reports over scenes and models: ablation of features, controls on patches, extents of polygons, and searches of settings."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions.columns import portable_hash
from leafgrid.operators.metrics import best_threshold, ranking_metrics
from leafgrid.operators.models import KINDS, Classifier, classifier_scores, fit_classifier, scaling
from leafgrid.sources.store import kept


def ablation(rows: DataFrame, conditions: dict[str, list[int]], means: Column, predict: Callable[[Column], Column], array: str = "features") -> DataFrame:
    """Ranking metrics of ``predict`` where the features of each condition give way to their ``means``.

    All conditions are scored in one pass: a row is repeated once for each. Columns: condition, average_precision,
    roc_auc; delta and delta_percent against the condition with no features; effect: none, weak or strong.
    """
    listed = F.array(*[F.struct(F.lit(name).alias("condition"), F.array(*map(F.lit, which)).cast("array<int>").alias("which")) for name, which in conditions.items()])
    each = rows.select("y_true", F.col(array).alias("_f"), means.alias("_m"), F.explode(listed).alias("c")).select("y_true", "_m", "c.*", "_f")
    changed = F.transform("_f", lambda v, i: F.when(F.array_contains("which", i), F.element_at("_m", i + 1)).otherwise(v))
    scored = each.withColumn("_f", changed).select("condition", "y_true", predict(F.col("_f")).alias("y_prob"))
    (base,) = [name for name, which in conditions.items() if not which]
    got = ranking_metrics(scored, "condition")
    kept = F.max(F.when(F.col("condition") == base, F.col("average_precision"))).over(Window.partitionBy())  # one row for each condition
    got = got.withColumn("delta", kept - F.col("average_precision")).withColumn("delta_percent", 100 * F.col("delta") / F.when(kept > 0, kept))
    return got.withColumn("effect", F.when(F.col("delta") < 0.02, "none").when(F.col("delta") < 0.05, "weak").otherwise("strong"))


def centre_only(patch: Column, r: int) -> Column:
    """The patch with zeros everywhere but in its centre."""
    return F.transform(patch, lambda rows: F.transform(rows, lambda row, i: F.transform(row, lambda v, j: F.when((i == r) & (j == r), v).otherwise(0.0))))


def permuted(patch: Column, place: Column, seed: int = 42) -> Column:
    """The patch with its channels in an order that depends on ``place`` (a number) and the seed."""
    # The hash has no ties within a patch of fewer than 4096 channels.
    keyed = F.transform(patch, lambda rows, c: F.struct(portable_hash(place * 4096 + c, seed).alias("k"), rows.alias("rows")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a.k < b.k, -1).when(a.k > b.k, 1).otherwise(0)), lambda s: s.rows)


def extents(polygons: DataFrame) -> DataFrame:
    """Bounds, area and centroid of polygons (id, rings of x and y); rings after the first are holes, whatever their turn."""
    ring = F.posexplode("rings").alias("ring", "points")
    rows = polygons.select("id", ring).select("id", "ring", F.posexplode("points").alias("i", "p"), F.col("points").alias("all"))
    rows = rows.select("id", "ring", "p.x", "p.y", F.element_at("all", ((F.col("i") + 1) % F.size("all") + 1).cast("int")).alias("q"), F.col("all")[0].alias("o"))
    # Moments are taken from the ring's first point, so that large map coordinates lose no digits.
    x0, y0, x1, y1 = F.col("x") - F.col("o.x"), F.col("y") - F.col("o.y"), F.col("q.x") - F.col("o.x"), F.col("q.y") - F.col("o.y")
    cross = x0 * y1 - x1 * y0
    of_ring = rows.groupBy("id", "ring").agg(
        *[f(c).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.min, "y", "y0"), (F.max, "x", "x1"), (F.max, "y", "y1"))],
        F.first("o").alias("o"), F.sum(cross).alias("a"), F.sum((x0 + x1) * cross).alias("mx"), F.sum((y0 + y1) * cross).alias("my"),
    )
    area = F.abs("a") / 2 * F.when(F.col("ring") == 0, 1).otherwise(-1)
    middle = lambda m, o: F.coalesce(F.col(m) / (3 * F.when(F.col("a") != 0, F.col("a"))), F.lit(0.0)) + F.col(o)
    of_ring = of_ring.select("*", area.alias("area"), (area * middle("mx", "o.x")).alias("wx"), (area * middle("my", "o.y")).alias("wy"))
    got = of_ring.groupBy("id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("area").alias("area"), F.sum("wx").alias("wx"), F.sum("wy").alias("wy"))
    whole = F.when(F.col("area") != 0, F.col("area"))
    return got.select("id", "x0", "y0", "x1", "y1", "area", (F.col("wx") / whole).alias("cx"), (F.col("wy") / whole).alias("cy"))


def containment(found: DataFrame, scene: tuple[float, float, float, float]) -> DataFrame:
    """Extents (x0, y0, x1, y1) with within, whether they lie in the scene's, and meets, whether they share any of its inside."""
    x0, y0, x1, y1 = scene
    within = (F.col("x0") >= x0) & (F.col("y0") >= y0) & (F.col("x1") <= x1) & (F.col("y1") <= y1)
    meets = (F.col("x1") > x0) & (F.col("y1") > y0) & (F.col("x0") < x1) & (F.col("y0") < y1)
    return found.withColumn("within", within).withColumn("meets", meets)


def draws(n: int, ranges: dict[str, tuple[float, float]], seed: int = 42) -> list[dict[str, float]]:
    """Random settings, uniform in the logarithm of each range."""
    rng = np.random.default_rng(seed)
    return [{k: float(np.exp(rng.uniform(np.log(a), np.log(b)))) for k, (a, b) in ranges.items()} for _ in range(n)]


def search(rows: DataFrame, trials: list[dict[str, float]], kind: str = "logistic", folds: int = 3, at_once: int = 4) -> DataFrame:
    """Settings of a classifier by their mean average precision over folds: trial, settings, mean_ap, std_ap, best_fold.

    ``rows`` has features, y_true and fold (0 to ``folds`` - 1). Fits run as Spark jobs, some at once; what returns is one
    figure for each trial and fold.
    """
    spark = rows.sparkSession
    rows = rows.select("features", "y_true", "fold").persist()

    def judge(at: tuple[int, int]) -> tuple[int, int, float | None]:
        trial, fold = at
        scored = classifier_scores(rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold), kind, scale=scales[fold], **trials[trial])
        return trial, fold, ranking_metrics(scored.select("y_true", "y_prob")).first()["average_precision"]

    try:
        with ThreadPoolExecutor(at_once) as pool:
            scales = list(pool.map(lambda fold: scaling(rows.where(F.col("fold") != fold)), range(folds)))
            found = list(pool.map(judge, [(t, f) for t in range(len(trials)) for f in range(folds)]))
    finally:
        rows.unpersist()
    got = spark.createDataFrame(found, "trial int, fold int, ap double").groupBy("trial").agg(F.avg("ap").alias("mean_ap"), F.stddev_pop("ap").alias("std_ap"), F.max_by("fold", F.struct("ap", -F.col("fold"))).alias("best_fold"))
    settings = spark.createDataFrame(list(enumerate(trials)), "trial int, settings map<string,double>")
    return got.join(settings, "trial").orderBy(F.col("mean_ap").desc(), "trial")


def transposed(report: DataFrame, names: str, into: str = "column") -> DataFrame:
    """A small report turned over: a row for each of its numeric columns, and a column for each of its rows, named by ``names``.

    Names must be there once each; they are read by the driver, as columns need them.
    """
    columns = [c for c in report.columns if c != names]
    found = [r[0] for r in report.select(F.col(names).cast("string")).orderBy(names).limit(1001).collect()]
    if len(found) > 1000 or len(set(found)) < len(found) or None in found:
        raise ValueError(f"{names} must name at most 1000 rows, each once")
    long = report.select(F.col(names).cast("string").alias("_name"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["_name"], columns, into, "_value")
    return long.groupBy(into).pivot("_name", found).agg(F.first("_value"))


def screen(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Each kind of classifier with its ranking metrics over ``rows``, best first: model, average_precision, roc_auc."""
    found, scale = None, scaling(train)
    for kind in KINDS:
        one = classifier_scores(train, rows, kind, scale=scale).select(F.lit(kind).alias("model"), "y_true", "y_prob")
        found = one if found is None else found.unionByName(one)
    return ranking_metrics(found, "model").orderBy(F.col("average_precision").desc(), "model")


def train_by_folds(rows: DataFrame, fold: Column, folds: int, stop: Column | None = None, kind: str = "boosted", at_once: int = 3, **settings) -> tuple[Classifier, float, DataFrame]:
    """A classifier of all rows (features, y_true), the threshold of best macro-F1, and the scores that it comes from.

    Each row is scored once, by a model of the other folds (``fold``, from 0 to ``folds`` - 1), whose scaling and class weights come
    from these alone; the threshold is the best one over all such scores. ``stop`` says which rows of the training folds boosting
    is judged on, to end early. The model of all rows grows as many trees as the folds' did in the mean, for want of rows to
    judge it on. Rows that lack features or a label are left out. Fits run as Spark jobs, some at once.
    """
    rows = rows.withColumn("_fold", fold.cast("int")).withColumn("_stop", stop if stop is not None else F.lit(False)).persist()
    stop_on = "_stop" if stop is not None else None

    def fit(k: int) -> Classifier:
        return fit_classifier(rows.where(F.col("_fold") != k), kind, stop_on=stop_on, **settings)

    try:
        with ThreadPoolExecutor(at_once) as pool:
            models = list(pool.map(fit, range(folds)))
        parts = [m.scores(rows.where(F.col("_fold") == k)).withColumn("trees", F.lit(m.info.get("trees"))) for k, m in enumerate(models)]
        scores = kept(reduce(DataFrame.unionByName, parts).where(F.col("y_true").isNotNull()).withColumnRenamed("_fold", "fold").drop("_stop"))
        threshold = best_threshold(scores.select("y_true", "y_prob")).first()["threshold"]
        if stop is not None:
            settings["maxIter"] = max(1, round(sum(m.info["trees"] for m in models) / folds))
        return fit_classifier(rows, kind, **settings), threshold, scores
    finally:
        rows.unpersist()
