"""Models over pixel tables: band correlations and selection, components, clusters, unmixing and classifiers.

Pixels are only ever aggregated or mapped; what reaches the driver is bands by bands or classes by bands.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
    MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgrid.operators.cube import robust_fit

#: Kinds of classifiers with the settings that aren't Spark's own.
KINDS = {
    "logistic": (LogisticRegression, {"maxIter": 50, "regParam": 1e-3}),
    "boosted": (GBTClassifier, {"maxIter": 10, "maxDepth": 3}),
    "forest": (RandomForestClassifier, {"numTrees": 50, "maxDepth": 6}),
    "tree": (DecisionTreeClassifier, {}),
    "perceptron": (MultilayerPerceptronClassifier, {"hidden": [16], "maxIter": 100}),
}


def complete(pixels: DataFrame, array: str = "features") -> DataFrame:
    """Pixels that have a value in each band."""
    return pixels.where(F.col(array).isNotNull() & F.forall(array, lambda v: v.isNotNull()))


def fill(pixels: DataFrame, fit: DataFrame, array: str = "features") -> DataFrame:
    """Pixels with the bands that have no value filled by the band's mean over ``fit`` (0 if no pixel there has one).

    A pixel without any value stays as it is. One row of means is broadcast.
    """
    means = fit.select(F.posexplode(array).alias("band", "v")).groupBy("band").agg(F.avg("v").alias("mean"))
    means = means.agg(F.map_from_entries(F.collect_list(F.struct("band", "mean"))).alias("_means"))
    filled = F.transform(array, lambda v, i: F.coalesce(v, F.col("_means")[i], F.lit(0.0)))
    known = F.exists(array, lambda v: v.isNotNull())
    return pixels.join(F.broadcast(means)).withColumn(array, F.when(known, filled).otherwise(F.col(array))).drop("_means")


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        lists = batch.column(0)
        if not len(lists):
            continue
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
        m = (~np.isnan(x)).astype(float)
        x = np.where(m > 0, x, 0.0)
        part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        total = part if total is None else total + part
    if total is not None:
        a, b = np.triu_indices(total.shape[1], 1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.array(t[a, b]) for t in total)], ["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])


def pair_correlation(pixels: DataFrame, array: str = "features", least: int = 50) -> DataFrame:
    """Correlation of each two bands over the pixels that have both: a < b, n, corr.

    A partition gives one matrix product, bands by bands, and the shuffle sums those; null for no more than ``least``
    pixels or for constant bands. All vectors must have as many values.
    """
    sums = pixels.where(F.col(array).isNotNull()).select(array).mapInArrow(_partial_moments, "a long, b long, n double, sa double, sb double, saa double, sbb double, sab double")
    sums = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    n, sa, sb, saa, sbb, sab = (F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab"))
    spread = (n * saa - sa * sa) * (n * sbb - sb * sb)
    return sums.select("a", "b", n.cast("long").alias("n"), F.when((n > least) & (spread > 1e-12), (n * sab - sa * sb) / F.sqrt(spread)).alias("corr"))


@dataclass(frozen=True)
class Spacing:
    """How densely bands are chosen in a segment: the length (nm) over which they go together, other lengths within windows
    (from, to, length), the share of the length that bands keep apart, the correlation that neighbours may have, and what is left
    out at both ends."""

    length: float = 30.0
    windows: tuple[tuple[float, float, float], ...] = ()
    factor: float = 0.85
    corr_limit: float = 0.99
    margins: tuple[float, float] = (0.0, 0.0)

    def at(self, wl: float) -> float:
        return next((n for low, high, n in self.windows if low <= wl <= high), self.length)


def band_candidates(bands: DataFrame, bonus: Column, spacings: dict[int, Spacing] | None = None, snr_quantile: float = 0.15, valid_floor: float = 0.45, anchor_quantile: float = 0.10, anchor_valid: float = 0.35) -> DataFrame:
    """Scores and first verdicts for bands (seg, band, wl, snr, valid_ratio).

    score is z(snr) + z(valid_ratio) / 2 + bonus within a segment; reason is null for bands that may be chosen; anchor_ok says
    whether a band passes the weaker limits of anchors.
    """
    w = Window.partitionBy("seg")  # the band dimension
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-6)
    quantile = lambda c, q: F.percentile(c, F.lit(q)).over(w)
    margin = lambda side: F.coalesce(F.create_map(*[F.lit(v) for s, r in (spacings or {}).items() for v in (s, r.margins[side])])[F.col("seg")], F.lit(0.0)) if spacings else F.lit(0.0)
    near = lambda distance, side: (margin(side) > 0) & (distance < margin(side))
    rows = bands.withColumn("score", z("snr") + 0.5 * z("valid_ratio") + bonus).withColumn("_left", near(F.col("wl") - F.min("wl").over(w), 0)).withColumn("_right", near(F.max("wl").over(w) - F.col("wl"), 1))
    few = F.col("valid_ratio").isNull() | (F.col("valid_ratio") < F.greatest(F.lit(valid_floor), quantile("valid_ratio", 0.25)))
    noisy = F.col("snr").isNull() | (F.col("snr") < quantile("snr", snr_quantile))
    reason = F.when(F.col("_left") | F.col("_right"), "margin").when(few, "few valid").when(noisy, "low snr")
    anchor = ~F.col("_left") & ~F.col("_right") & (F.col("valid_ratio") >= anchor_valid) & (F.col("snr") >= F.greatest(quantile("snr", anchor_quantile), F.lit(0.0)))
    return rows.select("seg", "band", "wl", "snr", "valid_ratio", "score", reason.alias("reason"), F.coalesce(anchor, F.lit(False)).alias("anchor_ok"))


def select_bands(candidates: DataFrame, pairs: DataFrame, spacings: dict[int, Spacing] | None = None, anchors: tuple[float, ...] = (), tolerance: float = 25.0) -> DataFrame:
    """Greedy choice in each segment, best score first: seg, band, wl, score, kept, reason.

    The band nearest to each anchor goes first, if it lies within ``tolerance`` and passes the weaker limits. A further band must
    keep the segment's spacing to all that are kept. Both must not correlate more than the segment allows with bands that are
    kept within half the length around them. A segment in which no band may be chosen has none. One task sees one segment's
    bands, a few hundred at most; pixels don't come here.
    """

    def choose(bands: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        corr = {(a, b): c for a, b, c in zip(links.a, links.b, links["corr"]) if not pd.isna(c)}
        bands = bands.sort_values("band").reset_index(drop=True)
        rule = (spacings or {}).get(int(bands.seg.iloc[0]), Spacing())
        wl, free = bands.wl.to_numpy(), bands.reason.isna().to_numpy()
        kept: list[int] = []
        verdict = dict(bands.reason[~free])

        def alike(i: int) -> bool:
            pair = lambda j: corr.get((min(bands.band[i], bands.band[j]), max(bands.band[i], bands.band[j])))
            return any((c := pair(j)) is not None and c > rule.corr_limit for j in kept if abs(wl[i] - wl[j]) < 0.5 * rule.at(wl[i]))

        for target in anchors if free.any() else ():
            i = int(np.abs(wl - target).argmin())
            if abs(wl[i] - target) <= tolerance and bands.anchor_ok[i] and i not in kept:
                verdict[i] = "anchor correlated" if alike(i) else "anchor"
                kept += [i] * (verdict[i] == "anchor")
        for i in bands[free].sort_values(["score", "band"], ascending=[False, True], na_position="last").index.tolist():
            if i in kept:
                continue
            if any(abs(wl[i] - wl[j]) < rule.factor * rule.at(wl[i]) for j in kept):
                verdict[i] = "too near"
            elif alike(i):
                verdict[i] = "correlated"
            else:
                verdict[i] = "score"
                kept.append(i)
        return bands[["seg", "band", "wl", "score"]].assign(kept=[i in kept for i in bands.index], reason=[verdict[i] for i in bands.index])

    side = lambda c: F.broadcast(candidates.select(F.col("seg").alias("link_seg"), F.col("band").alias(c)))  # noqa: E731  (the band dimension)
    links = pairs.join(side("a"), "a").join(side("b"), ["link_seg", "b"]).select("link_seg", "a", "b", "corr")
    return candidates.groupBy("seg").cogroup(links.groupBy("link_seg")).applyInPandas(choose, "seg long, band long, wl double, score double, kept boolean, reason string")


def pca_fit(pixels: DataFrame, k: int = 3, array: str = "features") -> tuple[list[float], list[list[float]], list[float]]:
    """Means, k components and their shares of variance over complete pixels. A component's largest loading is positive."""
    rows = complete(pixels, array).select(array_to_vector(array).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="pc").fit(rows)
    means = rows.select(Summarizer.mean(F.col("v")).alias("m")).first().m.toArray().tolist()
    parts = model.pc.toArray().T
    parts = parts * np.sign(parts[np.arange(k), np.abs(parts).argmax(axis=1)])[:, None]
    return means, parts.tolist(), model.explainedVariance.toArray().tolist()


def _dot(array: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(array, F.lit(weights), lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)


def pca_project(array: str, means: list[float], parts: list[list[float]]) -> list[Column]:
    """Columns pc1, pc2, …; null where a band has no value."""
    centred = F.zip_with(array, F.lit(means), lambda v, m: v - m)
    return [_dot(centred, w).alias(f"pc{i}") for i, w in enumerate(parts, 1)]


def cross_singular_values(rows: DataFrame, left: list[str], right: list[str]) -> list[float]:
    """Singular values of the correlations between two small sets of columns."""
    got = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a in left for b in right]).first()
    return np.linalg.svd(np.array(got, dtype=float).reshape(len(left), len(right)), compute_uv=False).tolist()


def clusters(pixels: DataFrame, k: int = 5, iterations: int = 30, seed: int = 42, array: str = "features") -> DataFrame:
    """Complete pixels with the cluster of k-means that each falls into."""
    rows = complete(pixels, array).withColumn("_v", array_to_vector(array))
    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("_v")


def mean_spectra(pixels: DataFrame, by: str, array: str = "features") -> dict[int, list[float]]:
    """The mean vector of each class over complete pixels; there must be few classes."""
    rows = complete(pixels, array).groupBy(by).agg(Summarizer.mean(array_to_vector(array)).alias("m"))
    return {r[by]: r.m.toArray().tolist() for r in rows.orderBy(by).collect()}


def unmix(pixels: DataFrame, endmembers: dict[int, list[float]], array: str = "features") -> DataFrame:
    """Shares of each endmember by least squares without constraints, and the endmember with the largest, first of equals."""
    solve = np.linalg.pinv(np.array(list(endmembers.values())).T)
    shares = F.array(*[_dot(F.col(array), w.tolist()) for w in solve])
    top = F.element_at(F.lit(list(endmembers)), F.array_position("shares", F.array_max("shares")).cast("int"))
    return complete(pixels, array).withColumn("shares", shares).withColumn("endmember", top)


@dataclass(frozen=True)
class Classifier:
    """A fitted classifier with the scaling of its features (median and interquartile range of each)."""

    model: Model
    median: list[float]
    iqr: list[float]
    info: dict

    def scores(self, rows: DataFrame, array: str = "features") -> DataFrame:
        """Complete ``rows`` with y_prob."""
        scored = self.model.transform(_scaled(complete(rows, array), array, self.median, self.iqr))
        return scored.withColumn("y_prob", vector_to_array("probability")[1]).drop("_x", "_p", "rawPrediction", "probability")

    def save(self, spark: SparkSession, path: str) -> None:
        """The model in Spark's own format, and beside it the scaling and what else is known, as JSON."""
        self.model.write().overwrite().save(f"{path}/model")
        one = [(json.dumps({"median": self.median, "iqr": self.iqr, "class": type(self.model).__name__, "info": self.info}, sort_keys=True),)]
        spark.createDataFrame(one, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load_classifier(spark: SparkSession, path: str) -> Classifier:
    about = json.loads(spark.read.text(f"{path}/info").first().value)
    kinds = {k.__name__: k for k in (LogisticRegressionModel, GBTClassificationModel, RandomForestClassificationModel, DecisionTreeClassificationModel, MultilayerPerceptronClassificationModel)}
    return Classifier(kinds[about["class"]].load(f"{path}/model"), about["median"], about["iqr"], about["info"])


def _scaled(rows: DataFrame, array: str, median: list[float], iqr: list[float]) -> DataFrame:
    centred = F.zip_with(array, F.lit(median), lambda v, m: v - m)
    return rows.withColumn("_x", array_to_vector(F.zip_with(centred, F.lit([s or 1.0 for s in iqr]), lambda v, s: v / s)))


def scaling(train: DataFrame, array: str = "features", label: str = "y_true") -> tuple[list[float], list[float]]:
    """The exact median and interquartile range of each feature over the rows that a classifier would be fitted on."""
    fit = robust_fit(complete(train.where(F.col(label).isNotNull()), array), array).orderBy("band").collect()
    return [r.median for r in fit], [r.iqr for r in fit]


def fit_classifier(train: DataFrame, kind: str = "logistic", array: str = "features", label: str = "y_true", seed: int = 42, scale: bool | tuple[list[float], list[float]] = True, stop_on: str | None = None, **settings) -> Classifier:
    """A classifier fitted on complete rows; both classes weigh the same, and features are scaled by their exact median and
    interquartile range. ``kind`` is one of KINDS; ``settings`` are the classifier's own.

    ``scale``: a :func:`scaling` that is known, for several fits on the same rows, or false for features that come scaled.
    ``stop_on``: a boolean column of rows on which boosting is judged after each tree, and ends when they gain no more; they have
    no part in the fit or the scaling. Rows are read in several passes: keep what is costly to work out.
    """
    if stop_on and kind != "boosted":
        raise ValueError(f"{kind} can't be stopped early")
    train = complete(train.where(F.col(label).isNotNull()), array)
    fitted = train.where(~F.col(stop_on)) if stop_on else train
    n, pos, size = fitted.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("long")), F.max(F.size(array))).first()
    if not pos or pos == n:
        raise ValueError("the training rows hold one class only")
    median, iqr = scale if isinstance(scale, tuple) else scaling(fitted, array, label) if scale else ([0.0] * size, [1.0] * size)
    cls, own = KINDS[kind]
    own = own | settings | ({} if kind == "logistic" else {"seed": seed}) | {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "_p"}
    rows = train.withColumn("_y", F.col(label).cast("double"))
    if kind == "perceptron":  # has no weights: rows of the rarer class are repeated
        own["layers"] = [len(median), *own.pop("hidden"), 2]
        times = max(1, round(max(pos, n - pos) / min(pos, n - pos)))
        rows = rows.withColumn("_w", F.explode(F.sequence(F.lit(1), F.when((F.col(label) == 1) == F.lit(pos < n - pos), times).otherwise(1))))
    else:
        rows, own["weightCol"] = rows.withColumn("_w", F.when(F.col(label) == 1, F.lit((n - pos) / pos)).otherwise(1.0)), "_w"
    if stop_on:
        own["validationIndicatorCol"] = stop_on
    model = cls(**own).fit(_scaled(rows, array, median, iqr))
    info = {"kind": kind, "rows": n, "settings": settings} | ({"trees": model.getNumTrees} if kind in ("boosted", "forest") else {})
    return Classifier(model, median, iqr, info)


def classifier_scores(train: DataFrame, rows: DataFrame, kind: str = "logistic", array: str = "features", label: str = "y_true", seed: int = 42, **settings) -> DataFrame:
    """``rows`` with y_prob from a classifier fitted on ``train``; ``settings`` go to :func:`fit_classifier`."""
    return fit_classifier(train, kind, array, label, seed, **settings).scores(rows, array)


def importances(train: DataFrame, array: str = "features", label: str = "y_true", seed: int = 42) -> DataFrame:
    """How much each feature gives to a forest: feature (its place), importance; they sum to 1."""
    rows = complete(train, array).where(F.col(label).isNotNull()).select(array_to_vector(array).alias("_x"), F.col(label).cast("double").alias("_y"))
    cls, own = KINDS["forest"]
    found = cls(**own, seed=seed, featuresCol="_x", labelCol="_y").fit(rows).featureImportances.toArray().tolist()
    return train.sparkSession.createDataFrame(list(enumerate(found)), "feature int, importance double")
