"""Evaluation of scores: y_true 0/1 and y_prob, over whole tables or by groups. Cumulative sums run over distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.operators.ranks import running_totals


def score_steps(scores: DataFrame, *by: str) -> DataFrame:
    """One row for each distinct score, from the highest: tp, fp, and cumulative ctp, cfp, with the totals p and n.

    Rows are combined first; then distinct scores are summed up in cells, so no task sees all of them.
    """
    groups = scores.groupBy(*by, "y_prob").agg(F.sum(F.col("y_true").cast("long")).alias("tp"), F.sum(1 - F.col("y_true").cast("long")).alias("fp"))
    return running_totals(groups, "y_prob", ["tp", "fp"], *by).withColumnsRenamed({"c_tp": "ctp", "c_fp": "cfp", "t_tp": "p", "t_fp": "n"})


def ranking_metrics(scores: DataFrame, *by: str) -> DataFrame:
    """Average precision (step-wise) and the area under the ROC curve (ties count half); null if a class is missing."""
    steps = score_steps(scores, *by)
    ap = F.sum(F.col("tp") / F.when(F.col("p") > 0, F.col("p")) * F.col("ctp") / (F.col("ctp") + F.col("cfp")))
    roc = F.sum(F.col("fp") / F.when(F.col("n") > 0, F.col("n")) * (F.col("ctp") - F.col("tp") / 2) / F.when(F.col("p") > 0, F.col("p")))
    return steps.groupBy(*by).agg(ap.alias("average_precision"), roc.alias("roc_auc"))


def curve_points(scores: DataFrame, *by: str) -> DataFrame:
    """Points of the ROC and of the precision-recall curve by falling score."""
    return score_steps(scores, *by).select(*by, "y_prob", (F.col("cfp") / F.when(F.col("n") > 0, F.col("n"))).alias("fpr"), (F.col("ctp") / F.when(F.col("p") > 0, F.col("p"))).alias("recall"), (F.col("ctp") / (F.col("ctp") + F.col("cfp"))).alias("precision"))


def _f1(tp, fp, fn):
    bottom = 2 * tp + fp + fn
    return F.when(bottom > 0, 2 * tp / F.when(bottom > 0, bottom)).otherwise(0.0)


def _counts(y, p):
    one = lambda a, b: F.sum(F.when((y == a) & (p == b), 1).otherwise(0))
    return one(1, 1), one(0, 1), one(1, 0), one(0, 0)


def threshold_metrics(scores: DataFrame, threshold: float, *by: str) -> DataFrame:
    """F1 (macro), recall and precision of class 1 and accuracy at a threshold; 0 where a ratio has nothing below."""
    pred = (F.col("y_prob") >= threshold).cast("int")
    tp, fp, fn, tn = _counts(F.col("y_true"), pred)
    got = scores.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    return got.select(*by, ((_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2).alias("f1_macro"), ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def best_threshold(scores: DataFrame, low: float = 0.1, high: float = 0.9, points: int = 161) -> DataFrame:
    """The grid threshold with the highest macro-F1, of equals the lowest: threshold, f1_macro.

    Scores fall into the cells between grid points, so one aggregation and cumulative sums over the grid decide.
    """
    step = (high - low) / (points - 1)
    # How many grid points the score reaches; a small allowance takes rounding of the grid into account.
    cell = F.least(F.lit(points), F.greatest(F.lit(0), (F.floor((F.col("y_prob") - low) / step + 1e-9) + 1).cast("int")))
    cells = scores.groupBy(cell.alias("cell")).agg(F.sum(F.col("y_true").cast("long")).alias("pos"), F.sum(1 - F.col("y_true").cast("long")).alias("neg"))
    grid = scores.sparkSession.range(0, points + 1).select(F.col("id").cast("int").alias("cell"))
    w = Window.orderBy(F.col("cell").desc())
    rows = grid.join(cells, "cell", "left").na.fill(0, ["pos", "neg"])
    rows = rows.select("cell", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("pos").over(Window.partitionBy()).alias("p"), F.sum("neg").over(Window.partitionBy()).alias("n")).where("cell > 0")
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    rows = rows.select((F.lit(low) + (F.col("cell") - 1) * step).alias("threshold"), ((_f1(tp, fp, p - tp) + _f1(n - fp, p - tp, fp)) / 2).alias("f1_macro"))
    return rows.orderBy(F.round("f1_macro", 12).desc(), "threshold").limit(1)


def confusion(scores: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Counts by truth and prediction with shares of the row, the column and all."""
    pred = (F.col("y_prob") >= threshold).cast("int")
    counts = scores.groupBy(*by, F.col("y_true").cast("int").alias("y_true"), pred.alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    share = lambda *over: F.col("n") / F.sum("n").over(Window.partitionBy(*by, *over))
    return counts.select("*", share("y_true").alias("of_row"), share("y_pred").alias("of_column"), share().alias("of_all"))


def classification_report(scores: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    pred = (F.col("y_prob") >= threshold).cast("int")
    tp, fp, fn, tn = _counts(F.col("y_true"), pred)
    one = scores.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    rows = one.select(F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("tp").alias("hit"), F.col("fp").alias("over"), F.col("fn").alias("missed")), F.struct(F.lit(0).alias("label"), F.col("tn").alias("hit"), F.col("fn").alias("over"), F.col("fp").alias("missed")))).alias("r")).select("r.*")
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    hit, over, missed = F.col("hit"), F.col("over"), F.col("missed")
    return rows.select("label", ratio(hit, hit + over).alias("precision"), ratio(hit, hit + missed).alias("recall"), _f1(hit, over, missed).alias("f1"), (hit + missed).alias("support"))


def report_averages(report: DataFrame) -> DataFrame:
    """Plain means over the classes of :func:`classification_report`, and means weighted by support."""
    cols = ("precision", "recall", "f1")
    means = lambda name, f: F.struct(F.lit(name).alias("average"), *[f(c).alias(c) for c in cols], F.sum("support").alias("support"))
    total = F.sum("support")
    both = report.agg(means("macro", F.avg).alias("a"), means("weighted", lambda c: F.sum(F.col(c) * F.col("support")) / F.when(total > 0, total)).alias("b"))
    return both.select(F.explode(F.array("a", "b")).alias("r")).select("r.*")


def group_metrics(scores: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Per group: n_px, n_pos, ranking metrics (null if a class is missing), F1, precision and recall of class 1 and accuracy."""
    pred = (F.col("y_prob") >= threshold).cast("int")
    tp, fp, fn, tn = _counts(F.col("y_true"), pred)
    got = scores.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    n = tp + fp + fn + tn
    got = got.select(*by, n.alias("n_px"), (tp + fn).alias("n_pos"), _f1(tp, fp, fn).alias("f1"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp + tn, n).alias("accuracy"))
    return got.join(ranking_metrics(scores, *by), list(by))


def staleness(log: DataFrame, value: str, order: str, patience: int, *by: str) -> DataFrame:
    """A log of epochs with stale, how many epochs ago the run was best so far, and stop, whether that is ``patience`` or more."""
    w = Window.partitionBy(*by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("_epoch", F.row_number().over(w)).withColumn("_before", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    better = F.col("_before").isNull() | (F.col(value) > F.col("_before"))
    rows = rows.withColumn("stale", (F.col("_epoch") - F.max(F.when(better, F.col("_epoch"))).over(upto)).cast("long"))
    return rows.withColumn("stop", F.col("stale") >= patience).drop("_epoch", "_before")
