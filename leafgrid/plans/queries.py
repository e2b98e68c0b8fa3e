"""Registered queries of the imagery operators, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgrid.functions import columns as C
from leafgrid.operators import cube, metrics, models, reports
from leafgrid.operators.ranks import exact_quantiles, place_in_group
from leafgrid.operators.superpixels import superpixel_means
from leafgrid.operators.superpixels import superpixels as find_superpixels
from leafgrid.plans import views as V
from leafgrid.plans.views import BANDS, CELLS, PLOTS, SCORES
from leafgrid.sources.store import kept, pending
from leafgrid.streaming.windows import tumbling_totals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Bands by their role, for a scene with V's wavelengths; see nearest_in_range.
GREEN, BLUE, RED, RED_P, EDGE, EDGE_P, NIR, NIR_E, P531, P570 = 5, 3, 8, 9, 10, 11, 12, 13, 4, 5


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _b(i: int):
    return C.band(F.col("refl"), i)


def _wide(*bands: int) -> str:
    """SQL: a row for each pixel with columns b<i>."""
    return f"WITH {CELLS}, px AS (SELECT y, x, any_value(label) AS label, " + ", ".join(f"max(CASE WHEN band = {i} THEN r END) AS b{i}" for i in bands) + " FROM refl GROUP BY y, x)"


# Calibration and bands


@query(f"WITH {CELLS} SELECT y, x, band, round(r, 6) AS r FROM refl")
def reflectance(spark, sf):
    return _round(cube.long_form(V.pixels(spark, sf)).select("y", "x", F.col("band").cast("long").alias("band"), F.col("v").alias("r")), "r")


@query(f"WITH {BANDS} SELECT band, wl FROM bands WHERE NOT (wl > 1340 AND wl < 1440) AND NOT (wl > 1800 AND wl < 1950) AND wl BETWEEN 450 AND 2400")
def valid_bands(spark, sf):
    return V.bands(spark, sf).where(~C.in_windows(F.col("wl")) & F.col("wl").between(450, 2400))


@query(f"WITH {BANDS} SELECT band, wl FROM bands WHERE NOT (wl BETWEEN 1342.5 AND 1440) AND NOT (wl BETWEEN 1800 AND 1960)")
def water_inclusive(spark, sf):
    return V.bands(spark, sf).where(~C.in_windows(F.col("wl"), ((1342.5, 1440.0), (1800.0, 1960.0)), inclusive=True))


@query(f"WITH {BANDS} SELECT band, wl FROM bands ORDER BY abs(wl - 660), band LIMIT 1")
def nearest_band(spark, sf):
    return cube.nearest_band(V.bands(spark, sf), 660.0)


@query(f"WITH {BANDS} SELECT band, wl FROM bands ORDER BY CASE WHEN wl BETWEEN 705 AND 740 THEN 0 ELSE 1 END, abs(wl - 722.5), band LIMIT 1")
def nearest_in_range(spark, sf):
    return cube.nearest_in_range(V.bands(spark, sf), 705.0, 740.0)


@query(f"WITH {BANDS} SELECT band, CASE WHEN wl BETWEEN 680 AND 750 THEN round(0.2 * least((wl - 680) / 35.0, (750 - wl) / 35.0), 6) ELSE 0 END AS bonus FROM bands")
def red_edge_bonus(spark, sf):
    return V.bands(spark, sf).select("band", F.round(C.red_edge_bonus(F.col("wl")), 6).alias("bonus"))


# Vegetation indices and masks


def _index(name: str, value, bands: tuple[int, ...], sql: str) -> None:
    def run(spark, sf):
        return V.pixels(spark, sf).select("y", "x", F.round(value(), 6).alias("value"))

    run.__name__ = name
    query(f"{_wide(*bands)} SELECT y, x, round({sql}, 6) AS value FROM px")(run)


def _sql_div(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) >= 1e-6 THEN ({a}) / ({b}) END)"


_index("ndvi", lambda: C.ndvi(_b(RED), _b(NIR)), (8, 12), "(b12 - b8) / (b12 + b8 + 1e-6::DOUBLE)")
_index("ndre", lambda: C.normalised(_b(NIR), _b(EDGE)), (10, 12), _sql_div("b12 - b10", "b12 + b10"))
_index("ci_green", lambda: C.ci_green(_b(NIR), _b(GREEN)), (5, 12), _sql_div("b12", "b5") + " - 1")
_index("pri", lambda: C.normalised(_b(P531), _b(P570)), (4, 5), _sql_div("b4 - b5", "b4 + b5"))
_index("psri", lambda: C.psri(_b(RED_P), _b(BLUE), _b(EDGE_P)), (3, 9, 11), _sql_div("b9 - b3", "b11"))
_index("ndvi_guarded", lambda: C.normalised(_b(NIR), _b(RED)), (8, 12), _sql_div("b12 - b8", "b12 + b8"))
_index("ndre_eps", lambda: C.ndvi(_b(EDGE), _b(NIR)), (10, 12), "(b12 - b10) / (b12 + b10 + 1e-6::DOUBLE)")
_NDVI_SQL = "(b12 - b8) / (b12 + b8 + 1e-6::DOUBLE)"


def _masked(spark, sf) -> DataFrame:
    ndvi = C.ndvi(_b(RED), _b(NIR))
    return V.pixels(spark, sf).withColumn("ndvi", ndvi).withColumn("veg", C.above(F.col("ndvi"), 0.3)).withColumn("nodata", F.exists("refl", lambda v: v.isNull())).withColumn("valid", F.col("veg") & ~F.col("nodata"))


_MASKED = f"""WITH {CELLS}, masked AS (
  SELECT y, x, any_value(label) AS label, (max(CASE WHEN band = 12 THEN r END) - max(CASE WHEN band = 8 THEN r END)) / (max(CASE WHEN band = 12 THEN r END) + max(CASE WHEN band = 8 THEN r END) + 1e-6::DOUBLE) AS ndvi, count(r) < count(*) AS nodata
  FROM refl GROUP BY y, x
), masks AS (SELECT *, coalesce(ndvi > 0.3, false) AS veg, coalesce(ndvi > 0.3, false) AND NOT nodata AS valid FROM masked)"""


@query(f"{_MASKED} SELECT y, x, veg, nodata, valid FROM masks")
def masks(spark, sf):
    return _masked(spark, sf).select("y", "x", "veg", "nodata", "valid")


@query(f"{_MASKED} SELECT y, x, CASE WHEN veg THEN label % 4 ELSE 255 END AS class, CASE label % 4 WHEN 0 THEN 0 ELSE 1 END AS stressed FROM masks")
def class_labels(spark, sf):
    cls = F.col("label") % 4
    return _masked(spark, sf).select("y", "x", F.when(F.col("veg"), cls).otherwise(255).alias("class"), F.when(cls == 0, 0).when(cls.isin(1, 2, 3), 1).alias("stressed"))


@query(f"{_MASKED} SELECT count(*) AS n, count(ndvi) AS finite, CAST(sum(veg::INT) AS BIGINT) AS n_veg, round(avg(veg::INT), 6) AS veg_ratio, CAST(sum(nodata::INT) AS BIGINT) AS n_nodata, round(count(ndvi) / count(*), 6) AS finite_ratio FROM masks")
def mask_ratios(spark, sf):
    m = _masked(spark, sf)
    return m.agg(F.count(F.lit(1)).alias("n"), F.count("ndvi").alias("finite"), F.count_if("veg").alias("n_veg"), F.round(F.avg(F.col("veg").cast("int")), 6).alias("veg_ratio"), F.count_if("nodata").alias("n_nodata"), F.round(F.count("ndvi") / F.count(F.lit(1)), 6).alias("finite_ratio"))


# Band statistics


@query(f"""{_MASKED} SELECT band, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS sd, round(min(r), 6) AS low, round(max(r), 6) AS high,
  round(avg(r) / CASE WHEN stddev_pop(r) > 0 THEN stddev_pop(r) END, 6) AS snr
FROM refl JOIN masks USING (y, x) WHERE veg AND NOT (wl > 1340 AND wl < 1440) AND NOT (wl > 1800 AND wl < 1950) GROUP BY band""")
def band_snr(spark, sf):
    stats = cube.band_statistics(_masked(spark, sf), F.col("veg"))
    wl = V.FIRST_NM + V.STEP_NM * F.col("band")
    return _round(stats.where(~C.in_windows(wl)).withColumn("band", F.col("band").cast("long")), "mean", "sd", "low", "high", "snr")


@query(f"{_MASKED} SELECT band, round(sum(CASE WHEN veg AND r IS NOT NULL THEN 1 ELSE 0 END) / count(*), 6) AS valid_ratio, CAST(sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, round(avg(CASE WHEN dn IN (-1, 15000) THEN 1.0 ELSE 0.0 END), 6) AS sentinel_ratio FROM refl JOIN masks USING (y, x) GROUP BY band")
def band_ratios(spark, sf):
    rows = _masked(spark, sf).select("veg", F.explode(F.arrays_zip("refl", "dn", F.sequence(F.lit(0), F.size("refl") - 1).alias("band"))).alias("c")).select("veg", "c.*")
    return rows.groupBy(F.col("band").cast("long").alias("band")).agg(F.round(F.count_if(F.col("veg") & F.col("refl").isNotNull()) / F.count(F.lit(1)), 6).alias("valid_ratio"), F.count_if(F.col("refl").isNull()).alias("n_null"), F.round(F.avg(F.col("dn").isin(*C.IGNORED).cast("int")), 6).alias("sentinel_ratio"))


@query(f"{_MASKED} SELECT round(quantile_cont(ndvi, 0.01), 6) AS q01, round(quantile_cont(ndvi, 0.5), 6) AS q50, round(quantile_cont(ndvi, 0.99), 6) AS q99 FROM masks")
def layer_quantiles(spark, sf):
    q = exact_quantiles(_masked(spark, sf), "ndvi", [0.01, 0.5, 0.99])
    return q.select(*[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q01", "q50", "q99"))])


@query(f"{_MASKED}, q AS (SELECT quantile_cont(ndvi, 0.02) AS a, quantile_cont(ndvi, 0.98) AS b, min(ndvi) AS lo, max(ndvi) AS hi FROM masks) SELECT y, x, round(CASE WHEN ndvi IS NOT NULL THEN least(1, greatest(0, (ndvi - a) / (b - a + 1e-6::DOUBLE))) END, 6) AS stretched, CAST(floor(CASE WHEN hi > lo THEN (ndvi - lo) / (hi - lo) * 255 ELSE 127 END) AS BIGINT) AS gray FROM masks, q")
def stretch(spark, sf):
    m = _masked(spark, sf)
    q = exact_quantiles(m, "ndvi", [0.0, 0.02, 0.98, 1.0]).select(*[F.col("q")[i].alias(n) for i, n in enumerate(("lo", "a", "b", "hi"))])
    v = F.col("ndvi")
    rows = m.join(F.broadcast(q))  # one row of limits
    gray = F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * 255).otherwise(127)
    return rows.select("y", "x", F.round(F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - F.col("a")) / (F.col("b") - F.col("a") + F.lit(C.EPS))))), 6).alias("stretched"), F.floor(gray).cast("long").alias("gray"))


@query(f"{_MASKED}, h AS (SELECT min(ndvi) AS lo, max(ndvi) AS hi FROM masks) SELECT CAST(least(floor((ndvi - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM masks, h WHERE ndvi IS NOT NULL GROUP BY 1")
def histogram(spark, sf):
    m = _masked(spark, sf).where("ndvi IS NOT NULL")
    rows = m.join(F.broadcast(m.agg(F.min("ndvi").alias("lo"), F.max("ndvi").alias("hi"))))
    return rows.groupBy(F.least(F.floor((F.col("ndvi") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 50), F.lit(49)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_MASKED}, size AS (SELECT (max(y) + 1) // 3 * 3 AS h FROM masks) SELECT y // 3 AS by, x // 3 AS bx, round(avg(ndvi), 6) AS mean FROM masks, size WHERE y < h AND x < 18 GROUP BY 1, 2")
def coarsen(spark, sf):
    m = _masked(spark, sf)
    height = m.agg(F.max("y")).first()[0] + 1
    return _round(cube.coarsen(m, 3, "ndvi", height, V.WIDTH), "mean")


@query(f"{_MASKED} SELECT y, x, round(ndvi, 6) AS ndvi FROM masks WHERE y BETWEEN 4 AND 15 AND x BETWEEN 2 AND 17 AND y % 2 = 0 AND x % 2 = 0")
def crop_and_stride(spark, sf):
    at = F.col("y").between(4, 15) & F.col("x").between(2, 17) & (F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)
    return _round(_masked(spark, sf).where(at).select("y", "x", "ndvi"), "ndvi")


# Spectral structure


@query(f"WITH {BANDS}, kept AS (SELECT * FROM bands WHERE NOT (wl > 1340 AND wl < 1440) AND NOT (wl > 1800 AND wl < 1950)), steps AS (SELECT *, wl - lag(wl) OVER (ORDER BY wl) AS step FROM kept), m AS (SELECT quantile_cont(step, 0.5) AS typical FROM steps) SELECT band, wl, step, CAST(sum(CASE WHEN step > 2.5 * typical THEN 1 ELSE 0 END) OVER (ORDER BY wl) AS BIGINT) AS seg FROM steps, m")
def segments(spark, sf):
    return cube.segments(V.bands(spark, sf).where(~C.in_windows(F.col("wl")))).select("band", "wl", "step", "seg")


_CORR = f"""WITH {CELLS}, pairs AS (SELECT a.band, b.band - a.band AS lag, a.r AS p, b.r AS q FROM refl a JOIN refl b ON a.y = b.y AND a.x = b.x AND b.band - a.band IN (LAGS)),
corr_ AS (SELECT band, lag, count(CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN 1 END) AS n, CASE WHEN count(CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN 1 END) > 10 THEN covar_pop(p, q) / nullif(stddev_pop(CASE WHEN q IS NOT NULL THEN p END) * stddev_pop(CASE WHEN p IS NOT NULL THEN q END), 0) END AS corr FROM pairs GROUP BY band, lag)"""


@query(_CORR.replace("LAGS", "1") + " SELECT CAST(band AS BIGINT) AS band, n, round(corr, 6) AS corr FROM corr_")
def adjacent_corr(spark, sf):
    return _round(cube.lagged_correlation(V.pixels(spark, sf), [1]).select(F.col("band").cast("long").alias("band"), "n", "corr"), "corr")


@query(_CORR.replace("LAGS", "1, 2, 3, 4") + " SELECT CAST(lag AS BIGINT) AS lag, round(32.5 * lag, 6) AS delta_nm, round(quantile_cont(corr, 0.5), 6) AS median_corr FROM corr_ GROUP BY lag")
def decorrelation(spark, sf):
    corr = cube.lagged_correlation(V.pixels(spark, sf), [1, 2, 3, 4])
    return corr.groupBy(F.col("lag").cast("long").alias("lag")).agg(F.round(F.percentile("corr", F.lit(0.5)), 6).alias("median_corr")).withColumn("delta_nm", F.round(V.STEP_NM * F.col("lag"), 6))


#: A pixel counts as known if no more than three of its bands have no value.
_KNOWN = "SELECT y, x, any_value(label) AS label, count(*) - count(r) <= 3 AS ok, sum(r) AS total, count(r) AS n, max(r) AS top FROM refl GROUP BY y, x"


def _known():
    return F.size(F.filter("refl", lambda v: v.isNull())) <= 3


@query(f"WITH {CELLS}, wide AS ({_KNOWN}), acc AS (SELECT y, x, sum(ok::INT) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM wide) SELECT y, x, coalesce(sum(s) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 9, false) AS box_ok FROM acc")
def box_valid(spark, sf):
    return cube.box_valid(V.pixels(spark, sf), _known(), 1)


@query(f"WITH {CELLS}, px AS ({_KNOWN}), near AS (SELECT c.y, c.x, c.label, p.* EXCLUDE (y, x, label) FROM px c JOIN px p ON p.y BETWEEN c.y - 1 AND c.y + 1 AND p.x BETWEEN c.x - 1 AND c.x + 1) SELECT y, x, round(sum(total), 6) AS total, CAST(sum(n) AS BIGINT) AS n, round(max(top), 6) AS top FROM near WHERE label < 5 AND ok GROUP BY y, x HAVING count(*) = 9")
def patches(spark, sf):
    got = cube.patches(V.pixels(spark, sf), F.col("label") < 5, _known(), 1, "refl")
    flat = F.filter(F.flatten(F.flatten("patch")), lambda v: v.isNotNull())
    return got.select("y", "x", F.round(F.aggregate(flat, F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.size(flat).cast("long").alias("n"), F.round(F.array_max(flat), 6).alias("top"))


@query(f"WITH {CELLS}, fit AS (SELECT band, quantile_cont(r, 0.5) AS med, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS iqr FROM refl GROUP BY band) SELECT y, x, refl.band, round((r - med) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END, 6) AS scaled FROM refl JOIN fit ON refl.band = fit.band")
def robust_scale(spark, sf):
    px = V.pixels(spark, sf)
    scaled = cube.robust_scale(px.select("y", "x", "refl"), cube.robust_fit(px, "refl"), "refl")
    return cube.long_form(scaled).select("y", "x", F.col("band").cast("long").alias("band"), F.round("v", 6).alias("scaled"))


@query(f"WITH {CELLS}, means AS (SELECT band, avg(r) AS m FROM refl WHERE label < 6 GROUP BY band) SELECT y, x, refl.band, round(CASE WHEN refl.band IN (1, 4) THEN m ELSE r END, 6) AS v FROM refl JOIN means ON refl.band = means.band WHERE label >= 6")
def ablate_features(spark, sf):
    px = V.pixels(spark, sf)
    rows = px.where("label >= 6").join(F.broadcast(_means(px.where("label < 6")))).withColumn("refl", cube.ablate("refl", [1, 4], F.col("means")))
    return cube.long_form(rows).select("y", "x", F.col("band").cast("long").alias("band"), F.round("v", 6).alias("v"))


def _means(pixels) -> DataFrame:
    """One row: the mean of each band."""
    of_band = cube.long_form(pixels).groupBy("band").agg(F.avg("v").alias("m"))
    return of_band.agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "m"))), lambda b: b["m"]).alias("means"))


# Evaluation


@query(f"WITH {SCORES}, g AS (SELECT y_prob, sum(y_true) AS tp, sum(1 - y_true) AS fp FROM scores GROUP BY y_prob), c AS (SELECT *, sum(tp) OVER (ORDER BY y_prob DESC) AS ctp, sum(fp) OVER (ORDER BY y_prob DESC) AS cfp, sum(tp) OVER () AS p, sum(fp) OVER () AS n FROM g) SELECT round(sum(tp / p * ctp / (ctp + cfp)), 6) AS average_precision, round(sum(fp / n * (ctp - tp / 2) / p), 6) AS roc_auc FROM c")
def ranking_metrics(spark, sf):
    return _round(metrics.ranking_metrics(V.scores(spark, sf)), "average_precision", "roc_auc")


@query(f"WITH {SCORES}, g AS (SELECT entry, y_prob, sum(y_true) AS tp, sum(1 - y_true) AS fp FROM scores GROUP BY ALL), c AS (SELECT *, sum(tp) OVER (PARTITION BY entry ORDER BY y_prob DESC) AS ctp, sum(fp) OVER (PARTITION BY entry ORDER BY y_prob DESC) AS cfp, sum(tp) OVER (PARTITION BY entry) AS p, sum(fp) OVER (PARTITION BY entry) AS n FROM g) SELECT entry, round(sum(tp / p * ctp / (ctp + cfp)), 6) AS average_precision, round(sum(fp / n * (ctp - tp / 2) / p), 6) AS roc_auc FROM c GROUP BY entry")
def group_ranking_metrics(spark, sf):
    return _round(metrics.ranking_metrics(V.scores(spark, sf), "entry"), "average_precision", "roc_auc")


@query(f"WITH {SCORES}, g AS (SELECT y_prob, sum(y_true) AS tp, sum(1 - y_true) AS fp FROM scores GROUP BY y_prob), c AS (SELECT *, sum(tp) OVER (ORDER BY y_prob DESC) AS ctp, sum(fp) OVER (ORDER BY y_prob DESC) AS cfp, sum(tp) OVER () AS p, sum(fp) OVER () AS n FROM g) SELECT round(y_prob, 6) AS y_prob, round(cfp / n, 6) AS fpr, round(ctp / p, 6) AS recall, round(ctp / (ctp + cfp), 6) AS precision FROM c")
def curve_points(spark, sf):
    return _round(metrics.curve_points(V.scores(spark, sf)), "y_prob", "fpr", "recall", "precision")


_THRESHOLD = f"WITH {SCORES}, k AS (SELECT model, sum(CASE WHEN y_true = 1 AND y_prob >= 0.45 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN y_true = 0 AND y_prob >= 0.45 THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN y_true = 1 AND y_prob < 0.45 THEN 1 ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN y_true = 0 AND y_prob < 0.45 THEN 1 ELSE 0 END)::DOUBLE AS tn FROM scores GROUP BY model)"


@query(_THRESHOLD + " SELECT model, round((CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END + CASE WHEN 2*tn+fp+fn > 0 THEN 2*tn/(2*tn+fp+fn) ELSE 0 END) / 2, 6) AS f1_macro, round(CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0 END, 6) AS precision, round((tp+tn)/(tp+fp+fn+tn), 6) AS accuracy FROM k")
def threshold_metrics(spark, sf):
    return _round(metrics.threshold_metrics(V.scores(spark, sf), 0.45, "model"), "f1_macro", "recall", "precision", "accuracy")


@query(f"WITH {SCORES}, grid AS (SELECT 0.1::DOUBLE + i * 0.005::DOUBLE AS threshold FROM range(161) t(i)), s AS (SELECT y_true, y_prob, count(*) AS w FROM scores GROUP BY ALL), k AS (SELECT threshold, sum(CASE WHEN y_true = 1 AND y_prob >= threshold - 1e-9 THEN w ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN y_true = 0 AND y_prob >= threshold - 1e-9 THEN w ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN y_true = 1 AND y_prob < threshold - 1e-9 THEN w ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN y_true = 0 AND y_prob < threshold - 1e-9 THEN w ELSE 0 END)::DOUBLE AS tn FROM s, grid GROUP BY threshold) SELECT round(threshold, 6) AS threshold, round((CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END + CASE WHEN 2*tn+fp+fn > 0 THEN 2*tn/(2*tn+fp+fn) ELSE 0 END) / 2, 6) AS f1_macro FROM k ORDER BY round((CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END + CASE WHEN 2*tn+fp+fn > 0 THEN 2*tn/(2*tn+fp+fn) ELSE 0 END) / 2, 12) DESC, threshold LIMIT 1")
def best_threshold(spark, sf):
    return _round(metrics.best_threshold(V.scores(spark, sf)), "threshold", "f1_macro")


@query(f"WITH {SCORES}, k AS (SELECT y_true, CASE WHEN y_prob >= 0.45 THEN 1 ELSE 0 END AS y_pred, count(*) AS n FROM scores GROUP BY ALL) SELECT y_true, y_pred, n, round(n / sum(n) OVER (PARTITION BY y_true), 6) AS of_row, round(n / sum(n) OVER (PARTITION BY y_pred), 6) AS of_column, round(n / sum(n) OVER (), 6) AS of_all FROM k")
def confusion(spark, sf):
    return _round(metrics.confusion(V.scores(spark, sf), 0.45), "of_row", "of_column", "of_all")


@query(f"WITH {SCORES}, k AS (SELECT y_true AS label, CASE WHEN (y_prob >= 0.45) = (y_true = 1) THEN 1 ELSE 0 END AS ok, CASE WHEN y_prob >= 0.45 THEN 1 ELSE 0 END AS pred FROM scores), l AS (SELECT unnest([0, 1]) AS label), c AS (SELECT l.label, sum(CASE WHEN k.label = l.label AND ok = 1 THEN 1 ELSE 0 END)::DOUBLE AS hit, sum(CASE WHEN pred = l.label AND ok = 0 THEN 1 ELSE 0 END)::DOUBLE AS over_, sum(CASE WHEN k.label = l.label AND ok = 0 THEN 1 ELSE 0 END)::DOUBLE AS missed FROM k, l GROUP BY l.label) SELECT label, round(hit / (hit + over_), 6) AS precision, round(hit / (hit + missed), 6) AS recall, round(2 * hit / (2 * hit + over_ + missed), 6) AS f1, CAST(hit + missed AS BIGINT) AS support FROM c")
def classification_report(spark, sf):
    return _round(metrics.classification_report(V.scores(spark, sf), 0.45), "precision", "recall", "f1")


# Tables: counts, joins, samples


@query(f"WITH {PLOTS}, s AS (SELECT class, CASE ((id + 42) * 2654435761) % 4294967296 % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split FROM plots) SELECT class, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM s GROUP BY class")
def pivot_split(spark, sf):
    k = C.portable_hash(F.col("id")) % 5
    rows = V.plots(spark, sf).withColumn("split", F.when(k == 3, "val").when(k == 4, "test").otherwise("train"))
    return rows.groupBy("class").pivot("split", ["train", "val", "test"]).count().na.fill(0)


@query(f"WITH {PLOTS} SELECT entry, class, count(*) AS n, grouping(entry) AS all_entries, grouping(class) AS all_classes FROM plots GROUP BY CUBE (entry, class)")
def crosstab_margins(spark, sf):
    return V.plots(spark, sf).cube("entry", "class").agg(F.count(F.lit(1)).alias("n"), F.grouping("entry").cast("long").alias("all_entries"), F.grouping("class").cast("long").alias("all_classes"))


@query(f"WITH {PLOTS}, c AS (SELECT entry, class, count(*) AS n, count(DISTINCT plot) AS n_plots FROM plots GROUP BY ALL) SELECT entry, class, n, n_plots, round(n / sum(n) OVER (PARTITION BY class), 6) AS of_class FROM c")
def class_shares(spark, sf):
    counts = V.plots(spark, sf).groupBy("entry", "class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("plot").alias("n_plots"))
    return counts.withColumn("of_class", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("class")), 6))


@query(f"WITH {PLOTS}, g AS (SELECT class, plot, min(id) AS first_id FROM plots GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY ((plot + 42) * 2654435761) % 4294967296, plot) AS k, count(*) OVER (PARTITION BY class) AS m FROM g) SELECT concat(class, '_', plot) AS group_id, first_id, CASE WHEN k <= floor(m * 0.6) THEN 1 WHEN k <= floor(m * 0.6) + floor(m * 0.2) THEN 2 ELSE 3 END AS split_id FROM r")
def group_split(spark, sf):
    groups = V.plots(spark, sf).groupBy("class", "plot").agg(F.min("id").alias("first_id"))
    k = F.row_number().over(Window.partitionBy("class").orderBy(C.portable_hash(F.col("plot")), "plot"))
    m = F.count(F.lit(1)).over(Window.partitionBy("class"))
    rows = groups.withColumn("k", k).withColumn("m", m)
    train, val = F.floor(F.col("m") * 0.6), F.floor(F.col("m") * 0.2)
    return rows.select(F.concat_ws("_", "class", "plot").alias("group_id"), "first_id", F.when(F.col("k") <= train, 1).when(F.col("k") <= train + val, 2).otherwise(3).alias("split_id"))


@query(f"WITH {PLOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY ((id + 42) * 2654435761) % 4294967296, id) AS k FROM plots), m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM plots GROUP BY class)) SELECT id, class, (k - 1) % 5 AS fold, k <= least AS kept FROM r, m")
def folds_and_undersample(spark, sf):
    rows = place_in_group(V.plots(spark, sf), "class", C.portable_hash(F.col("id")), "id")
    least = rows.groupBy("class").agg(F.first("m").alias("m")).agg(F.min("m").alias("least"))  # one row for each class
    return rows.join(F.broadcast(least)).select("id", "class", ((F.col("k") - 1) % 5).cast("long").alias("fold"), (F.col("k") <= F.col("least")).alias("kept"))


@query(f"WITH {PLOTS} SELECT id, class FROM plots ORDER BY ((id + 42) * 2654435761) % 4294967296, id LIMIT 100")
def hash_sample(spark, sf):
    return V.plots(spark, sf).orderBy(C.portable_hash(F.col("id")), "id").limit(100).select("id", "class")


@query("SELECT n_name, count(c_custkey) AS customers, count(*) FILTER (WHERE c_custkey IS NULL) AS unmatched FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY n_name")
def left_join_counts(spark, sf):
    customers = V.read(spark, sf, "customer").where("c_acctbal > 9000")
    joined = V.read(spark, sf, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.count_if(F.col("c_custkey").isNull()).alias("unmatched"))


@query(f"WITH {BANDS}, kept AS (SELECT band FROM bands WHERE band % 3 = 0 INTERSECT SELECT band FROM bands WHERE wl < 1000) SELECT b.band, n.band AS near FROM bands b JOIN bands n ON abs(b.wl - n.wl) < 70 AND b.band <> n.band WHERE b.band IN (SELECT band FROM kept)")
def band_neighbours(spark, sf):
    bands = V.bands(spark, sf)
    kept = bands.where("band % 3 = 0").select("band").intersect(bands.where("wl < 1000").select("band"))
    # A range join of the band dimension with itself, by cells of the radius: a few hundred rows.
    cell = F.floor(F.col("wl") / 70)
    left = bands.join(kept, "band", "left_semi").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    right = bands.select(F.col("band").alias("near"), F.col("wl").alias("near_wl"), cell.alias("cell"))
    return left.join(right, "cell").where((F.abs(F.col("wl") - F.col("near_wl")) < 70) & (F.col("band") != F.col("near"))).select("band", "near")


@query("SELECT o_custkey AS client, p_brand AS category, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_, count(DISTINCT l_partkey) AS products, round(sum(l_extendedprice), 2) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3")
def monthly_amounts(spark, sf):
    return _monthly(spark, sf).select("client", "category", "month_", "products", F.round("amount", 2).alias("amount"))


def _monthly(spark, sf) -> DataFrame:
    rows = V.read(spark, sf, "lineitem").join(V.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(V.read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("o_custkey").alias("client"), F.col("p_brand").alias("category"), F.trunc("o_orderdate", "month").alias("month_")).agg(F.countDistinct("l_partkey").alias("products"), F.sum("l_extendedprice").alias("amount"))


@query("WITH m AS (SELECT p_brand AS category, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_, sum(l_extendedprice) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), d AS (SELECT max(month_) AS last_ FROM m) SELECT category, count(*) AS months, round(sum(amount), 2) AS amount FROM m, d WHERE month_ > last_ - INTERVAL 6 MONTH GROUP BY category")
def rolling_amounts(spark, sf):
    m = _monthly(spark, sf).groupBy("category", "month_").agg(F.sum("amount").alias("amount"))
    last = m.agg(F.max("month_").alias("last_"))
    return m.join(F.broadcast(last)).where(F.col("month_") > F.add_months("last_", -6)).groupBy("category").agg(F.count(F.lit(1)).alias("months"), F.round(F.sum("amount"), 2).alias("amount"))


@query("WITH s AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events) SELECT user_id, event_id, round(best, 6) AS best, value >= best AS improved FROM s")
def running_best(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = V.read(spark, sf, "events").withColumn("best", F.max("value").over(w))
    return rows.select("user_id", "event_id", F.round("best", 6).alias("best"), (F.col("value") >= F.col("best")).alias("improved"))


@query("SELECT event_type, user_id, round(sum(value), 6) AS total FROM events GROUP BY ALL ORDER BY sum(value) DESC, event_type, user_id LIMIT 10")
def top_trials(spark, sf):
    rows = V.read(spark, sf, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("total"))
    return _round(rows.orderBy(F.col("total").desc(), "event_type", "user_id").limit(10), "total")


@query("WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer) SELECT c_mktsegment AS segment, CAST(CASE WHEN c_acctbal <= a THEN 0 WHEN c_acctbal <= b THEN 1 WHEN c_acctbal <= c THEN 2 ELSE 3 END AS BIGINT) AS quartile, count(*) AS n FROM customer, q GROUP BY ALL")
def quartile_crosstab(spark, sf):
    rows = V.read(spark, sf, "customer")
    q = exact_quantiles(rows, "c_acctbal", [0.25, 0.5, 0.75])
    quartile = sum(((F.col("c_acctbal") > F.col("q")[i]).cast("long") for i in range(3)), F.lit(0).cast("long"))
    return rows.join(F.broadcast(q)).groupBy(F.col("c_mktsegment").alias("segment"), quartile.alias("quartile")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH b AS (SELECT c_custkey AS id, c_nationkey AS value, (c_custkey % 50) * 0.4::DOUBLE AS x0, (c_custkey // 50) * 0.6::DOUBLE AS y0 FROM customer), p AS (SELECT id, value, y, unnest(range(CAST(floor(x0 / 0.25) AS BIGINT), CAST(ceil((x0 + 0.7) / 0.25) AS BIGINT))) AS x FROM (SELECT *, unnest(range(CAST(floor(y0 / 0.25) AS BIGINT), CAST(ceil((y0 + 0.9) / 0.25) AS BIGINT))) AS y FROM b)) SELECT y, x, CAST(max_by(value, id) AS BIGINT) AS value FROM p GROUP BY y, x")
def rasterise_boxes(spark, sf):
    key = F.col("c_custkey")
    boxes = V.read(spark, sf, "customer").select(key.alias("id"), F.col("c_nationkey").cast("long").alias("value"), ((key % 50) * 0.4).alias("x0"), (F.expr("c_custkey div 50") * 0.6).alias("y0"))
    boxes = boxes.withColumn("x1", F.col("x0") + 0.7).withColumn("y1", F.col("y0") + 0.9)
    return cube.boxes_to_pixels(boxes, 0.25)


@query("WITH d AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS value, (c_custkey % 50) * 0.4::DOUBLE + 0.203::DOUBLE AS cx, (c_custkey // 50) * 0.6::DOUBLE + 0.301::DOUBLE AS cy FROM customer), c AS (SELECT *, unnest(range(CAST(floor(cy / 0.25) AS BIGINT) - 3, CAST(floor(cy / 0.25) AS BIGINT) + 4)) AS y FROM d), p AS (SELECT *, unnest(range(CAST(floor(cx / 0.25) AS BIGINT) - 3, CAST(floor(cx / 0.25) AS BIGINT) + 4)) AS x FROM c) SELECT y, x, max_by(value, id) AS value FROM p WHERE abs((x + 0.5) * 0.25 - cx) + abs((y + 0.5) * 0.25 - cy) < 0.55 GROUP BY y, x")
def rasterise_polygons(spark, sf):
    key = F.col("c_custkey")
    cx, cy = (key % 50) * 0.4 + 0.203, F.expr("c_custkey div 50") * 0.6 + 0.301
    ring = F.array(*[F.struct((cx + dx).alias("x"), (cy + dy).alias("y")) for dx, dy in ((0.55, 0), (0, 0.55), (-0.55, 0), (0, -0.55))])
    shapes = V.read(spark, sf, "customer").select(key.alias("id"), F.col("c_nationkey").cast("long").alias("value"), F.array(ring).alias("rings"))
    return cube.polygons_to_pixels(shapes, 0.25)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    got = tumbling_totals(V.read(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
    return _round(got, "total", digits=4)


# Models


def _all_bands(spark, sf, fit=None) -> DataFrame:
    """Pixels with every band as features; a band without a value has its mean over the pixels that meet ``fit``, or over all."""
    px = V.pixels(spark, sf).select("y", "x", "label", F.col("refl").alias("features"))
    return kept(models.fill(px, px if fit is None else px.where(fit)))


@query(f"WITH {CELLS} SELECT a.band AS a, b.band AS b, count(CASE WHEN a.r IS NOT NULL AND b.r IS NOT NULL THEN 1 END) AS n, round(covar_pop(a.r, b.r) / (stddev_pop(CASE WHEN b.r IS NOT NULL THEN a.r END) * stddev_pop(CASE WHEN a.r IS NOT NULL THEN b.r END)), 6) AS corr FROM refl a JOIN refl b ON a.vec_id = b.vec_id AND a.band < b.band GROUP BY a.band, b.band")
def pair_correlation(spark, sf):
    return _round(models.pair_correlation(V.pixels(spark, sf), "refl"), "corr")


def _segmented(spark, sf) -> DataFrame:
    px = V.pixels(spark, sf)
    stats = cube.long_form(px).groupBy("band").agg((F.avg("v") / F.stddev_pop("v")).alias("snr"), (F.count("v") / F.count(F.lit(1))).alias("valid_ratio"))
    dry = V.bands(spark, sf).where(~C.in_windows(F.col("wl")))
    return cube.segments(dry).join(F.broadcast(stats), "band").select("seg", "band", "wl", "snr", "valid_ratio")  # the band dimension


#: By segment, for bands 32.5 nm apart: denser over the red edge, and no bands near the water windows.
_SPACINGS = {0: models.Spacing(60.0, ((680.0, 750.0, 40.0),), 0.8, 0.999), 1: models.Spacing(70.0, (), 0.8, 0.99, (33.0, 0.0)), 2: models.Spacing(50.0, (), 0.9, 0.99, (33.0, 20.0))}


@query()
def select_bands(spark, sf):
    found = models.band_candidates(_segmented(spark, sf), C.red_edge_bonus(F.col("wl")), _SPACINGS)
    return models.select_bands(found, models.pair_correlation(V.pixels(spark, sf), "refl"), _SPACINGS, anchors=(531.0, 570.0, 500.0, 678.0, 750.0, 705.0, 550.0, 782.0))


@query()
def pca_project(spark, sf):
    px = _all_bands(spark, sf)
    means, parts, _ = models.pca_fit(px)
    return px.select("y", "x", *models.pca_project("features", means, parts))


@query()
def cross_components(spark, sf):
    """How far the components of two halves of the spectrum go together."""
    half = F.floor(F.size("features") / 2).cast("int")
    px = _all_bands(spark, sf).select(F.slice("features", F.lit(1), half).alias("a"), F.slice("features", half + 1, F.size("features") - half).alias("b"))
    fits = {side: models.pca_fit(px, array=side) for side in "ab"}
    sides = [c.alias(f"{side}{i}") for side in "ab" for i, c in enumerate(models.pca_project(side, *fits[side][:2]), 1)]
    values = models.cross_singular_values(px.select(*sides), ["a1", "a2", "a3"], ["b1", "b2", "b3"])
    return spark.createDataFrame([(i, v) for i, v in enumerate(values, 1)], "rank long, value double")


@query()
def clusters(spark, sf):
    return models.clusters(_all_bands(spark, sf)).select("y", "x", "cluster")


@query()
def superpixels(spark, sf):
    return find_superpixels(_all_bands(spark, sf), 5, 0.5, least=6)


@query()
def superpixel_spectra(spark, sf):
    """The spectra of objects rather than pixels."""
    px = _all_bands(spark, sf)
    return superpixel_means(px, find_superpixels(px, 5, 0.5, least=6))


@query()
def unmix(spark, sf):
    px = _all_bands(spark, sf)
    return models.unmix(px, models.mean_spectra(px, "label")).select("y", "x", "shares", "endmember")


@query()
def classifier_metrics(spark, sf):
    """Two classifiers fitted on three fifths of the rows of pixels, judged on each part."""
    part = C.portable_hash(F.col("y")) % 5
    px = _all_bands(spark, sf, part < 3).withColumn("y_true", (F.col("label") >= 5).cast("int")).withColumn("split", F.when(part < 3, "train").when(part == 3, "validation").otherwise("test"))
    train = px.where("split = 'train'")
    scale = models.scaling(train)
    scored = [models.classifier_scores(train, px, kind, scale=scale).select(F.lit(kind).alias("model"), "split", "y_true", "y_prob") for kind in ("logistic", "boosted")]
    return metrics.ranking_metrics(scored[0].unionByName(scored[1]), "model", "split")


# Reports


@query(f"WITH {CELLS} SELECT band, count(*) FILTER (WHERE dn IN (-1, 15000)) AS n_nodata, round(count(*) FILTER (WHERE dn IN (-1, 15000)) / count(*), 6) AS ratio FROM dn GROUP BY band")
def nodata_ratio(spark, sf):
    rows = cube.long_form(V.pixels(spark, sf), "dn")
    n = F.count_if(F.col("v").isin(*C.IGNORED))
    return rows.groupBy(F.col("band").cast("long").alias("band")).agg(n.alias("n_nodata"), F.round(n / F.count(F.lit(1)), 6).alias("ratio"))


@query(f"WITH {CELLS}, lim AS (SELECT band, min(r) AS lo, max(r) AS hi FROM refl GROUP BY band) SELECT y, x, refl.band, CAST(CASE WHEN hi = lo THEN 127 ELSE floor((r - lo) / (hi - lo) * 255 + 1e-9) END AS BIGINT) AS level FROM refl JOIN lim ON refl.band = lim.band WHERE r IS NOT NULL")
def rescale_levels(spark, sf):
    rows = cube.long_form(V.pixels(spark, sf)).where(F.col("v").isNotNull())
    limits = rows.groupBy("band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    level = F.when(F.col("hi") == F.col("lo"), 127).otherwise(F.floor((F.col("v") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * 255 + 1e-9))
    return rows.join(F.broadcast(limits), "band").select("y", "x", F.col("band").cast("long").alias("band"), level.cast("long").alias("level"))  # one row for each band


#: Which bands give way: none, two, all others, and some one by one.
_CONDITIONS = {"C0": [], "C1": [0, 1], "C2": list(range(2, 64))} | {f"C3_{i}": [i] for i in range(6)}
_CASES = ", ".join(f"('{k}', {v!r}::INT[])" for k, v in _CONDITIONS.items())


@query(
    f"""WITH {CELLS}, means AS (SELECT band, avg(r) AS m FROM refl WHERE vec_id % 5 < 3 GROUP BY band), full_ AS (SELECT refl.*, m, coalesce(r, m) AS f FROM refl JOIN means ON refl.band = means.band), cond(condition, which) AS (VALUES {_CASES}),
	s AS (SELECT condition, vec_id, max(CASE WHEN label >= 5 THEN 1 ELSE 0 END) AS y_true, round(sum(CASE WHEN list_contains(which, full_.band) THEN m ELSE f END * (full_.band - 31.5::DOUBLE)), 6) AS y_prob FROM full_, cond WHERE vec_id % 5 >= 3 GROUP BY ALL),
	g AS (SELECT condition, y_prob, sum(y_true) AS tp, sum(1 - y_true) AS fp FROM s GROUP BY ALL),
	c AS (SELECT *, sum(tp) OVER (PARTITION BY condition ORDER BY y_prob DESC) AS ctp, sum(fp) OVER (PARTITION BY condition ORDER BY y_prob DESC) AS cfp, sum(tp) OVER (PARTITION BY condition) AS p, sum(fp) OVER (PARTITION BY condition) AS n FROM g),
	m AS (SELECT condition, sum(tp / p * ctp / (ctp + cfp)) AS ap, sum(fp / n * (ctp - tp / 2) / p) AS roc FROM c GROUP BY condition), d AS (SELECT *, max(CASE WHEN condition = 'C0' THEN ap END) OVER () AS ap0 FROM m)
	SELECT condition, round(ap, 6) AS average_precision, round(roc, 6) AS roc_auc, round(ap0 - ap, 6) AS delta, round(100 * (ap0 - ap) / ap0, 4) AS delta_percent, CASE WHEN ap0 - ap < 0.02 THEN 'none' WHEN ap0 - ap < 0.05 THEN 'weak' ELSE 'strong' END AS effect FROM d""".replace("\t", "")
)
def ablation_report(spark, sf):
    """What a linear score loses where features give way to their means over other pixels."""
    got = reports.ablation(_ablated(spark, sf), _CONDITIONS, F.col("means"), _linear)
    return _round(_round(got, "average_precision", "roc_auc", "delta"), "delta_percent", digits=4)


def _ablated(spark, sf) -> DataFrame:
    """Pixels of the test part with the means of the others, which also fill bands without a value."""
    px = V.pixels(spark, sf).withColumn("y_true", (F.col("label") >= 5).cast("int"))
    rows = px.where("vec_id % 5 >= 3").join(F.broadcast(_means(px.where("vec_id % 5 < 3"))))  # one row of means
    return rows.withColumn("features", F.zip_with("refl", "means", lambda v, m: F.coalesce(v, m)))


def _linear(features):
    return F.round(F.aggregate(F.transform(features, lambda v, i: v * (i - 31.5)), F.lit(0.0), lambda a, v: a + v), 6)


@query(
    f"""WITH {CELLS}, ok AS ({_KNOWN}), near AS (SELECT c.y, c.x, p.y AS py, p.x AS px FROM ok c JOIN ok p ON p.y BETWEEN c.y - 1 AND c.y + 1 AND p.x BETWEEN c.x - 1 AND c.x + 1 WHERE p.ok), whole AS (SELECT y, x FROM near GROUP BY y, x HAVING count(*) = 9),
t AS (SELECT n.y, n.x, r.band, sum(coalesce(r.r, 0)) AS total, sum(CASE WHEN r.y = n.y AND r.x = n.x THEN coalesce(r.r, 0) END) AS mid FROM near n JOIN whole w ON n.y = w.y AND n.x = w.x JOIN refl r ON r.y = n.py AND r.x = n.px GROUP BY n.y, n.x, r.band)
SELECT y, x, round(sum(mid), 6) AS centre_total, round(arg_min(total, (((y * 20 + x) * 4096 + band + 42) * 2654435761) % 4294967296), 6) AS first_total FROM t GROUP BY y, x"""
)
def patch_controls(spark, sf):
    """Patches for two control runs of a model: the centre pixel alone, and channels out of order."""
    got = cube.patches(V.pixels(spark, sf), F.lit(True), _known(), 1, "refl")
    total = lambda c: F.aggregate(F.flatten(c), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    shuffled = reports.permuted(F.col("patch"), F.col("y") * V.WIDTH + F.col("x"))
    return got.select("y", "x", F.round(total(F.flatten(reports.centre_only(F.col("patch"), 1))), 6).alias("centre_total"), F.round(total(shuffled[0]), 6).alias("first_total"))


@query(f"WITH {CELLS} SELECT y, x, coalesce(round(max(CASE WHEN band = 12 AND label < 5 THEN r END), 6), -1) AS y_prob, CASE WHEN max(CASE WHEN band = 12 AND label < 5 THEN r END) IS NULL THEN 255 WHEN max(CASE WHEN band = 12 AND label < 5 THEN r END) >= 0.3 THEN 1 ELSE 0 END AS class FROM refl GROUP BY y, x")
def score_map(spark, sf):
    px = V.pixels(spark, sf)
    scored = px.where("label < 5").select("y", "x", _b(NIR).alias("y_prob")).where(F.col("y_prob").isNotNull())
    return _round(cube.to_map(px, scored, 0.3), "y_prob")


@query(f"{_MASKED}, n AS (SELECT count(*) AS a, count(*) FILTER (WHERE veg) AS b, count(*) FILTER (WHERE veg AND label >= 5) AS c FROM masks), r AS (SELECT unnest(['all', 'vegetation', 'labelled']) AS stage, unnest([a, b, c]) AS pixels, a FROM n) SELECT stage, pixels, round(100.0::DOUBLE * pixels / a, 4) AS percent FROM r")
def scene_reduction(spark, sf):
    one = _masked(spark, sf).agg(F.count(F.lit(1)).alias("a"), F.count_if("veg").alias("b"), F.count_if(F.col("veg") & (F.col("label") >= 5)).alias("c"))
    rows = one.select("a", F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(c).alias("pixels")) for n, c in (("all", "a"), ("vegetation", "b"), ("labelled", "c"))])).alias("r"))
    return rows.select("r.*", F.round(100.0 * F.col("r.pixels") / F.col("a"), 4).alias("percent"))


@query(f"WITH {SCORES} SELECT model, sum(1 - y_true)::BIGINT AS n_neg, sum(y_true)::BIGINT AS n_pos, round(sum(1 - y_true) / sum(y_true), 6) AS weight FROM scores GROUP BY model")
def class_weight(spark, sf):
    pos, neg = F.sum(F.col("y_true").cast("long")), F.sum(1 - F.col("y_true").cast("long"))
    return V.scores(spark, sf).groupBy("model").agg(neg.alias("n_neg"), pos.alias("n_pos"), F.round(neg / F.when(pos > 0, pos), 6).alias("weight"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def pending_rows(spark, sf):
    written = V.read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return pending(V.read(spark, sf, "orders").select("o_orderkey", "o_custkey"), written, "o_custkey").select("o_orderkey", "o_custkey")


@query("WITH d AS (SELECT c_custkey AS id, (c_custkey % 50) * 0.4::DOUBLE + 0.203::DOUBLE AS cx, (c_custkey // 50) * 0.6::DOUBLE + 0.301::DOUBLE AS cy FROM customer) SELECT id, round(cx - 0.55, 6) AS x0, round(cy - 0.55, 6) AS y0, round(cx + 0.55, 6) AS x1, round(cy + 0.55, 6) AS y1, 0.605::DOUBLE AS area, round(cx, 6) AS cx, round(cy, 6) AS cy FROM d")
def polygon_extents(spark, sf):
    key = F.col("c_custkey")
    cx, cy = (key % 50) * 0.4 + 0.203, F.expr("c_custkey div 50") * 0.6 + 0.301
    ring = F.array(*[F.struct((cx + dx).alias("x"), (cy + dy).alias("y")) for dx, dy in ((0.55, 0), (0, 0.55), (-0.55, 0), (0, -0.55))])
    got = reports.extents(V.read(spark, sf, "customer").select(key.alias("id"), F.array(ring).alias("rings")))
    return _round(got, "x0", "y0", "x1", "y1", "area", "cx", "cy")


_REPORT = ORACLE_SQL["classification_report"].replace("round(", "(").replace(", 6)", ")")


@query(f"WITH r AS ({_REPORT}) SELECT 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM r UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r")
def report_averages(spark, sf):
    return _round(metrics.report_averages(metrics.classification_report(V.scores(spark, sf), 0.45)), "precision", "recall", "f1")


@query()
def screen_classifiers(spark, sf):
    """Every kind of classifier, fitted on four fifths of the rows of pixels and ranked on the rest."""
    part = C.portable_hash(F.col("y")) % 5
    rows = _all_bands(spark, sf, part < 4).withColumn("y_true", (F.col("label") >= 5).cast("int"))
    return reports.screen(rows.where(part < 4), rows.where(part == 4))


@query()
def feature_importance(spark, sf):
    rows = _all_bands(spark, sf).withColumn("y_true", (F.col("label") >= 5).cast("int"))
    return models.importances(rows)


@query()
def search_settings(spark, sf):
    """Random settings of a logistic classifier, ranked by average precision over folds of rows of pixels.

    The means that fill bands are over all folds; labels have no part in them.
    """
    rows = _all_bands(spark, sf).withColumn("y_true", (F.col("label") >= 5).cast("int")).withColumn("fold", (C.portable_hash(F.col("y")) % 3).cast("int"))
    return reports.search(rows, reports.draws(4, {"regParam": (1e-4, 1.0), "elasticNetParam": (0.01, 1.0)}))


@query()
def out_of_fold(spark, sf):
    """Boosted trees by folds of rows of pixels, each stopped early on every fourth row of the others: every pixel's score by a model
    that hasn't seen it, and its class at the threshold that is best over all of them. The means that fill bands are over all folds."""
    rows = _all_bands(spark, sf).withColumn("y_true", (F.col("label") >= 5).cast("int"))
    _, threshold, scores = reports.train_by_folds(rows, C.portable_hash(F.col("y")) % 3, 3, C.portable_hash(F.col("y"), 7) % 4 == 0, maxIter=20)
    return scores.select("y", "x", "fold", "trees", "y_true", "y_prob", (F.col("y_prob") >= threshold).cast("int").alias("class"))


@query()
def predict_map(spark, sf):
    """A scene from reflectance to maps: patches of all bands (without a value, the mean), a perceptron over them fitted on three fifths of the
    rows of pixels, and every pixel with probability and class at the threshold that is best on a further fifth."""
    part = C.portable_hash(F.col("y")) % 5
    px = _all_bands(spark, sf, part < 3)
    scaled = cube.robust_scale(px, cube.robust_fit(px.where(part < 3)))  # bands, before patches repeat them
    got = cube.patches(scaled, F.lit(True), F.forall("features", lambda v: v.isNotNull()), 1).join(px.select("y", "x", "label"), ["y", "x"])
    got = kept(got.select("y", "x", F.flatten(F.flatten("patch")).alias("features"), (F.col("label") >= 5).cast("int").alias("y_true")))
    scored = kept(models.fit_classifier(got.where(part < 3), "perceptron", scale=False).scores(got).select("y", "x", "y_true", "y_prob"))
    threshold = metrics.best_threshold(scored.where(part == 3).select("y_true", "y_prob")).first()["threshold"]
    return cube.to_map(px, scored, threshold)


# The registered queries over tables and over raster files stand in modules of their own.
from leafgrid.plans import tables  # noqa: E402, F401
from leafgrid.plans import rasters  # noqa: E402, F401, I001  (after tables, whose SQL it shares)
