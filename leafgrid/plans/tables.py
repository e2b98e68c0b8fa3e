"""More registered queries: joins of layers, scenes' structure, tables of scores and plots, samples, and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import columns as C
from leafgrid.operators import cube, metrics, reports, samples
from leafgrid.plans import views as V
from leafgrid.plans.queries import _MASKED, _ablated, _b, _linear, _masked, _round, query
from leafgrid.plans.views import BANDS, CELLS, PLOTS, SCORES

# Layers


@query(
    f"""{_MASKED}, split AS (SELECT y, x, CASE y % 5 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 1 END AS split_id FROM masks), labels_ AS (SELECT y, x, label % 4 AS class FROM masks WHERE label < 8)
SELECT m.y, m.x, class, split_id, round(sum(r), 6) AS total, count(r) AS n FROM masks m JOIN labels_ l ON m.y = l.y AND m.x = l.x JOIN split s ON m.y = s.y AND m.x = s.x JOIN refl r ON m.y = r.y AND m.x = r.x WHERE veg GROUP BY m.y, m.x, class, split_id"""
)
def training_table(spark, sf):
    """Features, labels, split and mask by position: the rows that models are fitted on."""
    px = _masked(spark, sf)
    split = px.select("y", "x", F.when(F.col("y") % 5 == 3, 2).when(F.col("y") % 5 == 4, 3).otherwise(1).alias("split_id"))
    got = cube.stack_layers(px.select("y", "x", "refl"), px.where("label < 8").select("y", "x", (F.col("label") % 4).alias("class")), split, px.where("veg").select("y", "x"))
    known = F.filter("refl", lambda v: v.isNotNull())
    return got.select("y", "x", "class", "split_id", F.round(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.size(known).cast("long").alias("n"))


@query(f"{_MASKED}, f AS (SELECT refl.y, refl.x, band, r FROM refl UNION ALL SELECT y, x, 64, ndvi FROM masks) SELECT y, x, band, round(r, 6) AS v FROM f")
def stacked_features(spark, sf):
    """Bands and an index, one array after the other."""
    rows = _masked(spark, sf).withColumn("refl", F.concat("refl", F.array("ndvi")))
    return cube.long_form(rows).select("y", "x", F.col("band").cast("long").alias("band"), F.round("v", 6).alias("v"))


@query(f"WITH {CELLS} SELECT y, x, band, round(CASE WHEN NOT (wl > 1340 AND wl < 1440) AND NOT (wl > 1800 AND wl < 1950) THEN r END, 6) AS v FROM refl")
def dry_bands(spark, sf):
    """Bands in water windows have no values, and their numbers are never looked at."""
    wl = lambda i: F.lit(V.FIRST_NM) + i * V.STEP_NM
    px = V.pixels(spark, sf).withColumn("dry", F.transform("dn", lambda v, i: F.when(~C.in_windows(wl(i)), C.reflectance(v))))
    return cube.long_form(px, "dry").select("y", "x", F.col("band").cast("long").alias("band"), F.round("v", 6).alias("v"))


@query(f"{_MASKED} SELECT y, x, round(CASE WHEN y % 5 = 4 THEN ndvi END, 6) AS inside FROM masks")
def inside_split(spark, sf):
    return _masked(spark, sf).select("y", "x", F.round(F.when(F.col("y") % 5 == 4, F.col("ndvi")), 6).alias("inside"))


def _variant(name: str, bands: tuple[int, ...], value, sql: str) -> None:
    def run(spark, sf):
        return V.pixels(spark, sf).select("y", "x", F.round(value(), 6).alias("value"))

    run.__name__ = name
    listed = ", ".join(f"max(CASE WHEN band = {i} THEN r END) AS b{i}" for i in bands)
    query(f"WITH {CELLS}, px AS (SELECT y, x, {listed} FROM refl GROUP BY y, x) SELECT y, x, round({sql}, 6) AS value FROM px")(run)


#: With wavelengths of 720, 678 and 554 nm and a small constant below the line instead of a guard.
_variant("ci_green_eps", (5, 12), lambda: C.ratio_eps(_b(12), _b(5)) - 1, "b12 / (b5 + 1e-6::DOUBLE) - 1")
_variant("ndre_720", (10, 12), lambda: C.ndvi(_b(10), _b(12)), "(b12 - b10) / (b12 + b10 + 1e-6::DOUBLE)")
_variant("psri_678", (3, 9, 11), lambda: C.ratio_eps(_b(9) - _b(3), _b(11)), "(b9 - b3) / (b11 + 1e-6::DOUBLE)")


@query("WITH d AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS value, (c_custkey % 50) * 0.4::DOUBLE + 0.203::DOUBLE AS cx, (c_custkey // 50) * 0.6::DOUBLE + 0.301::DOUBLE AS cy FROM customer), c AS (SELECT *, unnest(range(CAST(floor(cy / 0.25) AS BIGINT) - 4, CAST(floor(cy / 0.25) AS BIGINT) + 5)) AS y FROM d), p AS (SELECT *, unnest(range(CAST(floor(cx / 0.25) AS BIGINT) - 4, CAST(floor(cx / 0.25) AS BIGINT) + 5)) AS x FROM c) SELECT y, x, max_by(value, id) AS value FROM p WHERE greatest(0, x * 0.25 - cx, cx - (x + 1) * 0.25) + greatest(0, y * 0.25 - cy, cy - (y + 1) * 0.25) < 0.55 GROUP BY y, x")
def rasterise_touched(spark, sf):
    return cube.polygons_touched(_diamonds(spark, sf), 0.25)


def _diamonds(spark, sf) -> DataFrame:
    key = F.col("c_custkey")
    cx, cy = (key % 50) * 0.4 + 0.203, F.expr("c_custkey div 50") * 0.6 + 0.301
    ring = F.array(*[F.struct((cx + dx).alias("x"), (cy + dy).alias("y")) for dx, dy in ((0.55, 0), (0, 0.55), (-0.55, 0), (0, -0.55))])
    return V.read(spark, sf, "customer").select(key.alias("id"), F.col("c_nationkey").cast("long").alias("value"), F.array(ring).alias("rings"))


@query("WITH d AS (SELECT c_custkey AS id, (c_custkey % 50) * 0.4::DOUBLE + 0.203::DOUBLE AS cx, (c_custkey // 50) * 0.6::DOUBLE + 0.301::DOUBLE AS cy FROM customer) SELECT id, cx - 0.55 >= 0 AND cx + 0.55 <= 18 AND cy - 0.55 >= 0 AND cy + 0.55 <= 15 AS within, cx + 0.55 > 0 AND cx - 0.55 < 18 AND cy + 0.55 > 0 AND cy - 0.55 < 15 AS meets FROM d")
def containment(spark, sf):
    """Which polygons lie in a scene of 18 by 15 units, and which meet it."""
    return reports.containment(reports.extents(_diamonds(spark, sf)), (0.0, 0.0, 18.0, 15.0)).select("id", "within", "meets")


# Spectral structure


_SEGMENTS = f"""WITH {CELLS}, {BANDS}, kept AS (SELECT * FROM bands WHERE NOT (wl > 1340 AND wl < 1440) AND NOT (wl > 1800 AND wl < 1950)), steps AS (SELECT *, wl - lag(wl) OVER (ORDER BY wl) AS step FROM kept), typ AS (SELECT quantile_cont(step, 0.5) AS typical FROM steps),
seg AS (SELECT band, wl, CAST(sum(CASE WHEN step > 2.5 * typical THEN 1 ELSE 0 END) OVER (ORDER BY wl) AS BIGINT) AS seg FROM steps, typ),
pairs AS (SELECT a.band, b.band - a.band AS lag, a.r AS p, b.r AS q FROM refl a JOIN refl b ON a.y = b.y AND a.x = b.x AND b.band - a.band BETWEEN 1 AND 5 WHERE a.r IS NOT NULL AND b.r IS NOT NULL),
co AS (SELECT band, lag, CASE WHEN count(*) > 10 THEN corr(p, q) END AS c FROM pairs GROUP BY band, lag),
curve AS (SELECT s.seg, lag, quantile_cont(t.wl - s.wl, 0.5) AS x, quantile_cont(c, 0.5) AS y FROM co JOIN seg s ON co.band = s.band JOIN seg t ON t.band = co.band + co.lag AND t.seg = s.seg WHERE c IS NOT NULL GROUP BY s.seg, lag)"""
#: The supplied vectors' bands hardly go together, so thresholds lie around zero.
_LEVELS = [0.02, 0.005, 0.0, -0.005, -0.2]
_LENGTHS = f"""{_SEGMENTS}, th AS (SELECT unnest({_LEVELS!r})::DOUBLE AS t), st AS (SELECT seg, x, y, lag(x) OVER (PARTITION BY seg ORDER BY x) AS x0, lag(y) OVER (PARTITION BY seg ORDER BY x) AS y0 FROM curve), ev AS (SELECT *, y0 >= t AND y <= t AS cross_ FROM st, th),
g AS (SELECT seg, t, count(*) AS n, min(y) AS low, max(y) AS high, min(x) AS first_, max(x) AS last_, arg_max(y, x) AS y_last, arg_min(y, x) AS y_first, min(CASE WHEN cross_ THEN x END) AS at_ FROM ev GROUP BY seg, t),
h AS (SELECT g.*, CASE WHEN at_ IS NOT NULL THEN x0 + CASE WHEN y0 > y THEN (y0 - g.t) / (y0 - y) ELSE 0 END * (x - x0) END AS hit FROM g LEFT JOIN st ON g.seg = st.seg AND g.at_ = st.x),
r AS (SELECT seg, t AS threshold, CASE WHEN n < 2 THEN 'no-data' WHEN low > t THEN '>=max' WHEN high < t THEN '<=min' WHEN hit IS NOT NULL THEN 'hit' ELSE 'nan' END AS status, CASE WHEN t BETWEEN y_last AND y_first THEN hit END AS interpolated, first_, last_, hit FROM h),
lengths AS (SELECT seg, threshold, CASE status WHEN '>=max' THEN last_ WHEN '<=min' THEN first_ WHEN 'hit' THEN hit END AS length, status, interpolated FROM r)"""


@query(f"{_SEGMENTS} SELECT seg, CAST(lag AS BIGINT) AS lag, round(x, 6) AS delta_nm, round(y, 6) AS corr FROM curve")
def decorrelation_by_segment(spark, sf):
    return _round(_curve(spark, sf).withColumn("lag", F.col("lag").cast("long")), "delta_nm", "corr")


def _by_segment(spark, sf) -> DataFrame:
    return cube.segments(V.bands(spark, sf).where(~C.in_windows(F.col("wl")))).select("seg", "band", "wl")


def _curve(spark, sf) -> DataFrame:
    return cube.decorrelation_curve(cube.lagged_correlation(V.pixels(spark, sf), [1, 2, 3, 4, 5]), _by_segment(spark, sf))


@query(f"{_LENGTHS} SELECT seg, threshold, round(length, 4) AS length, status, round(interpolated, 4) AS interpolated FROM lengths")
def decorrelation_lengths(spark, sf):
    return _round(cube.decorrelation_lengths(_curve(spark, sf), _LEVELS), "length", "interpolated", digits=4)


@query(f"{_LENGTHS} SELECT l.seg, threshold, round((max(wl) - min(wl)) / any_value(length), 4) AS effective FROM lengths l JOIN seg s ON l.seg = s.seg GROUP BY l.seg, threshold")
def effective_bands(spark, sf):
    """About how many bands of a segment differ: its width over the length at which bands stop going together."""
    width = _by_segment(spark, sf).groupBy("seg").agg((F.max("wl") - F.min("wl")).alias("width"))
    return cube.decorrelation_lengths(_curve(spark, sf), _LEVELS).join(width, "seg").select("seg", "threshold", F.round(F.col("width") / F.col("length"), 4).alias("effective"))


@query(f"WITH {CELLS}, one AS (SELECT sum(count(r)) OVER () AS n, band FROM refl WHERE y IN (SELECT CAST(floor(i * (SELECT max(y) FROM refl) / 4.0) AS BIGINT) FROM range(5) t(i)) GROUP BY band) SELECT any_value(n)::BIGINT AS n, count(*) AS bands FROM one")
def stripe_sample(spark, sf):
    """Values in five rows of pixels that are spread evenly over the scene."""
    rows = samples.stripes(V.pixels(spark, sf), 5)
    return rows.agg(F.sum(F.size(F.filter("refl", lambda v: v.isNotNull()))).alias("n"), F.max(F.size("refl")).cast("long").alias("bands"))


# Scores


_STEPS = "g AS (SELECT {by}, y_prob, sum(y_true) AS tp, sum(1 - y_true) AS fp FROM s GROUP BY ALL), c AS (SELECT *, sum(tp) OVER (PARTITION BY {by} ORDER BY y_prob DESC) AS ctp, sum(fp) OVER (PARTITION BY {by} ORDER BY y_prob DESC) AS cfp, sum(tp) OVER (PARTITION BY {by}) AS p, sum(fp) OVER (PARTITION BY {by}) AS n FROM g), r AS (SELECT {by}, sum(tp / nullif(p, 0) * ctp / (ctp + cfp)) AS ap, sum(fp / nullif(n, 0) * (ctp - tp / 2) / nullif(p, 0)) AS roc FROM c GROUP BY {by})"


@query(f"WITH {SCORES}, s AS (SELECT entry, y_true, y_prob FROM scores), {_STEPS.format(by='entry')}, k AS (SELECT entry, count(*) AS n_px, sum(y_true)::BIGINT AS n_pos, sum(CASE WHEN y_true = 1 AND y_prob >= 0.45 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN y_true = 0 AND y_prob >= 0.45 THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN y_true = 1 AND y_prob < 0.45 THEN 1 ELSE 0 END)::DOUBLE AS fn FROM s GROUP BY entry) SELECT k.entry, n_px, n_pos, round(ap, 6) AS average_precision, round(roc, 6) AS roc_auc, round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round((n_px - fp - fn) / n_px, 6) AS accuracy FROM k JOIN r ON k.entry = r.entry")
def group_metrics(spark, sf):
    """Each entry's pixels with all metrics; F1 is of the positive class."""
    return _round(metrics.group_metrics(V.scores(spark, sf), 0.45, "entry"), "average_precision", "roc_auc", "f1", "precision", "recall", "accuracy")


@query(f"WITH {SCORES}, s AS (SELECT 0 AS all_, y_true, y_prob FROM scores WHERE entry NOT IN (2, 5, 11)), {_STEPS.format(by='all_')} SELECT round(ap, 6) AS average_precision, round(roc, 6) AS roc_auc FROM r")
def filtered_metrics(spark, sf):
    """Metrics over the entries that are documented."""
    return _round(metrics.ranking_metrics(V.scores(spark, sf).where(~F.col("entry").isin(2, 5, 11))), "average_precision", "roc_auc")


@query(f"WITH {SCORES}, grid AS (SELECT 0.01::DOUBLE + i * (0.98::DOUBLE / 198) AS threshold FROM range(199) t(i)), s AS (SELECT y_true, y_prob, count(*) AS w FROM scores GROUP BY ALL), k AS (SELECT threshold, sum(CASE WHEN y_true = 1 AND y_prob >= threshold - 1e-9 THEN w ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN y_true = 0 AND y_prob >= threshold - 1e-9 THEN w ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN y_true = 1 AND y_prob < threshold - 1e-9 THEN w ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN y_true = 0 AND y_prob < threshold - 1e-9 THEN w ELSE 0 END)::DOUBLE AS tn FROM s, grid GROUP BY threshold), f AS (SELECT threshold, (CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END + CASE WHEN 2*tn+fp+fn > 0 THEN 2*tn/(2*tn+fp+fn) ELSE 0 END) / 2 AS f1 FROM k) SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1_macro FROM f ORDER BY round(f1, 12) DESC, threshold LIMIT 1")
def best_threshold_fine(spark, sf):
    return _round(metrics.best_threshold(V.scores(spark, sf), 0.01, 0.99, 199), "threshold", "f1_macro")


@query(f"WITH {SCORES} SELECT model, CAST(sum(CASE WHEN (y_prob >= 0.45) = (y_true = 1) THEN 1 ELSE 0 END) AS BIGINT) AS agree, count(*) AS n FROM scores GROUP BY model")
def agreement(spark, sf):
    hit = (F.col("y_prob") >= 0.45) == (F.col("y_true") == 1)
    return V.scores(spark, sf).groupBy("model").agg(F.count_if(hit).alias("agree"), F.count(F.lit(1)).alias("n"))


#: Two linear models over the bands, and the conditions of the summary.
_MODELS = {"rising": 1.0, "falling": -1.0}
_SUMMARY = {"C0": [], "C1": [0, 1], "C2": list(range(2, 64)), "C3_7": [7], "C3_40": [40], "C3_63": [63]}
_SUMMARY_CASES = ", ".join(f"('{k}', {v!r}::INT[])" for k, v in _SUMMARY.items())
_ABLATED = f"""WITH {CELLS}, means AS (SELECT band, avg(r) AS m FROM refl WHERE vec_id % 5 < 3 GROUP BY band), full_ AS (SELECT refl.*, m, coalesce(r, m) AS f FROM refl JOIN means ON refl.band = means.band), cond(condition, which) AS (VALUES {_SUMMARY_CASES}), mod(model, sign_) AS (VALUES ('rising', 1), ('falling', -1)),
e AS (SELECT condition, vec_id, max(CASE WHEN label >= 5 THEN 1 ELSE 0 END) AS y_true, round(sum(CASE WHEN list_contains(which, full_.band) THEN m ELSE f END * (full_.band - 31.5::DOUBLE)), 6) AS v FROM full_, cond WHERE vec_id % 5 >= 3 GROUP BY ALL),
s AS (SELECT model || '/' || condition AS key, y_true, sign_ * v AS y_prob FROM e, mod), {_STEPS.format(by="key")}, t AS (SELECT split_part(key, '/', 1) AS model, split_part(key, '/', 2) AS condition, ap FROM r)"""


def _model_grid(spark, sf) -> DataFrame:
    """Average precision of each model under each condition: model, condition, average_precision."""
    got = [reports.ablation(_ablated(spark, sf), _SUMMARY, F.col("means"), lambda f, sign=sign: sign * _linear(f)).select(F.lit(name).alias("model"), "condition", "average_precision") for name, sign in _MODELS.items()]
    return got[0].unionByName(got[1])


@query(f"{_ABLATED}, p AS (SELECT model, max(CASE WHEN condition = 'C0' THEN ap END) AS a, max(CASE WHEN condition = 'C1' THEN ap END) AS b, max(CASE WHEN condition = 'C2' THEN ap END) AS c FROM t GROUP BY model) SELECT model, round(a, 6) AS c0, round(b, 6) AS c1, round(c, 6) AS c2, round(a - b, 4) AS delta, round((a - b) / a * 100, 2) AS delta_percent FROM p")
def ablation_pivot(spark, sf):
    """A row for each model with its conditions side by side, and what the first two differ by."""
    wide = _model_grid(spark, sf).groupBy("model").pivot("condition", ["C0", "C1", "C2"]).agg(F.first("average_precision"))
    delta = F.col("C0") - F.col("C1")
    return wide.select("model", *[F.round(c, 6).alias(c.lower()) for c in ("C0", "C1", "C2")], F.round(delta, 4).alias("delta"), F.round(delta / F.col("C0") * 100, 2).alias("delta_percent"))


@query(f"{_ABLATED}, d AS (SELECT t.model, t.condition, round(b.ap - t.ap, 6) AS delta FROM t JOIN t b ON t.model = b.model AND b.condition = 'C0' WHERE t.condition LIKE 'C3%'), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY delta DESC, condition) AS place FROM d) SELECT model, condition AS feature, delta FROM k WHERE place = 1")
def strongest_feature(spark, sf):
    """The single feature whose loss costs each model most; of equals the first."""
    grid = _model_grid(spark, sf)
    base = grid.where("condition = 'C0'").select("model", F.col("average_precision").alias("base"))
    drops = grid.where("condition LIKE 'C3%'").join(base, "model").withColumn("delta", F.round(F.col("base") - F.col("average_precision"), 6))
    best = F.row_number().over(Window.partitionBy("model").orderBy(F.col("delta").desc(), "condition"))  # a few conditions for each model
    return drops.withColumn("place", best).where("place = 1").select("model", F.col("condition").alias("feature"), "delta")


# Plots, orders and events


@query(f"WITH {PLOTS}, half AS (SELECT class, plot, min(id) AS first_id FROM plots WHERE id % 3 > 0 GROUP BY class, plot) SELECT p.class, count(*) AS n, count(*) FILTER (WHERE first_id IS NULL) AS unmatched FROM plots p LEFT JOIN half h ON p.class = h.class AND p.plot = h.plot GROUP BY p.class")
def unmatched_plots(spark, sf):
    """Plots without an entry in a split table, by two keys."""
    plots = V.plots(spark, sf)
    half = plots.where("id % 3 > 0").groupBy("class", "plot").agg(F.min("id").alias("first_id"))
    return plots.join(half, ["class", "plot"], "left").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first_id").isNull()).alias("unmatched"))


@query(f"WITH {PLOTS} SELECT entry, CASE entry WHEN 1 THEN 'ICA' WHEN 4 THEN 'Diamante' WHEN 7 THEN 'Capiro' ELSE 'unknown' END AS name, count(*) AS n FROM plots GROUP BY entry")
def entry_names(spark, sf):
    """Names from a dictionary, with one for all others."""
    names = F.create_map(*[F.lit(v) for pair in {1: "ICA", 4: "Diamante", 7: "Capiro"}.items() for v in pair])
    return V.plots(spark, sf).groupBy("entry").agg(F.count(F.lit(1)).alias("n")).select("entry", F.coalesce(names[F.col("entry")], F.lit("unknown")).alias("name"), "n")


@query(f"WITH {PLOTS} SELECT id, class, rep FROM plots WHERE (rep = 1) <> (class >= 1)")
def inconsistent_labels(spark, sf):
    """Rows whose two-valued label doesn't follow from the class."""
    return V.plots(spark, sf).where((F.col("rep") == 1) != (F.col("class") >= 1)).select("id", "class", "rep")


@query(f"WITH {PLOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY ((id + 42) * 2654435761) % 4294967296, id) AS k, count(*) OVER (PARTITION BY class) AS m FROM plots) SELECT id, class, k <= floor(m * 0.7) AS train FROM r")
def stratified_split(spark, sf):
    return samples.stratified(V.plots(spark, sf), "class", 0.7).select("id", "class", "train")


@query(f"WITH {PLOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY class, plot ORDER BY id) AS k FROM plots) SELECT class, plot, id, entry FROM r WHERE k = 1")
def first_of_group(spark, sf):
    """Of rows with the same class and plot the one with the smallest id."""
    return samples.first_of(V.plots(spark, sf).select("class", "plot", "id", "entry"), ["class", "plot"], "id")


@query(f"WITH {PLOTS}, o AS (SELECT unnest([3, 0, 2, 1]) AS class, unnest([0, 1, 2, 3]) AS place) SELECT place, o.class, count(id) AS n FROM o LEFT JOIN plots ON plots.class = o.class GROUP BY place, o.class")
def listed_order(spark, sf):
    """Classes in a given order, also those without rows."""
    counts = V.plots(spark, sf).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return samples.in_order(counts, "class", [3, 0, 2, 1]).select(F.col("place").cast("int").alias("place"), F.col("class").cast("int").alias("class"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1996-05-01'")
def date_range(spark, sf):
    """Orders of three months, from the first day to the last one whatever its number; the range reaches the scan."""
    first, last = F.lit("1996-02-01").cast("date"), F.last_day(F.lit("1996-04-01").cast("date"))
    day = F.col("o_orderdate")
    return V.read(spark, sf, "orders").where((day >= first.cast("timestamp")) & (day < F.date_add(last, 1).cast("timestamp"))).select("o_orderkey", "o_orderdate")


@query("WITH k AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS top FROM k GROUP BY event_type")
def event_properties(spark, sf):
    """Fields of a JSON column."""
    rows = V.read(spark, sf, "events").select("event_type", F.from_json("props", "k long").alias("p")).select("event_type", "p.k")
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


@query(f"WITH {CELLS}, c AS (SELECT y, x, count(*) AS n, count(r) AS known, min(CASE WHEN r IS NULL THEN band END) AS first_ FROM refl GROUP BY y, x) SELECT y, x, CASE WHEN n <> 64 THEN 'expected 64 bands, got ' || n WHEN known < n THEN 'band ' || first_ || ' has no value' ELSE 'ok' END AS verdict FROM c")
def request_verdicts(spark, sf):
    """What a service would say of each vector: how many values it lacks, or which is the first."""
    missing = F.array_position(F.transform("refl", lambda v: v.isNull()), True)
    verdict = F.when(F.size("refl") != 64, F.concat(F.lit("expected 64 bands, got "), F.size("refl"))).when(missing > 0, F.concat(F.lit("band "), missing - 1, F.lit(" has no value"))).otherwise("ok")
    return V.pixels(spark, sf).select("y", "x", verdict.alias("verdict"))


@query("WITH d AS (SELECT user_id, event_type, count(*) AS n, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS elapsed FROM events GROUP BY ALL) SELECT event_type, CAST(sum(elapsed) AS BIGINT) AS seconds, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / nullif(sum(elapsed), 0), 9) AS per_second FROM d GROUP BY event_type")
def run_durations(spark, sf):
    """How long runs took altogether, and their throughput; a run is what one user has of a type."""
    seconds = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    runs = V.read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), (seconds(F.max("ts")) - seconds(F.min("ts"))).alias("elapsed"))
    total = F.sum("elapsed")
    return runs.groupBy("event_type").agg(total.alias("seconds"), F.sum("n").alias("n"), F.round(F.sum("n") / F.when(total > 0, total), 9).alias("per_second"))


@query("WITH s AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events), b AS (SELECT *, max(CASE WHEN before IS NULL OR value > before THEN epoch END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_at FROM s) SELECT user_id, event_id, epoch - best_at AS stale, epoch - best_at >= 5 AS stop FROM b")
def early_stop(spark, sf):
    """How many epochs ago each run was best, and whether a patience of five is over."""
    return metrics.staleness(V.read(spark, sf, "events"), "value", "event_id", 5, "user_id").select("user_id", "event_id", "stale", "stop")


@query(f"WITH {SCORES}, k AS (SELECT y_true, CASE WHEN y_prob >= 0.45 THEN 1 ELSE 0 END AS y_pred, count(*) AS n FROM scores GROUP BY ALL) SELECT y_true, y_pred, printf('%.2f', 100.0 * n / sum(n) OVER (PARTITION BY y_true)) || '% of ' || n AS cell FROM k")
def confusion_text(spark, sf):
    """Cells of a confusion matrix as they are printed."""
    cells = metrics.confusion(V.scores(spark, sf), 0.45)
    return cells.select("y_true", "y_pred", F.format_string("%.2f%% of %d", 100 * F.col("of_row"), "n").alias("cell"))
