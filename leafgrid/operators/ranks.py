"""Exact ranks over whole tables without a task that sees all rows: quantiles, running totals and places in groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that one task sorts at most to find a rank, and cells into which a span of values is cut to narrow it down.
MOST_VALUES, CELLS = 200_000, 1024
#: Values of a place in arrays that a task sends one by one at most, for each span.
MOST_SENT = 20_000
#: Rows of a cell over which running totals are summed.
CELL_ROWS = 100_000


def exact_quantiles(rows: DataFrame, value: str, at: list[float], *by: str, most: int = MOST_VALUES) -> DataFrame:
    """Quantiles with linear interpolation for each group: ``by`` columns and q, an array; nulls are left out.

    Ranks are narrowed down: a pass counts the values of each cell of a span, and the cell with the rank is the next span,
    until it has few values or one only. There must be few groups: spans and counts of cells come to the driver. Without
    ``by`` there is one row always, with nulls if there is no value.
    """
    spark = rows.sparkSession
    rows = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    known = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where("n > 0").collect()
    spans = []
    for g, r in enumerate(known):
        for k in sorted({int(q * (r.n - 1)) + up for q in at for up in (0, 1)}):
            spans.append({"g": g, "rank": min(k, r.n - 1), "lo": r.lo, "hi": r.hi, "below": 0, "inside": r.n})

    def inside(chosen: list[dict]) -> DataFrame:
        """The rows in each span, as many times as there are spans that have them."""
        listed = [tuple(known[s["g"]][c] for c in by) + (i, s["lo"], s["hi"]) for i, s in enumerate(chosen)]
        schema = ", ".join([*(f"`k_{c}` {rows.schema[c].dataType.simpleString()}" for c in by), "i int, lo double, hi double"])
        same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in by]
        # A few spans for each group.
        return rows.join(F.broadcast(spark.createDataFrame(listed, schema)), [*same, F.col("_v").between(F.col("lo"), F.col("hi"))])

    while wide := [s for s in spans if s["inside"] > most and s["lo"] < s["hi"]]:
        cell = F.least(F.lit(CELLS - 1), F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * CELLS)).alias("cell")
        counts = inside(wide).groupBy("i", cell).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).orderBy("i", "cell").collect()
        before = [s["below"] for s in wide]
        for c in counts:
            if before[c.i] <= wide[c.i]["rank"] < before[c.i] + c.n:
                wide[c.i].update(lo=c.lo, hi=c.hi, below=before[c.i], inside=c.n)
            before[c.i] += c.n
    found = {(s["g"], s["rank"]): s["lo"] for s in spans if s["lo"] == s["hi"]}
    if few := [s for s in spans if s["lo"] < s["hi"]]:
        steps = Window.partitionBy("i").orderBy("_v")  # at most ``most`` values each
        values = inside(few).groupBy("i", "_v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(steps))
        wanted = spark.createDataFrame([(i, s["rank"] - s["below"]) for i, s in enumerate(few)], "i int, want long")
        for r in values.join(F.broadcast(wanted), "i").where("upto > want AND upto - n <= want").collect():
            found[few[r.i]["g"], few[r.i]["rank"]] = r._v
    out = []
    for g, r in enumerate(known):
        places = [q * (r.n - 1) for q in at]
        low, high = ([found[g, min(int(p) + up, r.n - 1)] for p in places] for up in (0, 1))
        out.append((*(r[c] for c in by), [a + (b - a) * (p - int(p)) for a, b, p in zip(low, high, places, strict=True)]))
    if not by and not out:
        out = [([None] * len(at),)]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by), "q array<double>"])
    return spark.createDataFrame(out, schema)


def _matrix(lists: pa.Array) -> np.ndarray:
    """A row for each array; NaN for nulls, and at the end of shorter ones."""
    lists = lists.filter(lists.is_valid())
    sizes, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.full((len(sizes), width), np.nan)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(0))
        n = np.sum(~np.isnan(x), axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(np.nanmin(x[:, some], axis=0, initial=np.inf)), pa.array(np.nanmax(x[:, some], axis=0, initial=-np.inf))], ["band", "n", "lo", "hi"])


def _counter(spans: list[tuple[int, float, float, bool]]):
    """Counts the values of each span (place in the array, from, to, narrow) by cells; by the values themselves in narrow spans."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = (np.full((len(spans), CELLS), v) for v in (0, np.inf, -np.inf))
        sent = [[] for _ in spans]
        for batch in batches:
            x = _matrix(batch.column(0))
            for i, (band, lo, hi, narrow) in enumerate(spans):
                v = x[:, band] if band < x.shape[1] else x[:0, 0]
                v = v[(v >= lo) & (v <= hi)]
                if narrow:
                    sent[i].append(v)
                    continue
                cell = np.minimum(CELLS - 1, np.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * CELLS)).astype(int)
                n[i] += np.bincount(cell, minlength=CELLS)
                np.minimum.at(low[i], cell, v)
                np.maximum.at(high[i], cell, v)
        i, cell = np.nonzero(n)
        parts = [(i, cell, n[i, cell], low[i, cell], high[i, cell])]
        for k, values in enumerate(sent):
            if values:
                v, times = np.unique(np.concatenate(values), return_counts=True)
                parts.append((np.full(len(v), k), np.full(len(v), -1), times, v, v))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["i", "cell", "n", "lo", "hi"])

    return count


def array_quantiles(rows: DataFrame, array: str, at: list[float], most: int = MOST_SENT) -> DataFrame:
    """Quantiles with linear interpolation of each place in arrays of numbers: band (from 0) and q, an array; nulls are left out.

    As exact_quantiles, but arrays are never exploded: a pass counts the cells of all places' spans in one scan, and Spark finds
    the cell of each rank. A task holds CELLS counts for a span and sends at most ``most`` values of a narrow one; only the cells
    that hold a rank come to the driver. Places without a value are left out.
    """
    spark = rows.sparkSession
    lists = rows.where(F.col(array).isNotNull()).select(F.col(array).cast("array<double>").alias("v"))
    known = lists.mapInArrow(_extent, "band long, n long, lo double, hi double").groupBy("band").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    known = {r.band: r for r in known.orderBy("band").collect()}
    ranks = {(b, min(int(q * (r.n - 1)) + up, r.n - 1)): (r.lo, r.hi, 0, r.n) for b, r in known.items() for q in at for up in (0, 1)}
    while wide := {key: s for key, s in ranks.items() if s[0] < s[1]}:
        spans = sorted({(key[0], s[0], s[1], s[3] <= most) for key, s in wide.items()})
        number = {span[:3]: i for i, span in enumerate(spans)}
        asked = [(number[band, s[0], s[1]], band, rank, s[2]) for (band, rank), s in wide.items()]
        ranks |= _narrowed(spark, lists.mapInArrow(_counter(spans), "i long, cell long, n long, lo double, hi double"), asked)
    out = []
    for band, r in known.items():
        places = [q * (r.n - 1) for q in at]
        low, high = ([ranks[band, min(int(p) + up, r.n - 1)][0] for p in places] for up in (0, 1))
        out.append((band, [a + (b - a) * (p - int(p)) for a, b, p in zip(low, high, places, strict=True)]))
    return spark.createDataFrame(out, "band int, q array<double>")


def _narrowed(spark, counts: DataFrame, asked: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], tuple[float, float, int, int]]:
    """For each (span, band, rank, values below the span) the cell with the rank: from, to, values below it and in it."""
    cells = counts.groupBy("i", "cell", F.when(F.col("cell") < 0, F.col("lo")).alias("value")).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("lo"))  # CELLS rows a span, or the values of a narrow one
    wanted = F.broadcast(spark.createDataFrame(asked, "i long, band long, rank long, below long"))  # two ranks for each quantile and place
    held = cells.withColumn("upto", upto).join(wanted, "i").where("below + upto > rank AND below + upto - n <= rank")
    return {(r.band, r.rank): (r.lo, r.hi, r.below + r.upto - r.n, r.n) for r in held.collect()}


def _cells(rows: DataFrame, value: str, cell_rows: int) -> Column:
    """A cell for each row, so that cells have about ``cell_rows`` rows and fall as the value rises."""
    n = rows.count()
    cells = -(-n // cell_rows)
    if cells < 2:
        return F.lit(0)
    cells = min(cells, 5000)
    bounds = sorted(set(rows.agg(F.percentile_approx(value, F.expr(f"array({', '.join(f'{i / cells!r}D' for i in range(1, cells))})"), 20 * cells)).first()[0]))
    listed = F.expr(f"array({', '.join(f'{float(b)!r}D' for b in bounds)})")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    # Binary search for the number of bounds that are not above the value.
    step = lambda acc, s: F.when((acc + s <= len(bounds)) & (F.try_element_at(listed, (acc + s).cast("int")) <= F.col(value)), acc + s).otherwise(acc)
    return F.lit(len(bounds)) - F.aggregate(steps, F.lit(0), step)


def running_totals(rows: DataFrame, order: str, sums: list[str], *by: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` with c_<name>, the sum of a column up to the row by falling ``order``, and t_<name>, the group's sum.

    Rows are cut into cells by their order; sums run within cells, and on from cell to cell over one row for each.
    """
    rows = rows.withColumn("_cell", _cells(rows, order, cell_rows))
    own = Window.partitionBy(*by, "_cell").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    cells = rows.groupBy(*[F.col(c).alias(f"k_{c}") for c in by], F.col("_cell").alias("k_cell")).agg(*[F.sum(s).alias(f"s_{s}") for s in sums])
    keys = [f"k_{c}" for c in by]
    before = Window.partitionBy(*keys).orderBy("k_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, "k_cell", *[F.coalesce(F.sum(f"s_{s}").over(before), F.lit(0)).alias(f"b_{s}") for s in sums], *[F.sum(f"s_{s}").over(Window.partitionBy(*keys)).alias(f"t_{s}") for s in sums])
    joined = rows.select("*", *[F.sum(s).over(own).alias(f"w_{s}") for s in sums]).join(cells, [*[F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in by], F.col("_cell") == F.col("k_cell")])
    return joined.select(*rows.drop("_cell").columns, *[(F.col(f"w_{s}") + F.col(f"b_{s}")).alias(f"c_{s}") for s in sums], *[f"t_{s}" for s in sums])


def place_in_group(rows: DataFrame, by: str, key: Column, *ties: str, span: int = 1 << 32, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` with k, each row's place from 1 in its group by ``key`` (a hash in [0, span), spread evenly) and ``ties``, and
    m, the group's number of rows. A group is ranked by many tasks: places within cells of the key, after the cells before."""
    cells = max(1, -(-rows.count() // cell_rows))
    rows = rows.withColumn("_key", key).withColumn("_cell", F.floor(F.col("_key") / (span / cells)).cast("long"))
    counts = rows.groupBy(F.col(by).alias("k_by"), F.col("_cell").alias("k_cell")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("k_by").orderBy("k_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("k_by", "k_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("k_by")).alias("m"))
    own = F.row_number().over(Window.partitionBy(by, "_cell").orderBy("_key", *ties))
    joined = rows.withColumn("_own", own).join(counts, F.col(by).eqNullSafe(F.col("k_by")) & (F.col("_cell") == F.col("k_cell")))
    return joined.withColumn("k", F.col("_own") + F.col("_before")).drop("_own", "_before", "_key", "_cell", "k_by", "k_cell")
