"""Superpixels against a plain loop, whatever the tiles, and their means."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leafgrid.operators import superpixels as S
from leafgrid.operators.superpixels import PITCH, superpixel_means, superpixels
from leafgrid.plans import queries as Q
from leafgrid.sources.catalog import save_layer
from leafgrid.sources.store import scratch_folder

SF = "/root/testdata/sf0.001"
SCHEMA = "y long, x long, features array<double>"


def _plain(rows, step, compactness, rounds, least, resolution=1e6):
    """The superpixel of each position by loops over pixels, centres and pieces."""
    px = {(y, x): [int(v * resolution + 0.5) if v >= 0 else -int(-v * resolution + 0.5) for v in vs] for y, x, vs in rows if vs is not None and None not in vs and y is not None and x is not None}
    own = {(y, x): (y // step, x // step) for y, x in px}
    weight, before = (compactness * resolution / step) ** 2, None
    for turn in range(rounds + 1):
        groups = defaultdict(list)
        for p, c in own.items():
            groups[c].append(p)
        centres = {c: (sum(y for y, _ in g) / len(g), sum(x for _, x in g) / len(g), [sum(px[p][k] for p in g) / len(g) for k in range(len(px[g[0]]))]) for c, g in groups.items()}
        if centres == before:
            break
        before = centres
        for y, x in px:
            found = []
            for c in ((y // step + i, x // step + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if c in centres:
                    cy, cx, v = centres[c]
                    d = 0.0
                    for a, b in zip(px[y, x], v, strict=True):
                        d += (a - b) * (a - b)
                    found.append((d + weight * ((y - cy) * (y - cy) + (x - cx) * (x - cx)), c))
            own[y, x] = min(found)[1]
    piece = {}
    for p in sorted(px):
        if p not in piece:
            piece[p], todo = p, [p]
            while todo:
                y, x = todo.pop()
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if q in px and q not in piece and own[q] == own[p]:
                        piece[q] = piece[p]
                        todo.append(q)
    sizes = Counter(piece.values())
    label = {c: c for c, n in sizes.items() if n >= least}
    while True:
        borders = defaultdict(Counter)
        for (y, x), c in piece.items():
            if c not in label:
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if piece.get(q) in label:
                        borders[c][label[piece[q]]] += 1
        if not borders:
            break
        for c, seen in borders.items():
            label[c] = min(seen, key=lambda k: (-seen[k], k))
    return {p: (r := label.get(c, c))[0] * PITCH + r[1] for p, c in piece.items()}, sizes


def _scene(height, width, seed, noise):
    """Blobs of two values with noise, holes, and an island that nothing but small pieces makes up."""
    rnd = random.Random(seed)
    rows = []
    for y in range(height):
        for x in range(width):
            base = (y // 5 + x // 7) % 3 * 0.3
            rows.append((y, x, [round(base + rnd.gauss(0, noise), 3), round(0.5 - base + rnd.gauss(0, noise), 3)]))
    rows = [(y, x, None if (y, x) == (3, 4) else [v[0], None] if rnd.random() < 0.05 else v) for y, x, v in rows]
    return [*rows, (height + 20, 1, [0.1, 0.2]), (height + 20, 2, [0.9, 0.2]), (None, 2, [0.1, 0.1])]


@pytest.mark.parametrize(("steps", "buckets"), [(1, 5), (2, 3), (64, 1)])
def test_superpixels_equal_a_plain_loop(spark, steps, buckets):
    rows = _scene(23, 31, 5, 0.12)
    want, sizes = _plain(rows, 6, 0.2, 4, 9)
    got = superpixels(spark.createDataFrame(rows, SCHEMA).repartition(3), 6, 0.2, 4, 9, steps=steps, buckets=buckets).collect()
    assert {(r.y, r.x): r.superpixel for r in got} == want and len(got) == len(want)
    assert sum(n < 9 for n in sizes.values()) > 20 and len(set(want.values())) > 10  # small pieces did join
    assert {want[43, 1], want[43, 2]} <= {43 * PITCH + 1, 43 * PITCH + 2}  # and the island stayed


def test_superpixels_follow_edges(spark):
    rows = [(y, x, [float(x >= 11)]) for y in range(12) for x in range(24)]
    got = {(r.y, r.x): r.superpixel for r in superpixels(spark.createDataFrame(rows, SCHEMA), 6, 0.1, buckets=2).collect()}
    assert len(got) == len(rows) and not {s for (_, x), s in got.items() if x < 11} & {s for (_, x), s in got.items() if x >= 11}


def test_superpixels_of_odd_tables(spark):
    assert superpixels(spark.createDataFrame([], SCHEMA), buckets=2).collect() == []
    assert superpixels(spark.createDataFrame([(0, 0, None), (0, 1, [None])], SCHEMA), buckets=2).collect() == []
    with pytest.raises(ValueError, match="from 1 to 2"):
        superpixels(spark.createDataFrame([(0, 0, [1.0]), (0, 1, [1.0, 2.0])], SCHEMA), buckets=2)
    extra = spark.createDataFrame([(0, 0, [1.0], 9, "a")], SCHEMA + ", tile long, best string")
    assert [tuple(r) for r in superpixels(extra, buckets=2).collect()] == [(0, 0, 0)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("superpixels_")]


def test_rounds_leave_pixels_in_their_buckets(spark):
    rows = spark.range(4000).select(F.expr("id div 50").alias("y"), (F.col("id") % 50).alias("x"), F.array(F.col("id")).alias("v"))
    save_layer(rows.withColumn("ci", F.floor(F.col("y") / 5)).withColumn("cj", F.floor(F.col("x") / 5)), "dealt_pixels", 10, 4, scratch_folder(spark))
    try:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        dealt = spark.table("dealt_pixels")
        centres = S.kept(S._means(dealt.withColumn("mi", F.col("ci")).withColumn("mj", F.col("cj")), 1, "tile"))
        plan = S._assign(dealt, centres, 1.0, 2)._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        join = next(i for i, line in enumerate(lines) if "ShuffledHashJoin" in line)
        scan = next(i for i, line in enumerate(lines) if "dealt_pixels" in line)
        assert join < scan and not any("Exchange" in line for line in lines[join:scan]), plan
    finally:
        spark.sql("DROP TABLE dealt_pixels")


def test_superpixel_queries(spark):
    px = [(r.y, r.x, r.features) for r in Q._all_bands(spark, SF).select("y", "x", "features").collect()]
    want, _ = _plain(px, 5, 0.5, 10, 6)
    got = {(r.y, r.x): r.superpixel for r in Q.QUERIES["superpixels"](spark, SF).collect()}
    assert got == want
    means = {r.superpixel: r for r in Q.QUERIES["superpixel_spectra"](spark, SF).collect()}
    assert {s: r.n for s, r in means.items()} == Counter(want.values())
    some = next(iter(means))
    inside = [v for y, x, v in px if want.get((y, x)) == some]
    assert all(abs(m - sum(v[k] for v in inside) / len(inside)) < 1e-9 for k, m in enumerate(means[some].mean))


def test_means_leave_out_missing_values(spark):
    px = spark.createDataFrame([(0, 0, [1.0, None]), (0, 1, [3.0, 5.0]), (1, 0, [9.0, 9.0])], SCHEMA)
    labels = spark.createDataFrame([(0, 0, 7), (0, 1, 7)], "y long, x long, superpixel long")
    assert [tuple(r) for r in superpixel_means(px, labels).collect()] == [(7, 2, 0.0, 0.5, [2.0, 5.0])]
