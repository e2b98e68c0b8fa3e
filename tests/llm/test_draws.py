"""Whitening, SimHash and importance resampling against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafgrid.llm import importance, simhash, whitening
from leafgrid.llm.importance import crc32_slices, resample
from leafgrid.llm.queries import QUERIES
from leafgrid.llm.simhash import link_near_fingerprints, near_links
from leafgrid.llm.whitening import jacobi_davidson, minres, whiten

SCHEMA = "doc_id long, text string, fp string, score double, n long, rank string"
SF = "/root/testdata/sf0.001"


def texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdéÉXYZ09") for _ in range(r.randint(1, 9)))
    vocabulary = [word() for _ in range(150)]
    text = lambda n: r.choice([" ", "\t\n ", " x "]).join(r.choice(vocabulary) for _ in range(n))
    long = [r.choice(vocabulary) for _ in range(4000)]
    base = " ".join(long)
    near = [" \n".join([*long[:at], word(), *long[at + 1 :]]) for at in range(0, 4000, 250)]
    odd = [None, "", " \n", "one", "One", "two words", "- , .", "w" * 300 + " " + "w" * 300, text(30_000)]
    return [*odd, *near, *[text(r.randint(1, 120)) for _ in range(150)], *[base] * 4]


ROWS = [(None if i % 40 == 7 else i * 2 % 331, t, "clash", 0.5, i, "r") for i, t in enumerate(texts())]
ROWS += [ROWS[30]] * 3  # rows that repeat


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


def _fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    h = [xxhash.xxh64_intdigest(b" ".join(w[a : a + 3]), 42) for a in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _linked(fps, radius):
    """The root of each fingerprint, by comparing each two."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("sent", [200_000, 3])
def test_simhash(docs, monkeypatch, sent):
    monkeypatch.setattr(simhash, "MOST_SENT", sent)  # the second way joins all but the hot classes in a shuffle
    prints = [_fingerprint(r[1]) for r in ROWS]
    root = _linked(set(prints), 2)
    least = {}
    for r, f in zip(ROWS, prints, strict=True):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    want = Counter((r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(ROWS, prints, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in link_near_fingerprints(docs).collect()) == want
    assert len(set(prints)) - len(set(root.values())) > 2  # some near copies are linked by other fingerprints than their own


def test_shingle_hashes_are_those_of_spark(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first()["h"]
    assert _fingerprint("ONE two  three") == got % (1 << 64)


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_of_fingerprints_meet_in_the_middle(spark, radius):
    r, fps = random.Random(radius), {0, (1 << 64) - 1, 1 << 63}
    for _ in range(25):
        f = r.getrandbits(64)
        for _ in range(6):  # chains of fingerprints with a few bits between them
            fps.add(f)
            for b in r.sample(range(64), r.randint(1, 5)):
                f ^= 1 << b
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    links = near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()
    assert all(0 < (signed[u] ^ signed[v]).bit_count() <= radius for u, v in links)
    root = _linked(fps, radius)
    ours = {f: f for f in fps}
    for u, v in links:
        old, new = ours[signed[u]], ours[signed[v]]
        ours = {f: new if g == old else g for f, g in ours.items()}
    assert len(set(ours.values())) == len(set(root.values()))


def test_radius_must_be_even(spark):
    with pytest.raises(ValueError, match="even"):
        near_links(spark.range(1).withColumnRenamed("id", "fp"), 3)


def _drawn(rows, target, runs=1, buckets=10_000, percent=10, least=20):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(" ".join(w[a : a + k]).encode()) % buckets for k in range(1, runs + 1) for a in range(len(w) - k + 1)]

    s, t = (Counter(b for x in xs for b in features(x)[1]) for xs in ([r[1] for r in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for r in rows:
        n_words, found = features(r[1])
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    some = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, -x[2], -x[1]))
    for rank, x in enumerate(some[: percent * len(some) // 100], 1):
        x[4] = rank
    return Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize(("runs", "percent", "accuracy"), [(1, 10, 10_000), (2, 35, 10), (1, 100, 5), (3, 0, 10_000)])
def test_resample(spark, docs, runs, percent, accuracy):
    target = [ROWS[40][1], ROWS[41][1], None, "", "nothing like IT"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample(docs, items, percent, runs=runs, accuracy=accuracy, carry=("fp", "text"))
    rows = got.collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in rows) == _drawn(ROWS, target, runs, percent=percent)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in ROWS) and {r.fp for r in rows} == {"clash"}


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    rows = spark.createDataFrame([(i, s, 0, 0, i) for i, s in enumerate([*range(500), *[250] * 500])], "doc_id long, score long, weight long, n_features long, _row long")
    seen = []
    exact = F.percentile_approx
    monkeypatch.setattr(importance.F, "percentile_approx", lambda c, q, a: seen.append(q) or exact(c, [0.0, 0.0], a))  # a sketch that is always off
    low, high, above = importance._bracket(rows, 1000, 100, 1000)
    assert len(seen) > 1 and (low, high, above) == (0, 499, 0)


def test_slices_have_their_crc():
    data = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    starts = np.array([0, 5, 5, 100, 4000])
    ends = np.array([5, 5, 69, 165, 5000])
    assert crc32_slices(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def _whitened(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return c @ v / np.sqrt(e), e / (c * c).sum() * n, [sum(d * d for d in row) for row in (n * x.astype(object) - s.astype(object)).tolist()]


@pytest.mark.parametrize(("dim", "n", "k"), [(6, 50, 4), (40, 300, 32), (200, 900, 8)])
def test_whiten(spark, monkeypatch, dim, n, k):
    monkeypatch.setattr(whitening, "BLOCK_VALUES", 50 * dim)
    vectors = (np.random.default_rng(dim).standard_normal((n, dim)) * np.linspace(4, 0.5, dim)).astype(np.float32).tolist()
    vectors += vectors[:3]
    bad = [None, [], [1.0] * (dim - 1), [float("nan")] * dim, [None, *[1.0] * (dim - 1)], [float("inf"), *[0.0] * (dim - 1)]]
    rows = [(i, v, 1.0) for i, v in enumerate([*vectors, *bad])] + [(None, [0.25] * dim, 2.0)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n double").repartition(4), components=k).collect()
    values, explained, deviations = _whitened([*vectors, [0.25] * dim], k)
    assert len(got) == n + 4 and {r.n for r in got} == {n + 4} and {len(r.whitened) for r in got} == {k}
    at = {i: i for i in range(n + 3)} | {None: n + 3}
    ours, theirs = np.array([r.whitened for r in got]), values[[at[r.vec_id] for r in got]]
    assert np.abs(ours - theirs * np.sign((ours * theirs).sum(axis=0))).max() < 1e-8
    assert np.abs(np.array(got[0].explained) / explained - 1).max() < 1e-10
    assert [r.deviation for r in got] == [Decimal(deviations[at[r.vec_id]]) for r in got]
    assert got[0].identity_error < 1e-10


def test_odd_embeddings(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, schema)).collect()
    assert len(same) == 5 and all(r.whitened == [] and r.deviation == 0 and r.identity_error is None for r in same)
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 3.0]) for i in range(6)], schema)).collect()
    assert {len(r.whitened) for r in line} == {1} and abs(line[0].explained[0] - 1) < 1e-12
    far = [[3.0e13, 0.0], [-3.0e13, 1.0], [0.0, 5.0]]  # beyond what 64 bits hold of (n x - S)^2
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame(list(enumerate(far)), "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(3)] == [Decimal(d) for d in _whitened(far, 1)[2]]


def test_jacobi_davidson_in_a_large_space():
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.standard_normal((600, 600)))[0]
    spectrum = np.concatenate([[9.0, 9.0, 8.999999], 1 / np.arange(1, 598)])
    a, products = (q * spectrum) @ q.T, []
    values, vectors = jacobi_davidson(lambda t: products.append(t.shape[1]) or a @ t, 600, 12, most=60)
    assert np.abs(values - spectrum[:12]).max() < 1e-12 and np.abs(a @ vectors - vectors * values).max() < 1e-12
    assert len(products) < 100 and max(products) <= 48


def test_minres_has_the_least_residual_of_its_space():
    r = np.random.default_rng(4)
    a = r.standard_normal((30, 30))
    a, b = a + a.T, r.standard_normal((30, 2))
    t = minres(lambda t: a @ t, b, 7)
    for j in range(2):
        space = [b[:, j]]
        for _ in range(6):
            space.append(a @ space[-1] / np.linalg.norm(space[-1]))
        q = np.linalg.qr(np.stack(space, axis=1))[0]
        least = q @ np.linalg.lstsq(a @ q, b[:, j], rcond=None)[0]
        assert np.abs(t[:, j] - least).max() < 1e-8


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert link_near_fingerprints(none).count() == 0 and resample(none, items).count() == 0
    one = [(4, "word " * 25)]
    got = resample(spark.createDataFrame(one, "doc_id long, text string"), items.limit(0), percent=100)
    assert Counter(map(tuple, got.collect())) == _drawn(one, [], percent=100)


def test_queries_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op13_importance"](spark, SF).collect())) == _drawn(docs, target)
    prints = {i: _fingerprint(t) for i, t in docs}
    root = _linked(set(prints.values()), 2)
    least = {}
    for i, f in prints.items():
        least[root[f]] = min(least.get(root[f], i), i)
    assert {tuple(r) for r in QUERIES["op12_simhash"](spark, SF).collect()} == {(i, f"{f:016x}", least[root[f]]) for i, f in prints.items()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    values, explained, deviations = _whitened([r.embedding for r in rows], 32)
    got = QUERIES["op11_whitening"](spark, SF).orderBy("vec_id", "component").toPandas()
    ours = got["whitened"].to_numpy().reshape(len(rows), 32)
    assert np.abs(np.abs(ours) - np.abs(values)).max() < 1e-6 and got["deviation"][::32].tolist() == deviations
    assert np.abs(got["explained"][:32] / explained - 1).max() < 1e-9 and got["identity_error"].max() < 1e-9
