"""Importance resampling towards a target's distribution of hashed features.

Each document has the sum of its buckets' log ratios as weight, read from an array, and a Gumbel noise of its id on top; the
documents with the highest scores are drawn. The cutoff is bracketed by a quantile sketch, exact counts outside show whether
the bracket holds it, and only the bracket is sorted to find it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, Words, materialise, pieces, spaced, sums

BUCKETS = 10_000
#: The sketch's ranks are off by one in so many of all.
ACCURACY = 10_000
#: Slices of more bytes than this are hashed one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC_TABLE = _crc_table()


def crc32_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each slice of bytes: the first bytes of all slices, then the second ones, and so on."""
    size = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    left, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(left):
        now = crc[left]
        crc[left] = CRC_TABLE[(now ^ data[starts[left] + at]) & np.uint32(255)] ^ (now >> np.uint32(8))
        at += 1
        left = left[size[left] > at]
    crc = ~crc
    for i in np.flatnonzero(size > LONG):
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return crc


def _features(column: pa.Array, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the features of all texts, the bounds of each text's, and each text's number of words."""
    words = Words(column, fold=True, word_bytes=ALNUM_BYTES)
    data, starts, ends = spaced(words)
    owner, found, of = words.owner, [], []
    for k in range(1, runs + 1):
        first = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :]) if len(owner) >= k else np.zeros(0, np.int64)
        found.append(crc32_slices(data, starts[first], ends[first + k - 1]) % np.uint32(buckets))
        of.append(owner[first])
    found, of = np.concatenate(found).astype(np.int64), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return found[order], np.searchsorted(of[order], np.arange(len(words.bounds))), words.counts


def _bucket_counts(texts: DataFrame, runs: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts: a task gives one number a bucket, and the shuffle sums those."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                total += np.bincount(_features(piece.column("text"), runs, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():  # at most one row a bucket
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a nat by which a bucket is likelier in the target, one added to each count, rounded down."""
    s_all, t_all = float(corpus.sum()) + len(corpus), float(target.sum()) + len(corpus)
    ratio = lambda s, t: (t + 1.0) * s_all / ((s + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable that the id alone decides, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, seed: int = 2024, runs: int = 1, buckets: int = BUCKETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document, and carry_* for the columns named in ``carry``."""
    gains = bucket_gains(_bucket_counts(docs, runs, buckets), _bucket_counts(target, runs, buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    kept = ["doc_id", *[f"carry_{c}" for c in carry]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found, bounds, n_words = _features(piece.column("text"), runs, buckets)
                figures = [n_words, np.diff(bounds), sums(gains[found], bounds)]
                yield pa.RecordBatch.from_arrays([*map(piece.column, kept), *[pa.array(x.astype(np.int64)) for x in figures]], [*kept, "n_words", "n_features", "weight"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    weighed = rows.mapInArrow(score, f"{kinds}, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def _order() -> list[Column]:
    """Falling score, ties to the smaller doc_id; rows that agree in these are told apart by weight, and at last by row."""
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc(), F.col("_row").asc()]


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with their place from 1 in the order of draws: ranges are sorted apart, and counts of the ranges before are added."""
    ranges = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    ranges = materialise(ranges.withColumn("_at", F.monotonically_increasing_id()))  # range in the high bits, place in the low 33
    ranges = ranges.withColumn("_range", F.shiftright("_at", 33))
    before, starts = 0, []
    for r, n in ranges.groupBy("_range").count().orderBy("_range").collect():  # one row a task
        starts.append((r, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "_range long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranges.join(F.broadcast(starts), "_range").withColumn("place", place).drop("_range", "_before", "_at")


def _bracket(rows: DataFrame, n: int, k: int, accuracy: int) -> tuple[int, int, int]:
    """Scores between which the k-th highest of n lies, and how many are above both.

    The sketch may be off; a bracket holds only if the exact counts above and within say so, and is widened until it does.
    """
    share, margin = 1 - k / n, 2 / accuracy
    while True:
        ends = F.percentile_approx("score", [max(0.0, share - margin), min(1.0, share + margin)], accuracy) if margin < 1 else F.array(F.min("score"), F.max("score"))
        low, high = rows.agg(ends).first()[0]
        above, within = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + within:
            return low, high, above
        margin *= 16


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, runs: int = 1, buckets: int = BUCKETS, carry: tuple[str, ...] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Draws ``percent`` of the documents with ``least_words`` words or more, likelier the more they are like the target.

    Every document comes back: doc_id, n_features, weight, score, and rank (1, 2, 3... among the drawn, falling score, ties to
    the smaller doc_id; null for the others), and the columns named in ``carry`` (not these five). Words are runs of digits,
    letters and characters beyond ASCII, A-Z lower-cased; features are all runs of 1 to ``runs`` consecutive words.

    A null or empty text has no features and weight 0. A null doc_id draws the noise of the empty text and loses ties. Rows
    that repeat count one by one and have ranks of their own. No documents give an empty table; with an empty target every
    bucket's gain follows from the documents alone. Columns that aren't asked for are left out.
    """
    scored = materialise(weigh(docs, target, seed, runs, buckets, carry).withColumn("_row", F.monotonically_increasing_id()))
    fit = scored.where(F.col("n_words") >= least_words)
    n = fit.count()
    k = percent * n // 100
    shown = lambda rows, rank: rows.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"), *[F.col(f"carry_{c}").alias(c) for c in carry])
    if not k:
        return shown(scored, F.lit(None))
    low, high, above = _bracket(fit, n, k, accuracy)
    certain = _placed(fit.where(F.col("score") > high))
    bracket = _placed(fit.where(F.col("score").between(low, high)))
    rest = scored.where((F.col("n_words") < least_words) | (F.col("score") < low))
    cut = F.when(F.col("place") <= k - above, F.col("place") + above)
    return shown(certain, F.col("place")).unionByName(shown(bracket, cut)).unionByName(shown(rest, F.lit(None)))
