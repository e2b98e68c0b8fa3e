"""SimHash fingerprints of shingles, and near copies by meeting in the middle.

Two fingerprints within a radius share a point within half of it from both. Every distinct fingerprint sends all points of its
ball of half the radius; fingerprints that meet at a point are compared, and those within the radius are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, materialise, pieces, spaced
from .components import connected_components

SEED = 42
#: Shingles whose bits are counted at a time.
AT_ONCE = 500_000
#: Classes that are broadcast at most when documents look up their component. Beyond that only those with more than one in so
#: many of all documents are, and there can't be more of these.
MOST_SENT = 200_000


def simhash(column: pa.Array, k: int = 3, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned 64-bit fingerprints of all texts, and their numbers of shingles.

    A bit is 1 if it is set in over half of the hashes of a text's shingles, repeats included.
    """
    words = Words(column, fold=True)
    data, starts, ends = spaced(words)
    counts = words.counts
    n_shingles = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    owner = np.repeat(np.arange(len(counts)), n_shingles)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + words.bounds[:-1][owner]
    last = np.minimum(first + k, words.bounds[1:][owner]) - 1
    raw, digest = data.tobytes(), xxhash.xxh64_digest
    ones = np.zeros((len(counts), 64), np.int64)
    for a in range(0, len(owner), AT_ONCE):
        of = owner[a : a + AT_ONCE]
        hashed = b"".join([digest(raw[s:e], seed) for s, e in zip(starts[first[a : a + AT_ONCE]].tolist(), ends[last[a : a + AT_ONCE]].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1)
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        ones[of[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n_shingles[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64), n_shingles


def fingerprints(docs: DataFrame, k: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) and n_shingles of each whole text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                fp, n = simhash(piece.column("text"), k, seed)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fp.view(np.int64)), pa.array(n.astype(np.int64))], ["doc_id", "fp", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, fp long, n_shingles long")


def near_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links u, v that connect all fingerprints (fp, each once) within ``radius``, which must be even, of one another.

    All that meet at a point lie within half the radius of it, so each two of them are linked: one after another in order,
    which connects as much as all pairs would. At most as many meet as a ball of half the radius has points, 65 for 2.
    """
    if radius < 0 or radius % 2:
        raise ValueError(f"the radius must be even, not {radius}")
    masks = [sum(1 << b for b in bits) for h in range(radius // 2 + 1) for bits in combinations(range(64), h)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    met = distinct.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in signed])).alias("point"))
    before = F.lag("fp").over(Window.partitionBy("point").orderBy("fp"))
    links = met.select(before.alias("u"), F.col("fp").alias("v")).where("u IS NOT NULL")
    return links.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def link_near_fingerprints(docs: DataFrame, radius: int = 2, k: int = 3, seed: int = SEED) -> DataFrame:
    """Each document's SimHash and near copies: doc_id, fingerprint (16 hexadecimal digits), n_shingles, component_id.

    Words lie between white space, A-Z lower-cased; a text of fewer than ``k`` words is one shingle. Documents link whose
    fingerprints differ in at most ``radius`` bits (an even number); component_id is the smallest doc_id reachable by links,
    itself included.

    A null or empty text has no shingles and the fingerprint zero, which links like any other. Each row gives a row, repeated
    ones too; a null doc_id is never the smallest, and a component without any other has null. An empty table gives an empty
    table. Columns other than doc_id and text are left out.
    """
    prints = materialise(fingerprints(docs, k, seed))
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    linked = connected_components(near_links(classes.select("fp"), radius), "u", "v")
    rooted = materialise(classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    classes = _looked_up(rooted.drop("least"), materialise(least), "root").select("fp", "n", "component_id")
    named = _looked_up(prints, materialise(classes), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_shingles", "component_id")


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows with the table's columns for their key; ``n`` of the table says how many rows have the key.

    A small table is broadcast. Of a large one the hot keys are: at most MOST_SENT keys can have more than one in MOST_SENT rows
    each. The others meet in a shuffle, in which no key is hot.
    """
    keys, total = table.agg(F.count(F.lit(1)), F.sum("n")).first()
    if keys <= MOST_SENT:
        return rows.join(F.broadcast(table.drop("n")), key)
    hot = table.where(F.col("n") > total // MOST_SENT)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot.drop("n")), key).unionByName(rest.join(table.drop("n").hint("shuffle_merge"), key))
