"""Mixing sources to target weights by the cube method: balanced sampling on word and document totals."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, materialise

#: Documents of one source that a task draws from at once, and chunks whose open documents are drawn together.
CHUNK_DOCS = 1000
CHUNKS_AT_ONCE = 64
#: Sources that are broadcast at most, a few numbers each; with more of them none can be hot enough to harm a join.
MOST_SOURCES = 100_000
#: Documents of a group that the flight leaves open; with the two that it can't settle, the landing has so many choices.
RESERVED = 13
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """For each source: source, source_size, n_docs, target.

    Sources in code point order, null last, weigh ``weights`` in turn and share the total of all sizes; a target stops at
    ``most`` times its source's size, and the excess goes to the others by weight until none is above. That is: with
    sources by rising cap for each unit of weight, those before some place are at their caps. Windows here see one row
    for each source, and no document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (turn % len(weights) + 1).cast("int"))
    rows = totals.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("full", F.col("left") * F.col("w") >= F.col("cap") * F.col("w_left"))
    free = F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    free_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)
    target = F.when(F.col("full"), F.col("cap")).otherwise(free * F.col("w") / free_w)
    return rows.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _rng(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little"))


def fly(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase of the cube method on one run of units, in order: nearly all probabilities become 0 or 1.

    Three units are open at a time. They move along the direction that changes neither the expected total of sizes nor
    that of units, up to a face of the cube, to either side with the chances that keep the expectation; the unit that has
    reached 0 or 1 makes room for the next. At most two units stay open.
    """
    p = p.astype(float).copy()
    draws = rng.random(len(p) + 3)
    open_, used = [], 0
    for i in range(len(p)):
        if p[i] <= _EPS or p[i] >= 1 - _EPS:
            p[i] = round(p[i])
            continue
        open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b]))
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = np.inf
            for j, d in zip(open_, u, strict=True):
                if d:
                    to_one, to_zero = (1 - p[j]) / abs(d), p[j] / abs(d)
                    up, down = min(up, to_one if d > 0 else to_zero), min(down, to_zero if d > 0 else to_one)
            step = up if draws[used] * (up + down) < down else -down
            used += 1
            for j, d in zip(open_, u, strict=True):
                p[j] += step * d
                if p[j] <= _EPS or p[j] >= 1 - _EPS:
                    p[j] = round(p[j])
            open_ = [j for j in open_ if 0 < p[j] < 1]
    return p


def reserve(n: int) -> np.ndarray:
    """Places, evenly spread over n units by size, that the flight leaves for the landing."""
    return np.unique(np.linspace(0, n - 1, min(n, RESERVED)).astype(int)) if n else np.zeros(0, int)


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Round the few open units so that the total of sizes changes least, then that of units."""
    at = np.flatnonzero((p > 0) & (p < 1))
    total, units = np.zeros(1), np.zeros(1)
    for i in at:
        total, units = np.concatenate([total, total + size[i]]), np.concatenate([units, units + 1])
    best = np.lexsort((np.abs(units - p[at].sum()), np.abs(total - (size[at] * p[at]).sum()).round(6)))[0]
    p = p.copy()
    p[at] = (best >> np.arange(len(at))) & 1
    return p


def _draw(last: bool):
    """Draws within one group of documents of one source: the flight of most of them, and in the last round the landing."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "mark"], ascending=[False, True], kind="stable")
        size, p = pdf["size"].to_numpy(np.int64), pdf["p"].to_numpy(float).copy()
        flown = np.ones(len(p), bool)
        flown[reserve(len(p))] = False
        p[flown] = fly(size[flown], p[flown], _rng(pdf["source"].iloc[0], pdf["group"].iloc[0], last))
        return pdf.assign(p=land(size, p) if last else p)

    return draw


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """How much of each document a mix of the sources takes: doc_id, source, size, source_size, target, taken.

    ``size`` is the number of words. A source with target t and size s takes each document floor(t / s) times, and once
    more with probability frac(t / s); these are drawn so that the words and the documents taken match their
    expectations, but for the landing of a few documents of each source, which changes the words least. No document is taken more than
    ``most`` times. Draws depend on the rows alone, so reruns agree, whatever the partitions.

    Documents are dealt into chunks of about CHUNK_DOCS within a source, however large the source; the open ones of
    many chunks are drawn together in further rounds, until one group for each source lands.

    A null or empty text has size 0 and is taken 0 words. A null source is a source of its own, the last. Repeated rows
    count and are drawn separately (they share chunks). Other columns are left out; an empty table gives an empty one.
    """
    # Rows without a doc_id are dealt by their text, as a third of all rows may be such.
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("doc_id").cast("long"), F.lit(5)))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), mark.alias("mark"))
    sizes = materialise(sizes)  # the texts are read once; a few bytes for each document are kept
    targets = source_targets(sizes, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chunks = F.ceil(F.col("n_docs") / CHUNK_DOCS).cast("long")
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "target", F.floor(ratio + _EPS).cast("long").alias("whole"), ratio.alias("ratio"), chunks.alias("chunks"))
    targets = materialise(targets)
    targets = F.broadcast(targets) if targets.count() <= MOST_SOURCES else targets
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source", "n_docs")
    p = F.col("ratio") - F.col("whole")
    rows = rows.withColumn("p", F.when((F.col("size") > 0) & (p > _EPS), p).otherwise(0.0))
    rows = rows.withColumn("group", F.pmod("mark", F.col("chunks"))).drop("ratio", "chunks")

    most_chunks = -(-sizes.count() // CHUNK_DOCS)
    schema = rows.schema
    parts, at, groups = [rows.where(F.col("p") == 0.0)], rows.where(F.col("p") > 0.0), most_chunks
    while True:
        last = groups <= 1
        drawn = materialise(at.groupBy("source", "group").applyInPandas(_draw(last), schema))
        if last:
            parts.append(drawn)
            break
        parts.append(drawn.where(F.col("p").isin(0.0, 1.0)))
        at = drawn.where(~F.col("p").isin(0.0, 1.0)).withColumn("group", F.expr(f"group div {CHUNKS_AT_ONCE}"))
        groups = -(-groups // CHUNKS_AT_ONCE)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("p").cast("long"))).cast("long").alias("taken"))
