"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over single features, then over chosen pairs of them, with small steps; each tree only
adds to its feature's (or pair's) lookup table. A score is the sum of the tables' entries at a text's bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, grams, starts_within, sums

#: Fitting sees at most so many labelled documents: those with the smallest hash of their doc_id.
FIT_ROWS = 20_000
PIECE_BYTES = 1 << 20
FEATURES = (
    "log_words", "log_lines", "word_bytes", "word_bytes_sd", "distinct_words", "top_word", "distinct_pairs", "repeated_next", "words_a_line", "upper", "digits", "punctuation", "marks", "pipes",
    "spaces", "beyond_ascii", "shouting", "ends_in_mark", "stops", "longest_word", "commas", "quotes_brackets",
)


def _table(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _table("abcdefghijklmnopqrstuvwxyz")
_CLASSES = {"digits": _table("0123456789"), "punctuation": _table(".,;:!?"), "marks": _table("#$%&*@^~+=<>/\\_{}|"), "pipes": _table("|"), "spaces": _table(" \t\r\x0b\f"), "beyond_ascii": np.arange(256) >= 128, "commas": _table(","), "quotes_brackets": _table("\"'()[]{}")}


def text_features(column, piece_bytes: int = PIECE_BYTES) -> np.ndarray:
    """FEATURES of each text, from all of its bytes; an empty or null text has 0 throughout.

    Texts are taken in pieces of about ``piece_bytes``, as the arrays behind the features are many times their size; a
    longer text is a piece of its own.
    """
    size = pc.fill_null(pc.binary_length(column.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // piece_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(size)]
    return np.concatenate([_piece_features(column.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])


def _piece_features(column) -> np.ndarray:
    words = Words(column)
    raw, off, n = words.raw, words.offsets, np.maximum(words.counts, 1)
    size = np.maximum(np.diff(off), 1)
    share = lambda flags: sums(flags, off) / size
    length = (words.ends - words.starts).astype(float)
    mean = sums(length, words.bounds) / n
    lines = sums(raw == 10, off) + 1
    x = {name: share(table[raw]) for name, table in _CLASSES.items()}
    upper = _UPPER[raw]
    x["upper"] = share(upper)
    x["log_words"], x["log_lines"] = np.log1p(words.counts), np.log(lines)
    x["words_a_line"] = np.log1p(words.counts / lines)
    x["word_bytes"] = mean
    x["word_bytes_sd"] = np.sqrt(np.maximum(sums(length**2, words.bounds) / n - mean**2, 0))
    x["longest_word"] = np.zeros(len(n))
    some = np.flatnonzero(words.counts)
    if len(some):
        x["longest_word"][some] = np.log1p(np.maximum.reduceat(length, words.bounds[:-1][some]))
    x["distinct_words"], x["top_word"] = _distinct(words.hashes, words.owner, len(n), n)
    inner = starts_within(words.bounds, 2)
    x["distinct_pairs"], _ = _distinct(grams(words.hashes, 2)[inner], words.owner[: len(inner)][inner], len(n), np.maximum(n - 1, 1))
    same = np.zeros(len(words.hashes), bool)
    same[: len(inner)] = (words.hashes[:-1] == words.hashes[1:])[: len(inner)] & inner
    x["repeated_next"] = sums(same, words.bounds) / n
    last = raw[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    x["ends_in_mark"] = sums(_CLASSES["marks"][last] | (last == ord("!")), words.bounds) / n
    x["stops"] = sums(last == ord("."), words.bounds) / n
    first = upper[words.starts] if len(words.starts) else np.zeros(0, bool)
    lower_at = np.concatenate([[0], np.cumsum(_LOWER[raw])])
    x["shouting"] = sums(first & (lower_at[words.ends] == lower_at[words.starts]) & (length > 1), words.bounds) / n
    out = np.stack([x[name] for name in FEATURES], axis=1).astype(float)
    out[np.diff(off) == 0] = 0
    return out


def _distinct(keys: np.ndarray, owner: np.ndarray, texts: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, distinct keys and the most frequent key as shares of n."""
    if not len(keys):
        return np.zeros(texts), np.zeros(texts)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]))
    top = np.zeros(texts)
    np.maximum.at(top, o[new], np.diff(np.append(new, len(k))))
    return np.bincount(o[new], minlength=texts) / n, top / n


@dataclass
class AdditiveModel:
    """Bin edges for each feature, lookup tables for features and for pairs, and the intercept."""

    bins: int = 48
    pair_bins: int = 12
    rounds: int = 150
    pair_rounds: int = 60
    pairs_kept: int = 8
    rate: float = 0.15
    leaves: int = 3
    least: float = 20.0
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """Fit on rows x features and 0/1 labels. Without rows of both labels, every score is the smoothed share of 1."""
        share = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(share / (1 - share)))
        wide = x.shape[1]
        self.edges = [self._cuts(x[:, f], self.bins) for f in range(wide)]
        self.pair_edges = [self._cuts(x[:, f], self.pair_bins) for f in range(wide)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs, self.pair_tables = [], []
        if len(y) < 2 or y.min() == y.max():
            return self
        at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.pair_edges)]
        score = np.full(len(y), self.intercept)
        for _ in range(self.rounds):  # features take turns, each with a small tree
            for f in range(wide):
                step = self._tree(at[f], len(self.tables[f]), *self._slopes(score, y))
                self.tables[f] += step
                score += step[at[f]]
        g, h = self._slopes(score, y)
        gains = [(self._cross_gain(coarse[a], coarse[b], g, h), a, b) for a in range(wide) for b in range(a + 1, wide)]
        for gain, a, b in sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[: self.pairs_kept]:
            if gain > 0:
                self.pairs.append((a, b))
                self.pair_tables.append(np.zeros((len(self.pair_edges[a]) + 1, len(self.pair_edges[b]) + 1)))
        for _ in range(self.pair_rounds):
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                step = self._pair_tree(coarse[a], coarse[b], table.shape, *self._slopes(score, y))
                table += step
                score += step[coarse[a], coarse[b]]
        return self

    @staticmethod
    def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) if len(v) else np.zeros(0)

    @staticmethod
    def _slopes(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)

    def _tree(self, at: np.ndarray, n: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of few leaves over one feature's bins, as steps to add to its table."""
        G, H, N = (np.bincount(at, weights=w, minlength=n) for w in (g, h, np.ones(len(g))))
        leaves = [(0, n)]
        while len(leaves) < self.leaves:
            best = max(((*self._cut(G[a:b], H[a:b], N[a:b]), i) for i, (a, b) in enumerate(leaves)), default=None)
            if best is None or best[0] <= 1e-9:
                break
            a, b = leaves[best[2]]
            leaves[best[2] : best[2] + 1] = [(a, a + best[1]), (a + best[1], b)]
        step = np.zeros(n)
        for a, b in leaves:
            step[a:b] = self.rate * G[a:b].sum() / (H[a:b].sum() + 1)
        return step

    def _cut(self, G: np.ndarray, H: np.ndarray, N: np.ndarray) -> tuple[float, int]:
        if len(G) < 2:
            return 0.0, 0
        g, h, n = np.cumsum(G), np.cumsum(H), np.cumsum(N)
        gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
        gain[(n[:-1] < self.least) | (n[-1] - n[:-1] < self.least)] = 0
        k = int(np.argmax(gain))
        return float(gain[k]), k + 1

    def _grid(self, a: np.ndarray, b: np.ndarray, shape: tuple[int, int], *weights: np.ndarray) -> list[np.ndarray]:
        cell = a * shape[1] + b
        return [np.bincount(cell, weights=w, minlength=shape[0] * shape[1]).reshape(shape) for w in weights]

    def _quarters(self, G: np.ndarray, H: np.ndarray) -> tuple[float, int, int]:
        """The best cut of both features at once: the gain of four quarters over none."""
        if min(G.shape) < 2:
            return 0.0, 0, 0
        cg, ch = G.cumsum(0).cumsum(1), H.cumsum(0).cumsum(1)
        gain = np.zeros((G.shape[0] - 1, G.shape[1] - 1))
        for gq, hq in zip(self._corners(cg), self._corners(ch), strict=True):
            gain += gq**2 / (hq + 1)
        gain -= cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
        k = np.unravel_index(int(np.argmax(gain)), gain.shape)
        return float(gain[k]), int(k[0]) + 1, int(k[1]) + 1

    @staticmethod
    def _corners(c: np.ndarray) -> list[np.ndarray]:
        nw, rows, cols, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [nw, rows - nw, cols - nw, all_ - rows - cols + nw]

    def _cross_gain(self, a: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> float:
        G, H = self._grid(a, b, (int(a.max()) + 1, int(b.max()) + 1), g, h)
        return self._quarters(G, H)[0]

    def _pair_tree(self, a: np.ndarray, b: np.ndarray, shape: tuple[int, int], g: np.ndarray, h: np.ndarray) -> np.ndarray:
        G, H = self._grid(a, b, shape, g, h)
        gain, i, j = self._quarters(G, H)
        step = np.zeros(shape)
        if gain > 1e-9:
            for rows in (slice(0, i), slice(i, None)):
                for cols in (slice(0, j), slice(j, None)):
                    step[rows, cols] = self.rate * G[rows, cols].sum() / (H[rows, cols].sum() + 5)
        return step

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row: bins looked up and added."""
        z = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-z))


def held_out(doc_id: Column, remainder: int = 0) -> Column:
    """Whether crc32 of the doc_id as text leaves this remainder by 5; false for null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == remainder, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """A model of labels.quality from the texts of labelled documents that are not held out.

    At most ``fit_rows`` labels are used, those with the smallest hash of the doc_id, and at most twice as many rows of
    documents, by the same rule. Rows with a null doc_id or quality are left out; a doc_id with several labels or several
    documents gives a row for each two.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample is bounded by fit_rows, so this side may be broadcast; texts become features where they are read.
    rows = texts.join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    known = rows.select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, quality int, x array<double>")
    fitted = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(2 * fit_rows).toPandas()
    x = np.stack(fitted["x"].tolist()) if len(fitted) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, fitted["doc_id"].to_numpy())) if len(fitted) else np.zeros(0, int)
    return AdditiveModel().fit(x[order], fitted["quality"].to_numpy(float)[order])


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """Scores of all whole texts: all columns of docs that are given, and ``score`` from 0 to 1.

    A null text counts as empty, and an empty text gets a score too. Repeated rows give a row each; an empty table gives
    an empty table. A column named score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.score(text_features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
