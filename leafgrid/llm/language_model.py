"""Language-model scoring: a trigram model by deleted interpolation.

Maximum-likelihood estimates of trigrams are mixed with those of bigrams, and these with smoothed unigrams; the weights depend on
how often the context occurs, by buckets, and are learned by expectation-maximisation on counts from which the judged token is
deleted: first the bigrams' weights, then, with these, the trigrams'.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import Words, mix, sums
from .quality import held_out

_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR, _TRIPLE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Context buckets are powers of two of its count. Evidence is counted by cells of the likelihood ratio, a 32nd power of two wide,
#: with the mean ratio of each: within a cell a token's share of a weight differs by less than 0.6 % from that at the mean, and the
#: sums of shares by its square.
BUCKETS, BINS, SHIFT, FINE = 48, 3200, 1920, 32
UNIT = 1 << 30
ROUNDS = 100
#: Pairs and triples of words are told apart by so many bits of hash, and one more for each doubling of the ranges: about one in
#: 20 million has the hash of another, whatever the corpus. Words are told apart by 64.
PAIR_BITS = 45


def _dropped(ranges: int) -> int:
    return max(0, 64 - PAIR_BITS - math.ceil(math.log2(ranges)))


class _Text:
    """The tokens of a block: words and ends, each with the pair and the triple that it ends."""

    def __init__(self, table: pa.Table, ranges: int):
        self.block, self.ranges, self.drop = B.block_of(table), ranges, _dropped(ranges)
        words = Words(table.column("text"), fold=True)
        n = words.counts
        self.bounds = np.concatenate([[0], np.cumsum(n + 1)])
        token = np.full(self.bounds[-1], _END, np.uint64)
        token[np.arange(len(words.hashes)) + words.owner] = words.hashes
        before = np.empty(len(token), np.uint64)
        before[1:] = token[:-1]
        self.first = np.zeros(len(token), bool)
        self.first[self.bounds[:-1]] = True
        before[self.first] = _BEGIN
        with np.errstate(over="ignore"):
            pair = mix(before * _PAIR + token)
            self._triple = self._short(mix(self._before(pair) * _TRIPLE + token))
        self.learn = np.repeat(~table.column("held_out").to_numpy(), n + 1)
        self.singles, self.single = np.unique(token, return_inverse=True)
        self.pairs, self.pair = np.unique(self._short(pair), return_inverse=True)
        # The context of a bigram is the token before; the beginning is as frequent as the end.
        self.context = self._before(self.single)
        self.context[self.first] = np.searchsorted(self.singles, _END)

    def _short(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(self.drop) << np.uint64(self.drop)

    @staticmethod
    def _before(values: np.ndarray) -> np.ndarray:
        """Of each token, the value of the one before; the first of a text has another text's."""
        out = np.empty_like(values)
        out[1:], out[:1] = values[:-1], 0
        return out

    def _ask(self, *lists: tuple[np.ndarray, np.ndarray, int]) -> pa.Table:
        """Sorted keys with their occurrences to learn from, and how many low bits of the keys are dropped."""
        cuts, width, out = [B.cut(keys, self.ranges) for keys, _, _ in lists], B.range_width(self.ranges), []
        for r in np.flatnonzero(sum(np.diff(c) for c in cuts)).tolist():
            part = [slice(*c[r : r + 2].tolist()) for c in cuts]
            keys = b"".join(B.coded(k[p], width * r, drop) for (k, _, drop), p in zip(lists, part, strict=True))
            out.append((r, self.block, keys, B.packed(np.concatenate([n[p] for (_, n, _), p in zip(lists, part, strict=True)]))))
        return B.rows(B.ASK, out)

    def _told(self, answers: pa.Table, offset: int, *lists: np.ndarray) -> list[np.ndarray]:
        """How often each of the keys asked about occurs in the corpus to learn from."""
        at = answers.column("range").to_numpy()
        mine = np.flatnonzero((at >= offset) & (at < offset + self.ranges))
        data = dict(zip((at[mine] - offset).tolist(), answers.column("data").take(pa.array(mine)).to_pylist(), strict=True))
        sizes = np.stack([np.diff(B.cut(keys, self.ranges)) for keys in lists])
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in lists]
        for r in np.flatnonzero(sizes.sum(axis=0)).tolist():
            counts = B.unpacked(data[r], int(sizes[:, r].sum()))[0]
            for got, part in zip(out, np.split(counts, np.cumsum(sizes[:-1, r])), strict=True):
                got.append(part)
        return [np.concatenate(got) for got in out]

    def ask_words_and_pairs(self) -> pa.Table:
        one = np.bincount(self.single[self.learn], minlength=len(self.singles))
        two = np.bincount(self.pair[self.learn], minlength=len(self.pairs))
        return self._ask((self.singles, one, 0), (self.pairs, two, self.drop))

    def hear_words_and_pairs(self, answers: pa.Table) -> None:
        """For each token: how often it, the token before, both, and the pair before occur; the last is 0 where there is no triple."""
        one, two = self._told(answers, 0, self.singles, self.pairs)
        self.c1, self.cv, self.c2 = one[self.single], one[self.context], two[self.pair]
        self.cuv = np.where(self.first, 0, self._before(self.c2))
        # A pair that occurs once is no context: nothing is left of it without the judged token. Where the pair at the end
        # is unknown, so is the triple.
        self.open = np.flatnonzero((self.cuv > 1) & (self.c2 > 0))
        self.triples, self.triple = np.unique(self._triple[self.open], return_inverse=True)

    def ask_triples(self) -> pa.Table:
        three = np.bincount(self.triple[self.learn[self.open]], minlength=len(self.triples))
        return self._ask((self.triples, three, self.drop))

    def hear_triples(self, answers: pa.Table) -> None:
        self.c3 = np.zeros(len(self.c2), np.int64)
        self.c3[self.open] = self._told(answers, self.ranges, self.triples)[0][self.triple]


def _totals(table: pa.Table, offset: int, lists: int) -> pa.Table:
    """The sums of a range's keys over all blocks, told to each that asked, and to one block how many words it has."""
    blocks, rows = table.column("block").to_pylist(), table.column("keys").to_pylist()
    keys: list[list[np.ndarray]] = [[] for _ in range(lists)]
    counts: list[list[np.ndarray]] = [[] for _ in range(lists)]
    for row, data in zip(rows, table.column("data").to_pylist(), strict=True):
        at, parts = 0, []
        for _ in range(lists):
            part, at = B.decoded(row, at)
            parts.append(part)
        given = np.split(B.unpacked(data, sum(map(len, parts)))[0], np.cumsum([len(p) for p in parts[:-1]]))
        for k, n, part, count in zip(keys, counts, parts, given, strict=True):
            k.append(part)
            n.append(count)
    range_, known, sums_ = int(table.column("range")[0].as_py()), [], []
    for k, n in zip(keys, counts, strict=True):
        _, code = np.unique(np.concatenate(k), return_inverse=True)
        each = np.bincount(code, weights=np.concatenate(n)).astype(np.int64)
        known.append(int((each > 0).sum()))
        sums_.append(np.split(each[code], np.cumsum([len(x) for x in k[:-1]])))
    out = [(b, offset + range_, B.packed(np.concatenate(parts))) for b, *parts in zip(blocks, *sums_, strict=True)]
    return B.rows(B.ANSWER, out if offset else [*out, (blocks[0], -1 - range_, np.int64(known[0]).tobytes())])


def _evidence(bucket: np.ndarray, ratio: np.ndarray, notes: list[int]) -> pa.Table:
    """Tokens by bucket and cell of the ratio, with the sum of ratios, and notes in bucket -1."""
    bin_ = np.zeros(len(bucket), np.int64)
    some = ratio > 0
    bin_[some] = np.clip(np.floor(FINE * np.log2(ratio[some])) + SHIFT, 1, BINS - 1)
    cell = bucket * BINS + bin_
    n = np.bincount(cell, minlength=BUCKETS * BINS)
    # Summed as multiples of the cell's lower end, in whole numbers, so that no order of sums changes the model.
    total = np.bincount(cell, weights=np.rint(ratio * _lower(-bin_) * UNIT), minlength=BUCKETS * BINS).astype(np.int64)
    at, k = np.flatnonzero(n), len(notes)
    return pa.table({
        "bucket": pa.array(np.append(at // BINS, [-1] * k), pa.int32()), "bin": pa.array(np.append(at % BINS, np.arange(k)), pa.int32()),
        "n": pa.array(np.append(n[at], notes), pa.int64()), "ratio": pa.array(np.append(total[at], [0] * k), pa.int64()),
    })


def _lower(bin_: np.ndarray) -> np.ndarray:
    """The lower end of a cell of ratios; of a negative cell, one over it."""
    return np.exp2(np.where(bin_ < 0, bin_ + SHIFT, bin_ - SHIFT) / FINE)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(context, 0).astype(float))[1], BUCKETS - 1)


def learn_weights(bucket: np.ndarray, ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each bucket the weight of the longer context's estimate, by expectation-maximisation.

    ratio: that estimate over the one below, both without the judged token; n: how many tokens have it.
    """
    weight = np.full(BUCKETS, 0.5)
    total = np.bincount(bucket, weights=n, minlength=BUCKETS)
    for _ in range(ROUNDS):
        w = weight[bucket]
        share = w * ratio / (w * ratio + 1 - w)
        weight = np.where(total > 0, np.bincount(bucket, weights=n * share, minlength=BUCKETS) / np.maximum(total, 1), weight)
        weight = np.clip(weight, 1e-6, 1 - 1e-6)
    return weight


def score_texts(docs: DataFrame) -> DataFrame:
    """Scores of all whole texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words, A-Z lower-cased, then one end. Documents whose crc32(doc_id as text) leaves 1 by 5 are held out; all
    others are learned from. ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens; ``score`` is the mixed
    model's log10 probability, a proper distribution over the known tokens and one unknown. A pair of words is a context if it
    occurs twice or more.

    A null or empty text has the end as its only token. A null doc_id is learned from. Repeated rows count and are scored one by
    one. Extra columns are left out; an empty table gives an empty table; with nothing to learn from, all tokens are
    unknown.
    """
    plan = B.plan_for(docs)
    placed = B.in_blocks(docs, plan, held_out(F.col("doc_id").cast("long"), 1).alias("held_out"))

    def heard(table: pa.Table, answers: pa.Table, triples: bool = False) -> _Text:
        text = _Text(table, plan.ranges)
        text.hear_words_and_pairs(answers)
        if triples:
            text.hear_triples(answers)
        return text

    def bigrams(table: pa.Table, answers: pa.Table) -> pa.Table:
        text = heard(table, answers)
        use = text.learn & (text.cv > 1)
        c1, cv, c2 = text.c1[use] - 1, text.cv[use] - 1, text.c2[use] - 1
        parts = answers.filter(pa.compute.less(answers.column("range"), 0)).column("data").to_pylist()
        distinct = sum(int(np.frombuffer(p, np.int64)[0]) for p in parts)
        return _evidence(_bucket(cv), c2 / cv / (c1 + 0.5), [int(text.learn.sum()), distinct])

    def trigrams(table: pa.Table, answers: pa.Table) -> pa.Table:
        text = heard(table, answers, triples=True)
        _, mass, weight = _model(answers, "bigrams")
        use = text.learn & (text.cuv > 1)
        c1, cv, c2, cuv, c3 = (c[use] - 1 for c in (text.c1, text.cv, text.c2, text.cuv, text.c3))
        return _evidence(_bucket(cuv), c3 / cuv / _mixed(weight, c2, cv, (c1 + 0.5) / mass), [0])

    def fit(scaled: bool):
        def one(table: pa.Table) -> pa.Table:
            table = table.sort_by([("bucket", "ascending"), ("bin", "ascending")])
            bucket, bin_, n, total = (table.column(c).to_numpy() for c in ("bucket", "bin", "n", "ratio"))
            tokens, distinct = (float(n[(bucket == -1) & (bin_ == k)].sum()) for k in (0, 1))
            mass = tokens + 0.5 * (distinct + 1)
            own = bucket >= 0
            weights = learn_weights(bucket[own], total[own] / UNIT / n[own] * _lower(bin_[own]) * (mass if scaled else 1.0), n[own].astype(float))
            return B.rows("model binary", [(np.concatenate([[tokens, mass], weights]).tobytes(),)])

        return one

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        text = heard(table, answers, triples=True)
        tokens, mass, weight = _model(answers, "bigrams")
        base = (text.c1 + 0.5) / mass
        context = np.where(text.cuv > 1, text.cuv, 0)
        both = _mixed(_model(answers, "trigrams")[2], text.c3, context, _mixed(weight, text.c2, text.cv, base))
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(np.diff(text.bounds), pa.int64()), "n_known": pa.array(sums(text.c1 > 0, text.bounds), pa.int64()),
            "train_tokens": pa.array(np.full(table.num_rows, int(tokens)), pa.int64()), "base_score": pa.array(sums(np.log10(base), text.bounds)), "score": pa.array(sums(np.log10(both), text.bounds)),
        })

    def learned(answers: DataFrame, evidence, scaled: bool, name: str) -> DataFrame:
        """One row of BUCKETS + 2 numbers, from one row for each bucket and bin at most, whatever the corpus."""
        seen = B.with_answers(placed, answers, evidence, "bucket int, bin int, n long, ratio long").groupBy("bucket", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("ratio").cast("decimal(38,0)")).cast("double").alias("ratio"))
        model = seen.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(fit(scaled), "model binary")
        return F.broadcast(model.select(F.lit(0).alias("all"), F.col("model").alias(name)))

    # Answers are dealt by block once; a union of tables that are dealt alike stays so.
    words = B.answer(B.ask(placed, lambda t: _Text(t, plan.ranges).ask_words_and_pairs(), plan), lambda t: _totals(t, 0, 2), plan).repartition("block")
    triples = B.answer(B.ask(placed, lambda t, a: heard(t, a).ask_triples(), plan, words), lambda t: _totals(t, plan.ranges, 1), plan).repartition("block")
    answers = words.unionByName(triples).withColumn("all", F.lit(0))
    answers = answers.join(learned(words, bigrams, True, "bigrams"), "all")
    answers = answers.join(learned(answers.drop("all"), trigrams, False, "trigrams"), "all").drop("all")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = B.with_answers(placed, answers, score, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != B.LOWEST, F.col("doc_id")))


def _model(answers: pa.Table, name: str) -> tuple[float, float, np.ndarray]:
    tokens, mass, *weight = np.frombuffer(answers.column(name)[0].as_py(), float)
    return tokens, mass, np.array(weight)


def _mixed(weight: np.ndarray, n: np.ndarray, context: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The estimate n / context, mixed with the one below by the weight of the context's bucket."""
    w = np.where(context > 0, weight[_bucket(context)], 0.0)
    return w * n / np.maximum(context, 1) + (1 - w) * below
