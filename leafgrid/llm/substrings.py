"""Substring deduplication: prefix-partitioned suffix trees over the words of all documents.

Each window (20 words, say) has an anchor: the first of its eight-word parts with the smallest hash. Equal windows have
equal anchors, so suffixes that begin at anchors, each with the few words before it, hold all that windows have in common.
They are split into groups by their prefix: the anchor's eight words, or, where these have too many suffixes for one task,
the window's whole length. A group becomes a suffix tree, as the sorted suffixes of its stretches of words with the
lengths that neighbours have in common; its internal nodes at the window's depth are the repeats, and a node's first leaf is
the one that stays.

Stretches that can't repeat stay at home: a window is only sent if its anchor occurs elsewhere too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import Words, grams, mix, starts_within

#: Words of an anchor, the shortest prefix; and stretches that a prefix may have before the longer one is taken.
ANCHOR = 8
GROUP_STRETCHES = 200_000
#: Bytes of a word's hash that a stretch carries.
WORD_HASH = 6


def _by_doc(table: pa.Table) -> pa.Table:
    """Rows by doc_id, mark and text, so that places in the block are in the order of the contract.

    Rows without a doc_id are in several blocks; their mark, 31 bits of a hash of the text, orders them across blocks.
    """
    none = table.column("doc_id").to_numpy() == B.LOWEST
    mark = np.zeros(len(none), np.int64)
    for i in np.flatnonzero(none).tolist():
        mark[i] = int.from_bytes(hashlib.blake2b((table.column("text")[i].as_py() or "").encode(), digest_size=4).digest(), "little") >> 1
    table = table.append_column("mark", pa.array(mark))
    return table.sort_by([("doc_id", "ascending"), ("mark", "ascending"), ("text", "ascending")]) if table.num_rows > 1 else table


class _Stretches:
    """Windows in a row that have the same anchor: first word, number of windows, and the anchor's place in ``keys``."""

    def __init__(self, words: Words, window: int):
        k = min(ANCHOR, window)
        at = np.flatnonzero(starts_within(words.bounds, window))
        low, span = grams(words.hashes, k), window - k + 1
        left = np.arange(len(low))
        right, wide = left, 1
        while wide < span and len(low):  # smallest of wide places, doubled, and its first and last place
            step = min(wide, span - wide)
            if len(low) <= step:  # no text is as long as the window
                low = low[:0]
                break
            a, b = low[: len(low) - step], low[step:]
            first_b, last_b = b < a, b <= a
            left = np.where(first_b, left[step:], left[: len(a)])
            right = np.where(last_b, right[step:], right[: len(a)])
            low, wide = np.minimum(a, b), wide + step
        value, left, right = low[at], left[at], right[at]
        new = np.ones(len(value), bool)
        new[1:] = left[1:] != left[:-1]
        run = np.flatnonzero(new)
        self.start, self.count = at[run], np.diff(np.append(run, len(at)))
        # Smallest hashes are small; mixed, they are spread evenly over the ranges.
        self.keys, self.anchor, self.times = np.unique(mix(value[run]), return_inverse=True, return_counts=True)
        # A key is here again if it stands at several places, of one window or of several.
        self.here = self.times > 1
        twice = np.zeros(len(at) + 1, np.int64)
        np.cumsum(left != right, out=twice[1:])
        self.here[self.anchor[twice[run + self.count] > twice[run]]] = True

    def again(self, told: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of windows of the stretches that may repeat, and which of them need the long prefix."""
        some = np.flatnonzero((self.here | (told > 0))[self.anchor])
        hot = (told > 1)[self.anchor[some]] & (self.count[some] > 1)
        pieces = np.where(hot, self.count[some], 1)
        start, count = np.repeat(self.start[some], pieces), np.repeat(np.where(hot, 1, self.count[some]), pieces)
        start += np.arange(len(start)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        return start, count, np.repeat(self.anchor[some], pieces)


class _Leaves:
    """The distinct stretches of a block that may repeat, each with its first place, by range."""

    def __init__(self, words: Words, stretches: _Stretches, told: np.ndarray, window: int, ranges: int):
        self.start, self.count, anchor = stretches.again(told, window)
        k = min(ANCHOR, window)
        whole = grams(words.hashes, window)
        first, last = whole[self.start], whole[self.start + self.count - 1]
        more = grams(words.hashes, k)[self.start]
        prefix = np.where(told[anchor] > 1, first, stretches.keys[anchor])
        range_ = ((mix(prefix) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        # The first and the last window overlap and make up the stretch.
        order = np.lexsort((self.count, last, more, first, range_))  # stable, so the first of equals is the earliest
        new = np.ones(len(order), bool)
        for column in (range_, first, last, more, self.count):
            new[1:] &= column[order][1:] == column[order][:-1]
        new[1:] = ~new[1:]
        self.first = order[new]
        self.range = range_[self.first]


class Subtree:
    """The suffix tree of some sequences, cut off at a depth: suffixes in sorted order, and what neighbours have in common.

    ``symbols`` are the sequences one after the other and ``at`` the places where the suffixes begin, each with ``depth``
    symbols to go. Symbols are ordered by value, and equal suffixes by place.
    """

    def __init__(self, symbols: np.ndarray, at: np.ndarray, depth: int):
        ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
        while 2 << len(ranks) - 1 <= depth:  # ranks of all runs of 1, 2, 4, … symbols
            ranks.append(self._pairs(ranks[-1], 1 << len(ranks) - 1))
        key, done = None, 0
        for level in reversed(range(len(ranks))):  # the depth is a sum of powers of two
            if depth >> level & 1:
                part = ranks[level][at + done]
                key = part if key is None else np.unique(key * (part.max(initial=0) + 1) + part, return_inverse=True)[1].astype(np.int64)
                done += 1 << level
        self.depth, self.at = depth, at
        self.order = np.argsort(key, kind="stable")
        a, b = at[self.order[:-1]], at[self.order[1:]]
        self.common = np.zeros(len(a), np.int64)
        for level in reversed(range(len(ranks))):
            fits = np.flatnonzero(self.common + (1 << level) <= depth)
            same = ranks[level][a[fits] + self.common[fits]] == ranks[level][b[fits] + self.common[fits]]
            self.common[fits[same]] += 1 << level

    @staticmethod
    def _pairs(rank: np.ndarray, step: int) -> np.ndarray:
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - step] = rank[step:] + 1
        return np.unique(rank * (after.max(initial=0) + 1) + after, return_inverse=True)[1].astype(np.int64)

    def firsts(self) -> np.ndarray:
        """For each suffix whether it is the first leaf of its deepest internal node, or hangs at none."""
        out = np.zeros(len(self.at), bool)
        if len(out):
            out[self.order[np.concatenate([[True], self.common < self.depth])]] = True
        return out

    def internal_nodes(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """Internal nodes of at least this depth, with the places of their leaves."""
        open_: list[tuple[int, int]] = []  # depth and first leaf
        for i, d in enumerate([*self.common.tolist(), 0]):
            first = i
            while open_ and open_[-1][0] > d:
                depth, first = open_.pop()
                if depth >= least:
                    yield depth, self.at[self.order[first : i + 1]]
            if d and (not open_ or open_[-1][0] < d):
                open_.append((d, first))


def maximal_repeats(sequences: list[list], least: int) -> set[tuple[int, frozenset[tuple[int, int]]]]:
    """Repeats of at least ``least`` symbols that can't be extended: length and places (sequence, position).

    A repeat is an internal node; it is maximal if its leaves follow different symbols. For small inputs, as a whole tree
    goes down to the length of the longest sequence.
    """
    flat = [s for q in sequences for s in q]
    code = {s: i for i, s in enumerate(sorted(set(flat)))}
    depth = max(map(len, sequences), default=0)
    symbols, starts, owner = [], [], []
    for i, q in enumerate(sequences):  # after each sequence symbols that nothing else has
        starts += range(len(symbols), len(symbols) + len(q))
        owner += [(i, k) for k in range(len(q))]
        symbols += [code[s] for s in q] + list(range(len(code) + len(symbols), len(code) + len(symbols) + depth))
    place = dict(zip(starts, owner, strict=True))
    found = set()
    for length, leaves in Subtree(np.array(symbols), np.array(starts, np.int64), depth).internal_nodes(least) if starts else ():
        before = {symbols[a - 1] if place[a][1] else (place[a][0],) for a in leaves.tolist()}
        if len(before) > 1:
            found.add((length, frozenset(place[a] for a in leaves.tolist())))
    return found


def drop_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Documents without repeated passages: doc_id, text (kept words joined by one space), n_words, n_removed.

    Words are separated by white space and unchanged. A word goes if it is covered by ``window`` consecutive words of its
    document that also start earlier, in a document with a smaller doc_id or earlier in the same one. Windows are judged
    on the input, not on what is left. Words are compared by 48 bits of hash, all of a window's together.

    A null or empty text has no words. A null doc_id counts as the smallest. Rows that share a doc_id are taken one after
    the other by their text (those without one by a hash of it), so of repeated rows the first stays. Each row gives a row; extra columns are left out; an
    empty table gives an empty table. ``window`` is at least 1.
    """
    plan = B.plan_for(docs)
    placed = B.in_blocks(docs, plan)

    def ask_anchors(table: pa.Table) -> pa.Table:
        s = _Stretches(Words(table.column("text")), window)
        return B.rows(B.ASK, B.asked(B.block_of(table), s.keys, plan.ranges, s.times.astype(np.uint32)))

    def find_anchors(table: pa.Table) -> pa.Table:
        which, sizes, keys, (times,) = B.gather(table, np.uint32)
        _, code, blocks = np.unique(keys, return_inverse=True, return_counts=True)
        total = np.bincount(code, weights=times.astype(float))
        told = (blocks > 1).astype(np.uint8) + (total > GROUP_STRETCHES)
        return B.replies(int(table.column("range")[0].as_py()), which, sizes, told[code])

    def leaves_of(table: pa.Table, answers: pa.Table) -> tuple[Words, _Leaves]:
        words = Words(table.column("text"))
        return words, _Leaves(words, _Stretches(words, window), B.joined(answers, np.uint8), window, plan.ranges)

    def ask_leaves(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _by_doc(table)
        words, leaves = leaves_of(table, answers)
        start, count = leaves.start[leaves.first], leaves.count[leaves.first]
        owner = np.searchsorted(words.bounds, start, side="right") - 1
        doc, place = table.column("doc_id").to_numpy()[owner], start - words.bounds[owner]
        # Rows that share a doc_id follow each other: their places go on.
        mark = table.column("mark").to_numpy()
        place += ((mark << 32) + _before(table.column("doc_id").to_numpy(), mark, words.counts))[owner]
        small = len(doc) and doc.min() >= 0 and doc.max() < 1 << 32 and place.max() < 1 << 32
        doc, place = (doc.astype("<u4"), place.astype("<u4")) if small else (doc.astype("<i8"), place.astype("<i8"))
        said = words.hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_HASH]
        out, block, cuts = [], B.block_of(table), np.searchsorted(leaves.range, np.arange(plan.ranges + 1)).tolist()
        for r in np.unique(leaves.range).tolist():
            a, b = cuts[r], cuts[r + 1]
            here = said[_spread(start[a:b], count[a:b] + window - 1)]
            out.append((r, block, here.tobytes(), count[a:b].astype("<u4").tobytes() + doc[a:b].tobytes() + place[a:b].tobytes() + bytes([4 if small else 8])))
        return B.rows(B.ASK, out)

    def grow(table: pa.Table) -> pa.Table:
        said, count, doc, place, sizes = [], [], [], [], []
        for k, d in zip(table.column("keys").to_pylist(), table.column("data").to_pylist(), strict=True):
            wide = d[-1]
            n = (len(d) - 1) // (4 + 2 * wide)
            kind = "<u4" if wide == 4 else "<i8"
            said.append(np.frombuffer(k, np.uint8).reshape(-1, WORD_HASH))
            count.append(np.frombuffer(d, "<u4", n).astype(np.int64))
            doc.append(np.frombuffer(d, kind, n, 4 * n).astype(np.int64))
            place.append(np.frombuffer(d, kind, n, (4 + wide) * n).astype(np.int64))
            sizes.append(int(count[-1].sum()))
        count, doc, place = (np.concatenate(x) for x in (count, doc, place))
        symbols = np.zeros((sum(map(len, said)), 8), np.uint8)
        np.concatenate(said, out=symbols[:, :WORD_HASH])
        symbols = symbols.view("<u8").ravel()
        length = count + window - 1
        begin = np.cumsum(length) - length
        # In the order of the contract, so that equal suffixes stand by place.
        order = np.lexsort((place, doc))
        at = _spread(begin[order], count[order])
        firsts = np.empty(len(at), bool)
        home = np.cumsum(count) - count
        firsts[_spread(home[order], count[order])] = Subtree(symbols, at, window).firsts()
        return _bits(int(table.column("range")[0].as_py()), table.column("block").to_pylist(), np.array(sizes), firsts)

    schema = "doc_id long, text string, n_words long, n_removed long"

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _by_doc(table)
        anchors, firsts = (answers.filter(pa.compute.equal(answers.column("step"), s)) for s in (1, 2))
        words, leaves = leaves_of(table, anchors)
        windows = leaves.count[leaves.first]
        stays = _unpacked(firsts, np.bincount(leaves.range, weights=windows, minlength=plan.ranges).astype(np.int64))
        step = np.zeros(len(words.hashes) + window + 1, np.int64)
        np.add.at(step, leaves.start, 1)
        np.subtract.at(step, leaves.start + leaves.count, 1)
        gone = np.cumsum(step)[: len(words.hashes)] > 0
        gone[_spread(leaves.start[leaves.first], windows)[stays]] = False
        cover = np.concatenate([gone, np.zeros(window, bool)]).astype(np.int64)
        cover[window:] -= gone
        removed = np.cumsum(cover)[: len(words.hashes)] > 0
        counts_, bounds, texts = words.counts, words.bounds, []
        n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[bounds])
        for d, (a, b) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)):
            said = words.raw[a:b].tobytes().split()
            if n_removed[d]:
                said = compress(said, (~removed[bounds[d] : bounds[d + 1]]).tolist())
            texts.append(b" ".join(said).decode("utf-8"))
        return pa.table({"doc_id": table.column("doc_id"), "text": pa.array(texts, pa.string()), "n_words": pa.array(counts_.astype(np.int64)), "n_removed": pa.array(n_removed.astype(np.int64))})

    anchors = B.answer(B.ask(placed, ask_anchors, plan), find_anchors, plan)
    leaves = B.answer(B.ask(placed, ask_leaves, plan, anchors), grow, plan)
    both = anchors.withColumn("step", F.lit(1)).unionByName(leaves.withColumn("step", F.lit(2)))
    out = B.with_answers(placed, both, remove, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != B.LOWEST, F.col("doc_id")))


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, … for each length, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - length), length)


def _before(doc: np.ndarray, mark: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of earlier rows with the same doc_id and mark, for sorted rows."""
    total = np.cumsum(counts) - counts
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    return total - np.maximum.accumulate(np.where(new, total, 0))


def _elsewhere(keys: np.ndarray) -> np.ndarray:
    """Which keys more than one block has."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _bits(range_: int, blocks: list[int], sizes: np.ndarray, flags: np.ndarray) -> pa.Table:
    at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return B.rows(B.ANSWER, [(b, range_, np.packbits(flags[i:j]).tobytes()) for b, i, j in zip(blocks, at[:-1], at[1:], strict=True)])


def _unpacked(answers: pa.Table, sizes: np.ndarray) -> np.ndarray:
    """Flags in the order of the block's keys; sizes has how many each range was asked about."""
    got = dict(zip(answers.column("range").to_pylist(), answers.column("data").to_pylist(), strict=True))
    parts = [np.unpackbits(np.frombuffer(got[r], np.uint8), count=int(n)).astype(bool) for r, n in enumerate(sizes.tolist()) if n]
    return np.concatenate(parts) if parts else np.zeros(0, bool)
