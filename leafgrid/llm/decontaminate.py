"""Benchmark decontamination with a generalised suffix automaton of the normalised test items."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, ALNUM_REGEX, Words, materialise, run_bounds, sums

#: Words of a part, when a benchmark is dealt into parts: see the README for the memory that an automaton of them takes.
PART_WORDS = 150_000
#: One automaton for all of a benchmark is refused beyond this.
MOST_WORDS = PART_WORDS
#: Stands for a null doc_id where hits are joined with documents.
LOWEST = -(1 << 63)


class SuffixAutomaton:
    """All substrings of several sequences; ``marks`` holds, for states, the windows that end there and their items."""

    def __init__(self, items: list[list[int]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for item in items:
            last = 0
            for symbol in item:
                last = self._extend(last, symbol)
        self.marks: list[dict[int, set[int]] | None] = [None] * len(self.next)
        for i, item in enumerate(items):
            k = min(window, len(item))
            if k:
                for end, state in self._walk(item, k):
                    if end >= k:
                        here = self.marks[state] = self.marks[state] or {}
                        here.setdefault(k, set()).add(i)
        # For each state, the nearest one on its suffix links (itself included) at which some window ends.
        self.near = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.near[s] = s if self.marks[s] else self.near[self.link[s]]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, parent: int, symbol: int, child: int) -> int:
        twin = self._new(self.length[parent] + 1)
        self.next[twin] = dict(self.next[child])
        self.link[twin] = self.link[child]
        self.link[child] = twin
        while parent != -1 and self.next[parent].get(symbol) == child:
            self.next[parent][symbol] = twin
            parent = self.link[parent]
        return twin

    def _extend(self, last: int, symbol: int) -> int:
        there = self.next[last].get(symbol)
        if there is not None:  # an earlier item has this sequence too
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, symbol, there)
        state, parent = self._new(self.length[last] + 1), last
        while parent != -1 and symbol not in self.next[parent]:
            self.next[parent][symbol] = state
            parent = self.link[parent]
        if parent != -1:
            child = self.next[parent][symbol]
            self.link[state] = child if self.length[child] == self.length[parent] + 1 else self._clone(parent, symbol, child)
        return state

    def _step(self, state: int, length: int, symbol: int) -> tuple[int, int]:
        while state and symbol not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        there = self.next[state].get(symbol)
        return (0, 0) if there is None else (there, length + 1)

    def _walk(self, symbols: list[int], k: int) -> Iterator[tuple[int, int]]:
        """After each symbol, its place and the state of the last k symbols (or of as many as match)."""
        state = length = 0
        for end, symbol in enumerate(symbols, 1):
            state, length = self._step(state, length, symbol)
            length = min(length, k)
            while state and self.length[self.link[state]] >= length:
                state = self.link[state]
            yield end, state

    def matches(self, symbols: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """Windows in a stream: one past their last symbol, their length, and the items that have them."""
        state = length = 0
        for end, symbol in enumerate(symbols, 1):
            state, length = self._step(state, length, symbol)
            at = self.near[state]
            while at:
                for k, items in self.marks[at].items():
                    if k <= length:
                        yield end, k, items
                at = self.near[self.link[at]]


class Benchmark:
    """The automaton with what lets tasks skip words and word pairs that no item has."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        words = Words(pa.array(texts, pa.string()), fold=True, word_bytes=ALNUM_BYTES)
        self.ids, self.vocabulary = ids, np.unique(words.hashes)
        codes = np.searchsorted(self.vocabulary, words.hashes)
        items = [codes[a:b].tolist() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        self.automaton = SuffixAutomaton(items, window)
        self.shortest = min((min(window, len(i)) for i in items if i), default=0)
        pairs = [np.asarray(i[:-1], np.int64) * len(self.vocabulary) + np.asarray(i[1:], np.int64) for i in items if len(i) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def hits(self, words: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words lie inside a window, and the items of each text."""
        hit, found = np.zeros(len(words.hashes), bool), {}
        if not self.shortest or not len(hit):
            return hit, found
        code = np.searchsorted(self.vocabulary, words.hashes)
        code[code == len(self.vocabulary)] = 0
        known = self.vocabulary[code] == words.hashes
        if self.shortest == 1:
            first, end = run_bounds(known)
        else:
            both = np.flatnonzero(known[:-1] & known[1:])
            key = code[both] * len(self.vocabulary) + code[both + 1]
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            linked = np.zeros(len(hit), bool)
            linked[both[self.pairs[at] == key]] = True
            last = words.bounds[1:] - 1
            linked[last[last >= 0]] = False  # no pair across two texts
            first, end = run_bounds(linked)
            end = end + 1
        keep = end - first >= self.shortest
        owner = np.searchsorted(words.bounds, first[keep], side="right") - 1
        for a, b, text in zip(first[keep].tolist(), end[keep].tolist(), owner.tolist(), strict=True):
            for begin, stop in self._texts(words, a, b, text):
                for at, k, items in self.automaton.matches(code[begin:stop].tolist()):
                    hit[begin + at - k : begin + at] = True
                    found.setdefault(int(np.searchsorted(words.bounds, begin, side="right") - 1), set()).update(items)
        return hit, found

    def _texts(self, words: Words, a: int, b: int, text: int) -> Iterator[tuple[int, int]]:
        """A run cut where texts end."""
        while a < b:
            while words.bounds[text + 1] <= a:
                text += 1
            yield a, min(b, int(words.bounds[text + 1]))
            a = int(words.bounds[text + 1])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, clean: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document's overlap with the benchmark: doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A window is ``window`` consecutive
    words of an item, or the whole item if it has fewer. Words inside any occurrence of a window are hit; n_items counts
    the items with a window that occurs, and items_sha256 is over their ids, sorted as strings and joined by commas. With
    ``clean`` there is also clean_text: the text without its hit spans, each up to the next word that stays.

    A null or empty text or item has no words. Items without words match nothing; a null item_id reads as the empty string.
    Repeated documents give a row each, repeated items count one by one. Columns named in ``carry`` are kept, others are not. An
    empty table gives an empty table; an empty benchmark hits nothing.
    """
    # Counted before anything reaches the driver; an automaton has at most three edges for each word.
    if (benchmark.agg(F.sum(F.regexp_count(F.col("text").cast("string"), F.lit(ALNUM_REGEX)))).first()[0] or 0) > MOST_WORDS:
        raise ValueError(f"the benchmark has more than {MOST_WORDS} words; see find_contamination_in_parts")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t")).orderBy("i", "t").toPandas()
    test = Benchmark(rows["i"].tolist(), [t if isinstance(t, str) else None for t in rows["t"]], window)
    shared = docs.sparkSession.sparkContext.broadcast(test)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.value
        for batch in batches:
            words = Words(batch.column("text"), fold=True, word_bytes=ALNUM_BYTES)
            hit, found = test.hits(words)
            items = [sorted(test.ids[i] for i in found.get(d, ())) for d in range(batch.num_rows)]
            yield _judged(batch, words, hit, items, clean, carry)

    rows = _rows(docs, carry)
    return _named(rows.mapInArrow(scan, _schema(rows, clean, carry)), carry)


def _named(found: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Carried columns by their names again."""
    return found.withColumnsRenamed({f"carry_{c}": c for c in carry})


def _rows(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])


def _schema(docs: DataFrame, clean: bool, carry: tuple[str, ...]) -> str:
    schema = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean" + ", clean_text string" * clean
    return schema + "".join(f", `carry_{c}` {docs.schema[f'carry_{c}'].dataType.simpleString()}" for c in carry)


def _judged(batch: pa.RecordBatch, words: Words, hit: np.ndarray, items: list[list[str]], clean: bool, carry: tuple[str, ...]) -> pa.RecordBatch:
    n_hit = sums(hit, words.bounds)
    out = {
        "doc_id": batch.column("doc_id"), "n_words": pa.array(words.counts.astype(np.int64)), "n_hit": pa.array(n_hit.astype(np.int64)), "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items": pa.array(items, pa.list_(pa.string())), "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), "contaminated": pa.array(n_hit > 0),
    }
    if clean:
        texts = batch.column("text").to_pylist()
        for d in np.flatnonzero(n_hit):
            texts[d] = _cut(words, hit, d)
        out["clean_text"] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_pydict(out | {f"carry_{c}": batch.column(f"carry_{c}") for c in carry})


def find_contamination_in_parts(docs: DataFrame, benchmark: DataFrame, window: int = 10, clean: bool = False, carry: tuple[str, ...] = (), part_words: int = PART_WORDS) -> DataFrame:
    """What find_contamination gives, for a benchmark of any size.

    A benchmark of more than ``part_words`` words is dealt into parts of at most as many; documents are read once for each
    part, whose automaton is built in Python workers, and hit spans and items are united for each document. Long items are
    cut into pieces that share window - 1 words, so no window is lost.
    """
    total = benchmark.agg(F.sum(F.regexp_count(F.col("text").cast("string"), F.lit(ALNUM_REGEX)))).first()[0] or 0
    if total <= part_words:
        return find_contamination(docs, benchmark, window, clean, carry)
    pieces, parts = _dealt(benchmark, window, part_words, total)
    rows = _rows(docs, carry).withColumn("_id", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("_key", F.md5(F.coalesce("text", F.lit(""))))
    hits = None
    for p in range(parts):
        one = pieces.where(F.pmod(F.xxhash64("uid", "piece"), F.lit(parts)) == p).select("uid", "item", "text").orderBy("uid", "text").collect()
        part = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in one], window))
        got = rows.select("_id", "_key", "text").mapInArrow(_scanner(part), "_id long, _key string, spans binary, uids array<long>, items array<string>")
        got = got.groupBy("_id", "_key").agg(F.first(F.struct("spans", "uids", "items")).alias("hit"))  # repeated documents
        hits = got if hits is None else hits.unionByName(got)
    hits = materialise(hits).groupBy("_id", "_key").agg(F.collect_list("hit").alias("hits"))
    joined = rows.join(hits, ["_id", "_key"], "left").select("doc_id", "text", *[f"carry_{c}" for c in carry], F.col("hits.spans").alias("_spans"), F.col("hits.uids").alias("_uids"), F.col("hits.items").alias("_items"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("text"), fold=True, word_bytes=ALNUM_BYTES)
            hit, items = np.zeros(len(words.hashes), bool), []
            for d, (spans, uids, names) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_spans", "_uids", "_items")), strict=True)):
                for a, b in np.frombuffer(b"".join(spans or ()), np.int64).reshape(-1, 2) + words.bounds[d]:
                    hit[a:b] = True
                items.append(sorted({u: n for us, ns in zip(uids or (), names or (), strict=True) for u, n in zip(us, ns, strict=True)}.values()))
            yield _judged(batch, words, hit, items, clean, carry)

    return _named(joined.mapInArrow(unite, _schema(rows, clean, carry)), carry)


def _dealt(benchmark: DataFrame, window: int, part_words: int, total: int) -> tuple[DataFrame, int]:
    """Pieces of items (uid, item, piece, text, n), and into how many parts their hashes deal them with part_words at most."""
    size = max(window, part_words // 8)
    items = benchmark.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(F.col("text").cast("string"), F.lit(ALNUM_REGEX), F.lit(0)).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(size - window + 1))
    cut = items.where("size(words) > 0").select("uid", "item", "words", F.explode(starts).alias("piece")).withColumn("words", F.slice("words", F.col("piece") + 1, F.lit(size)))
    # Written, as the ids of rows have to stay.
    pieces = materialise(cut.select("uid", "item", "piece", F.array_join("words", " ").alias("text"), F.size("words").alias("n")))
    parts = -(-total // part_words)
    while parts < pieces.count() and pieces.groupBy(F.pmod(F.xxhash64("uid", "piece"), F.lit(parts))).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > part_words:
        parts += -(-parts // 4)
    return pieces, parts


#: The automaton that this Python worker has built last, by its part.
_built: dict[str, Benchmark] = {}


def _automaton(name: str, items: list[tuple[int, str, str]], window: int) -> Benchmark:
    if name not in _built:
        _built.clear()
        _built[name] = Benchmark(items, [t for _, _, t in items], window)
    return _built[name]


def _scanner(part) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The documents that a part hits: spans of words from each one's first, and the rows and names of items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = _automaton(*part.value)
        for batch in batches:
            words = Words(batch.column("text"), fold=True, word_bytes=ALNUM_BYTES)
            hit, found = test.hits(words)
            at, spans = sorted(found), []
            for d in at:
                first, end = run_bounds(hit[words.bounds[d] : words.bounds[d + 1]])
                spans.append(np.stack([first, end], axis=1).astype(np.int64).tobytes())
            which = [[test.ids[i] for i in sorted(found[d])] for d in at]
            yield pa.RecordBatch.from_pydict({
                "_id": batch.column("_id").take(pa.array(at, pa.int64())), "_key": batch.column("_key").take(pa.array(at, pa.int64())), "spans": pa.array(spans, pa.binary()),
                "uids": pa.array([[i[0] for i in x] for x in which], pa.list_(pa.int64())), "items": pa.array([[i[1] for i in x] for x in which], pa.list_(pa.string())),
            })

    return scan


def _cut(words: Words, hit: np.ndarray, text: int) -> str:
    a, b = int(words.bounds[text]), int(words.bounds[text + 1])
    first, end = run_bounds(hit[a:b])
    pieces, at, stop = [], int(words.offsets[text]), int(words.offsets[text + 1])
    for i, j in zip((first + a).tolist(), (end + a).tolist(), strict=True):
        pieces.append(words.raw[at : words.starts[i]])
        at = int(words.starts[j]) if j < b else int(words.ends[j - 1])
    pieces.append(words.raw[at:stop])
    return b"".join(p.tobytes() for p in pieces).decode("utf-8")
