"""N-gram Jaccard join with vertical partitioning of a global n-gram order.

The order is cut into fragments, twice. First all n-grams are ordered by hash and each fragment says, for the documents in
it, how many of their n-grams other documents share; summed per document this bounds every overlap, and documents that
can't reach the threshold with any other leave. Then, among what is left, n-grams are ordered by frequency; the rare
end of each document (its prefix) proposes partners, and overlaps are counted fragment by fragment and summed per pair,
until a pair is complete or can't reach the threshold any more.

Links are looked for between different texts: equal n-gram sets form a class beforehand. A pair that is already connected
is not counted again, so a group of near copies costs about a comparison for each member and not one for each pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import Words, grams, materialise, mix, starts_within
from .components import connected_components, union_find
from .substrings import _bits, _elsewhere, _unpacked

#: The share of the hash order that the first pass looks at. A higher share moves more and lets fewer documents through.
SHARE = 0.4
#: N-grams of one candidate group that a task compares at once; larger groups are split.
GROUP_GRAMS = 6_000_000
FRAGMENTS = 8


def gram_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, by text and hash, with the bounds of each text's.

    A text with fewer words has its whole sequence as one; a text without words has none.
    """
    texts = len(words.bounds) - 1
    full = np.flatnonzero(starts_within(words.bounds, k))
    parts = [grams(words.hashes, k)[full]]
    owners = [np.searchsorted(words.bounds, full, side="right") - 1]
    for n in range(1, k):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            parts.append(mix(grams(words.hashes, n)[words.bounds[short]] + np.uint64(n)))
            owners.append(short)
    gram, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[new], owner[new]
    return gram, np.searchsorted(owner, np.arange(texts + 1))


def _spare(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n n-grams a partner may lack: it has at least percent of them."""
    return n - -(-n * percent // 100)


class _Links:
    """Documents of one candidate group: finds all connections between residents, and of visitors with residents.

    With ``met``, residents have been compared with each other before.
    """

    def __init__(self, sets: list[np.ndarray], resident: np.ndarray, root: np.ndarray, percent: int, met: bool = False):
        self.percent, self.resident, self.met = percent, resident, met
        self.size = np.array([len(s) for s in sets])
        self.bounds = np.concatenate([[0], np.cumsum(self.size)])
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, code, times = np.unique(every, return_inverse=True, return_counts=True)
        order = np.argsort(times, kind="stable")  # the global order within the group: the rarest first
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        owner = np.repeat(np.arange(len(sets)), self.size)
        rank = rank[code]
        self.rank = rank[np.lexsort((rank, owner))]
        self.times = times[order]
        cuts = np.linspace(0, len(order), FRAGMENTS + 1).astype(np.int64)
        key = owner * (len(order) + 1) + self.rank
        self.fragment = np.stack([np.searchsorted(key, np.arange(len(sets)) * (len(order) + 1) + c) for c in cuts], axis=1)
        # Postings of the prefixes: partners share an n-gram among the first few of each.
        place = np.arange(len(self.rank)) - self.bounds[:-1][owner]
        prefix = (place <= _spare(self.size, percent)[owner]) & (self.times[self.rank] > 1)
        p_rank, p_owner = self.rank[prefix], owner[prefix]
        by = np.argsort(p_rank, kind="stable")
        self.post_rank, self.post_doc = p_rank[by], p_owner[by]
        self.lists = np.searchsorted(self.post_rank, np.arange(len(order) + 1))
        self.own = np.searchsorted(p_owner, np.arange(len(sets) + 1))
        self.own_rank = p_rank
        self.find, self.union, self.roots = union_find(len(sets))
        first: dict[int, int] = {}
        for i, r in enumerate(root.tolist()):
            self.union(i, first.setdefault(r, i))

    def connect(self) -> np.ndarray:
        """The root of each document, after all its connections are found."""
        n = len(self.size)
        weight = np.bincount(self.post_doc, weights=np.diff(self.lists)[self.post_rank], minlength=n) if len(self.post_doc) else np.zeros(n)
        root, alive, stale = self.roots(), self._alive(self.roots()), 0
        done = np.zeros(n, bool)
        for x in np.argsort(-weight, kind="stable").tolist():
            ranks = self.own_rank[self.own[x] : self.own[x + 1]]
            ranks = ranks[alive[ranks]]
            done[x] = True
            if not len(ranks):
                continue
            near = np.unique(np.concatenate([self.post_doc[self.lists[r] : self.lists[r + 1]] for r in ranks]))
            small, large = np.minimum(self.size[near], self.size[x]), np.maximum(self.size[near], self.size[x])
            meet = self.resident[near] != self.resident[x] if self.met else self.resident[near] | self.resident[x]
            near = near[~done[near] & (root[near] != root[x]) & (small * 100 >= large * self.percent) & meet]
            linked = near[self._reach(x, near)] if len(near) else near
            for y in linked.tolist():
                self.union(x, y)
            stale += len(linked)
            if len(linked):
                root = self.roots()
                if stale * 8 >= n or len(linked) * 50 >= n:
                    alive, stale = self._alive(root), 0
        return self.roots()

    def _alive(self, root: np.ndarray) -> np.ndarray:
        """Which posting lists still have documents of several components."""
        alive = np.zeros(len(self.lists) - 1, bool)
        some = np.flatnonzero(np.diff(self.lists))
        if len(some):
            r = root[self.post_doc]
            alive[some] = np.minimum.reduceat(r, self.lists[:-1][some]) != np.maximum.reduceat(r, self.lists[:-1][some])
        return alive

    def _reach(self, x: int, near: np.ndarray) -> np.ndarray:
        """Which of some documents share enough with x: partial overlaps by fragment, summed for each pair."""
        total = self.size[near] + self.size[x]
        need = -(-total * self.percent // (100 + self.percent))  # overlap for 100 i >= percent (total - i)
        have = np.zeros(len(near), np.int64)
        open_ = np.arange(len(near))
        mine = self.rank[self.bounds[x] : self.bounds[x + 1]]
        for f in reversed(range(FRAGMENTS)):
            a, b = self.fragment[near[open_], f], self.fragment[near[open_], f + 1]
            part = mine[self.fragment[x, f] - self.bounds[x] : self.fragment[x, f + 1] - self.bounds[x]]
            length = b - a
            if len(part) and length.sum():
                ends = np.cumsum(length)
                at = np.arange(ends[-1]) + np.repeat(a - (ends - length), length)
                where = np.searchsorted(part, self.rank[at])
                where[where == len(part)] = 0
                hit = np.concatenate([[0], np.cumsum(part[where] == self.rank[at])])
                have[open_] += hit[ends] - hit[ends - length]
            rest = np.minimum(a - self.bounds[near[open_]], self.fragment[x, f] - self.bounds[x])
            open_ = open_[have[open_] + rest >= need[open_]]
            if not len(open_):
                break
        return have >= need


def _chains(gram: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Where new chains begin, for entries sorted by n-gram and smallest size.

    Documents with a common n-gram form a chain while sizes fit: if two documents' sizes fit each other, so do all steps
    between them, so documents of different chains are never linked by that n-gram.
    """
    if not len(gram):
        return np.zeros(0, bool)
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    lift = (np.cumsum(new) - 1) * np.int64(1 << 36)
    top = np.maximum.accumulate(high + lift) - lift
    new[1:] |= top[:-1] * 100 < low[1:] * percent
    return new


def _stars(doc: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Pairs of each document with the smallest one it is connected with by chains."""
    nodes, code = np.unique(doc, return_inverse=True)
    _, union, roots = union_find(len(nodes))
    step = np.flatnonzero(~new)
    for i, j in set(zip(code[step - 1].tolist(), code[step].tolist(), strict=True)):
        union(i, j)
    root = roots()
    out = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[out], nodes[root[out]]])


def _postings(table: pa.Table, percent: int) -> pa.Table:
    """Edges between documents that share a rare n-gram of a range, and those that the blocks found by themselves."""
    parts, edges = [], [np.zeros((2, 0), np.int64)]
    for k, d in zip(table.column("keys").to_pylist(), table.column("data").to_pylist(), strict=True):
        if k:
            parts.append((np.frombuffer(k, np.uint64), *np.frombuffer(d, np.int64).reshape(3, -1)))
        else:
            edges.append(np.frombuffer(d, np.int64).reshape(2, -1))
    if parts:
        gram, doc, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, low, gram))
        new = _chains(gram[order], low[order], high[order], percent)
        edges.append(_stars(doc[order], new))
    a, b = np.concatenate(edges, axis=1)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def link_near_copies(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Components of documents that are linked by n-gram overlap: doc_id, n_shingles, component_id.

    A document's set has its distinct k-word shingles (A-Z lower-cased, words between white space); with fewer words, the
    whole sequence is one. Two documents are linked when 100 * shared >= percent * all of their shingles. component_id is
    the smallest doc_id that can be reached by links, its own included. No link is lost, whatever the group's size.

    A null or empty text has an empty set and is linked with nothing. Rows that share a doc_id are one document for links
    (and a null doc_id, the smallest, is one too), but each gives its row. Extra columns are left out; an empty table
    gives an empty table.
    """
    plan = B.plan_for(docs)
    placed = B.in_blocks(docs, plan)
    limit = np.uint64(int(SHARE * (1 << 64)))

    def sampled(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        gram, bounds = gram_sets(Words(table.column("text"), fold=True), k)
        low = np.flatnonzero(gram < limit)
        keys, code, times = np.unique(gram[low], return_inverse=True, return_counts=True)
        return gram, bounds, low, keys, code, times

    def question(table: pa.Table) -> pa.Table:
        return B.rows(B.ASK, _asked(B.block_of(table), sampled(table)[3], plan.ranges, limit))

    def reply(table: pa.Table) -> pa.Table:
        which, sizes, keys, _ = B.gather(table)
        return _bits(int(table.column("range")[0].as_py()), which, sizes, _elsewhere(keys))

    def sets_of(table: pa.Table, answers: pa.Table) -> pa.Table:
        gram, bounds, low, keys, code, times = sampled(table)
        shared = ((times > 1) | _unpacked(answers, np.diff(_cut(keys, plan.ranges, limit))))[code]
        n = np.diff(bounds)
        at = np.searchsorted(low, bounds)
        there = np.diff(at)
        count = np.diff(np.concatenate([[0], np.cumsum(shared)])[at])
        stays = (n > 0) & (count >= there - _spare(n, percent))
        raw = [gram[a:b].tobytes() if s else None for a, b, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), stays.tolist(), strict=True)]
        mark = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        return pa.table({"doc_id": table.column("doc_id"), "n": pa.array(n, pa.int64()), "mark": pa.array(mark, pa.binary()), "grams": pa.array(raw, pa.binary())})

    sets = materialise(B.with_answers(placed, B.answer(B.ask(placed, question, plan), reply, plan), sets_of, "doc_id long, n long, mark binary, grams binary"))
    # Classes of equal sets, each stood for by its smallest doc_id; only these are compared.
    classes = sets.where(F.col("mark").isNotNull()).groupBy("mark").agg(F.min("doc_id").alias("rep"))
    reps = sets.where(F.col("mark").isNotNull()).join(classes.hint("shuffle_hash"), "mark").where("doc_id = rep")
    reps = materialise(reps.select(F.pmod(_spread_rep(), F.lit(plan.blocks)).cast("int").alias("block"), "rep", "n", "grams").dropDuplicates(["rep", "n", "grams"]))
    links = _verified(reps, _candidates(reps, plan, percent), percent)
    same = sets.where(F.col("mark").isNotNull()).select("doc_id", "mark").join(classes, "mark").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(links.union(same), "a", "b")
    out = sets.join(found.hint("shuffle_hash"), F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    null = lambda c: F.when(F.col(c) != B.LOWEST, F.col(c)).alias(c)
    return out.select(null("doc_id"), "n_shingles", null("component_id"))


def _cut(keys: np.ndarray, ranges: int, limit: np.uint64) -> np.ndarray:
    """Where sorted keys below limit are cut into fragments."""
    width = int(limit) // ranges + 1
    return np.concatenate([[0], np.searchsorted(keys, np.array([width * i for i in range(1, ranges)], np.uint64)), [len(keys)]]).astype(np.int64)


def _asked(block: int, keys: np.ndarray, ranges: int, limit: np.uint64) -> list[tuple]:
    at = _cut(keys, ranges, limit).tolist()
    return [(r, block, keys[a:b].tobytes(), b"") for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of a block of representatives, which document has each, and the sizes."""
    raw = table.column("grams").to_pylist()
    size = np.array([len(r) // 8 for r in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint64), np.repeat(np.arange(len(raw)), size), size


def _candidates(reps: DataFrame, plan: B.Plan, percent: int) -> DataFrame:
    """Components of documents that may be linked: node, component.

    Prefixes follow the order of frequency among all representatives: any two linked documents share an n-gram there.
    """

    def question(table: pa.Table) -> pa.Table:
        keys, times = np.unique(_flat(table)[0], return_counts=True)
        return B.rows(B.ASK, B.asked(B.block_of(table), keys, plan.ranges, times.astype(np.uint64)))

    def reply(table: pa.Table) -> pa.Table:
        which, sizes, keys, (times,) = B.gather(table, np.uint64)
        _, code = np.unique(keys, return_inverse=True)
        total = np.bincount(code, weights=times.astype(float)).astype(np.uint64)
        return B.replies(int(table.column("range")[0].as_py()), which, sizes, total[code])

    def rare(table: pa.Table, answers: pa.Table) -> pa.Table:
        gram, owner, size = _flat(table)
        keys, code = np.unique(gram, return_inverse=True)
        times = B.joined(answers, np.uint64)[code]
        order = np.lexsort((gram, times, owner))
        gram, times = gram[order], times[order]
        place = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
        keep = (place <= _spare(size, percent)[owner]) & (times > 1)
        gram, owner = gram[keep], owner[keep]
        # A block sends one entry for each n-gram and chain, however many of its documents have it, and its own edges.
        doc = table.column("rep").to_numpy()[owner]
        order = np.lexsort((doc, size[owner], gram))
        gram, doc, n = gram[order], doc[order], size[owner[order]]
        new = _chains(gram, n, n, percent)
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(new)) - 1
        last = last[: len(first)]
        block = B.block_of(table)
        sent = B.asked(block, gram[first], plan.ranges, doc[first].astype(np.int64), n[first], n[last])
        own = _stars(doc, new)
        return B.rows(B.ASK, [*sent, (block % plan.ranges, block, b"", own.astype(np.int64).tobytes())])

    answers = B.answer(B.ask(reps, question, plan), reply, plan)
    edges = B.tell(B.ask(reps, rare, plan, answers), lambda table: _postings(table, percent), "a long, b long", plan)
    return connected_components(edges, "a", "b")


def _verified(reps: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Links within candidate groups, as edges a, b that connect what is connected by links.

    Groups with more than GROUP_GRAMS n-grams are dealt into chunks. A chunk is first compared with itself and with one
    visitor, the group's smallest document. Then one document of each link component of several visits all other chunks,
    and at last all documents outside the group's largest link component do; pairs inside it need no comparison. Visitors
    come in batches of GROUP_GRAMS n-grams, so a task holds a chunk and a batch, each about that large.
    """

    def link(met: bool):
        def one(table: pa.Table) -> pa.Table:
            table = table.sort_by([("rep", "ascending"), ("resident", "descending")])
            rep, root = table.column("rep").to_numpy(), table.column("root").to_numpy()
            raw = [np.frombuffer(r, np.uint64) for r in table.column("grams").to_pylist()]
            got = _Links(raw, table.column("resident").to_numpy(zero_copy_only=False), root, percent, met).connect()
            out = np.flatnonzero(got != np.arange(len(got)))
            return pa.table({"a": pa.array(rep[out], pa.int64()), "b": pa.array(rep[got[out]], pa.int64())})

        return one

    members = reps.join(candidates, F.col("rep") == F.col("node")).select("component", "rep", "n", "grams")
    groups = materialise(members.groupBy("component").agg(F.ceil(F.sum("n") / GROUP_GRAMS).cast("long").alias("chunks")))
    members = members.join(groups, "component").withColumn("chunk", F.pmod(_spread_rep(), F.col("chunks")))
    base = members.select("component", "chunk", "chunks", "rep", "n", "grams", F.lit(True).alias("resident"), F.col("rep").alias("root"))
    split = groups.where("chunks > 1").count() > 0
    first = base
    if split:
        first = first.unionByName(_abroad(_one_each(base.where("chunks > 1 AND rep = component"))))
    edges = first.groupBy("component", "chunk").applyInArrow(link(False), "a long, b long")
    if not split:
        return edges
    edges = materialise(edges)
    for last in (False, True):
        found = connected_components(edges, "a", "b").select("node", F.col("component").alias("found"))
        large = base.where("chunks > 1").drop("root").join(found, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("found", "rep")).drop("node", "found")
        sizes = materialise(large.groupBy("component", "root").agg(F.count(F.lit(1)).alias("size")))
        if last:
            largest = sizes.groupBy("component").agg(F.max_by("root", F.struct("size", "root")).alias("largest"))
            visitors = large.join(largest, "component").where("root != largest").drop("largest")
        else:
            visitors = _one_each(large.where("rep = root")).join(sizes.where("size > 1").select("component", "root"), ["component", "root"], "left_semi")
        edges = materialise(edges.union(_batched(large, visitors).groupBy("component", "chunk", "batch").applyInArrow(link(True), "a long, b long")))
    return edges


def _spread_rep() -> Column:
    """A hash of rep, and of the n-grams for those without a doc_id, which may be many."""
    return F.when(F.col("rep") == B.LOWEST, F.xxhash64("grams")).otherwise(F.xxhash64("rep"))


def _one_each(rows: DataFrame) -> DataFrame:
    """One row for each component and rep, the one whose n-grams have the smallest hash: texts may share a doc_id."""
    marked = rows.withColumn("turn", F.xxhash64("grams"))
    least = marked.groupBy("component", "rep").agg(F.min("turn").alias("turn"))
    return marked.join(least, ["component", "rep", "turn"], "left_semi").drop("turn")


def _abroad(visitors: DataFrame) -> DataFrame:
    """Visitors in all chunks of their group but their own."""
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    return visitors.withColumn("home", F.col("chunk")).withColumn("chunk", everywhere).where("chunk != home").drop("home").withColumn("resident", F.lit(False))


def _batched(large: DataFrame, visitors: DataFrame) -> DataFrame:
    """Each chunk's residents with each batch of visitors of the group, by component, chunk and batch."""
    batches = visitors.groupBy("component").agg(F.ceil(F.sum("n") / GROUP_GRAMS).cast("long").alias("batches"))
    residents = large.join(batches, "component").withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)))
    guests = _abroad(visitors.join(batches, "component").withColumn("batch", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("batches"))))
    return residents.unionByName(guests)
