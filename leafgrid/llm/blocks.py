"""Asking the whole corpus about keys, block by block.

Operators on word shingles need, for each of a document's many keys, something that all documents decide: how often it
occurs, who has it first. Sending each occurrence through a shuffle costs a multiple of the text. Instead documents are
dealt into blocks by doc_id. A block asks about each distinct key once; the keys, sorted, are cut into ranges, and
the range's task answers all blocks, in the order in which they asked. So a key has at most one entry for each block,
however many rows have it, no task sees more than one block or one range, and a block that is lost can be asked again.
The text is shuffled once: later passes over the blocks reuse the exchange.

Blocks times ranges would be too many rows for a large corpus. Beyond MOST_RANGES ranges, rows travel in bundles like mail
through sorting offices: a block bundles its rows by district of ranges, an office takes the bundles of some blocks for a
district and bundles them anew by range, and answers go back the same way. So a block, an office and a range each handle
about the square root of the number of ranges in bundles.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text to a block, and keys to a range.
BLOCK_CHARS = 4_000_000
RANGE_KEYS = 1_500_000
LEAST_BLOCKS, LEAST_RANGES = 24, 24
#: Ranges up to which blocks and ranges exchange rows without offices.
MOST_RANGES = 4096
LOWEST = -(1 << 63)

ASK = "range int, block int, keys binary, data binary"
ANSWER = "block int, range int, data binary"


@dataclass(frozen=True)
class Plan:
    blocks: int
    ranges: int

    @property
    def district(self) -> int:
        """How many ranges a district has, and how many blocks bring their bundles to one office; 0 without offices."""
        return math.ceil(math.sqrt(self.ranges)) if self.ranges > MOST_RANGES else 0


def plan_for(docs: DataFrame) -> Plan:
    """So many blocks and ranges that each fits a task, whatever the corpus; its size is summed over all texts."""
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    return Plan(max(LEAST_BLOCKS, -(-chars // BLOCK_CHARS)), max(LEAST_RANGES, -(-chars // (6 * RANGE_KEYS))))


def in_blocks(docs: DataFrame, plan: Plan, *more) -> DataFrame:
    """doc_id, text and more columns with the block; rows with the same doc_id share a block. Null ids become LOWEST.

    Rows without a doc_id are dealt by their text, as a third of all rows may be such.
    """
    doc_id = F.col("doc_id").cast("long")
    place = F.when(doc_id.isNull(), F.xxhash64("text")).otherwise(F.xxhash64(doc_id))
    return docs.select(F.pmod(place, F.lit(plan.blocks)).cast("int").alias("block"), F.coalesce(doc_id, F.lit(LOWEST)).alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def range_width(ranges: int) -> int:
    return (1 << 64) // ranges + 1


def cut(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted 64-bit keys are cut into ranges of equal width."""
    width = range_width(ranges)
    return np.concatenate([[0], np.searchsorted(keys, np.array([width * i for i in range(1, ranges)], np.uint64)), [len(keys)]]).astype(np.int64)


def rows(schema: str, values: list[tuple]) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*values, strict=True)) if values else [()] * len(fields)
    return pa.table({name: pa.array(c, types[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def asked(block: int, keys: np.ndarray, ranges: int, *data: np.ndarray) -> list[tuple]:
    """Rows of ASK for sorted distinct keys; data arrays go with the keys, one after the other in each row."""
    at = cut(keys, ranges)
    some = np.flatnonzero(np.diff(at))
    return [(r, block, keys[a:b].tobytes(), b"".join(d[a:b].tobytes() for d in data)) for r, a, b in zip(some.tolist(), at[some].tolist(), at[some + 1].tolist(), strict=True)]


def block_of(table: pa.Table) -> int:
    return int(table.column("block")[0].as_py())


def _bundled(table: pa.Table, by: str, share: int, names: list[str]) -> list[tuple[int, bytes]]:
    """The rows in bundles by ``by`` // share: its number, and the rows as bytes."""
    if not table.num_rows:
        return []
    key = table.column(by).to_numpy().astype(np.int64) // share
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1))
    table, out = table.select(names).take(pa.array(order)).combine_chunks(), []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table.slice(a, b - a))
        out.append((int(key[order[a]]), sink.getvalue().to_pybytes()))
    return out


def _opened(bundles: pa.ChunkedArray, names: list[str], types: list[pa.DataType]) -> pa.Table:
    parts = [pa.ipc.open_stream(b).read_all() for b in bundles.to_pylist()]
    return pa.concat_tables(parts).combine_chunks() if parts else pa.table({n: pa.array([], t) for n, t in zip(names, types, strict=True)})


_ASK = ["range", "block", "keys", "data"]
_ANSWER = ["block", "range", "data"]
_ANSWER_TYPES = [pa.int32(), pa.int32(), pa.binary()]


def ask(docs: DataFrame, question: Callable[[pa.Table], pa.Table], plan: Plan, answers: DataFrame | None = None) -> DataFrame:
    """What each block asks, with the ``answers`` to an earlier question if there are any."""
    wide = plan.district

    def sent(rows_: pa.Table) -> pa.Table:
        block = rows_.column("block")[0].as_py() if rows_.num_rows else 0
        return rows("district int, block int, bundle binary", [(d, block, b) for d, b in _bundled(rows_, "range", wide, _ASK)])

    schema = "district int, block int, bundle binary" if wide else ASK
    if answers is None:
        asks = docs.groupBy("block").applyInArrow((lambda t: sent(question(t))) if wide else question, schema)
    else:
        asks = with_answers(docs, answers, (lambda t, a: sent(question(t, a))) if wide else question, schema)
    if not wide:
        return asks

    def sort(table: pa.Table) -> pa.Table:
        office, district = (int(table.column(c)[0].as_py()) for c in ("office", "district"))
        got = _bundled(_opened(table.column("bundle"), _ASK, []), "range", 1, _ASK)
        return rows("range int, office int, district int, bundle binary", [(r, office, district, b) for r, b in got])

    offices = asks.withColumn("office", F.floor(F.col("block") / wide).cast("int"))
    return offices.groupBy("office", "district").applyInArrow(sort, "range int, office int, district int, bundle binary")


def answer(questions: DataFrame, reply: Callable[[pa.Table], pa.Table], plan: Plan) -> DataFrame:
    """The rows of ANSWER for each block; answers to a negative range (notes of a range to one block) go the same way."""
    wide = plan.district
    if not wide:
        return questions.groupBy("range").applyInArrow(reply, ANSWER)

    def back(table: pa.Table) -> pa.Table:
        district = int(table.column("district")[0].as_py())
        got = _bundled(reply(_opened(table.column("bundle"), _ASK, [])), "block", wide, _ANSWER)
        return rows("office int, district int, bundle binary", [(o, district, b) for o, b in got])

    def sort(table: pa.Table) -> pa.Table:
        got = _bundled(_opened(table.column("bundle"), _ANSWER, _ANSWER_TYPES), "block", 1, _ANSWER)
        return rows("block int, range int, data binary", [(b, BUNDLE, d) for b, d in got])

    replies_ = questions.groupBy("range").applyInArrow(back, "office int, district int, bundle binary")
    return replies_.groupBy("office", "district").applyInArrow(sort, ANSWER)


def tell(questions: DataFrame, use: Callable[[pa.Table], pa.Table], schema: str, plan: Plan) -> DataFrame:
    """What each range makes of the rows that blocks have sent it, without an answer to them."""
    return questions.groupBy("range").applyInArrow((lambda t: use(_opened(t.column("bundle"), _ASK, []))) if plan.district else use, schema)


#: Stands for the range where a row of ANSWER holds a bundle of rows.
BUNDLE = -(1 << 31)


def unbundled(answers: pa.Table) -> pa.Table:
    """Rows of ANSWER (and further columns, of which there is one value for all of a bundle) without bundles."""
    if not answers.num_rows or answers.column("range")[0].as_py() != BUNDLE:
        return answers
    more = [c for c in answers.schema.names if c not in _ANSWER]
    parts = []
    for i, b in enumerate(answers.column("data").to_pylist()):
        part = pa.ipc.open_stream(b).read_all()
        for c in more:
            part = part.append_column(c, pa.array([answers.column(c)[i].as_py()] * part.num_rows, answers.schema.field(c).type))
        parts.append(part)
    return pa.concat_tables(parts).combine_chunks()


def with_answers(docs: DataFrame, answers: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each block with its answers; blocks without documents give nothing."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return use(left, unbundled(right)) if left.num_rows else rows(schema, [])

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)


def joined(answers: pa.Table, dtype) -> np.ndarray:
    """The answers in the order of the block's sorted keys."""
    order = np.argsort(answers.column("range").to_numpy())
    data = answers.column("data").to_pylist()
    return np.frombuffer(b"".join(data[i] for i in order), dtype) if len(order) else np.zeros(0, dtype)


def gather(table: pa.Table, *dtypes) -> tuple[list[int], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a range: its blocks, how many keys each asks about, all keys, and the data arrays, in order of the blocks."""
    block = table.column("block").to_numpy()
    order = np.argsort(block)
    keys = table.column("keys").to_pylist()
    data = table.column("data").to_pylist()
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    sizes = []
    for i in order:
        n = len(keys[i]) // 8
        at = 0
        for part, kind in zip(parts, dtypes, strict=True):
            part.append(np.frombuffer(data[i], kind, n, at))
            at += n * np.dtype(kind).itemsize
        sizes.append(n)
    every = np.frombuffer(b"".join(keys[i] for i in order), np.uint64)
    return block[order].tolist(), np.array(sizes), every, [np.concatenate(p) for p in parts]


def replies(range_: int, blocks: list[int], sizes: np.ndarray, *data: np.ndarray) -> pa.Table:
    """Rows of ANSWER: the data arrays, which are in the order of gather(), dealt back to the blocks."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    return rows(ANSWER, [(b, range_, b"".join(d[i:j].tobytes() for d in data)) for b, i, j in zip(blocks, at[:-1].tolist(), at[1:].tolist(), strict=True)])


def packed(counts: np.ndarray, flags: np.ndarray | None = None) -> bytes:
    """Counts in a byte each, with a flag; those of 127 and more follow in eight."""
    low = np.minimum(counts, 127).astype(np.uint8)
    if flags is not None:
        low |= flags.astype(np.uint8) << 7
    return low.tobytes() + counts[counts >= 127].astype(np.uint64).tobytes()


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and flags of packed()."""
    low = np.frombuffer(data, np.uint8, n)
    counts = (low & 127).astype(np.int64)
    counts[counts == 127] = np.frombuffer(data, np.uint64, offset=n)
    return counts, low > 127


def coded(keys: np.ndarray, base: int, drop: int = 0) -> bytes:
    """Sorted keys, none below base, as steps without their low bits. The steps' bytes lie by significance, so that the shuffle
    compresses the high ones, which are nearly all zero.
    """
    steps = np.diff(keys >> np.uint64(drop), prepend=np.uint64(base >> drop))
    wide = -(-int(steps.max()).bit_length() // 8) if len(steps) else 0
    return struct.pack("<IB", len(steps), wide) + steps.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def decoded(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """Keys of coded() less the base, without the dropped bits, and where they end."""
    n, wide = struct.unpack_from("<IB", data, at)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :wide] = np.frombuffer(data, np.uint8, n * wide, at + 5).reshape(wide, n).T
    return np.cumsum(steps.view(np.uint64)[:, 0], dtype=np.uint64), at + 5 + n * wide
