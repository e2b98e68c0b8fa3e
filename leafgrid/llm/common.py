"""Shared pieces of the text operators: session settings, byte tables and UTF-8 word hashing with numpy."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space and the code points 9 to 13.
WS = " \t\n\x0b\f\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
ALNUM_REGEX = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of words that are separated by white space only.
WORD_BYTES = ~SPACES
#: Bytes of words made of digits, letters and everything beyond ASCII.
ALNUM_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
KEEP_CASE = np.arange(256, dtype=np.uint8)
FOLD_CASE = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_LONG_WORD = 512


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike ``lower``."""
    # lower() is much faster than translate() and does the same to texts of one byte a character.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder, deleted when the driver ends.

    Only a session in local mode may go without such a folder; it gets one of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            shared = known.get()
        elif spark.sparkContext.master.startswith("local"):
            shared = f"file://{tempfile.gettempdir()}/spark-leafgrid"
        else:
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    path = f"{shared.rstrip('/')}/leafgrid-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads 64-bit keys evenly."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Words:
    """The words of a batch of texts: 64-bit hashes in order, with their byte spans.

    ``bounds[i]:bounds[i + 1]`` are the words of text i; ``starts`` and ``ends`` are byte positions in ``raw``.
    """

    def __init__(self, column, fold: bool = False, word_bytes: np.ndarray = WORD_BYTES):
        self.raw, self.offsets = utf8(column)
        raw, off, n = self.raw, self.offsets, len(self.raw)
        inside = word_bytes[raw]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:] = inside[:-1]
            before[off[:-1][off[:-1] < n]] = False
            after[:-1] = inside[1:]
            last = off[1:] - 1
            after[last[last >= 0]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, off)
        self.hashes = self._hash(FOLD_CASE[raw] if fold else raw)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        size = self.ends - self.starts
        h = size.astype(np.uint64) * _M1
        if not len(h):
            return h
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        h = (h ^ (eights[self.starts] & _LOW[np.minimum(size, 8)])) * _M2
        h ^= h >> np.uint64(29)
        part = np.flatnonzero((size > 8) & (size <= _LONG_WORD))
        at = 8
        while len(part):
            x = (h[part] ^ (eights[self.starts[part] + at] & _LOW[np.minimum(size[part] - at, 8)])) * _M2
            h[part] = x ^ (x >> np.uint64(29))
            at += 8
            part = part[size[part] > at]
        for i in np.flatnonzero(size > _LONG_WORD):
            h[i] = int.from_bytes(hashlib.blake2b(data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest(), "little")
        return mix(h)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of whole rows with about ``most`` bytes of text; a longer text is a piece by itself."""
    size = np.cumsum(np.diff(utf8(batch.column(column))[1]))
    begin, done = 0, 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(begin, end - begin)
        begin, done = end, int(size[end - 1])


def spaced(words: Words, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts' words with one space between two of a text, and where each word starts and ends there."""
    data = (FOLD_CASE if fold else KEEP_CASE)[words.raw]
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, words.starts, 1)
    np.subtract.at(keep, words.ends, 1)
    keep = np.cumsum(keep, dtype=np.int8)[:-1].astype(bool)
    last = np.zeros(len(words.ends), bool)
    last[words.bounds[1:][words.counts > 0] - 1] = True
    gaps = words.ends[~last]
    data[gaps], keep[gaps] = 32, True
    place = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], place[words.starts], place[words.ends]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row, by position of the first, across text bounds too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done = None, 0
    power, width, left = hashes, 1, k
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                piece = power[done : done + n]
                out = piece.copy() if out is None else out * _power(width) + piece
                done += width
            left >>= 1
            if left:
                power = power[: len(power) - width] * _power(width) + power[width:]
                width *= 2
        return mix(out)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64))


def starts_within(bounds: np.ndarray, k: int) -> np.ndarray:
    """For each k-gram position over all words: whether all its words are of one text."""
    n = int(bounds[-1])
    ok = np.ones(n, bool)
    for back in range(1, k):
        at = bounds[1:] - back
        ok[at[at >= bounds[:-1]]] = False
    return ok[: max(0, n - k + 1)]


def run_bounds(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and one past the last of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each slice bounds[i]:bounds[i + 1]; empty slices give 0."""
    if not len(values):
        return np.zeros(len(bounds) - 1, values.dtype)
    out = np.zeros(len(bounds) - 1, np.result_type(values, np.int64) if values.dtype.kind in "bui" else values.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values.astype(out.dtype), bounds[:-1][some])
    return out
