"""Line deduplication over documents, with built-in functions only.

Lines are normalised, exploded and hashed; the distinct documents of each hash are counted, lines whose hash reaches the
threshold go, and what is left is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, lower_ascii, materialise

#: Lines' hashes that are broadcast at most, 16 bytes each. Beyond that only those with more than one in so many of all lines
#: are, and there can't be more of these.
MOST_SENT = 200_000


def _line_hashes(text: Column, min_chars: int) -> Column:
    """128 bits of each normalised line as a pair, in order; null for keys that are too short."""
    keys = F.transform(F.split(lower_ascii(text), "\n", -1), lambda line: F.btrim(line, F.lit(WS)))
    return F.transform(keys, lambda key: F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document with the lines that few documents share: doc_id, text (what is kept), n_lines, n_dropped.

    A line's key is the line stripped of white space at both ends, A-Z lower-cased. Keys of at least ``min_chars``
    code points found in at least ``min_docs`` documents lose all their lines in every document.

    Documents are told apart by doc_id: rows that share one count as one document, and rows without one aren't counted
    (their lines go like any others). Each row gives a row. A null or empty text is one empty line; its key has no code
    points, so it stays. A document that loses all lines keeps an empty text. Columns named in ``carry`` are kept (not the
    four above), others are left out; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text, F.char_length(text)).alias("mark"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    # Each line is hashed once; 16 bytes a line are written, and the texts are read again for the last join only.
    hashed = materialise(whole.select("doc_id", "mark", _line_hashes(F.col("text"), min_chars).alias("keys")))
    lines = hashed.select("doc_id", "mark", F.posexplode("keys").alias("at", "k")).where("k IS NOT NULL").select("doc_id", "mark", "at", "k.a", "k.b")
    # Only a line that occurs often enough at all can do so in enough documents. Counts are combined on the map side.
    often = materialise(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs))
    hits = materialise(_joined(lines, often))
    # The two steps of a distinct count: a hot line is dealt by its documents first.
    common = hits.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("n"), F.count(F.lit(1)).alias("lines")).where(F.col("n") >= min_docs).select("a", "b", F.col("lines").alias("n"))
    gone = _joined(hits, materialise(common)).groupBy(F.col("doc_id").alias("g_id"), F.col("mark").alias("g_mark")).agg(F.collect_set("at").alias("gone"))
    joined = whole.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("mark") == F.col("g_mark")), "left")
    # Lines are split once, as the only element of an array, and then taken by the places that stay.
    places = F.array_except(F.sequence(F.lit(0), _n_lines() - 1), "gone")
    kept = F.transform(F.array(F.split("text", "\n", -1)), lambda parts: F.array_join(F.transform(places, lambda i: F.element_at(parts, i + 1)), "\n"))
    return joined.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept[0]).alias("text"),
        _n_lines().cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col(f"carry_{c}").alias(c) for c in carry],
    )


def _n_lines() -> Column:
    return F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1


def _joined(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines whose hash is among ``keys`` (a, b, n: how many lines have it).

    Few keys are broadcast. Of many, the hot ones are: at most MOST_SENT keys can have more than one in MOST_SENT lines
    each. The rest meet their lines in a shuffle, in which no key is hot.
    """
    few, total = keys.agg(F.count(F.lit(1)), F.sum("n")).first()
    share = (total or 0) // MOST_SENT if few > MOST_SENT else 0
    found = lines.join(F.broadcast(keys.where(F.col("n") > share).select("a", "b")), ["a", "b"], "left_semi")
    return found if not share else found.unionByName(lines.join(keys.where(F.col("n") <= share).select("a", "b").hint("shuffle_merge"), ["a", "b"], "left_semi"))
