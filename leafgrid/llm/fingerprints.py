"""Document fingerprints (I-Match): hashes of the distinct terms that a document shares with random lexicons.

Only terms whose inverse document frequency lies in a band count. Lexicons are random subsets of that band at several
densities, so that a document with few band terms and one with many both get informative hashes. Built-in functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialise

#: Random lexicons of each density, and the share of the band that each keeps: one term in so many.
LEXICONS = 16
DENSITIES = (16, 64, 256)
#: Lexicons with terms that a density needs before its share counts in full.
ENOUGH = 4
#: The hash of no terms.
NONE = "0000002A"
#: Bits of the band's Bloom filter for each of its terms, and the places of a term's two bits in its hash. A term outside the
#: band passes with a chance of 1.4 %, wherever it occurs.
BLOOM_BITS, PROBES = 16, (0, 27)
#: Rows to a range of documents for the neighbour search, as long as there are no more than MOST_RANGES; larger ones spill.
RANGE_ROWS = 3000
MOST_RANGES = 1 << 16
LOWEST = -(1 << 63)


def _longs(values) -> Column:
    """A literal array of long values; folded by the optimizer, without an expression for each."""
    text = ",".join(map(str, values))
    return F.split(F.lit(text), ",").cast("array<bigint>") if text else F.lit(None).cast("array<bigint>")


def _bound(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def terms_of(text: Column) -> Column:
    """The sorted distinct terms of a text, each as a hash of 64 bits; none for null."""
    words = F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def idf_band(docs: DataFrame, low: float = 0.0002, high: float = 0.1) -> list[int]:
    """The terms whose share of all documents lies in [low, high], as a Bloom filter (64 bits to a number).

    All terms are counted, combined on the map side; those of one document only are out, for they match nothing. The filter
    is sized by the number of terms in the band. That is at most 1 / low times the distinct terms of a mean document,
    however large the corpus: with 400 of them, 4 MB.
    """
    counts = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    band = materialise(counts.where((F.col("n") > 1) & (F.col("n") >= total * low) & (F.col("n") <= total * high)).select("term"))
    numbers = 1 << max(6, (band.count() * BLOOM_BITS // 64).bit_length())
    bits = band.select(F.explode(F.array(*[_place(F.col("term"), p, numbers) for p in PROBES])).alias("bit"))
    out = [0] * numbers
    for row in bits.groupBy(F.shiftright("bit", 6).alias("number")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).collect():
        out[row["number"]] = row["bits"]
    return out


def _place(term: Column, probe: int, numbers: int) -> Column:
    return F.shiftrightunsigned(term, probe).bitwiseAND(F.lit(64 * numbers - 1))


def in_band(terms: Column, band: list[int]) -> Column:
    """The terms that are in the band, or all where none is."""
    bitmap = _longs(band)

    def has(term: Column) -> Column:
        bits = [F.getbit(F.element_at(bitmap, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) for p in (_place(term, probe, len(band)) for probe in PROBES)]
        return (bits[0] == 1) & (bits[1] == 1)

    return _bound(terms, lambda every: _bound(F.filter(every, has), lambda some: F.when(F.size(some) > 0, some).otherwise(every)))


def lexicon_rules(seed: int = 42) -> list[tuple[tuple[int, int, int], list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each density: a rule for all its lexicons, and two lists of four rules.

    A rule (shift, mask, value) keeps the terms whose hash has these bits; lexicon (i, j) keeps what the rule for all,
    the first list's i and the second list's j do. Rules look at bits of their own, so they are independent, and the random
    subsets overlap.
    """
    rules, shift = [], 0

    def rule(bits: int) -> tuple[int, int, int]:
        nonlocal shift
        shift += bits
        return shift - bits, (1 << bits) - 1, (seed * 2654435761 + shift * 40503 >> 7) % (1 << bits)

    for density in DENSITIES:
        rules.append((rule((density // LEXICONS).bit_length() - 1), [rule(2) for _ in range(4)], [rule(2) for _ in range(4)]))
    return rules


def _kept(terms: Column, rule: tuple[int, int, int]) -> Column:
    shift, mask, value = rule
    return F.filter(terms, lambda t: t.bitwiseAND(F.lit(mask << shift)) == value << shift) if mask else terms


def fingerprint(text: Column, band: list[int]) -> Column:
    """The fingerprint: for each density, one hash (8 hexadecimal digits) of the text's terms in each lexicon.

    NONE stands for a lexicon that has no term of the text. A text without any band term is judged by all its terms;
    an empty or null text has NONE throughout. Equal texts have equal fingerprints.
    """

    def of_density(terms: Column, rules) -> Column:
        every, firsts, seconds = rules

        def hashes(some: Column) -> Column:
            return F.array(*[F.substring(F.lpad(F.hex(F.xxhash64(_kept(some, r))), 16, "0"), -8, 8) for r in seconds])

        quarters = _bound(_kept(terms, every), lambda some: F.array(*[_kept(some, r) for r in firsts]))
        return F.flatten(F.transform(quarters, hashes))

    return _bound(in_band(terms_of(text), band), lambda t: F.array_join(F.concat(*[of_density(t, r) for r in lexicon_rules()]), ""))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the largest share, over the densities, of equal hashes among lexicons that have a term of either.

    A density with few such lexicons counts less, by ENOUGH. Equal fingerprints give 1.
    """
    shares = []
    for k in range(len(DENSITIES)):
        at = F.array(*[F.lit(8 * (k * LEXICONS + j) + 1) for j in range(LEXICONS)])
        pairs = F.transform(at, lambda i: F.struct(F.substring(a, i, F.lit(8)).alias("x"), F.substring(b, i, F.lit(8)).alias("y")))
        used = F.size(F.filter(pairs, lambda p: (p["x"] != NONE) | (p["y"] != NONE)))
        same = F.size(F.filter(pairs, lambda p: (p["x"] == p["y"]) & (p["x"] != NONE)))
        shares.append(same / F.greatest(used, F.lit(ENOUGH)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(*shares)).cast("double")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with next_<column>: the values of the next row by descending doc_id; after the last comes the first.

    Rows are dealt into ranges of doc_id with about as many rows each; the first row of each range is also sent to the
    range above, as a guest, so one shuffle is enough and no task sees all rows. Equal doc_ids follow each other by
    their text's hash. Null doc_ids come last; a third of all rows may be such, so they are spread, by 40 bits of their text's
    hash, over numbers that are smaller than all doc_ids.
    """
    spread = F.lit(LOWEST) + F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1))
    rows = docs.select(F.coalesce(F.col("doc_id"), spread).alias("_id"), F.xxhash64("text").alias("_mark"), "doc_id", *columns)
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    shares = F.split(F.lit(",".join(repr(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
    found = rows.agg(F.percentile_approx("_id", shares, max(10000, 20 * ranges)).alias("b")).first()["b"] if ranges > 1 else None
    least = rows.agg(F.min("_id").alias("m")).first()["m"] if found else None
    bounds = sorted({b for b in found or [] if b > least})
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    if bounds:  # binary search: the number of bounds that are not above the doc_id
        step = lambda acc, s: F.when((acc + s <= len(bounds)) & (F.try_element_at(_longs(bounds), (acc + s).cast("int")) <= F.col("_id")), acc + s).otherwise(acc)
        at = F.aggregate(_longs(steps), F.lit(0).cast("bigint"), step)
    else:
        at = F.lit(0).cast("bigint")
    size = len(bounds) + 1
    rows = rows.withColumn("_range", at)
    first = rows.groupBy("_range").agg(F.max("_id").alias("_id")).select("_id", F.lit(True).alias("_first"))
    # One row for each range: at most MOST_RANGES numbers are broadcast.
    rows = rows.join(F.broadcast(first), "_id", "left")
    to = F.when(F.col("_first"), F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")), F.struct(F.pmod(F.col("_range") + 1, F.lit(size)).alias("r"), F.lit(1).alias("guest"))))
    rows = rows.withColumn("_to", F.explode(to.otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest"))))))
    w = Window.partitionBy("_to.r").orderBy("_to.guest", F.col("_id").desc(), "_mark")
    out = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.where(F.col("_to.guest") == 0).select("doc_id", *columns, *[f"next_{c}" for c in columns])


def fingerprint_with_edits(docs: DataFrame, low: float = 0.0002, high: float = 0.1) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with how alike they are.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document's. Columns: doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty; a lone document is its own next. Repeated rows give a row each. Extra columns are left out; an empty
    table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    band = idf_band(docs, low, high)
    rows = with_next(docs.withColumn("fingerprint", fingerprint(F.col("text"), band)), ["text", "fingerprint"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited_text"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited_text"), band))
    return rows.select(
        "doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
