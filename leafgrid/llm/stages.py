"""The stages of the corpus pipeline: each applies an operator and lets its decision take effect.

All stages keep nulls in doc_id, lang, source and n_chars as they are, leave out columns that documents don't have, give an
empty table for an empty one, and treat repeated rows alike, but for the join, which leaves one of them. A null text counts
as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise
from .decontaminate import find_contamination_in_parts
from .line_dedup import drop_common_lines
from .mixing import mix_sources
from .ngram_join import link_near_copies
from .quality import fit_quality, score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that the classifier scores below this are rejected.
LEAST_SCORE = 0.3
#: A document goes as a whole if more than this share of its words are in benchmark passages.
MOST_HIT = 0.5


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(_documents(docs), model).where(F.col("score") >= LEAST_SCORE).drop("score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them share; a document that has only such lines goes."""
    kept = drop_common_lines(docs, carry=("lang", "source")).where("n_dropped < n_lines")
    return kept.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Texts are told apart even where their doc_id is the same or missing: of those that share one, the text with the smallest
    hash has it, and the others, like those without one, come after all that have one, by their hash. Of rows with the same
    doc_id and text one stays, the first by lang, source and n_chars. A document without words is in no group.
    """
    docs = _documents(docs)
    late = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    mark = F.xxhash64("text")
    shared = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(mark).alias("_least"), F.max(mark).alias("_most")).where("_least < _most")
    shared = materialise(shared.select("doc_id", "_least"))
    rows = docs.withColumn("_least", F.lit(None).cast("long")) if shared.isEmpty() else docs.join(shared, "doc_id", "left")
    key = F.when(F.col("doc_id").isNull(), late("text")).when(mark != F.col("_least"), late("text", "doc_id")).otherwise(F.col("doc_id"))
    rows = rows.withColumn("_key", key).drop("_least")
    groups = link_near_copies(rows.select(F.col("_key").alias("doc_id"), "text"))
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias("_key")).distinct()
    first = Window.partitionBy("_key").orderBy("lang", "source", "n_chars")
    # Repeated rows go before the join: each task keeps one of a key, so a text that a third of all rows have isn't moved with it.
    return rows.withColumn("_turn", F.row_number().over(first)).where("_turn = 1").join(gone, "_key", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; one that has little else goes as a whole."""
    found = find_contamination_in_parts(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True, carry=("lang", "source"))
    kept = found.where(F.col("n_hit") <= MOST_HIT * F.col("n_words"))
    return kept.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.char_length("clean_text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    return mix_sources(docs)
