"""A corpus pipeline: quality, line deduplication, near copies, benchmark decontamination and the mix, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and returns the columns of documents;
the last returns how much of each document the mix takes.
"""

from __future__ import annotations

from leafgrid.llm.common import materialise
from leafgrid.llm.stages import decontaminate, line_dedup, mix, near_copies, quality

STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
]

#: The model's scores and the draws of the mix can't be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; each stage is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
