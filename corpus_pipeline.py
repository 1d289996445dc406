"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as
Parquet and read again.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsheaf.llm import exact, ngram, packing, pii, quality
from docsheaf.llm.shared import new_path, read_documents, remove

STAGES = [
    ("quality rules", quality.stage),
    ("exact dedup", exact.stage),
    ("n-gram Jaccard join", ngram.stage),
    ("personal data", pii.stage),
    ("packing", packing.stage),
]

#: Near-duplicate components, the fitted span model and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's rows are deleted once the next one's are written."""
    docs, before = read_documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
