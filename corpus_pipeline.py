"""A corpus pipeline of five operators: reject by classifier and rules, keep one of each group of near duplicates, drop what leaks the benchmark, encode.

Every stage judges all rows that the one before kept; null and empty texts are judged as empty texts, which the rules reject.
Null and repeated ids are rows like any other; of equal texts, repeated rows included, one stays (the smallest id, nulls last).
Texts of any length are judged whole. Empty tables of documents, labels or benchmark items give no rows, no model and no leaks.
Extra columns travel with their rows up to the last stage, which returns doc_id, n_tokens and ids alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotwise.llm import byte_bpe, decontaminate, jaccard_join, quality_classifier, quality_rules
from lotwise.llm.common import Scratch, read_table

#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_classifier", quality_classifier.stage),
    ("quality_rules", quality_rules.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontaminate", decontaminate.stage),
    ("byte_bpe", byte_bpe.stage),
]
#: SQL expresses neither the classifier's fit nor the joins' tiling; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and reread as the next stage's input."""
    scratch, docs = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
