"""Corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over everything its
predecessor kept; ``run`` writes every stage's rows as Parquet to the shared
folder and reads them back as the next stage's documents.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carelake.llm.common import read_documents, stored
from carelake.session import apply_defaults


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the repetition rules reject go.

    Null and empty texts have no words and go; every row is judged by itself, so repeated rows
    share one fate; texts of any length are read whole; columns of any name pass through."""
    from carelake.llm.quality import keep_quality

    apply_defaults(spark)  # the first stage; the settings stay with the session
    return keep_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts the row with the largest doc_id stays.

    Null equals empty; null ids come last; of rows equal in id and text one stays; an empty
    table and columns of any name pass through."""
    from carelake.llm.exact import drop_duplicates

    return drop_duplicates(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of linked texts stays (the smallest doc_id).

    Near duplicates share 80 % of their shingles of five words.  Null texts and texts
    without words link with nothing and stay; null ids come after all others; an empty table and
    columns of any name pass through."""
    from carelake.llm.ngram_join import keep_representatives

    return keep_representatives(docs, percent=80, words=5)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the sources meet their target weights; a document drawn twice is there twice.

    A null source is a source of its own, the last one; documents without words take no part in the
    targets; an empty table gives an empty table, columns of any name pass through."""
    from carelake.llm.mixing import draw_documents

    return draw_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every document of the mix in sequences of at most 2048 tokens.

    A null text is empty and is one end token; longer documents are cut into pieces; repeated rows are
    packed each; an empty table gives no piece."""
    from carelake.llm.packing import packing_report

    return packing_report(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

# Packing and near-duplicate components are not expressible in SQL over whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
