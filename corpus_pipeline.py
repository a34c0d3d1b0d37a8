"""A corpus pipeline over ``documents``: language, near duplicates, leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.llm import decontam, jaccard, langid, packing
from sourceweave.llm.common import bound_batches, table, written
from sourceweave.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects.

    Null texts and texts without a letter have no language and go, however long they
    are. Repeated rows are judged one by one; an empty table stays empty.
    """
    bound_batches(spark)
    found = langid.identify(docs, langid.fit(langid.training_rows(docs)))
    return found.filter(~F.col("rejected")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every group of linked documents.

    Rows are judged one by one: a repeated id loses only its linked texts, and a
    group without ids keeps one row. Texts without words stay.
    """
    bound_batches(spark)
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, with few edits or, if it is short, as whole words.

    Null and empty texts stay, as do all rows where the benchmark is empty.
    """
    bound_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest into sequences of at most 4096 tokens; a null text counts as empty."""
    bound_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
