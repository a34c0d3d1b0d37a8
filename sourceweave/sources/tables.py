"""Readers that shape the given tables into the library's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One document becomes one file. The extension and the folder vary with the
# document id so that every path rule of the scan operators is exercised.
DOC_PATH_SQL = (
    "concat(case when doc_id % 10 = 0 then 'node_modules/' when doc_id % 10 = 1 then 'src/.hidden/' "
    "when doc_id % 10 = 2 then 'build/' when doc_id % 10 = 3 then '' else concat(source, '/', lang, '/') end, "
    "case when doc_id % 17 = 0 then '.' else '' end, 'doc_', cast(doc_id as string), "
    "case when doc_id % 8 = 0 then '.py' when doc_id % 8 = 1 then '.js' when doc_id % 8 = 2 then '.TS' "
    "when doc_id % 8 = 3 then '.java' when doc_id % 8 = 4 then '.min.js' when doc_id % 8 = 5 then '.png' "
    "when doc_id % 8 = 6 then '.md' else '.go' end)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(project_id, path, content)`` with one file per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return docs.selectExpr("source as project_id", f"{DOC_PATH_SQL} as path", "text as content")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``messages(session_id, ts, role, content)`` from the conversations."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, conv_id, turn, 0)").alias("ts"),
        "turn",
        "role",
        F.col("text").alias("content"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vectors(id, embedding, label)``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
