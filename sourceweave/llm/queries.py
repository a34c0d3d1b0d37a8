"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.llm import (
    chat, collocations, decontam, divergence, exacthash, forest, jaccard, langid, packing, ring, tokencount, urlrules, wrappers,
)
from sourceweave.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_documents(table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlrules.judge_urls(urls, urlrules.rules_frame(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return forest.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(added)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.training_rows(documents))
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    found = langid.identify(documents.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exacthash.exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_wrapper_text,
        op2_ring_shards,
        op3_url_rules,
        op4_prefix_forest,
        op5_token_counts,
        op6_jaccard_join,
        op7_decontamination,
        op8_best_fit_packing,
        op9_chat_format,
        op10_language_id,
        op11_source_divergence,
        op12_collocations,
        op13_exact_dedup,
    )
}

#: Checking SQL where SQL can express the whole result.
ORACLES: dict[str, str] = {
    "op3_url_rules": urlrules.ORACLE,
    "op6_jaccard_join": jaccard.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_exact_dedup": exacthash.ORACLE,
}
