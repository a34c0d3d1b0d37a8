"""Chunking, embedding and exact vector search."""

from __future__ import annotations

from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sourceweave.functions import vectors as V
from sourceweave.functions.lines import let, lines_of
from sourceweave.session import bound_batches, scratch_folder
from sourceweave.sources.files import INDEXED_EXTENSIONS, skip_filter, suffix

# --- fixed values ------------------------------------------------------------------
CHUNK_TOKENS = 1000
CHUNK_LINES = 50
SEMANTIC_WEIGHT, KEYWORD_BONUS = 0.7, 0.3
#: Every character the white-space tokeniser splits on.
WHITE_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

#: Queries of one pass over the vectors.
QUERY_BLOCK = 5_000


def count_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WHITE_SPACE), lambda w: w != ""))


def chunk_lines(files: DataFrame, max_tokens: int = CHUNK_TOKENS, max_lines: int = CHUNK_LINES, *keep: str) -> DataFrame:
    """Greedy chunks of whole lines: a line that would pass ``max_tokens``, or a
    51st line, starts a new chunk; an over-long line forms its own chunk.

    One fold per file finds the chunk starts; the file never leaves its row.
    """
    src = files.select("project_id", "path", *keep, lines_of(F.col("content")).alias("lines"))
    tokens = F.transform("lines", count_tokens)
    zero = F.struct(
        F.array(F.lit(1)).alias("starts"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("tok"), F.lit(0).alias("i")
    )

    def step(s: Column, t: Column) -> Column:
        flush = (s["n"] > 0) & ((s["tok"] + t > max_tokens) | (s["n"] >= max_lines))
        return F.struct(
            F.when(flush, F.array_append(s["starts"], s["i"] + 1)).otherwise(s["starts"]).alias("starts"),
            F.when(flush, 1).otherwise(s["n"] + 1).alias("n"),
            F.when(flush, t.cast("bigint")).otherwise(s["tok"] + t).alias("tok"),
            (s["i"] + 1).alias("i"),
        )

    starts = F.aggregate(tokens, zero, step, lambda s: s["starts"])
    ranges = let(
        starts,
        lambda b: F.transform(
            b, lambda s, i: F.struct(s.alias("start_line"), F.coalesce(F.get(b, i + 1) - 1, F.size("lines")).alias("end_line"))
        ),
    )
    rows = src.select("project_id", "path", *keep, "lines", F.explode_outer(ranges).alias("r"))
    first, last = F.col("r.start_line"), F.col("r.end_line")
    return rows.select(
        "project_id",
        "path",
        *keep,
        F.concat_ws(":", "path", first.cast("string"), last.cast("string")).alias("chunk_id"),
        first.alias("start_line"),
        last.alias("end_line"),
        F.array_join(F.slice("lines", first, last - first + 1), "\n").alias("content"),
    )


def index_chunks(files: DataFrame) -> DataFrame:
    """Vectors of all indexed files: ids ``project:path:start:end``, content, metadata, embedding.

    Written partitioned by project with dynamic overwrite, this replaces each
    project's earlier vectors.
    """
    kept = skip_filter(files, "index").where(suffix(F.col("path")).isin(INDEXED_EXTENSIONS))
    chunks = chunk_lines(kept)
    return chunks.select(
        F.concat_ws(":", "project_id", "chunk_id").alias("id"),
        "project_id",
        F.col("path").alias("file_path"),
        "start_line",
        "end_line",
        F.concat(F.lit("."), suffix(F.col("path"))).alias("file_extension"),
        "content",
        V.hash_embed(F.col("content")).alias("embedding"),
    )


def index_stats(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("project_id").agg(
        F.countDistinct("file_path").alias("indexed_files"), F.count("*").alias("indexed_chunks")
    )


def store_stats(indexed: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: documents in the store and sessions with messages."""
    documents = indexed.agg(F.count("*").alias("total_documents"))
    sessions = messages.agg(F.countDistinct("session_id").alias("active_sessions"))
    both = documents.unionByName(sessions, allowMissingColumns=True)
    return both.agg(F.max("total_documents").alias("total_documents"), F.max("active_sessions").alias("active_sessions"))


def topk_search(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact top-``k`` vectors per query by cosine: ``(query_id, id, score, rank)``.

    ``vectors(id, embedding)`` never move: each task scores its rows against blocks
    of ``block`` queries and keeps its own ``k`` best per query, so only
    ``tasks * queries * k`` rows are shuffled. Queries stream through the driver, as
    many blocks for one pass over the vectors as ``QUERY_BLOCK`` holds, whatever their
    number. Of several passes each one's results are written before the next one
    comes, so the driver holds the queries of one pass and the plan does not grow with them.
    """
    spark, folder, one = vectors.sparkSession, None, None
    # few tasks, since each of them hands on k rows of every query; the vectors of a task come in batches
    vecs = vectors.select("id", "embedding").coalesce(2 * spark.sparkContext.defaultParallelism)
    qs = queries.select("query_id", F.col("embedding").alias("q"))
    id_type, q_type = vecs.schema["id"].dataType, qs.schema["query_id"].dataType
    value = np.dtype(to_arrow_type(qs.schema["q"].dataType.elementType).to_pandas_dtype())
    out = T.StructType([T.StructField("query_id", q_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    bound_batches(spark)
    as_bytes = qs.mapInArrow(V.packed, T.StructType([T.StructField("query_id", q_type), T.StructField("q", T.BinaryType())]))
    rows, sent_at_once = as_bytes.toLocalIterator(), block * max(1, QUERY_BLOCK // block)
    for number in count():
        part = list(islice(rows, sent_at_once))
        if one is not None and (part or folder):
            folder = folder or scratch_folder(spark)
            one.write.parquet(f"{folder}/block={number}")
            sent.destroy()
        if not part:
            break
        matrix = np.frombuffer(b"".join(r["q"] for r in part), value).reshape(len(part), -1)
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in part], dtype=object), matrix))

        def score(batches, sent=sent):
            ids, matrix = sent.value
            yield from V.topk_batches(batches, ids, matrix, k, schema, block)

        one = vecs.mapInArrow(score, out).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = out.add("rank", T.IntegerType())
    if one is None:
        return spark.createDataFrame([], out)
    return spark.read.schema(out).parquet(f"{folder}/block=*") if folder else one


def retrieve(vectors: DataFrame, questions: DataFrame, k: int = 5, threshold: float | None = None, **equals) -> DataFrame:
    """Best ``k`` chunks per ``questions(query_id, text)``; the threshold applies after the top-k.

    ``equals`` are metadata filters (for example ``project_id="p1"``); they are
    pushed to the scan of the vector table.
    """
    store = vectors
    for name, value in equals.items():
        store = store.where(F.col(name) == value)
    queries = questions.select("query_id", V.hash_embed(F.col("text")).alias("embedding"))
    hits = topk_search(store, queries, k)
    return hits.where(F.col("score") >= threshold) if threshold else hits


def with_payload(hits: DataFrame, vectors: DataFrame, *columns: str) -> DataFrame:
    """Attach payload columns of the hit vectors.

    The hits are written once, so the join is planned with their real size: few of
    them go to the vectors, whose payload is not shuffled. A checkpoint has no size.
    """
    folder = scratch_folder(hits.sparkSession)
    hits.write.parquet(folder)
    return vectors.select("id", *columns).join(hits.sparkSession.read.schema(hits.schema).parquet(folder), "id")


def hybrid_rerank(hits: DataFrame, keywords: list[str], k: int) -> DataFrame:
    """Re-rank ``2k`` semantic hits: weighted score plus a bonus when any keyword occurs in the content."""
    low = F.lower("content")
    has = F.lit(False)
    for word in keywords:
        has = has | low.contains(word.lower())
    score = F.round(F.col("score") * SEMANTIC_WEIGHT + F.when(has, KEYWORD_BONUS).otherwise(0.0), 9)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid_retrieve(vectors: DataFrame, questions: DataFrame, keywords: list[str], k: int = 5) -> DataFrame:
    hits = with_payload(retrieve(vectors, questions, 2 * k), vectors, "content")
    return hybrid_rerank(hits, keywords, k)


def multi_query_retrieve(
    vectors: DataFrame, questions: DataFrame, k: int = 5, max_keywords: int | None = None, max_results: int | None = None
) -> DataFrame:
    """``questions(query_id, keywords)``: top-k of every keyword, distinct, in keyword order.

    A keyword is searched once, however many questions have it. Where asked only
    the first keywords are searched and the first results kept.
    """
    asked = F.col("keywords") if max_keywords is None else F.slice("keywords", 1, max_keywords)
    words = questions.select(F.col("query_id").cast("string").alias("query_id"), F.posexplode(asked).alias("ordinal", "text"))
    once = words.select(F.col("text").alias("query_id"), "text").distinct()
    hits = retrieve(vectors, once, k).withColumnRenamed("query_id", "text")
    rows = words.join(hits, "text").select("query_id", "ordinal", "id", "score", "rank")
    first = rows.groupBy("query_id", "id").agg(F.min(F.struct("ordinal", "rank", "score")).alias("f"))
    order = Window.partitionBy("query_id").orderBy("f.ordinal", "f.rank", "id")
    ranked = first.select("query_id", "id", F.col("f.score").alias("score"), F.row_number().over(order).alias("rank"))
    return ranked if max_results is None else ranked.where(F.col("rank") <= max_results)


def vector_get(vectors: DataFrame, ids: DataFrame | None = None, **equals) -> DataFrame:
    out = vectors
    for name, value in equals.items():
        out = out.where(F.col(name) == value)
    return out if ids is None else out.join(ids.select("id").distinct(), "id", "left_semi")


def vector_delete(vectors: DataFrame, ids: DataFrame | None = None, **equals) -> DataFrame:
    """Vectors left after deleting ids and/or every row with the given metadata."""
    out = vectors
    if ids is not None:
        out = out.join(ids.select("id").distinct(), "id", "left_anti")
    for name, value in equals.items():
        out = out.where(~F.col(name).eqNullSafe(F.lit(value)))
    return out
