"""Structured Streaming versions of indexing, progress and session summaries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourceweave.operators.retrieval import chunk_lines
from sourceweave.operators.snapshots import percentage
from sourceweave.session import cut_lineage


def progress_stream(events: DataFrame) -> DataFrame:
    """Running stage and percentage per project (output mode ``update`` or ``complete``)."""
    last = events.groupBy("project_id").agg(F.max_by(F.struct("stage", "current", "total"), F.struct("ts", "seq")).alias("p"))
    return last.select(
        "project_id",
        F.col("p.stage").alias("stage"),
        percentage(F.col("p.current"), F.col("p.total")).alias("percentage"),
        (F.col("p.stage") == "completed").alias("is_complete"),
        (F.col("p.stage") == "error").alias("has_error"),
    )


def session_stream(messages: DataFrame) -> DataFrame:
    """Running message count, first and last message per session."""
    order: Column = F.struct("ts", "turn")
    return messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"),
        F.min_by("content", order).alias("first_content"),
        F.max_by("content", order).alias("last_content"),
        F.max("ts").alias("updated_at"),
    )


HASHES = "project_id string, path string, version bigint, sha256 string, chunks_in string, batch string"


def index_stream(files: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep an index table of the newest version of every file.

    ``files(project_id, path, content, version)`` arrive as a stream; null
    content says that the file is gone. Each micro-batch takes the newest version
    of a file and drops it where the table knows that version or a newer one, so
    late rows change nothing. Changed files write their chunks, all others only a
    row of the narrow hash table, which points to the batch that holds the
    chunks. A batch writes below a key of its own, made of the query's id and the
    batch number: a repeated batch overwrites itself, and a query that starts
    anew after losing its checkpoint never overwrites another's batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id:010d}"
        newest = batch.groupBy("project_id", "path").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("version"))
        fresh = newest.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
        old = _latest(_hashes(spark, table).where(F.col("batch") != key))
        old = old.select("project_id", "path", F.col("version").alias("v"), F.col("sha256").alias("old_hash"), F.col("chunks_in").alias("old_chunks"))
        fresh = fresh.join(old, ["project_id", "path"], "left").where("v is null or version > v")
        same = F.col("sha256").eqNullSafe(F.col("old_hash")) & F.col("v").isNotNull()
        fresh = cut_lineage(fresh.withColumn("chunks_in", F.when(same, F.col("old_chunks")).otherwise(F.lit(key))))
        changed = fresh.where((F.col("chunks_in") == key) & F.col("content").isNotNull())
        chunk_lines(changed, 1000, 50, "version").write.mode("overwrite").parquet(f"{table}/chunks/batch={key}")
        fresh.select("project_id", "path", "version", "sha256", "chunks_in").write.mode("overwrite").parquet(f"{table}/hashes/batch={key}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _hashes(spark, table: str) -> DataFrame:
    """The hash table, empty before the first batch."""
    try:
        return spark.read.schema(HASHES).parquet(f"{table}/hashes")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], HASHES)


def _latest(hashes: DataFrame) -> DataFrame:
    newest = hashes.groupBy("project_id", "path").agg(F.max_by(F.struct("sha256", "chunks_in"), "version").alias("x"), F.max("version").alias("version"))
    return newest.select("project_id", "path", "version", "x.sha256", "x.chunks_in")


def current_index(spark, table: str) -> DataFrame:
    """Chunks of the newest version of every file that is not gone."""
    live = _latest(_hashes(spark, table)).where("sha256 is not null")
    return spark.read.parquet(f"{table}/chunks").join(live.select("project_id", "path", F.col("chunks_in").alias("batch")), ["project_id", "path", "batch"], "left_semi")


def compact_index(spark, table: str, target: str) -> None:
    """Write the current state of ``table`` as a new table of one batch; gone files keep their row."""
    hashes = _latest(_hashes(spark, table)).withColumn("chunks_in", F.lit("compacted"))
    current_index(spark, table).drop("batch").write.parquet(f"{target}/chunks/batch=compacted")
    hashes.write.parquet(f"{target}/hashes/batch=compacted")


# --- summaries without streaming state ------------------------------------------------


def session_table_stream(messages: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a table of session summaries whose stream holds no state.

    ``messages(session_id, ts, turn, content)`` arrive as a stream. The parts of
    ``session_stream``'s summary can be merged, so a micro-batch writes one narrow row
    for each of its sessions below its own key (see ``index_stream``) and forgets
    them: memory does not grow with the sessions ever seen, however late a message
    is, and an idle session stays in the table. A repeated batch overwrites itself.
    Messages without an order (``ts`` or ``turn`` null) come first; rows without a
    session are one session.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        key = f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id:010d}"
        said = F.struct("ts", "turn", "content")
        parts = batch.groupBy("session_id").agg(
            F.count("*").alias("message_count"), F.min(said).alias("first"), F.max(said).alias("last"), F.max("ts").alias("updated_at")
        )
        parts.write.mode("overwrite").parquet(f"{table}/batch={key}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("session_id").agg(
        F.sum("message_count").alias("message_count"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("updated_at").alias("updated_at")
    )


def current_sessions(spark, table: str) -> DataFrame:
    """``session_id, message_count, first_content, last_content, updated_at`` of every session in the table."""
    merged = _merged(spark.read.option("basePath", table).parquet(table))
    return merged.select("session_id", "message_count", F.col("first.content").alias("first_content"), F.col("last.content").alias("last_content"), "updated_at")


def compact_sessions(spark, table: str, target: str) -> None:
    """Write ``table`` as a new table with one row for each session, which a stream can go on with."""
    _merged(spark.read.option("basePath", table).parquet(table)).write.parquet(f"{target}/batch=compacted")
