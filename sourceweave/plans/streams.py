"""Streaming queries, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceweave.plans.inventory import PROGRESS_SQL, progress_events
from sourceweave.plans.registry import plan
from sourceweave.plans.retrieval import chunk_sql
from sourceweave.session import scratch_folder
from sourceweave.streaming import jobs


def _stream(spark, sf: str, name: str):
    """One given table, a file or a folder of files, as a file stream."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # a stream takes a single file only as the match of a pattern
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _result(df, spark, key: str):
    """Run a stateful stream in update mode over everything available; a row per key, from its last update."""
    folder = scratch_folder(spark)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = df.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*df.columns), "batch").alias("row"))
    return last.select("row.*")


@plan("stream_progress", PROGRESS_SQL)
def stream_progress(spark, sf):
    return _result(jobs.progress_stream(progress_events(_stream(spark, sf, "events"))), spark, "project_id")


SESSION_SQL = "select conv_id as session_id, count(*) as message_count, arg_min(text, turn) as first_content, arg_max(text, turn) as last_content, max(timestamp '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60)) as updated_at from conversations group by 1"


def _messages(conversations):
    return conversations.select(
        F.col("conv_id").alias("session_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, conv_id, turn, 0)").alias("ts"),
        "turn",
        F.col("text").alias("content"),
    )


@plan("stream_sessions", SESSION_SQL)
def stream_sessions(spark, sf):
    return _result(jobs.session_stream(_messages(_stream(spark, sf, "conversations"))), spark, "session_id")


@plan("stream_session_table", SESSION_SQL)
def stream_session_table(spark, sf):
    """Odd turns in a first run, even ones late in a second, over one table that is compacted between."""
    folder = scratch_folder(spark)
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    for i, table in ((1, "parts"), (0, "compact")):
        rows.where(F.col("turn") % 2 == i).write.parquet(f"{folder}/in{i}")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{folder}/in{i}")
        jobs.session_table_stream(_messages(arriving), f"{folder}/{table}", f"{folder}/state{i}").awaitTermination()
        if i:
            jobs.compact_sessions(spark, f"{folder}/parts", f"{folder}/compact")
    return jobs.current_sessions(spark, f"{folder}/compact")


# Three runs over one index: all documents; late older versions with newer ones; deletions.
RUNS = [
    "select doc_id, source, lang, text, 10 as version from {0}",
    "select doc_id, source, lang, concat(text, 'late') as text, 5 as version from {0} where doc_id % 3 = 0 union all "
    "select doc_id, source, lang, concat(text, 'x') as text, 20 as version from {0} where doc_id % 4 = 1 union all "
    "select doc_id, source, lang, text, 25 as version from {0} where doc_id % 4 = 2",
    "select doc_id, source, lang, cast(null as string) as text, 30 as version from {0} where doc_id % 5 = 2 union all "
    "select doc_id, source, lang, cast(null as string) as text, 7 as version from {0} where doc_id % 5 = 3",
]
LEFT = (
    "plain as materialized (select source as project_id, concat(source, '/', lang, '/', cast(doc_id as string), '.py') as path, "
    "case when doc_id % 4 = 1 then concat(text, 'x') else text end as content from documents where doc_id % 5 <> 2)"
)


@plan("stream_index", f"with {LEFT}, {chunk_sql('plain')} select project_id, path, chunk_id, start_line, end_line, md5(content) as content_md5 from chunks")
def stream_index(spark, sf):
    folder = scratch_folder(spark)
    spark.read.parquet(f"{sf}/documents.parquet").createOrReplaceTempView("index_documents")
    for i, run in enumerate(RUNS):
        rows = spark.sql(run.format("index_documents"))
        rows.write.parquet(f"{folder}/in{i}")
        docs = spark.readStream.schema(rows.schema).parquet(f"{folder}/in{i}")
        path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
        files = docs.select(F.col("source").alias("project_id"), path.alias("path"), F.col("text").alias("content"), F.col("version").cast("bigint"))
        jobs.index_stream(files, f"{folder}/index", f"{folder}/state{i}").awaitTermination()
    jobs.compact_index(spark, f"{folder}/index", f"{folder}/compact")
    out = jobs.current_index(spark, f"{folder}/compact")
    return out.select("project_id", "path", "chunk_id", "start_line", "end_line", F.md5("content").alias("content_md5"))
