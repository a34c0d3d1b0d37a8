"""Chat sessions and message history (``messages(session_id, ts, turn, role, content)``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.functions.lines import non_empty

# --- fixed values -------------------------------------------------------------------
TITLE_LENGTH, PREVIEW_LENGTH = 50, 30
DEFAULT_TITLE = "新对话"
RING_SIZE = 100


def history(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages in time order; with ``limit`` the first ones of each session.

    Without a limit this is one range-partitioned sort; with a limit every task
    keeps at most ``limit`` rows per session before anything is shuffled.
    """
    if limit is None:
        return messages.orderBy("session_id", "ts", "turn")
    order = Window.partitionBy("session_id").orderBy("ts", "turn")
    return messages.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def recent_history(messages: DataFrame, limit: int = RING_SIZE) -> DataFrame:
    """Last ``limit`` messages of each session, numbered in time order from the end."""
    order = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("turn"))
    return messages.withColumn("from_end", F.row_number().over(order)).where(F.col("from_end") <= limit)


def llm_context(messages: DataFrame, limit: int | None = None, end: str = "last") -> DataFrame:
    """Role and content of each session's messages in order: ``(session_id, position, role, content)``.

    All messages by default; with ``limit`` those at the ``first`` or ``last``
    end. One row per message, so a long session is no value of unbounded size.
    """
    if end not in ("first", "last"):
        raise ValueError("end is 'first' or 'last'")
    rows = messages
    if limit is not None:
        rows = history(messages, limit) if end == "first" else recent_history(messages, limit)
    order = Window.partitionBy("session_id").orderBy("ts", "turn")
    return rows.select("session_id", F.row_number().over(order).alias("position"), "role", "content")


def _cut(text: Column, n: int) -> Column:
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, "...").otherwise(""))


def session_titles(messages: DataFrame) -> DataFrame:
    """Title of each session from its first user message."""
    first = F.min_by("content", F.when(F.col("role") == "user", F.struct("ts", "turn")))
    return messages.groupBy("session_id").agg(first.alias("content")).where("content is not null").select(
        "session_id", _cut(F.col("content"), TITLE_LENGTH).alias("title")
    )


def set_missing_titles(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Fill the title only where none is stored."""
    new = titles.withColumnRenamed("title", "new_title")
    rest = [c for c in sessions.columns if c != "title"]
    return sessions.join(new, "session_id", "left").select(*rest, F.coalesce(non_empty(F.col("title")), F.col("new_title")).alias("title"))


def session_list(sessions: DataFrame, messages: DataFrame, project_id: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Sessions, newest update first, with message count and display title; ``offset`` and ``limit`` name a page.

    Only the messages of the page's sessions are aggregated, combined map-side.
    """
    wanted = sessions if project_id is None else sessions.where(F.col("project_id") == project_id)
    page, own = wanted, messages
    if offset or limit is not None:
        page = wanted.orderBy(F.desc("updated_at"), "session_id").offset(offset)
        page = page if limit is None else page.limit(limit)
        own = messages.join(page.select("session_id"), "session_id", "left_semi")
    info = own.groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.max_by("content", F.struct("ts", "turn")).alias("last_content")
    )
    preview = F.concat(F.substring("last_content", 1, PREVIEW_LENGTH), F.lit("..."))
    title = F.coalesce(non_empty(F.col("title")), F.when(F.col("last_content") != "", preview), F.lit(DEFAULT_TITLE))
    return page.join(info, "session_id", "left").select(
        "session_id", "project_id", "chat_mode", "updated_at", title.alias("title"), F.coalesce("message_count", F.lit(0)).alias("message_count")
    )


def session_counts(messages: DataFrame) -> DataFrame:
    """Session ids with their number of messages."""
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"))


def upsert_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Create or update sessions from messages: newest project and mode, time of the last message."""
    order = F.struct("ts", "turn")
    seen = messages.groupBy("session_id").agg(
        F.max_by("project_id", F.when(F.col("project_id").isNotNull(), order)).alias("new_project"),
        F.max_by("chat_mode", F.when(F.col("chat_mode").isNotNull(), order)).alias("new_mode"),
        F.max("ts").alias("last_ts"),
    )
    return sessions.join(seen, "session_id", "full_outer").select(
        "session_id",
        F.coalesce("new_project", "project_id").alias("project_id"),
        F.coalesce("new_mode", "chat_mode").alias("chat_mode"),
        F.greatest("updated_at", "last_ts").alias("updated_at"),
    )


def delete_sessions(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a session or message table that survive deleting the given sessions."""
    return table.join(ids.select("session_id").distinct(), "session_id", "left_anti")


def export_history(messages: DataFrame, page_size: int = 1000) -> DataFrame:
    """Sessions as JSON documents of at most ``page_size`` messages: ``(session_id, page, json)``.

    A page is a range of turns, so a huge session becomes many documents and
    no group grows with it.
    """
    page = F.floor(F.col("turn") / page_size).alias("page")
    items = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    pages = messages.groupBy("session_id", page).agg(items.alias("messages"))
    return pages.select("session_id", "page", F.to_json(F.struct("session_id", "messages")).alias("json"))


EXPORT_SCHEMA = "session_id bigint, messages array<struct<turn:bigint,role:string,content:string>>"


def import_history(exported: DataFrame) -> DataFrame:
    """Messages back from exported documents."""
    rows = exported.select(F.from_json("json", EXPORT_SCHEMA).alias("d"))
    return rows.select("d.session_id", F.inline_outer("d.messages")).where("turn is not null")
