"""Queries of chat history and of the project catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceweave.operators import catalog as ct
from sourceweave.operators import history as hi
from sourceweave.plans.registry import plan
from sourceweave.plans.sqltext import q
from sourceweave.sources.tables import messages, table

TS = "timestamp '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60)"
MSG = f"msg as (select conv_id as session_id, {TS} as ts, turn, role, text as content from conversations)"
# Every conversation has a stored session, every fourth a title; upserts find two of three stored.
SESSIONS = (
    "sessions as (select conv_id as session_id, concat('p', cast(conv_id % 7 as string)) as project_id, 'project' as chat_mode, case when conv_id % 4 = 0 then concat('T', cast(conv_id as string)) else '' end as title, "
    "max(timestamp '2024-01-01 00:00:00' + to_seconds(conv_id * 1800)) as updated_at from conversations group by 1, 2, 3, 4)"
)
STORED = SESSIONS.replace(" from conversations group", " from conversations where conv_id % 3 <> 0 group")


def _sessions(spark, sf, stored="true"):
    c = table(spark, sf, "conversations").where(stored).select("conv_id").distinct()
    return c.select(
        F.col("conv_id").alias("session_id"),
        F.concat(F.lit("p"), (F.col("conv_id") % 7).cast("string")).alias("project_id"),
        F.lit("project").alias("chat_mode"),
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("T"), F.col("conv_id").cast("string"))).otherwise("").alias("title"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, conv_id * 30, 0)").alias("updated_at"),
    )


@plan("history", f"with {MSG} select session_id, ts, turn, role, content from msg order by session_id, ts, turn")
def history(spark, sf):
    return hi.history(messages(spark, sf))


@plan(
    "history_first",
    f"with {MSG}, r as (select *, row_number() over (partition by session_id order by ts, turn) as position from msg) select session_id, role, content, position from r where position <= 3",
)
def history_first(spark, sf):
    return hi.history(messages(spark, sf), 3).select("session_id", "role", "content", "position")


@plan(
    "recent_history",
    f"with {MSG}, r as (select *, row_number() over (partition by session_id order by ts desc, turn desc) as from_end from msg) select session_id, turn, role, content, from_end from r where from_end <= 3",
)
def recent_history(spark, sf):
    return hi.recent_history(messages(spark, sf), 3).select("session_id", "turn", "role", "content", "from_end")


@plan(
    "llm_context",
    f"with {MSG}, r as (select *, row_number() over (partition by session_id order by ts, turn) as position from msg) select session_id, position, role, content from r",
)
def llm_context(spark, sf):
    return hi.llm_context(messages(spark, sf))


@plan(
    "llm_context_last",
    f"with {MSG}, r as (select *, row_number() over (partition by session_id order by ts, turn) as k, count(*) over (partition by session_id) as n from msg) "
    "select session_id, k - greatest(n - 5, 0) as position, role, content from r where k > n - 5",
)
def llm_context_last(spark, sf):
    return hi.llm_context(messages(spark, sf), 5)


@plan(
    "session_titles",
    f"with {MSG}, r as (select *, row_number() over (partition by session_id order by ts, turn) as k from msg where role = 'user') select session_id, concat(left(content, 50), case when length(content) > 50 then '...' else '' end) as title from r where k = 1",
)
def session_titles(spark, sf):
    return hi.session_titles(messages(spark, sf))


@plan(
    "set_missing_titles",
    f"with {MSG}, {SESSIONS}, r as (select *, row_number() over (partition by session_id order by ts, turn) as k from msg where role = 'user') select s.session_id, s.project_id, "
    "coalesce(nullif(s.title, ''), concat(left(content, 50), case when length(content) > 50 then '...' else '' end)) as title from sessions s left join r on r.session_id = s.session_id and k = 1".replace(
        "concat(left(content, 50), case when length(content) > 50 then '...' else '' end)", "left(content, 50) || case when length(content) > 50 then '...' else '' end"
    ),
)
def set_missing_titles(spark, sf):
    out = hi.set_missing_titles(_sessions(spark, sf), hi.session_titles(messages(spark, sf)))
    return out.select("session_id", "project_id", "title")


LAST = "l as (select session_id, count(*) as n, arg_max(content, ts) as c from msg group by 1)"


LISTED = (
    f"select s.session_id, project_id, chat_mode, updated_at, coalesce(nullif(title, ''), case when c <> '' then concat(left(c, 30), '...') end, {q(hi.DEFAULT_TITLE)}) as title, coalesce(n, 0) as message_count "
    "from {sessions} s left join l on l.session_id = s.session_id"
)


@plan("session_list", f"with {MSG}, {SESSIONS}, {LAST} {LISTED.format(sessions='sessions')}")
def session_list(spark, sf):
    return hi.session_list(_sessions(spark, sf), messages(spark, sf))


@plan(
    "session_list_page",
    f"with {MSG}, {SESSIONS}, {LAST} {LISTED.format(sessions='(select * from sessions order by updated_at desc, session_id limit 50 offset 5)')}",
)
def session_list_page(spark, sf):
    """One page, the way a client asks for it."""
    return hi.session_list(_sessions(spark, sf), messages(spark, sf), offset=5, limit=50)


@plan("session_counts", f"with {MSG} select session_id, count(*) as message_count from msg group by 1")
def session_counts(spark, sf):
    return hi.session_counts(messages(spark, sf))


@plan(
    "upsert_sessions",
    f"with {MSG}, {STORED}, m as (select *, case when turn % 3 = 0 then null else concat('q', cast(turn as string)) end as project_id, case when turn % 2 = 0 then 'freeform' else 'smart' end as chat_mode from msg), "
    "n as (select session_id, arg_max(project_id, ts) filter (project_id is not null) as np, arg_max(chat_mode, ts) as nm, max(ts) as last_ts from m group by 1) "
    "select coalesce(s.session_id, n.session_id) as session_id, coalesce(np, project_id) as project_id, coalesce(nm, chat_mode) as chat_mode, greatest(updated_at, last_ts) as updated_at from sessions s full join n on n.session_id = s.session_id",
)
def upsert_sessions(spark, sf):
    m = messages(spark, sf).withColumn("project_id", F.when(F.col("turn") % 3 != 0, F.concat(F.lit("q"), F.col("turn").cast("string"))))
    m = m.withColumn("chat_mode", F.when(F.col("turn") % 2 == 0, "freeform").otherwise("smart"))
    return hi.upsert_sessions(_sessions(spark, sf, "conv_id % 3 <> 0"), m)


@plan("delete_sessions", f"with {MSG} select session_id, turn, role from msg where session_id not in (select doc_id from labels where quality = 0)")
def delete_sessions(spark, sf):
    ids = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("session_id"))
    return hi.delete_sessions(messages(spark, sf), ids).select("session_id", "turn", "role")


@plan(
    "export_history",
    "select conv_id as session_id, cast(floor(turn / 4) as bigint) as page, concat('{\"session_id\":', cast(conv_id as string), ',\"messages\":[', string_agg(concat('{\"turn\":', cast(turn as string), ',\"role\":', to_json(role), ',\"content\":', to_json(text), '}'), ',' order by turn), ']}') as json "
    "from conversations group by 1, 2",
)
def export_history(spark, sf):
    return hi.export_history(messages(spark, sf), 4)


@plan("import_history", "select conv_id as session_id, turn, role, text as content from conversations")
def import_history(spark, sf):
    return hi.import_history(hi.export_history(messages(spark, sf), 4))


# --- catalog: orders are projects, customers their owners ------------------------------------

PROJECTS = "projects as (select o_orderkey as project_id, o_custkey as owner_id, lower(o_orderstatus) as status, o_orderdate as created_at from orders)"


def _projects(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("owner_id"), F.lower("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at")
    )


@plan("paginate", f"with {PROJECTS} select * from projects order by created_at desc, project_id limit 25 offset 50")
def paginate(spark, sf):
    return ct.paginate(_projects(spark, sf), page=3, page_size=25)


@plan("paginate_owner", f"with {PROJECTS} select * from projects where owner_id = 7 order by created_at desc, project_id limit 10")
def paginate_owner(spark, sf):
    return ct.paginate(_projects(spark, sf), owner_id=7)


@plan("project_total", f"with {PROJECTS} select count(*) as total from projects")
def project_total(spark, sf):
    return ct.total(_projects(spark, sf))


@plan("point_lookup", f"with {PROJECTS} select * from projects where project_id = 42")
def point_lookup(spark, sf):
    return ct.point_lookup(_projects(spark, sf), "project_id", 42)


@plan(
    "cascade_delete",
    "with gone as (select o_orderkey as k from orders where o_orderstatus = 'P') select 'projects' as t, o_orderkey as project_id, 0 as child from orders where o_orderkey not in (select k from gone) "
    "union all select 'versions', l_orderkey, l_linenumber from lineitem where l_orderkey not in (select k from gone)",
)
def cascade_delete(spark, sf):
    projects = _projects(spark, sf)
    versions = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("child"))
    left = ct.cascade_delete(projects, {"versions": versions}, projects.where("status = 'p'"))
    p = left["projects"].select(F.lit("projects").alias("t"), "project_id", F.lit(0).alias("child"))
    return p.unionByName(left["versions"].select(F.lit("versions").alias("t"), "project_id", "child"))


@plan("visible_projects", "select o_custkey as user_id, o_orderkey as project_id from orders join customer on c_custkey = o_custkey where c_mktsegment <> 'BUILDING'")
def visible_projects(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_mktsegment") == "BUILDING").alias("is_admin"))
    return ct.visible_projects(_projects(spark, sf), users)


@plan("projects_for_user", f"with {PROJECTS} select * from projects where owner_id = 11")
def projects_for_user(spark, sf):
    return ct.projects_for(_projects(spark, sf), 11)


# Line items send a new status to their order: one per order, some of them invalid.
UPDATES = "upd as (select l_orderkey as project_id, max(case l_returnflag when 'A' then 'ready' when 'N' then 'bogus' else 'error' end) as new_status from lineitem group by 1)"


def _updates(spark, sf):
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", "ready").when(flag == "N", "bogus").otherwise("error")
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("project_id")).agg(F.max(status).alias("new_status"))


@plan("status_update", f"with {PROJECTS}, {UPDATES} select p.project_id, owner_id, created_at, case when new_status in ('ready', 'error') then new_status else status end as status from projects p left join upd on upd.project_id = p.project_id")
def status_update(spark, sf):
    return ct.status_update(_projects(spark, sf), _updates(spark, sf))[0]


@plan("status_rejects", f"with {PROJECTS}, {UPDATES} select * from upd where new_status = 'bogus' or project_id not in (select project_id from projects)")
def status_rejects(spark, sf):
    return ct.status_update(_projects(spark, sf), _updates(spark, sf))[1]


TEXTS = (
    "select doc_id as project_id, case when doc_id % 3 = 0 then '' else source end as summary, case when doc_id % 2 = 0 then null else lang end as readme_stored, case when doc_id % 5 = 0 then '' else text end as readme_file, "
    "case when doc_id % 4 = 0 then null else text end as architecture, case when doc_id % 6 = 0 then '' else lang end as data_flow, case when doc_id % 7 = 0 then null else concat('[\"', lang, '\",\"', source, '\"]') end as tech_stack, "
    "concat('{\"apis\":[', cast(n_chars as string), ',', cast(doc_id as string), ',1]}') as api_info, case when doc_id % 8 = 0 then 'x' else concat('{\"modules\":[\"', lang, '\"]}') end as key_modules from documents"
)


def _texts(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("catalog_documents")
    return spark.sql(TEXTS.replace("from documents", "from catalog_documents"))


@plan("description_pick", f"select project_id, coalesce(nullif(summary, ''), nullif(readme_stored, ''), nullif(readme_file, ''), '') as description from ({TEXTS})")
def description_pick(spark, sf):
    return ct.description_pick(_texts(spark, sf))


@plan(
    "analysis_flags",
    "select project_id, coalesce(length(architecture) > 0, false) as has_architecture, coalesce(length(summary) > 0, false) as has_summary, coalesce(length(data_flow) > 0, false) as has_data_flow, "
    "case when tech_stack is null then 0 else 2 end as tech_stack_count, 3 as api_count, case when key_modules = 'x' then 0 else 1 end as modules_count from (" + TEXTS + ")",
)
def analysis_flags(spark, sf):
    return ct.analysis_flags(_texts(spark, sf))
