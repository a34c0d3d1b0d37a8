"""Queries of the web-feature miners over the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceweave.functions import rules as R
from sourceweave.operators import endpoints as ep
from sourceweave.operators import frontend as fe
from sourceweave.operators import infra
from sourceweave.operators import models as mo
from sourceweave.plans import minesql as ms
from sourceweave.plans.registry import plan
from sourceweave.plans.sqltext import CORPUS
from sourceweave.sources.corpus import corpus

ROUTES = f"with {CORPUS}, {ms.routes('corpus')}"
UI = f"with {CORPUS}, {ms.ui('corpus')}"
CALLS = f"with {CORPUS}, {ms.calls('corpus')}"
ENDPOINTS = f"with {CORPUS}, {ms.endpoints('corpus')}"
MODELS = f"with {CORPUS}, {ms.models('corpus')}"
FEATURES = f"with {CORPUS}, {ms.features('corpus')}"


@plan("router_framework", f"with {CORPUS} select project_id, path, {ms.ROUTER} as framework from corpus")
def router_framework(spark, sf):
    return corpus(spark, sf).select("project_id", "path", fe.router_framework(F.col("content")).alias("framework"))


@plan("extract_routes", f"{ROUTES} select * from routes")
def extract_routes(spark, sf):
    return fe.extract_routes(corpus(spark, sf))


@plan(
    "route_tree",
    f"{ROUTES}, t as (select *, case when route_path = '/' or route_path not like '/%' then null else coalesce(nullif(regexp_replace(route_path, '/[^/]*$', ''), ''), '/') end as parent_path, "
    "case when route_path = '/' or route_path not like '/%' then 0 else len(string_split(route_path, '/')) - 1 end as depth from routes) "
    "select project_id, path, line_no, rule, route_path, parent_path, depth, exists (select 1 from routes r where r.project_id = t.project_id and r.path = t.path "
    "and r.route_path = t.parent_path) as parent_declared from t",
)
def route_tree(spark, sf):
    return fe.route_tree(fe.extract_routes(corpus(spark, sf)))


@plan("extract_ui_actions", f"{UI} select * from ui")
def extract_ui_actions(spark, sf):
    return fe.extract_ui_actions(corpus(spark, sf))


@plan("ui_summary", f"{UI} select project_id, path, type, count(*) as n from ui group by all")
def ui_summary(spark, sf):
    return fe.ui_summary(fe.extract_ui_actions(corpus(spark, sf)))


@plan("extract_api_calls", f"{CALLS} select * from calls")
def extract_api_calls(spark, sf):
    return fe.extract_api_calls(corpus(spark, sf))


@plan("extract_api_calls_all", f"with {CORPUS}, {ms.calls('corpus', False)} select * from calls")
def extract_api_calls_all(spark, sf):
    return fe.extract_api_calls(corpus(spark, sf), dedupe=False)


@plan(
    "api_call_summary",
    f"{CALLS} select project_id, path, method, count(*) as calls, count(distinct api_path) as unique_paths from calls group by 1, 2, 3",
)
def api_call_summary(spark, sf):
    return fe.api_call_summary(fe.extract_api_calls(corpus(spark, sf)))


@plan(
    "endpoint_index",
    f"{CALLS} select project_id, concat(method, ' ', api_path) as endpoint, count(*) as calls, count(distinct path) as files from calls group by 1, 2",
)
def endpoint_index(spark, sf):
    return fe.endpoint_index(fe.extract_api_calls(corpus(spark, sf)))


@plan("backend_framework", f"with {CORPUS} select project_id, path, {ms.BACKEND} as framework from corpus")
def backend_framework(spark, sf):
    return corpus(spark, sf).select("project_id", "path", ep.backend_framework(F.col("content")).alias("framework"))


@plan("extract_endpoints", f"{ENDPOINTS} select * from endpoints")
def extract_endpoints(spark, sf):
    return ep.extract_endpoints(corpus(spark, sf))


@plan(
    "endpoint_summary",
    f"{ENDPOINTS} select project_id, method, count(*) as endpoints, count(*) filter (auth_required) as auth_required, "
    "count(*) filter (not auth_required) as auth_optional, count(distinct api_path) as paths from endpoints group by 1, 2",
)
def endpoint_summary(spark, sf):
    return ep.endpoint_summary(ep.extract_endpoints(corpus(spark, sf)))


@plan("dedupe_endpoints", f"{ENDPOINTS}, {ms.deduped()} select * from apis")
def dedupe_endpoints(spark, sf):
    return ep.dedupe_endpoints(ep.extract_endpoints(corpus(spark, sf)))


TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '([A-Za-z]+|[^A-Za-z]+)', 1), lambda t: upper(t[1]) || lower(t[2:])), '')"
MODULE = (
    f"case when len(p) <= 1 then 'Default' when p[1] in ('api', 'v1', 'v2') then concat({TITLE.format('p[1]')}, ' ', {TITLE.format('p[2]')}) "
    f"else {TITLE.format('p[1]')} end"
)


@plan(
    "endpoints_by_module",
    f"{ENDPOINTS}, e as (select *, string_split(trim(api_path, '/'), '/') as p from endpoints) select project_id, {MODULE} as module, "
    "count(*) as endpoints, count(distinct method) as methods from e group by 1, 2",
)
def endpoints_by_module(spark, sf):
    return ep.endpoints_by_module(ep.extract_endpoints(corpus(spark, sf)))


NAMED = r"regexp_matches(path, '(^|/)[^/]*(api|route|router|controller)[^/]*\.(py|js|ts)$')"
PLACED = "(regexp_matches(path, '^(api|routes|routers|controllers|src/api|app/api)/') or path not like '%/%')"
# the corpus has no such folders at its root, so the API and web folders are moved there
MOVED = "regexp_replace(path, '^(backend/api|server|frontend/src)/(sup|app|router)', 'api/api_\\2')"


@plan(
    "api_candidate_files",
    f"with {CORPUS}, m as (select project_id, {MOVED} as path, content from corpus), c as (select *, row_number() over (partition by project_id order by path) as rank "
    f"from m where {NAMED} and {PLACED}) select project_id, path, rank from c",
)
def api_candidate_files(spark, sf):
    moved = F.regexp_replace("path", "^(backend/api|server|frontend/src)/(sup|app|router)", "api/api_$2")
    return ep.api_candidate_files(corpus(spark, sf).withColumn("path", moved)).select("project_id", "path", "rank")


@plan("orm_dialect", f"with {CORPUS} select project_id, path, {ms.ORM} as dialect from corpus")
def orm_dialect(spark, sf):
    return corpus(spark, sf).select("project_id", "path", mo.orm_dialect(F.col("content")).alias("dialect"))


@plan("extract_models", f"{MODELS} select project_id, path, line_no, name, table_name, model_type, n_fields from models")
def extract_models(spark, sf):
    return mo.extract_models(corpus(spark, sf)).withColumn("n_fields", F.size("fields")).drop("fields")


@plan(
    "extract_models_typeorm",
    f"with {CORPUS}, {ms.models('corpus', 'typeorm')} select m.project_id, m.path, m.line_no, m.name as model, m.table_name, f.name, f.type, f.nullable, f.primary_key "
    "from models m join fields f on f.project_id = m.project_id and f.path = m.path and f.line_no = m.line_no",
)
def extract_models_typeorm(spark, sf):
    m = mo.extract_models(corpus(spark, sf), "typeorm")
    rows = m.select("project_id", "path", "line_no", F.col("name").alias("model"), "table_name", F.inline_outer("fields")).where("name is not null")
    return rows.select("project_id", "path", "line_no", "model", "table_name", "name", "type", "nullable", "primary_key")


@plan(
    "extract_model_fields",
    f"{MODELS} select project_id, path, model, line_no, i as ordinal, name, type, nullable, primary_key, default_value, foreign_key from fields",
)
def extract_model_fields(spark, sf):
    return mo.model_fields(mo.extract_models(corpus(spark, sf)))


@plan(
    "model_summary",
    f"{MODELS} select project_id, model_type, count(*) as models, cast(sum(n_fields) as bigint) as fields, count(*) filter (n_fields = 0) as without_fields from models group by 1, 2",
)
def model_summary(spark, sf):
    return mo.model_summary(mo.extract_models(corpus(spark, sf)))


@plan(
    "foreign_key_edges",
    f"{MODELS} select project_id, model as source_model, name as source_field, split_part(foreign_key, '.', 1) as target_table, "
    "split_part(foreign_key, '.', 2) as target_column from fields where foreign_key is not null",
)
def foreign_key_edges(spark, sf):
    return mo.foreign_key_edges(mo.model_fields(mo.extract_models(corpus(spark, sf))))


@plan("detect_features", f"{FEATURES} select * from features")
def detect_features(spark, sf):
    return infra.detect_features(corpus(spark, sf))


@plan("feature_framework", f"with {CORPUS} select project_id, path, {ms.FRAMEWORK} as framework from corpus")
def feature_framework(spark, sf):
    return corpus(spark, sf).select("project_id", "path", infra.feature_framework().alias("framework"))


@plan(
    "feature_summary",
    f"{FEATURES} select project_id, path, type, count(*) as n, string_agg(name, ',' order by line_no, name) as names from features group by 1, 2, 3",
)
def feature_summary(spark, sf):
    return infra.feature_summary(infra.detect_features(corpus(spark, sf)))


MARKERS = " ".join(f"when '{f}' then '{t}'" for t, names in R.TECH_MARKERS.items() for f in names)
PACKAGES = " union all ".join(
    f"select project_id, '{t}' as technology from corpus where path = 'package.json' and (json_exists((case when path = 'package.json' then content end)::json, '$.dependencies.\"{p}\"') "
    f"or json_exists((case when path = 'package.json' then content end)::json, '$.devDependencies.\"{p}\"'))"
    for p, t in R.TECH_PACKAGES.items()
)
REQS = " union all ".join(
    f"select project_id, '{t}' from corpus where path = 'requirements.txt' and contains(lower(content), '{w}')" for w, t in R.TECH_REQUIREMENTS.items()
)


@plan(
    "tech_stack",
    f"with {CORPUS}, t as (select project_id, case path {MARKERS} end as technology from corpus union all {PACKAGES} union all {REQS}) "
    "select distinct project_id, technology from t where technology is not null",
)
def tech_stack(spark, sf):
    return infra.tech_stack(corpus(spark, sf))
