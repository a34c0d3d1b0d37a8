"""Queries over the mined features of whole projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceweave.operators import insights as ins
from sourceweave.plans import minesql as ms
from sourceweave.plans.inventory import keep_sql
from sourceweave.plans.registry import plan
from sourceweave.plans.sqltext import CORPUS, SUFFIX, in_list
from sourceweave.sources import files as fs
from sourceweave.session import cut_lineage
from sourceweave.sources.corpus import corpus

FE, BE = in_list(fs.FRONTEND_EXTENSIONS), in_list(fs.BACKEND_EXTENSIONS)
KEPT = f"{CORPUS}, kept as materialized (select * from corpus where {keep_sql('features')})"
FRONT = f"fe as materialized (select * from kept where {SUFFIX} in ({FE}))"
BACK = f"be as materialized (select * from kept where {SUFFIX} in ({BE}))"
BOTH = f"fb as materialized (select * from kept where {SUFFIX} in ({FE}, {BE}))"
FRONT_ALL = f"with {KEPT}, {FRONT}, {ms.routes('fe')}, {ms.ui('fe')}, {ms.calls('fe')}"
BACK_CTES = f"{BACK}, {BOTH}, {ms.endpoints('be')}, {ms.deduped()}, {ms.models('be')}, {ms.features('fb')}"
BACK_ALL = f"with {KEPT}, {BACK_CTES}"


def _mined(spark, sf, *staged: str, **columns: str):
    """Mined tables; the ``staged`` ones are read several times and are written once.

    ``columns`` names those that are read of a staged table: a checkpoint would compute all others too.
    """
    mined = {k: df.select(*columns[k].split()) if k in columns else df for k, df in ins.feature_mine(corpus(spark, sf)).items()}
    return {k: cut_lineage(df) if k in staged or k in columns else df for k, df in mined.items()}


@plan(
    "feature_mine",
    f"{FRONT_ALL}, {BACK_CTES} select project_id, 'routes' as kind, path, count(*) as n from routes group by 1, 3 union all "
    "select project_id, 'ui_actions', path, count(*) from ui group by 1, 3 union all select project_id, 'api_calls', path, count(*) from calls group by 1, 3 union all "
    "select project_id, 'endpoints', path, count(*) from apis group by 1, 3 union all select project_id, 'models', path, count(*) from models group by 1, 3 union all "
    "select project_id, 'features', path, count(*) from features group by 1, 3",
)
def feature_mine(spark, sf):
    out = None
    for kind, df in _mined(spark, sf).items():
        one = df.groupBy("project_id", F.lit(kind).alias("kind"), "path").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


SEP = "chr(1)"


def _key(*parts: str) -> str:
    return f"md5(concat_ws({SEP}, {', '.join(parts)}))"


def _sec(name: str) -> str:
    return _key("project_id", "'section'", f"'{name}'")


PAGE = "replace(replace(replace(replace(regexp_extract(path, '([^/]*)$', 1), '.tsx', ''), '.ts', ''), '.jsx', ''), '.js', '')"
VERB = "concat(method, ' ', api_path)"
MODEL_KEY = _key("project_id", "'model'", "path", "line_no", "name")
FIELD_PARENT = _key("project_id", "'model'", "path", "line_no", "model")
COLS = "project_id, {id} as node_id, {parent} as parent_id, '{cat}' as category, '{sec}' as section, '{type}' as type, {name} as name, {path} as path, {line} as line_no"


def _rows(src, sec, type_, id_, parent, name, path="path", line="cast(line_no as int)"):
    return f"select {COLS.format(id=id_, parent=parent, cat=ins.SECTIONS[sec][0], sec=sec, type=type_, name=name, path=path, line=line)} from {src}"


HEADS = [
    f"select project_id, {_key('project_id', chr(39) + 'root' + chr(39), chr(39) + c + chr(39))} as node_id, null as parent_id, '{c}' as category, '' as section, 'component' as type, "
    f"'{c}' as name, '' as path, 0 as line_no from projects"
    for c in ("frontend", "backend")
] + [
    f"select project_id, {_sec(n)}, {_key('project_id', chr(39) + 'root' + chr(39), chr(39) + c + chr(39))}, '{c}', '{n}', '{t}', '{n}', '', 0 from projects"
    for n, (c, t) in ins.SECTIONS.items()
]
PAGE_ID = _key("project_id", "'page'", "path")
TREE = (
    f"{FRONT_ALL}, {BACK_CTES}, projects as (select distinct project_id from corpus), tree as materialized ("
    + " union all ".join(
        HEADS
        + [
            _rows("routes", "routes", "route", _key("project_id", "'route'", "path", "line_no", "rule", "route_path"), _sec("routes"), "name"),
            _rows("(select distinct project_id, path from ui)", "pages", "page", PAGE_ID, _sec("pages"), PAGE, line="0"),
            _rows("ui", "pages", "function", _key("project_id", "'function'", "path", "line_no", "rule", "handler"), PAGE_ID, "name"),
            _rows("calls", "api_calls", "api", _key("project_id", "'call'", "path", "line_no", "rule", VERB), _sec("api_calls"), VERB),
            _rows("apis", "apis", "api", _key("project_id", "'api'", VERB), _sec("apis"), VERB),
            _rows("features", "system", "system", _key("project_id", "'system'", "path", "line_no", "type"), _sec("system"), "name"),
            _rows("models", "models", "model", MODEL_KEY, _sec("models"), "name"),
            _rows("fields", "models", "model", _key(FIELD_PARENT, "i"), FIELD_PARENT, "name", "''", "0"),
        ]
    )
    + ")"
)


def _tree(spark, sf):
    return ins.feature_tree(_mined(spark, sf, "ui_actions", "models"), corpus(spark, sf).select("project_id").distinct())


@plan("feature_tree", f"{TREE} select * from tree")
def feature_tree(spark, sf):
    return _tree(spark, sf)


@plan("tree_counts", f"{TREE} select project_id, category, type, count(*) as n from tree where parent_id is not null group by 1, 2, 3")
def tree_counts(spark, sf):
    return ins.tree_counts(_tree(spark, sf))


@plan("tree_find_type", f"{TREE} select node_id, project_id, name, path from tree where type = 'api'")
def tree_find_type(spark, sf):
    return ins.tree_find(_tree(spark, sf), type_="api").select("node_id", "project_id", "name", "path")


@plan(
    "arch_modules",
    f"{TREE}, leaf as (select * from tree where parent_id is not null and node_id not in (select parent_id from tree where parent_id is not null)), "
    "r as (select *, row_number() over (partition by project_id, category order by section, path, line_no, name, node_id) as rank from leaf) "
    "select project_id, category, rank, type, name from r where rank <= 10",
)
def arch_modules(spark, sf):
    return ins.arch_modules(_tree(spark, sf))


def _highlight(*pairs: tuple[str, str]) -> str:
    text = "concat_ws(',', " + ", ".join(f"case when {test} then '{code}' end" for test, code in pairs) + ")"
    return f"case when {text} = '' then 'clear' else {text} end as highlights"


FE_UNION = (
    "u as (select project_id, path, 'r' as src, '' as type from routes union all select project_id, path, 'a', type from ui union all select project_id, path, 'c', '' from calls)"
)
FE_SUMS = "count(*) filter (src = 'r') as route_count, count(*) filter (src = 'a') as page_function_count, count(*) filter (src = 'c') as api_call_count"


@plan(
    "frontend_insights",
    f"{FRONT_ALL}, {FE_UNION}, s as (select project_id, {FE_SUMS}, count(*) filter (type = 'state') as st, count(distinct path) as active_file_count from u group by 1) "
    f"select project_id, route_count, page_function_count, api_call_count, active_file_count, {_highlight(('route_count > 20', 'many_routes'), ('st > 30', 'much_state'), ('api_call_count > 40', 'many_api_calls'))} from s",
)
def frontend_insights(spark, sf):
    return ins.frontend_insights(_mined(spark, sf))


TOP = (
    "c as (select project_id, list, name, count(*) as n from l group by 1, 2, 3), k as (select *, row_number() over (partition by project_id, list order by n desc, name) as rank from c) "
    "select project_id, list, rank, name, n from k where rank <= 6"
)


@plan(
    "frontend_top",
    f"{FRONT_ALL}, {FE_UNION}, l as (select project_id, 'types' as list, type as name from ui union all select project_id, 'files', path from u), {TOP}",
)
def frontend_top(spark, sf):
    return ins.frontend_top(_mined(spark, sf, "ui_actions"))


@plan(
    "frontend_sample_routes",
    f"with {KEPT}, {FRONT}, {ms.routes('fe')}, k as (select *, row_number() over (partition by project_id order by path, line_no, rule, route_path) as rank from routes) "
    "select project_id, rank, route_path from k where rank <= 8",
)
def frontend_sample_routes(spark, sf):
    return ins.sample_routes(_mined(spark, sf))


def _top3(src: str, name: str) -> str:
    return (
        f"(select string_agg(concat(name, ':', cast(n as string)), ',' order by n desc, name) from (select {name} as name, count(*) as n from {src} x "
        "where x.project_id = s.project_id and x.path = s.path group by 1 order by 2 desc, 1 limit 3))"
    )


def _first5(src: str, col: str, order: str) -> str:
    return (
        f"(select string_agg({col}, ',' order by k) from (select {col}, row_number() over (order by {order}) as k from {src} x "
        "where x.project_id = s.project_id and x.path = s.path) where k <= 5)"
    )


@plan(
    "frontend_file_insights",
    f"{FRONT_ALL}, {FE_UNION}, s as (select project_id, path, {FE_SUMS}, count(*) filter (type = 'state') as st from u group by 1, 2) "
    f"select project_id, path, route_count, page_function_count, api_call_count, coalesce({_top3('ui', 'type')}, '') as top_types, "
    f"coalesce({_first5('routes', 'route_path', 'line_no, rule, route_path')}, '') as sample_routes, "
    f"{_highlight(('route_count >= 3', 'many_routes'), ('st >= 4', 'much_state'), ('api_call_count >= 4', 'many_api_calls'))} from s",
)
def frontend_file_insights(spark, sf):
    return ins.frontend_file_insights(_mined(spark, sf, "routes"))


BE_UNION = (
    "u as (select project_id, path, 'e' as src, auth_required as auth, '' as type from apis union all select project_id, path, 'm', false, '' from models "
    "union all select project_id, path, 'f', false, type from features)"
)
BE_SUMS = (
    "count(*) filter (src = 'e') as api_count, count(*) filter (src = 'm') as model_count, count(*) filter (src = 'f') as system_feature_count, count(*) filter (auth) as auth_api_count"
)


@plan(
    "backend_insights",
    f"{BACK_ALL}, {BE_UNION}, s as (select project_id, {BE_SUMS}, count(*) filter (type = 'middleware') as mw, count(distinct path) as active_file_count from u group by 1) "
    "select project_id, api_count, model_count, system_feature_count, auth_api_count, active_file_count, "
    f"{_highlight(('api_count > 50', 'many_apis'), ('model_count > 20', 'many_models'), ('auth_api_count > 0 and auth_api_count < api_count * 0.3', 'low_auth'), ('mw > 8', 'much_middleware'))} from s",
)
def backend_insights(spark, sf):
    return ins.backend_insights(_mined(spark, sf))


@plan(
    "backend_top",
    f"{BACK_ALL}, {BE_UNION}, l as (select project_id, 'methods' as list, upper(method) as name from apis union all select project_id, 'groups', "
    "case when trim(api_path, '/') = '' then 'root' else split_part(trim(api_path, '/'), '/', 1) end from apis union all select project_id, 'features', type from features "
    f"union all select project_id, 'files', path from u), {TOP}",
)
def backend_top(spark, sf):
    return ins.backend_top(_mined(spark, sf, endpoints="project_id path method api_path", features="project_id path type"))


@plan(
    "backend_file_insights",
    f"{BACK_ALL}, {BE_UNION}, s as (select project_id, path, {BE_SUMS} from u group by 1, 2) select project_id, path, api_count, model_count, system_feature_count, auth_api_count, "
    f"coalesce({_top3('apis', 'method')}, '') as top_methods, coalesce({_top3('features', 'type')}, '') as top_features, "
    f"coalesce({_first5('apis', 'api_path', 'line_no, method, api_path')}, '') as sample_paths, "
    f"{_highlight(('api_count >= 6', 'many_apis'), ('model_count >= 3', 'many_models'), ('system_feature_count >= 5', 'many_features'), ('auth_api_count > 0 and auth_api_count < api_count * 0.3', 'low_auth'))} from s",
)
def backend_file_insights(spark, sf):
    return ins.backend_file_insights(_mined(spark, sf, "endpoints"))
