"""Queries of the call graph and the module dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceweave.operators import graphs as gr
from sourceweave.operators import symbols as sy
from sourceweave.plans import symbolsql as ss
from sourceweave.plans.inventory import LANG, MANIFEST_KIND, keep_sql
from sourceweave.plans.minesql import strip
from sourceweave.plans.registry import plan
from sourceweave.plans.sqltext import CORPUS, in_list, q
from sourceweave.session import cut_lineage
from sourceweave.sources.corpus import corpus
from sourceweave.sources.files import skip_filter

# --- call graph ------------------------------------------------------------------------

CALL_SQL = (
    f"{CORPUS}, kept as materialized (select * from corpus where {keep_sql('structure')}), {ss.functions('kept')}, {ss.calls('kept', False)}, "
    "nf as (select *, case when class_name <> '' then concat(class_name, '.', name) else name end as full_name from functions), "
    "nr as (select *, row_number() over (partition by project_id, path, full_name order by start_line desc) as k from nf), "
    "nodes as materialized (select project_id, concat(path, ':', full_name) as id, name, full_name, path, start_line as line, case when class_name <> '' then 'method' else 'function' end as type, class_name from nr where k = 1), "
    "loc as (select * from (select project_id, path, name, id, row_number() over (partition by project_id, path, name order by line, id) as k from nodes) where k = 1), "
    "kn as (select * from (select project_id, full_name, id, row_number() over (partition by project_id, full_name order by path desc, line desc) as k from nodes) where k = 1), "
    "edges as materialized (select c.project_id, coalesce(l.id, kc.id) as src, ke.id as dst, c.path, c.line_no as line from calls c "
    "join kn ke on ke.project_id = c.project_id and ke.full_name = c.callee left join loc l on l.project_id = c.project_id and l.path = c.path and l.name = c.caller "
    "left join kn kc on kc.project_id = c.project_id and kc.full_name = c.caller where c.caller <> '' and coalesce(l.id, kc.id) is not null)"
)


def _kept(spark, sf):
    return skip_filter(corpus(spark, sf), "structure")


def _nodes(spark, sf):
    return gr.call_nodes(sy.extract_functions(_kept(spark, sf)))


def _graph(spark, sf):
    files = _kept(spark, sf)
    # nodes and calls are used several times, so both are written once
    nodes = cut_lineage(gr.call_nodes(sy.extract_functions(files)))
    return nodes, gr.call_edges(nodes, cut_lineage(sy.extract_calls(files, arguments=False)))


@plan("call_nodes", f"with {CALL_SQL} select * from nodes")
def call_nodes(spark, sf):
    return _nodes(spark, sf)


@plan("call_edges", f"with {CALL_SQL} select * from edges")
def call_edges(spark, sf):
    return _graph(spark, sf)[1]


@plan("entry_points", f"with {CALL_SQL} select project_id, id from nodes n where not exists (select 1 from edges e where e.project_id = n.project_id and e.dst = n.id)")
def entry_points(spark, sf):
    return gr.entry_points(*_graph(spark, sf))


@plan("leaf_functions", f"with {CALL_SQL} select project_id, id from nodes n where not exists (select 1 from edges e where e.project_id = n.project_id and e.src = n.id)")
def leaf_functions(spark, sf):
    return gr.leaf_functions(*_graph(spark, sf))


@plan("callees", f"with {CALL_SQL} select distinct e.project_id, src as id, dst as other from edges e join nodes n on n.project_id = e.project_id and n.id = e.src where n.type = 'method' or n.name like 'main%'")
def callees(spark, sf):
    nodes, edges = _graph(spark, sf)
    return gr.neighbours(edges, nodes.where("type = 'method' or name like 'main%'"))


@plan("callers", f"with {CALL_SQL} select distinct e.project_id, dst as id, src as other from edges e join nodes n on n.project_id = e.project_id and n.id = e.dst where n.name like 'helper%'")
def callers(spark, sf):
    nodes, edges = _graph(spark, sf)
    return gr.neighbours(edges, nodes.where("name like 'helper%'"), "callers")


@plan(
    "call_chain",
    f"with recursive {CALL_SQL}, u as (select distinct project_id, src, dst from edges), seeds as (select project_id, id from nodes where name like 'main%' or name like 'load%'), "
    "d as (select project_id, 'callees' as direction, src as at_id, dst as next_id from u union all select project_id, 'callers', dst, src from u), "
    "r as (select s.project_id, s.id as seed, d.direction, d.next_id as id, 0 as hop from seeds s join d on d.project_id = s.project_id and d.at_id = s.id "
    "union select r.project_id, r.seed, r.direction, d.next_id, r.hop + 1 from r join d on d.project_id = r.project_id and d.direction = r.direction and d.at_id = r.id where r.hop < 60) "
    "select project_id, seed, direction, id, min(hop) as hop from r group by 1, 2, 3, 4",
)
def call_chain(spark, sf):
    """To the fixed point; the recursion of the checking SQL, which has none, runs far beyond it."""
    nodes, edges = _graph(spark, sf)
    return gr.call_chain(edges, nodes.where("name like 'main%' or name like 'load%'"))


@plan(
    "call_graph_stats",
    f"with {CALL_SQL} select n.project_id, count(*) as total_nodes, (select count(*) from edges e where e.project_id = n.project_id) as total_edges, "
    "count(*) filter (not exists (select 1 from edges e where e.project_id = n.project_id and e.dst = n.id)) as entry_points, "
    "count(*) filter (not exists (select 1 from edges e where e.project_id = n.project_id and e.src = n.id)) as leaf_functions from nodes n group by 1",
)
def call_graph_stats(spark, sf):
    return gr.call_graph_stats(*_graph(spark, sf))


@plan("graph_export_nodes", f"with {CALL_SQL} select project_id, id, full_name as label, path, line, type, class_name from nodes")
def graph_export_nodes(spark, sf):
    return gr.graph_export_nodes(_nodes(spark, sf))


@plan(
    "graph_export_edges",
    f"with {CALL_SQL} select project_id, concat('e', md5(concat(src, chr(1), dst, chr(1), path, chr(1), cast(line as string))), '-', cast(row_number() over (partition by project_id, src, dst, path, line) as string)) as edge_id, src, dst, path, line from edges",
)
def graph_export_edges(spark, sf):
    return gr.graph_export_edges(_graph(spark, sf)[1])


# --- dependency graph ----------------------------------------------------------------------

MODULE = (
    "replace(case when regexp_extract(path, '([^/]*)$', 1) in ('__init__.py', '__init__.ts', '__init__.js') then regexp_replace(path, '/?[^/]*$', '') else regexp_replace(path, '\\.[^./]*$', '') end, '/', '.')"
)


def _norm(x: str) -> str:
    bare = f"ltrim(ltrim({x}, '.'), '/')"
    return f"(case when regexp_matches({bare}, '^@[^/]*/[^/]') or regexp_matches({bare}, '^@[^/]*/') then regexp_extract({bare}, '^(@[^/]*/[^/]*)', 1) else split_part({bare}, '/', 1) end)"


SRC = f"src_files as materialized (select project_id, path, content from corpus where {keep_sql('structure')}), mods as materialized (select project_id, {MODULE} as module, path from src_files)"
INTERNAL = "exists (select 1 from mods m where m.project_id = {0}.project_id and (m.module = {0}.{1} or starts_with(m.module, {0}.{1}) or starts_with({0}.{1}, m.module)))"
INTERNAL_DOT = "exists (select 1 from mods m where m.project_id = {0}.project_id and (m.module = {0}.{1} or starts_with(m.module, {0}.{1} || '.') or starts_with({0}.{1}, m.module || '.')))"
EDGE_SQL = (
    f"{CORPUS}, {SRC}, {ss.imports('src_files')}, de as (select project_id, {MODULE} as src, {_norm('module')} as dst, names, path, ordinal from imports), "
    f"dt as materialized (select project_id, dst, not {INTERNAL.format('x', 'dst')} as is_external from (select distinct project_id, dst from de) x), "
    "edges as materialized (select de.*, is_external from de join dt on dt.project_id = de.project_id and dt.dst = de.dst)"
)


def _source_files(spark, sf):
    return _kept(spark, sf)


def _deps(spark, sf, boundary: bool = False):
    files = _source_files(spark, sf)
    return files, gr.dependency_edges(files, cut_lineage(sy.extract_imports(files)), boundary)


@plan("module_names", f"with {CORPUS} select project_id, path, {MODULE} as module from corpus")
def module_names(spark, sf):
    return corpus(spark, sf).select("project_id", "path", gr.module_name(F.col("path")).alias("module"))


@plan("normalize_imports", f"with {CORPUS}, {ss.imports('corpus')} select project_id, path, ordinal, module, {_norm('module')} as target from imports")
def normalize_imports(spark, sf):
    rows = sy.extract_imports(corpus(spark, sf))
    return rows.select("project_id", "path", "ordinal", "module", gr.normalize_import(F.col("module")).alias("target"))


@plan("dependency_edges", f"with {EDGE_SQL} select * from edges")
def dependency_edges(spark, sf):
    return _deps(spark, sf)[1]


@plan("classify_imports_boundary", f"with {EDGE_SQL} select project_id, dst as target, {INTERNAL_DOT.format('x', 'dst')} as is_internal from (select distinct project_id, dst from de) x")
def classify_imports_boundary(spark, sf):
    files, edges = _deps(spark, sf)
    return gr.classify_imports(edges.select("project_id", F.col("dst").alias("target")), gr.module_table(files), boundary=True)


SECTION_SQL = " union all ".join(
    f"select project_id, path, kind, {i} * 1000 as base, unnest(json_keys(content::json, '$.{s}')) as name, unnest(list_transform(json_keys(content::json, '$.{s}'), lambda k: json_extract_string(content::json, '$.{s}.\"' || k || '\"'))) as version, "
    f"generate_subscripts(json_keys(content::json, '$.{s}'), 1) as k from mfile where kind = 'package.json'"
    for i, s in enumerate(gr.PACKAGE_SECTIONS)
)
LINE_SQL = "(select project_id, path, kind, " + strip("unnest(string_split(content, chr(10)))") + " as x, generate_subscripts(string_split(content, chr(10)), 1) as k from mfile)"
REQ = r"^([A-Za-z0-9_.\-]+)(.*)$"
QUOTED = r'"([A-Za-z0-9_.\-]+)(?:\[[^\]]+\])?(\s*[<>=!~].*?)?"'
DECLARED = (
    f"mkept as (select * from corpus where {keep_sql('manifest')}), mfile as materialized (select project_id, path, content, {MANIFEST_KIND} as kind from mkept where ({MANIFEST_KIND}) is not null), "
    f"pk as (select project_id, path, kind, base + k as o, name, version from ({SECTION_SQL})), "
    f"rq as (select project_id, path, kind, k as o, regexp_extract(x, {q(REQ)}, 1) as name, regexp_extract(x, {q(REQ)}, 2) as version from {LINE_SQL} where kind = 'requirements.txt' and regexp_matches(x, {q(REQ)}) and x not like '-r%' and x not like '--requirement%'), "
    f"pp as (select * from (select project_id, path, kind, generate_subscripts(regexp_extract_all(content, {q(QUOTED)}, 1), 1) as o, unnest(regexp_extract_all(content, {q(QUOTED)}, 1)) as name, unnest(regexp_extract_all(content, {q(QUOTED)}, 2)) as version from mfile where kind = 'pyproject.toml') "
    f"where lower(name) not in ({in_list(gr.PYPROJECT_IGNORED)})), "
    rf"go as (select project_id, path, kind, k as o, regexp_extract(x, '^require\s+([^\s(]+)(?:\s+(\S+))?', 1) as name, regexp_extract(x, '^require\s+([^\s(]+)(?:\s+(\S+))?', 2) as version from {LINE_SQL} where kind = 'go.mod' and regexp_matches(x, '^require\s+([^\s(]+)(?:\s+(\S+))?') "
    rf"union all select project_id, path, kind, 100000 + k, regexp_extract(x, '^\s*([^\s/][^\s]*)\s+(v\S+)', 1), regexp_extract(x, '^\s*([^\s/][^\s]*)\s+(v\S+)', 2) from (select project_id, path, kind, unnest(string_split(regexp_extract(content, '(?s)require\s*\((.*?)\)', 1), chr(10))) as x, "
    r"generate_subscripts(string_split(regexp_extract(content, '(?s)require\s*\((.*?)\)', 1), chr(10)), 1) as k from mfile where kind = 'go.mod') where regexp_matches(x, '^\s*([^\s/][^\s]*)\s+(v\S+)')), "
    r"px as (select project_id, path, kind, unnest(regexp_extract_all(content, '(?s)<dependency>(.*?)</dependency>', 1)) as d, generate_subscripts(regexp_extract_all(content, '(?s)<dependency>(.*?)</dependency>', 1), 1) as o from mfile where kind = 'pom.xml'), "
    r"po as (select project_id, path, kind, o, concat_ws(':', nullif(regexp_extract(d, '(?s)<groupId>\s*(.*?)\s*</groupId>', 1), ''), regexp_extract(d, '(?s)<artifactId>\s*(.*?)\s*</artifactId>', 1)) as name, regexp_extract(d, '(?s)<version>\s*(.*?)\s*</version>', 1) as version from px "
    r"where regexp_extract(d, '(?s)<artifactId>\s*(.*?)\s*</artifactId>', 1) <> ''), "
    f"da as (select * from pk union all select * from rq union all select * from pp union all select * from go union all select * from po), "
    f"declared as materialized (select project_id, path, kind, row_number() over (partition by project_id, path order by o) as ordinal, {strip('name')} as name, coalesce({strip('version')}, '') as version from da where {strip('name')} <> '')"
)
MERGED = (
    f"mn as (select project_id, {_norm('name')} as name, version, path, ordinal from declared where {_norm('name')} <> ''), "
    "merged as materialized (select project_id, name, coalesce(arg_min(version, row(path, ordinal)) filter (version <> ''), '') as version from mn group by 1, 2)"
)
EXTERNAL = (
    f"{EDGE_SQL}, {DECLARED}, {MERGED}, mo as (select * from merged x where not {INTERNAL.format('x', 'name')}), "
    "xi as (select distinct project_id, dst as name from edges where is_external), "
    "externals as materialized (select coalesce(xi.project_id, mo.project_id) as project_id, coalesce(xi.name, mo.name) as name, coalesce(version, '') as version, xi.name is not null as imported from xi full join mo on mo.project_id = xi.project_id and mo.name = xi.name)"
)


@plan("manifest_dependencies", f"with {CORPUS}, {DECLARED} select * from declared")
def manifest_dependencies(spark, sf):
    return gr.manifest_dependencies(corpus(spark, sf))


@plan("merge_versions", f"with {CORPUS}, {DECLARED}, {MERGED} select * from merged")
def merge_versions(spark, sf):
    return gr.merge_versions(gr.manifest_dependencies(corpus(spark, sf)))


def _externals(spark, sf):
    files, edges = _deps(spark, sf)
    edges = cut_lineage(edges)
    return files, edges, gr.external_modules(edges, gr.manifest_dependencies(corpus(spark, sf)), files)


@plan("external_modules", f"with {EXTERNAL} select * from externals")
def external_modules(spark, sf):
    return _externals(spark, sf)[2]


@plan(
    "dependency_stats",
    f"with {EXTERNAL} select p.project_id, (select count(distinct module) from mods m where m.project_id = p.project_id) as internal_modules, (select count(*) from externals x where x.project_id = p.project_id) as external_modules, "
    "(select count(*) from edges e where e.project_id = p.project_id and not is_external) as internal_edges, (select count(*) from edges e where e.project_id = p.project_id and is_external) as external_edges from (select distinct project_id from corpus) p",
)
def dependency_stats(spark, sf):
    files, edges, externals = _externals(spark, sf)
    return gr.dependency_stats(files, edges, externals)


def _degree(end: str) -> str:
    return (
        f"with {EDGE_SQL}, c as (select project_id, {end} as module, count(*) as n from edges where not is_external group by 1, 2), "
        "r as (select *, row_number() over (partition by project_id order by n desc, module) as rank from c) select project_id, rank, module, n from r where rank <= 10"
    )


@plan("most_depended_on", _degree("dst"))
def most_depended_on(spark, sf):
    return gr.degree_ranking(_deps(spark, sf)[1], "dst")


@plan("most_dependent", _degree("src"))
def most_dependent(spark, sf):
    return gr.degree_ranking(_deps(spark, sf)[1], "src")


@plan("dependency_tree", f"with {EDGE_SQL} select distinct project_id, src as module, dst as import, is_external from edges")
def dependency_tree(spark, sf):
    return gr.dependency_tree(_deps(spark, sf)[1])


@plan(
    "dependency_counts",
    f"with {EDGE_SQL} select project_id, src as module, count(distinct dst) as imports_count, count(distinct dst) filter (not is_external) as internal_imports, count(distinct dst) filter (is_external) as external_imports from edges group by 1, 2",
)
def dependency_counts(spark, sf):
    return gr.dependency_counts(_deps(spark, sf)[1])


@plan(
    "external_importers",
    f"with {EXTERNAL} select x.project_id, x.name, x.version, (select count(distinct src) from edges e where e.is_external and e.project_id = x.project_id and e.dst = x.name) as imported_by_count from externals x",
)
def external_importers(spark, sf):
    _, edges, externals = _externals(spark, sf)
    return gr.importers(edges, externals)


PAIRS = (
    "pairs as materialized (select distinct e.project_id, e.src, e.dst from edges e where not is_external and src <> dst and exists (select 1 from mods m where m.project_id = e.project_id and m.module = e.dst))"
)
REACH = (
    "reach as (select project_id, src as a, dst as b from pairs union select r.project_id, r.a, p.dst from reach r join pairs p on p.project_id = r.project_id and p.src = r.b)"
)
SCC = "scc as materialized (select x.project_id, x.a as module, min(x.b) as component from reach x join reach y on y.project_id = x.project_id and y.a = x.b and y.b = x.a group by 1, 2)"


def _pairs(spark, sf):
    files, edges = _deps(spark, sf)
    return gr.internal_pairs(files, edges)


@plan(
    "circular_dependencies",
    f"with recursive {EDGE_SQL}, {PAIRS}, p as (select project_id, src as s, [src, dst] as path, dst as at_id, 2 as n, false as closed from pairs where src < dst union all "
    "select p.project_id, p.s, list_append(p.path, e.dst), e.dst, p.n + 1, e.dst = p.s from p join pairs e on e.project_id = p.project_id and e.src = p.at_id where not p.closed and p.n <= 4 and (e.dst = p.s or (e.dst > p.s and not list_contains(p.path, e.dst) and p.n < 4))) "
    "select project_id, array_to_string(path, ' -> ') as cycle, n - 1 as length from p where closed",
)
def circular_dependencies(spark, sf):
    return gr.circular_dependencies(_pairs(spark, sf), 4)


@plan("strong_components", f"with recursive {EDGE_SQL}, {PAIRS}, {REACH}, {SCC} select * from scc")
def strong_components(spark, sf):
    return gr.strong_components(_pairs(spark, sf))


@plan(
    "witness_cycles",
    f"with recursive {EDGE_SQL}, {PAIRS}, {REACH}, {SCC}, inside as materialized (select p.project_id, a.component, p.src, p.dst from pairs p join scc a on a.project_id = p.project_id and a.module = p.src "
    "join scc b on b.project_id = p.project_id and b.module = p.dst where a.component = b.component), sizes as (select project_id, component, count(*) as n from scc group by 1, 2), "
    "walk as (select project_id, component, dst as at_id, 1 as hop from inside where src = component union select w.project_id, w.component, i.dst, w.hop + 1 from walk w "
    "join inside i on i.project_id = w.project_id and i.component = w.component and i.src = w.at_id join sizes z on z.project_id = w.project_id and z.component = w.component where w.at_id <> w.component and w.hop < z.n) "
    "select project_id, component, min(hop) as length from walk where at_id = component group by 1, 2",
)
def witness_cycles(spark, sf):
    return gr.witness_cycles(_pairs(spark, sf)).select("project_id", "component", "length")


@plan(
    "dependency_depth",
    f"with recursive {EDGE_SQL}, {PAIRS}, {REACH}, {SCC}, dag as materialized (select distinct p.project_id, coalesce(a.component, p.src) as s, coalesce(b.component, p.dst) as d from pairs p left join scc a on a.project_id = p.project_id and a.module = p.src "
    "left join scc b on b.project_id = p.project_id and b.module = p.dst where coalesce(a.component, p.src) <> coalesce(b.component, p.dst)), "
    "walk as (select project_id, s, d, 1 as n from dag union select w.project_id, w.s, g.d, w.n + 1 from walk w join dag g on g.project_id = w.project_id and g.s = w.d), "
    "top as (select project_id, s, max(n) as n from walk group by 1, 2), mm as (select distinct project_id, module from mods) "
    "select m.project_id, m.module, coalesce(t.n, 0) as depth, c.component is not null as in_cycle from mm m left join scc c on c.project_id = m.project_id and c.module = m.module left join top t on t.project_id = m.project_id and t.s = coalesce(c.component, m.module)",
)
def dependency_depth(spark, sf):
    files, edges = _deps(spark, sf)
    return gr.dependency_depth(gr.internal_pairs(files, edges), gr.module_table(files))


# --- one row per project ---------------------------------------------------------------------

@plan(
    "structure_summary",
    f"with {CORPUS}, src_files as materialized (select project_id, path, content from corpus where {keep_sql('structure')}), {ss.spans('src_files')}, {ss.calls('src_files', False)}, {ss.imports('src_files', False)}, {ss.variables()}, errors as (select project_id, {ss.ERROR} as error from sm) "
    "select p.project_id, count(*) as total_files, (select count(*) from spans s where s.project_id = p.project_id and s.kind <> 'class' and (s.language <> 'python' or s.pk in ('', 'class'))) as total_functions, "
    "(select count(*) from spans s where s.project_id = p.project_id and s.kind = 'class') as total_classes, (select count(*) from imports i where i.project_id = p.project_id) as total_imports, "
    "(select count(*) from calls c where c.project_id = p.project_id) as total_calls, (select count(*) from variables v where v.project_id = p.project_id) as total_variables, "
    "(select count(error) from errors e where e.project_id = p.project_id) as total_errors from src_files p group by 1",
)
def structure_summary(spark, sf):
    return sy.structure_summary(corpus(spark, sf))


@plan(
    "by_language_directory",
    f"with {CORPUS}, s as (select project_id, {LANG} as language, case when path like '%/%' then regexp_replace(path, '/?[^/]*$', '') else '<root>' end as dir from corpus where {keep_sql('structure')}) "
    "select project_id, case when grouping(language) = 0 then 'language' when grouping(dir) = 0 then 'directory' else 'project' end as level, coalesce(language, dir, '') as key, count(*) as files from s group by grouping sets ((project_id, language), (project_id, dir), (project_id))",
)
def by_language_directory(spark, sf):
    return sy.by_language_directory(corpus(spark, sf))


@plan(
    "project_graph_summary",
    f"with {CORPUS}, src_files as materialized (select project_id, path, content from corpus where {keep_sql('structure')}), {ss.spans('src_files')}, mods as materialized (select project_id, {MODULE} as module, path from src_files), "
    f"{ss.imports('src_files', False)}, de as (select project_id, {MODULE} as src, {_norm('module')} as dst from imports), dt as materialized (select project_id, dst, not {INTERNAL.format('x', 'dst')} as is_external from (select distinct project_id, dst from de) x) "
    "select p.project_id, count(*) as files, (select count(*) from spans s where s.project_id = p.project_id and s.kind <> 'class' and (s.language <> 'python' or s.pk in ('', 'class'))) as functions, (select count(*) from spans s where s.project_id = p.project_id and s.kind = 'class') as classes, "
    "(select count(distinct module) from mods m where m.project_id = p.project_id) as modules, (select count(*) from de join dt on de.project_id = dt.project_id and de.dst = dt.dst where de.project_id = p.project_id and not is_external) as internal_edges, "
    "(select count(*) from de join dt on de.project_id = dt.project_id and de.dst = dt.dst where de.project_id = p.project_id and is_external) as external_edges from src_files p group by 1",
)
def project_graph_summary(spark, sf):
    return gr.project_graph_summary(corpus(spark, sf))
