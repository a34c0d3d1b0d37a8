"""Checking SQL of the rule scans (DuckDB dialect), written with windows and list functions."""

from __future__ import annotations

from sourceweave.functions import rules as R
from sourceweave.plans.sqltext import q


def matches(src: str, rules, ordinal: int = 0) -> str:
    """Union of all matches of ``rules`` over the lines table ``src``."""
    out = []
    for i, r in enumerate(rules, ordinal):
        second = f"unnest(regexp_extract_all(line, {q(r.pattern)}, {r.groups[1]}))" if len(r.groups) > 1 else "''"
        out.append(
            f"select project_id, path, line_no, line, {i} as rule, '{r.kind}' as kind, "
            f"unnest(regexp_extract_all(line, {q(r.pattern)}, {r.groups[0]})) as a, {second} as b from {src}"
        )
    return " union all ".join(out)


def lines(name: str, src: str) -> str:
    return (
        f"{name} as materialized (select project_id, path, unnest(string_split(content, chr(10))) as line, "
        f"generate_subscripts(string_split(content, chr(10)), 1) as line_no from {src})"
    )


def arrays(name: str, src: str) -> str:
    return f"{name} as materialized (select project_id, path, content, string_split(content, chr(10)) as ls from {src})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def name_of(x: str) -> str:
    bare = f"replace(replace(replace({x}, 'Page', ''), 'View', ''), 'Component', '')"
    spaced = rf"regexp_replace({bare}, '([A-Z])', ' \1', 'g')"
    return f"coalesce(nullif({strip(spaced)}, ''), {x})"


ROUTER = (
    "case when lower(content) like '%react-router%' or lower(content) like '%reactrouter%' then 'react' "
    "when content like '%createBrowserRouter%' or content like '%BrowserRouter%' then 'react' "
    "when lower(content) like '%vue-router%' or lower(content) like '%createrouter%' then 'vue' "
    "when content like '%next/router%' or content like '%useRouter%' or content like '%next/navigation%' then 'nextjs' else 'unknown' end"
)


def routes(src: str) -> str:
    """CTEs ending in ``routes``."""
    next_sql = ""
    for rule, test, pat, p, c in (
        ("nextjs-pages", "(^|/)pages/", R.NEXT_PAGE, "case when n = 'index' then '/' else concat('/', n) end", "n"),
        ("nextjs-app", "(^|/)app/", R.NEXT_APP, "concat('/', n)", "concat(n, 'Page')"),
    ):
        next_sql += (
            f" union all select project_id, path, 'nextjs', 0, '{rule}', {p}, {c}, n from (select *, "
            f"regexp_extract(path, {q(pat)}, 1) as n from rf where framework = 'nextjs' and regexp_matches(path, '{test}')) where n <> ''"
        )
    return (
        f"rf as (select project_id, path, content, {ROUTER} as framework from {src}), "
        "rr as (select * from rf where framework = 'react'), rv as (select * from rf where framework = 'vue'), "
        f"{lines('rrl', 'rr')}, {lines('rvl', 'rv')}, "
        f"rm as (select *, 'react' as framework from ({matches('rrl', R.ROUTE_RULES['react'])}) union all "
        f"select *, 'vue' from ({matches('rvl', R.ROUTE_RULES['vue'])})), "
        "routes as materialized (select project_id, path, framework, line_no, kind as rule, a as route_path, b as component, "
        f"{name_of('coalesce(nullif(b, chr(0)), a)').replace('nullif(b, chr(0))', 'nullif(b, ' + chr(39) * 2 + ')')} as name from rm{next_sql})"
    )


def action_name(x: str) -> str:
    known = " ".join(f"when contains(lower({x}), '{k}') then '{v}'" for k, v in R.UI_NAMES.items())
    return (
        f"case {known} when {x} like 'handle%' then replace(replace({x}, 'handle', ''), 'Handle', '') "
        f"when {x} like 'on%' then replace(replace({x}, 'on', ''), 'On', '') else {x} end"
    )


def ui(src: str) -> str:
    """CTEs ending in ``ui``."""
    d = R.UI_DESCRIPTIONS
    call = "concat(coalesce(nullif(upper(b), ''), 'GET'), ' ', a)"
    target = "(case when kind = 'state' then coalesce(nullif(a, ''), b) else a end)"
    desc = " ".join(f"when '{k}' then concat('{t}', {call if k == 'fetch' else target})" for k, t in d.items())
    return (
        f"{lines('uil', src)}, uim as ({matches('uil', R.UI_RULES)}), ui as materialized (select project_id, path, line_no, kind as type, rule, "
        f"case kind when 'navigation' then '{R.UI_NAVIGATION_NAME}' when 'fetch' then concat({action_name('a')}, '{R.UI_FETCH_NAME}') "
        f"when 'state' then concat({target}, '{R.UI_STATE_NAME}') else {action_name('a')} end as name, "
        f"case kind when 'navigation' then concat('navigate(', a, ')') when 'fetch' then {call} when 'state' then concat('useState(', {target}, ')') else a end as handler, "
        f"case kind {desc} end as description, case when kind in ('fetch', 'navigation') then a end as param from uim)"
    )


def api_path(x: str) -> str:
    clean = rf"regexp_replace(regexp_replace(trim({x}, '''" + '"' + rf"'), '\$\{{[^}}]+\}}', ':param', 'g'), '`([^`]+)`', '\1', 'g')"
    return f"(case when regexp_matches({clean}, '^(\\$\\{{|`|/|http)') then {clean} else concat('/', {clean}) end)"


def calls(src: str, dedupe: bool = True) -> str:
    """CTEs ending in ``calls``."""
    ctx = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, {q(p)}, 1), '')" for p in R.CONTEXT_PATTERNS) + ")"
    blocks = "list_concat(list_concat(regexp_extract_all(line, {0}, 1), regexp_extract_all(line, {1}, 1)), list_concat(regexp_extract_all(line, {2}, 1), regexp_extract_all(line, {3}, 1)))".format(
        *[q(p) for p in R.PARAM_BLOCKS]
    )
    base = "list_concat(list_concat(regexp_extract_all(content, {0}, 1), regexp_extract_all(content, {1}, 1)), regexp_extract_all(content, {2}, 1))".format(
        *[q(p) for p in R.BASE_URL_PATTERNS]
    )
    jq = "case " + " ".join(
        f"when line like '%$.{v.lower()}%' or (line like '%$.ajax%' and line like '%{v}%') then '{v}'" for v in ("POST", "PUT", "DELETE", "PATCH")
    ) + " else 'GET' end"
    keep = "where k = 1" if dedupe else ""
    return (
        f"{lines('cl', src)}, "
        f"cctx as (select project_id, path, line_no, coalesce(last_value({ctx} ignore nulls) over (partition by project_id, path order by line_no "
        "rows between unbounded preceding and current row), 'anonymous') as function_name, "
        f"first_value(nullif(regexp_extract(line, {q(R.BODY_LITERAL)}, 1), '') ignore nulls) over (partition by project_id, path order by line_no "
        "rows between current row and 9 following) as request_body from cl), "
        f"cm as (select *, {api_path('a')} as api_path from ({matches('cl', R.API_CALL_RULES)})), "
        "ck as (select *, row_number() over (partition by project_id, path, line_no, api_path order by rule) as k from cm), "
        f"cb as (select project_id, path, {base}[-1] as base_url from {src}), "
        f"calls as materialized (select m.project_id, m.path, m.line_no, m.rule, case kind when 'match' then upper(b) when 'jquery' then {jq} else kind end as method, "
        f"m.api_path, x.function_name, array_to_string(flatten(list_transform({blocks}, lambda t: regexp_extract_all(t, '(\\w+)\\s*:', 1))), ',') as params, "
        f"x.request_body, cb.base_url from (select * from ck {keep}) m join cctx x on m.project_id = x.project_id and m.path = x.path and m.line_no = x.line_no "
        "join cb on m.project_id = cb.project_id and m.path = cb.path)"
    )


BACKEND = (
    "case when lower(content) like '%fastapi%' or content like '%APIRouter%' then 'fastapi' "
    "when lower(content) like '%flask%' or content like '%@app.route%' then 'flask' "
    "when lower(content) like '%express%' or content like '%app.get%' or content like '%router.get%' then 'express' "
    "when content like '%@RestController%' or content like '%@Controller%' or content like '%@GetMapping%' then 'spring' else 'unknown' end"
)


def endpoints(src: str) -> str:
    """CTEs ending in ``endpoints``."""
    prefix = "coalesce(" + ", ".join(f"nullif(regexp_extract(content, {q(p)}, 1), '')" for p in R.ROUTER_PREFIXES) + ", '')"
    per_fw = " union all ".join(
        f"select m.*, '{fw}' as framework from ({matches('el', [rule])}) m join ef on m.project_id = ef.project_id and m.path = ef.path and ef.framework = '{fw}'"
        for fw, rule in R.ENDPOINT_RULES.items()
    )
    spring = "case b " + " ".join(f"when '{k}' then '{v}'" for k, v in R.SPRING_METHODS.items()) + " end"
    quoted = """regexp_extract_all(b, '["''](\\w+)["'']', 1)"""

    def first(n: int, expr: str) -> str:
        return f"list_filter(list_transform(ls[line_no + 1:line_no + {n}], lambda t: {expr}), lambda t: t is not null)[1]"

    py = first(10, "nullif(regexp_extract(t, 'def\\s+(\\w+)', 1), '')")
    js = first(
        5,
        "coalesce(nullif(regexp_extract(t, '(?:async\\s+)?function\\s+(\\w+)', 1), ''), case when regexp_matches(t, '(?:async\\s+)?\\([^)]*\\)\\s*=>') then 'arrow_function' end)",
    )
    jv = first(5, "nullif(regexp_extract(t, 'public\\s+\\w+\\s+(\\w+)\\s*\\(', 1), '')")
    up = "list_reverse(list_transform(ls[greatest(line_no - {0}, 0) + 2:line_no], lambda t: " + strip("t") + "))"
    jsdoc = f"list_filter({up.format(5)}, lambda t: regexp_matches(t, '^(//|\\*|/\\*)'))[1]"
    jvdoc = f"list_filter({up.format(10)}, lambda t: (t like '*%' and t not like '*/%') or t like '/**%')[1]"
    auth = " or ".join(f"contains(t, {q(w)})" for w in R.AUTH_INDICATORS)
    typed = "nullif(regexp_extract(t, '(\\w+):\\s*(?:str|int|float)', 1), '') || ':path:true'"
    dflt = (
        "nullif(regexp_extract(t, '(\\w+):\\s*(?:Optional\\[)?(\\w+)(?:\\])?\\s*=\\s*(.+)', 1), '') || ':query:' || "
        "case when contains(t, 'Optional') then 'false' else 'true' end"
    )
    params = f"array_to_string(flatten(list_transform(ls[line_no + 1:line_no + 15], lambda t: list_filter([{typed}, {dflt}], lambda u: u is not null))), ',')"
    body = first(15, "nullif(regexp_extract(t, '(?:data|body|request):\\s*(\\w+)', 1), '')")
    # docstring: nearest of the next ten lines that opens a triple quote
    return (
        f"ef as materialized (select project_id, path, content, {BACKEND} as framework, {prefix} as prefix, string_split(content, chr(10)) as ls from {src}), "
        f"{lines('el', src)}, em as ({per_fw}), "
        "ed as (select l.project_id, l.path, l.line_no, coalesce(nullif(trim(trim(s, '\"'), ''''), ''), nxt) as doc from (select *, "
        f"{strip('line')} as s, lead({strip('line')}) over (partition by project_id, path order by line_no) as nxt from el) l "
        "where s like '\"\"\"%' or s like '''''''%'), "
        "ex as (select m.*, ef.prefix, ef.ls, "
        f"case m.framework when 'flask' then case when len({quoted}) = 0 then ['GET'] else {quoted} end when 'spring' then [{spring}] else [b] end as verbs, "
        "(select arg_min(doc, ed.line_no) from ed where ed.project_id = m.project_id and ed.path = m.path and ed.line_no between m.line_no + 1 and m.line_no + 10 and doc is not null) as doc "
        "from em m join ef on m.project_id = ef.project_id and m.path = ef.path), "
        "ey as (select *, unnest(verbs) as verb from ex), "
        "endpoints as materialized (select project_id, path, framework, line_no, upper(verb) as method, "
        "case when framework = 'fastapi' and prefix <> '' and not starts_with(a, prefix) then concat(prefix, a) else a end as api_path, "
        f"coalesce(case when framework in ('fastapi', 'flask') then {py} when framework = 'express' then {js} else {jv} end, 'anonymous') as handler, "
        "coalesce(case when framework in ('fastapi', 'flask') then doc when framework = 'express' then "
        f"case when {jsdoc} like '//%' then {strip('substr(' + jsdoc + ', 3)')} when {jsdoc} like '*%' then {strip('substr(' + jsdoc + ', 2)')} "
        f"else {strip('trim(substr(' + jsdoc + ', 3), ' + q('*/') + ')')} end "
        f"else case when {jvdoc} like '*%' then {strip('substr(' + jvdoc + ', 2)')} else {strip('trim(substr(' + jvdoc + ', 4), ' + q('*/') + ')')} end end, '') as description, "
        f"framework in ('fastapi', 'flask') and len(list_filter(ls[line_no + 1:line_no + 15], lambda t: {auth})) > 0 as auth_required, "
        f"case when framework = 'fastapi' then {params} else '' end as params, "
        f"case when framework = 'fastapi' then {body} end as request_body, "
        "case when framework = 'fastapi' then nullif(regexp_extract(line, 'response_model\\s*=\\s*(\\w+)', 1), '') end as response_model, "
        "case when framework = 'fastapi' then array_to_string(regexp_extract_all(regexp_extract(line, 'tags\\s*=\\s*\\[([^\\]]+)\\]', 1), '[\"'']([^\"'']+)[\"'']', 1), ',') else '' end as tags from ey)"
    )


def deduped(src: str = "endpoints", out: str = "apis") -> str:
    return (
        f"{out} as materialized (select * exclude (k) from (select *, row_number() over (partition by project_id, method, api_path order by path, line_no) as k "
        f"from {src}) where k = 1)"
    )


ORM = (
    "case when lower(content) like '%sqlalchemy%' or contains(content, 'Column(') then 'sqlalchemy' when lower(content) like '%prisma%' or "
    r"regexp_matches(content, 'model\s+\w+\s*\{') then 'prisma' when contains(content, '@Entity') or lower(content) like '%typeorm%' then 'typeorm' "
    "when contains(content, 'models.Model') or contains(content, 'from django.db') then 'django' when lower(content) like '%mongoose%' or "
    "contains(content, 'new Schema(') then 'mongoose' else 'unknown' end"
)


def models(src: str, dialect: str | None = None) -> str:
    """CTEs ending in ``models`` (with a list of fields) and ``fields``."""
    kind = ORM if dialect is None else f"'{dialect}'"
    heads = " ".join(
        f"when '{d}' then nullif(regexp_extract(l.line, {q(p)}, 1), '')"
        for d, p in (
            ("sqlalchemy", R.SQLALCHEMY_CLASS),
            ("django", R.DJANGO_CLASS),
            ("mongoose", R.MONGOOSE_MODEL),
            ("prisma", r"model\s+(\w+)\s*\{"),
        )
    )
    schema_head, schema_tail = R.MONGOOSE_SCHEMA.split("{name}")

    def parallel(pattern: str, *groups: int) -> str:
        return ", ".join(f"unnest(regexp_extract_all(body, {q(pattern)}, {g})) as g{g}" for g in groups) + (
            f", generate_subscripts(regexp_extract_all(body, {q(pattern)}, 1), 1) as i"
        )

    key = "project_id, path, line_no, name as model"
    has = "contains(g2, '{0}')".format
    sqla = (
        f"select project_id, path, line_no, model, i, g1 as name, coalesce(nullif(regexp_extract(g2, {q(R.SQLALCHEMY_TYPE)}, 1), ''), 'unknown') as type, "
        f"case when {has('nullable=True')} then true when {has('nullable=False')} then false else not {has('primary_key=True')} end as nullable, "
        f"{has('primary_key=True')} as primary_key, nullif({strip('regexp_extract(g2, ' + q(R.SQLALCHEMY_DEFAULT) + ', 1)')}, '') as default_value, "
        f"nullif(regexp_extract(g2, {q(R.SQLALCHEMY_FK)}, 1), '') as foreign_key from (select {key}, {parallel(R.SQLALCHEMY_COLUMN, 1, 2)} from mh where dialect = 'sqlalchemy')"
    )
    dj = (
        "select project_id, path, line_no, model, i, g1, g2, contains(g3, 'null=True') or contains(g3, 'blank=True'), contains(g3, 'primary_key=True'), null, null "
        f"from (select {key}, {parallel(R.DJANGO_FIELD, 1, 2, 3)} from mh where dialect = 'django')"
    )
    pr = (
        f"select project_id, path, line_no, model, row_number() over (partition by project_id, path, line_no order by i), regexp_extract(x, {q(R.PRISMA_FIELD)}, 1), regexp_extract(x, {q(R.PRISMA_FIELD)}, 2), contains(x, '?'), contains(x, '@id'), null, null "
        f"from (select {key}, {strip('unnest(string_split(body, chr(10)))')} as x, generate_subscripts(string_split(body, chr(10)), 1) as i from mh where dialect = 'prisma') "
        f"where regexp_matches(x, {q(R.PRISMA_FIELD)}) and x not like '//%' and x not like '@@%'"
    )
    ty = (
        f"select project_id, path, line_no, model, i, g2, 'number', false, true, null, null from (select {key}, {parallel(R.TYPEORM_PRIMARY, 1, 2)} from mh where dialect = 'typeorm') union all "
        f"select project_id, path, line_no, model, 100000 + i, g2, coalesce(nullif(g3, ''), 'string'), contains(g1, 'nullable: true'), false, null, null from (select {key}, {parallel(R.TYPEORM_COLUMN, 1, 2, 3)} from mh where dialect = 'typeorm')"
    )
    mg = (
        "select project_id, path, line_no, model, i, g1, g2, true, g1 = '_id', null, null "
        f"from (select {key}, {parallel(R.MONGOOSE_FIELD, 1, 2)} from mh where dialect = 'mongoose')"
    )
    stop = r"length(t) - length(regexp_replace(t, '^\s+', ''))"
    code = f"case when {strip('t')} <> '' and {strip('t')} not like '#%' then {stop} end"
    return (
        f"mf as materialized (select project_id, path, content, {kind} as dialect, string_split(content, chr(10)) as ls from {src}), "
        f"{lines('ml', src)}, "
        f"mhead as (select l.*, dialect, content, ls, case dialect {heads} when 'typeorm' then case when contains(l.line, '@Entity(') then '?' end end as head "
        "from ml l join mf on l.project_id = mf.project_id and l.path = mf.path), "
        f"mbody as (select *, list_transform(ls[line_no + 1:], lambda t: {code}) as ind, array_to_string(ls[line_no:], chr(10)) as here from mhead where head is not null), "
        "mcut as (select *, list_filter(ind, lambda t: t is not null)[1] as level from mbody), "
        "mpos as (select *, list_position(list_transform(ind, lambda t: coalesce(t < level, false)), true) as p from mcut), "
        "mh as materialized (select project_id, path, line_no, dialect, line, case dialect when 'typeorm' then regexp_extract(here, "
        f"{q(R.TYPEORM_ENTITY)}, 2) else head end as name, case dialect when 'typeorm' then regexp_extract(here, {q(R.TYPEORM_ENTITY)}, 1) end as entity_table, "
        f"case when dialect = 'prisma' then regexp_extract(here, {q(R.PRISMA_MODEL)}, 2) when dialect = 'typeorm' then regexp_extract(here, {q(R.TYPEORM_BODY)}, 1) when dialect = 'mongoose' then "
        f"regexp_extract(content, {q(schema_head)} || head || {q(schema_tail)}, 1) "
        "else array_to_string(list_concat([line], case when p is null or p = 0 then ls[line_no + 1:] else ls[line_no + 1:line_no + p - 1] end), chr(10)) end as body from mpos), "
        f"fields as materialized ({sqla} union all {dj} union all {pr} union all {ty} union all {mg}), "
        f"models as materialized (select project_id, path, line_no, name, coalesce(case dialect when 'sqlalchemy' then nullif(regexp_extract(body, {q(R.SQLALCHEMY_TABLE)}, 1), '') "
        f"when 'typeorm' then nullif(entity_table, '') when 'mongoose' then regexp_extract(line, {q(R.MONGOOSE_MODEL)}, 2) end, lower(name)) as table_name, dialect as model_type, "
        "coalesce((select count(*) from fields f where f.project_id = mh.project_id and f.path = mh.path and f.line_no = mh.line_no and f.model = mh.name), 0) as n_fields from mh where name <> '')"
    )


FRAMEWORK = "case " + " ".join(
    "when " + " or ".join(f"regexp_matches(content, {q('(?i)' + p)})" for p in pats) + f" then '{fw}'"
    for fw, pats in R.FRAMEWORK_PATTERNS.items()
) + " else 'unknown' end"


def features(src: str) -> str:
    """CTEs ending in ``features``; positions are taken on the whole text."""
    hits = " union all ".join(
        f"select project_id, path, line_no, line, {i} as rule, '{kind}' as type, {q('(?i)' + p)} as p, regexp_extract(line, {q('(?i)' + p)}, 0) as text "
        f"from fl where regexp_matches(line, {q('(?i)' + p)})"
        for kind, pats in R.FEATURE_PATTERNS.items()
        for i, p in enumerate(pats)
    )
    names = " ".join(
        f"when '{kind}' then coalesce(" + ", ".join(f"nullif(regexp_extract(ahead, {q(p)}, 1), '')" for p in pats) + ", text)"
        for kind, pats in R.FEATURE_NAME_PATTERNS.items()
    )
    cfg = {k: f"nullif(regexp_extract(context, {q(p)}, 1), '')" for k, p in R.FEATURE_CONFIG.items()}
    return (
        f"{lines('fl', src)}, fo as (select project_id, path, line_no, sum(length(line) + 1) over (partition by project_id, path order by line_no "
        "rows between unbounded preceding and current row) - length(line) - 1 as off from fl), "
        f"fh as ({hits}), fk as (select *, row_number() over (partition by project_id, path, line_no, type order by rule) as k from fh), "
        f"fc as materialized (select project_id, path, content, {FRAMEWORK} as framework from {src}), "
        "fx as (select h.*, fc.framework, fc.content, cast(fo.off + strpos(h.line, h.text) as bigint) as hit from fk h "
        "join fo on h.project_id = fo.project_id and h.path = fo.path and h.line_no = fo.line_no "
        "join fc on h.project_id = fc.project_id and h.path = fc.path where k = 1), "
        "fy as (select *, substr(content, hit, 200) as ahead, substr(content, greatest(hit - 50, 1), hit - greatest(hit - 50, 1) + length(text) + 200) as context from fx), "
        f"features as materialized (select project_id, path, line_no, type, case type {names} else text end as name, framework, {cfg['host']} as host, "
        f"cast({cfg['port']} as int) as port, {cfg['url']} as url from fy)"
    )
