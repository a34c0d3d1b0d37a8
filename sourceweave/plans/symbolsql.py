"""Checking SQL of the symbol extraction: extents by joins and running sums instead of a fold."""

from __future__ import annotations

from sourceweave.functions import grammar as G
from sourceweave.functions import lexer as L
from sourceweave.plans.inventory import LANG
from sourceweave.plans.minesql import lines, strip
from sourceweave.plans.sqltext import in_list, q

KW = in_list(G.KEYWORDS)
PYTHON = "language = 'python'"


def _pick(value: str) -> str:
    """``kind`` or ``name`` of the first declaration pattern that matches a line."""
    out = []
    for lang, rules in G.DECLARATIONS.items():
        for kind, p in rules:
            ex = f"regexp_extract(whole, {q(p)}, 1)"
            got = f"'{kind}'" if value == "kind" else ex
            out.append(f"when language = '{lang}' and {ex} <> '' and {ex} not in ({KW}) then {got}")
    return "case " + " ".join(out) + " else '' end"


def _n(ch: str) -> str:
    return f"(length(line) - length(replace(line, '{ch}', '')))"


def _replaced(text: str, pattern, change: str) -> str:
    """Every match of the language's pattern changed; ``change`` is SQL over ``z[2]``."""
    cases = []
    for family, names in L.LANGUAGES.items():
        p = q(L.plain(pattern(family)))
        zipped = f"list_zip(string_split_regex({text}, {p}), regexp_extract_all({text}, {p}))"
        cases.append(f"when language in ({in_list(names)}) then array_to_string(list_transform({zipped}, lambda z: concat(z[1], {change})), '')")
    return "case " + " ".join(cases) + " end"


_MASK = (
    "case when z[2] is null then '' when regexp_matches(z[2], '^(?:#|//|/[*])') then regexp_replace(z[2], '[^\\n]', ' ', 'g') "
    "else concat(z[2][1], regexp_replace(z[2][2:], '[^\\n]', chr(1), 'g')) end"
)
_JOINED = "case when z[2] is null then '' else replace(z[2], chr(10), chr(2)) end"


def masked_files(src: str) -> str:
    """CTEs ``sf`` and ``sm``: files of known languages, and the same with strings and comments masked."""
    return (
        f"sf as materialized (select project_id, path, content, {LANG} as language from {src} where ({LANG}) is not null), "
        f"sm as materialized (select *, {_replaced('content', L.tokens, _MASK)} as masked from sf)"
    )


def items(code: str, text: str | None = None, angle: bool = False) -> str:
    """Trimmed items of a list, as the library's ``items_of``."""
    found = f"regexp_extract_all({code}, {q(L.plain(L.item(angle)))}, 1)"
    if text is None:
        return f"list_filter(list_transform({found}, lambda t: {strip('t')}), lambda t: t <> '')"
    at = f"coalesce(list_sum(list_transform({found}[1:i - 1], lambda u: length(u) + 1)), 0)::bigint"
    cut = f"substr({text}, 1 + {at}, length({found}[i]))"
    return f"list_filter(list_transform(range(1, len({found}) + 1), lambda i: {strip(cut)}), lambda t: t <> '')"


def spans(src: str) -> str:
    """CTEs ending in ``spans`` (first, last, kind, name, parent) over code lines ``ll``."""
    return (
        f"{masked_files(src)}, lj as (select project_id, path, language, {_replaced('masked', L.heads, _JOINED)} as joined from sm), "
        "lx as (select project_id, path, language, unnest(string_split(joined, chr(10))) as x, generate_subscripts(string_split(joined, chr(10)), 1) as li from lj), "
        "ly as (select project_id, path, language, li, x, unnest(string_split(x, chr(2))) as line, generate_subscripts(string_split(x, chr(2)), 1) as j from lx), "
        "sk as materialized (select project_id, path, language, row_number() over (partition by project_id, path order by li, j) as line_no, line, li, "
        "case when j = 1 then replace(x, chr(2), ' ') else '' end as whole, j > 1 as inside from ly), "
        f"sj as (select *, {_pick('kind')} as kind, {_pick('name')} as name, bool_or(regexp_matches(whole, {q(L.plain(G.DECORATOR))})) over (partition by project_id, path, li) as deco from sk), "
        "ll as materialized (select project_id, path, language, line_no as no, line, kind, name, deco, "
        r"length(line) - length(regexp_replace(line, '^\s+', '')) as level, inside or regexp_matches(line, '^\s*[)\]}\x01]') as cont, "
        f"{_n('{')} - {_n('}')} as delta, ({_n('{')} > 0 and {_n('{')} <= {_n('}')}) or ({_n('{')} = 0 and (kind = 'arrow' or regexp_matches(whole, ';\\s*$'))) as single, "
        "case when language in ('javascript', 'typescript') then kind = 'function' else kind in ('function', 'method') end as sets from sj "
        f"where {strip('line')} <> ''), "
        "dp as materialized (select *, sum(delta) over (partition by project_id, path order by no rows between unbounded preceding and current row) as after_d, "
        "max(no) over (partition by project_id, path) as eof, lag(no) over (partition by project_id, path order by no) as prev_no, "
        "row_number() over (partition by project_id, path order by no) as k from ll), "
        "pyterm as (select d.project_id, d.path, d.no, min(t.k) as tk from dp d join dp t on d.project_id = t.project_id and d.path = t.path and t.no > d.no "
        "and t.level <= d.level and not t.cont where d.language = 'python' and d.kind <> '' group by 1, 2, 3), "
        "opened as (select d.project_id, d.path, d.no, any_value(d.after_d - d.delta) as lvl, min(t.no) as o from dp d join dp t on d.project_id = t.project_id and d.path = t.path "
        "and t.no >= d.no and (t.after_d > d.after_d - d.delta or (t.no = d.no and d.single)) where d.language <> 'python' and d.kind <> '' group by 1, 2, 3), "
        "closed as (select o.project_id, o.path, o.no, min(t.no) as c from opened o join dp t on o.project_id = t.project_id and o.path = t.path and t.no >= o.o and t.after_d <= o.lvl group by 1, 2, 3), "
        "sp0 as materialized (select d.project_id, d.path, d.language, d.kind, d.name, d.sets, d.no as first, d.k, "
        "case when d.language = 'python' then coalesce(tp.prev_no, d.eof) else coalesce(c.c, d.eof) end as last from dp d "
        "left join pyterm p on p.project_id = d.project_id and p.path = d.path and p.no = d.no "
        "left join dp tp on tp.project_id = d.project_id and tp.path = d.path and tp.k = p.tk "
        "left join closed c on c.project_id = d.project_id and c.path = d.path and c.no = d.no where d.kind <> ''), "
        "par as (select a.project_id, a.path, a.first, arg_max(b.kind, b.first) as pk, arg_max(b.name, b.first) as pn from sp0 a join sp0 b on a.project_id = b.project_id "
        "and a.path = b.path and b.first < a.first and b.last >= a.first group by 1, 2, 3), "
        "spans as materialized (select a.*, coalesce(pk, '') as pk, coalesce(pn, '') as pn from sp0 a left join par on a.project_id = par.project_id and a.path = par.path and a.first = par.first)"
    )


#: Lines of a file, plain, masked and whether they continue the one before; decorator lines right above a block.
BODIES = (
    "fi as (select project_id, path, list(inside order by line_no) as ins, list(whole order by line_no) as wholes from sk group by 1, 2), "
    "fa as materialized (select sm.project_id, sm.path, string_split(content, chr(10)) as ls, string_split(masked, chr(10)) as ms, ins, wholes from sm join fi on fi.project_id = sm.project_id and fi.path = sm.path), "
    "dg as (select *, k - row_number() over (partition by project_id, path order by k) as g from dp where deco), "
    "dr as (select project_id, path, max(k) as k, count(*) as n from dg group by project_id, path, g), "
    "bodies as materialized (select s.*, array_to_string(ls[s.first:s.last], chr(10)) as body, array_to_string(ms[s.first:s.last], chr(10)) as code, wholes[s.first] as head, coalesce(dr.n, 0) as nd, ls, ms, ins "
    "from spans s join fa on fa.project_id = s.project_id and fa.path = s.path left join dr on dr.project_id = s.project_id and dr.path = s.path and dr.k = s.k - 1)"
)
_DECORATED = "array_to_string(list_transform(list_zip(ls[first - nd:first - 1], ins[first - nd:first - 1]), lambda z: concat(case when z[2] then chr(2) else chr(10) end, z[1])), '')"
DECORATORS = (
    f"array_to_string(list_transform(list_filter(string_split({_DECORATED}, chr(10)), lambda t: t <> ''), "
    f"lambda t: regexp_replace({strip('replace(t, chr(2), chr(10))')}, '^@', '')), '|')"
)


def docstring(head: str) -> str:
    rest = f"substr(body, length(regexp_extract(code, {q(head)})) + 1)"
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({rest}, {q('^[rRuU]?' + quote)}, 1), '')" for quote in G.DOCSTRINGS) + ", '')"


def functions(src: str, with_spans: bool = True) -> str:
    """CTEs ending in ``functions``."""
    first = f"{spans(src)}, " if with_spans else ""
    inner, after = (f"regexp_extract(code, {q(G.SIGNATURE)}, {g})" for g in (2, 3))
    arrow = r"nullif(regexp_extract(h, '=\s*(?:async\s*)?(\w+)\s*=>', 1), '')"
    params = f"coalesce({arrow}, substr(body, length(regexp_extract(code, {q(G.SIGNATURE)}, 1)) + 1, length({inner})))"
    returns = (
        rf"case language when 'python' then regexp_extract({after}, '^\s*->\s*([^:]+)', 1) when 'typescript' then regexp_extract({after}, '^\s*:\s*([^{{=;]+)', 1) "
        rf"when 'java' then regexp_extract(h, '([\w<>\[\],.?]+)\s+\w+\s*\(', 1) when 'go' then regexp_extract({after}, '^\s*([^{{]*)', 1) else '' end"
    )
    recv = r"nullif(regexp_extract(h, '^func\s+\(\s*\w+\s+\*?(\w+)(?:\[[^()]*\])?\s*\)', 1), '')"
    return (
        f"{first}{BODIES}, fb as (select *, string_split(code, chr(10))[1] as h from bodies where kind <> 'class' and (language <> 'python' or pk in ('', 'class'))), "
        f"functions as materialized (select project_id, path, language, name, case when language = 'go' then coalesce({recv}, '') when pk = 'class' then pn else '' end as class_name, "
        f"first as start_line, last as end_line, {params} as params, coalesce({arrow}, {inner}) as param_code, {strip(returns)} as return_type, "
        f"case when language = 'python' then {docstring(G.PY_HEAD)} else '' end as docstring, {DECORATORS} as decorators, "
        rf"regexp_matches(h, '\basync\b') as is_async, case when language = 'go' then {recv} is not null else pk = 'class' end as is_method, body from fb)"
    )


def calls(src: str, with_spans: bool = True) -> str:
    """CTEs ending in ``calls``."""
    first = f"{spans(src)}, " if with_spans else ""
    p = q(G.CALL)

    def ends(x: str) -> str:
        return f"(length({x}) - length(replace({x}, chr(10), '')))"

    return (
        f"{first}ct as (select project_id, path, language, string_split_regex(masked, {p}) as ps, regexp_extract_all(masked, {p}) as ms, regexp_extract_all(masked, {p}, 1) as cs from sm), "
        "cx as (select project_id, path, language, unnest(ps[1:len(ms)]) as b, unnest(ms) as m, unnest(cs) as callee, generate_subscripts(ms, 1) as k from ct), "
        f"cy as (select *, 1 + sum({ends('b')} + {ends('m')}) over (partition by project_id, path order by k) - {ends('m')} as line_no, lag(callee) over (partition by project_id, path order by k) as prev from cx), "
        f"cz as (select *, callee in ({KW}) or regexp_matches(b, {q(G.NOT_CALLED)}) or (coalesce(prev, '') = 'func' and regexp_matches(b, {q(G.RECEIVER)})) "
        "or (language = 'go' and exists (select 1 from spans x where x.kind = 'class' and x.project_id = cy.project_id and x.path = cy.path and x.first < cy.line_no and cy.line_no < x.last)) as known from cy), "
        "hd as (select distinct project_id, path, first, name from spans where kind in ('function', 'method')), "
        "cd as (select cz.*, not known and hd.name is not null as declared from cz left join hd on hd.project_id = cz.project_id and hd.path = cz.path and hd.first = cz.line_no and hd.name = cz.callee), "
        "ce0 as (select *, row_number() over (partition by project_id, path, line_no, declared order by k) as nth from cd), "
        "ce as materialized (select project_id, path, language, line_no::int as line_no, callee, row_number() over (partition by project_id, path order by k) - 1 as ordinal from ce0 where not known and not (declared and nth = 1)), "
        "own as (select e.project_id, e.path, e.line_no, arg_max(s.name, s.first) as caller from (select distinct project_id, path, line_no from ce) e join spans s on s.project_id = e.project_id "
        "and s.path = e.path and s.sets and e.line_no between s.first and s.last and (s.language = 'python' or s.first < s.last) group by 1, 2, 3), "
        "calls as materialized (select ce.*, coalesce(own.caller, '') as caller from ce left join own on own.project_id = ce.project_id and own.path = ce.path and own.line_no = ce.line_no)"
    )


def imports(src: str, with_files: bool = True) -> str:
    """CTEs ending in ``imports``."""
    head = f"{masked_files(src)}, " if with_files else ""

    def found(text: str, pattern: str, where: str, *groups: int) -> str:
        lists = ", ".join(f"unnest(regexp_extract_all({text}, {q(pattern)}, {g})) as g{g}" for g in groups)
        return f"select project_id, path, language, {lists}, generate_subscripts(regexp_extract_all({text}, {q(pattern)}), 1) as o from sm where {where}"

    names = (
        r"case when language = 'python' then regexp_extract_all(raw, '([\w.*]+(?:\s+as\s+\w+)?)', 1) else regexp_extract_all(raw, '(\*\s+as\s+\w+|[\w$]+(?:\s+as\s+\w+)?)', 1) end"
    )
    return (
        f"{head}i1 as ({found("masked", G.PY_IMPORT, PYTHON, 1, 2, 3, 4)}), "
        f"i2 as ({found('content', G.SCRIPT_IMPORT, 'language in (' + in_list(['javascript', 'typescript']) + ')', 1, 2)}), "
        f"i3 as ({found('masked', G.JAVA_IMPORT, 'language = ' + q('java'), 1)}), i4 as ({found('content', G.GO_IMPORT, 'language = ' + q('go'), 1, 2)}), "
        "i5 as (select *, case when g2 <> '' then [g2] else regexp_extract_all(g1, '\"([^\"]+)\"', 1) end as gs from i4), "
        "i6 as (select project_id, path, language, unnest(gs) as module, o, generate_subscripts(gs, 1) as j from i5), "
        "im as (select project_id, path, language, concat(g2, g3) as module, concat(g1, g4) as raw, coalesce(g3, '') <> '' as is_from_import, o, 1 as j from i1 "
        "union all select project_id, path, language, g2, coalesce(g1, ''), true, o, 1 from i2 union all select project_id, path, language, g1, '', false, o, 1 from i3 "
        "union all select project_id, path, language, module, '', false, o, j from i6), "
        f"imports as materialized (select project_id, path, language, row_number() over (partition by project_id, path order by o, j) as ordinal, {strip('module')} as module, "
        rf"array_to_string(list_transform({names}, lambda n: regexp_replace(n, '\s+', ' ', 'g')), ',') as names, is_from_import from im)"
    )


def variables() -> str:
    """CTE ``variables`` over ``sm`` and ``sk``."""

    def part(g: int) -> str:
        return f"case when language = 'python' then regexp_extract(code, {q(G.PY_VARIABLE)}, {g}) else regexp_extract(code, {q(G.SCRIPT_VARIABLE)}, {g}) end"

    return (
        f"{lines('vl', 'sf')}, vc as (select vl.project_id, vl.path, language, vl.line_no, vl.line as text, sk.line as code from vl join sk on sk.project_id = vl.project_id and sk.path = vl.path and sk.line_no = vl.line_no), "
        f"variables as materialized (select project_id, path, language, line_no::int as line_no, {part(2)} as name, {strip(part(3))} as type, {strip(f'substr(text, length({part(1)}) + 1, length({part(4)}))')} as value from vc "
        f"where (language = 'python' and regexp_matches(code, {q(G.PY_VARIABLE)})) or (language in ('javascript', 'typescript') and regexp_matches(code, {q(G.SCRIPT_VARIABLE)}) "
        f"and not regexp_matches(code, {q(G.DECLARATIONS['javascript'][2][1])})))"
    )


def _odd(a: str, b: str) -> str:
    return f"(length(replace(masked, '{a}', '')) <> length(replace(masked, '{b}', '')))"


ERROR = f"case when {_odd('(', ')')} or {_odd('[', ']')} or {_odd('{', '}')} then 'unbalanced brackets' end"
