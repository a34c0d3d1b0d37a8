"""Queries of the symbol extraction over the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceweave.functions import grammar as G
from sourceweave.operators import symbols as sy
from sourceweave.plans import symbolsql as ss
from sourceweave.plans.minesql import strip
from sourceweave.plans.registry import plan
from sourceweave.plans.sqltext import CORPUS, q
from sourceweave.sources.corpus import corpus

FUNCTIONS = f"with {CORPUS}, {ss.functions('corpus')}"


@plan(
    "block_spans",
    f"with {CORPUS}, {ss.spans('corpus')} select project_id, path, language, kind, name, first as start_line, last as end_line, pk as parent_kind, pn as parent_name from spans",
)
def block_spans(spark, sf):
    return sy.block_spans(corpus(spark, sf))


@plan(
    "extract_functions",
    f"{FUNCTIONS} select project_id, path, language, name, class_name, start_line, end_line, params, return_type, docstring, decorators, is_async, is_method, md5(body) as body_md5 from functions",
)
def extract_functions(spark, sf):
    f = sy.extract_functions(corpus(spark, sf))
    return f.withColumn("decorators", F.array_join("decorators", "|")).withColumn("body_md5", F.md5("body")).drop("body", "param_code")


PIECE = (
    f"fp as (select project_id, path, language, name as function, class_name, start_line, list_filter(case when {G.ANGLED} then {ss.items('param_code', 'params', True)} else {ss.items('param_code', 'params')} end, "
    "lambda t: regexp_matches(t, '\\w')) as ps from functions), "
    "fq as (select project_id, path, language, function, class_name, start_line, unnest(ps) as p, generate_subscripts(ps, 1) as ordinal from fp), "
    f"fr as (select *, {strip('string_split(p, ' + q('=') + ')[1]')} as l from fq)"
)


@plan(
    "extract_parameters",
    f"{FUNCTIONS}, {PIECE} select project_id, path, function, class_name, start_line, ordinal, "
    + r"regexp_replace("
    + strip(
        r"case when language in ('python', 'typescript') then regexp_extract(l, '^([^:]*)', 1) when language = 'java' then regexp_extract(l, '(\w+)$', 1) when language = 'go' then regexp_extract(l, '^(\w+)', 1) else l end"
    )
    + r", '\?$', '') as name, "
    + strip(
        r"case when language in ('python', 'typescript') then regexp_extract(l, '^[^:]*:\s*((?s:.*))$', 1) when language = 'java' then regexp_extract(l, '^((?s:.*))\s\w+$', 1) when language = 'go' then regexp_extract(l, '^\w+\s+((?s:.*))$', 1) else '' end"
    )
    + " as type, "
    + strip(r"case when language in ('python', 'javascript', 'typescript') then regexp_extract(p, '^[^=]*=\s*((?s:.+))$', 1) else '' end")
    + " as default_value from fr",
)
def extract_parameters(spark, sf):
    return sy.extract_parameters(sy.extract_functions(corpus(spark, sf)))


HEAD = rf"regexp_replace(head, {q(G.OWN_TYPES)}, '\\1')"
BASES = f"case when language = 'python' then regexp_extract({HEAD}, {q(G.PY_BASES)}, 1) else concat_ws(',', {', '.join(f'nullif(regexp_extract({HEAD}, {q(p)}, 1), {q(str())})' for p in G.BASES)}) end"
CLASSES = f"with {CORPUS}, {ss.spans('corpus')}, {ss.BODIES}, c as (select *, {BASES} as bases from bodies where kind = 'class')"


@plan(
    "extract_classes",
    f"{CLASSES} select project_id, path, language, name, first as start_line, last as end_line, array_to_string(list_filter(list_transform(case when language = 'python' then {ss.items('bases')} else {ss.items('bases', None, True)} end, "
    "lambda t: regexp_replace(t, '\\s+', ' ', 'g')), lambda t: not contains(t, '=')), ',') as base_classes, "
    f"case when language = 'python' then {ss.docstring(G.PY_CLASS_HEAD)} else '' end as docstring, {ss.DECORATORS} as decorators, "
    "(select count(*) from spans m where m.project_id = c.project_id and m.path = c.path and m.kind <> 'class' and m.pk = 'class' and m.pn = c.name and m.first between c.first and c.last) as method_count, md5(body) as body_md5 from c",
)
def extract_classes(spark, sf):
    c = sy.extract_classes(corpus(spark, sf)).withColumn("decorators", F.array_join("decorators", "|"))
    return c.withColumn("body_md5", F.md5("body")).drop("body", "code")


def _field(patterns) -> str:
    return "case " + " ".join(f"when language = '{one}' then regexp_extract(code, {q(p)}, 1)" for one, p in patterns.items()) + " else '' end"


FIELD_VALUE = f"case when language = 'python' then substr(line, length(regexp_extract(code, {q(G.UP_TO_VALUE)})) + 1, length(v)) else v end"


@plan(
    "extract_attributes",
    f"{CLASSES}, b as (select project_id, path, language, name, first, ls[first + 1:last] as bl, ms[first + 1:last] as bm from c where language in ('python', 'typescript', 'java') "
    "or (language = 'go' and regexp_matches(code, '^[^\\n{]*\\bstruct\\b'))), "
    f"m as (select *, coalesce(regexp_extract(list_filter(bm, lambda t: {strip('t')} <> '')[1], '^([ \\t]*)', 1), '') as margin from b), "
    "e as (select project_id, path, language, name, first, margin, unnest(bl) as line, unnest(bm) as code from m), "
    f"f as (select *, {_field(G.FIELDS)} as names, {_field(G.FIELD_VALUES)} as v from e where starts_with(code, margin) and not regexp_matches(substr(code, length(margin) + 1), '^\\s')), "
    f"g as (select *, case when language in ('java', 'go') then list_transform({ss.items('names')}, lambda t: regexp_extract(t, '(\\w[\\w.]*)', 1)) else [names] end as ns from f where names <> ''), "
    "h as (select *, unnest(ns) as n from g) "
    f"select project_id, path, name as class_name, first as start_line, case when language = 'go' then regexp_extract(n, '(\\w+)$', 1) else n end as name, {strip(FIELD_VALUE)} as value from h where n <> ''",
)
def extract_attributes(spark, sf):
    return sy.extract_attributes(sy.extract_classes(corpus(spark, sf)))


@plan("extract_imports", f"with {CORPUS}, {ss.imports('corpus')} select * from imports")
def extract_imports(spark, sf):
    return sy.extract_imports(corpus(spark, sf)).withColumn("names", F.array_join("names", ","))


@plan("extract_variables", f"with {CORPUS}, {ss.spans('corpus')}, {ss.variables()} select * from variables")
def extract_variables(spark, sf):
    return sy.extract_variables(corpus(spark, sf))


@plan("parse_errors", f"with {CORPUS}, {ss.masked_files('corpus')} select project_id, path, language, {ss.ERROR} as error from sm where error is not null")
def parse_errors(spark, sf):
    return sy.parse_errors(corpus(spark, sf))


@plan("call_arguments")
def call_arguments(spark, sf):
    """All call sites with their argument texts, which SQL without look-ahead cannot cut; tested against a syntax tree."""
    return sy.extract_calls(corpus(spark, sf)).withColumn("arguments", F.to_json("arguments"))


@plan("extract_calls", f"with {CORPUS}, {ss.calls('corpus')} select project_id, path, language, line_no, caller, ordinal, callee from calls")
def extract_calls(spark, sf):
    return sy.extract_calls(corpus(spark, sf), arguments=False)
