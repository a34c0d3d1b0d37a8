"""Functions, classes, imports, variables and calls of source files.

Text is first masked by its tokens (``functions.lexer``), so strings and comments
never count as code, and brackets without statements are joined over lines. Symbols
are found by declaration patterns on these logical lines and block extents by one
ordered fold, inside the row that holds the file: indentation closes Python blocks,
brace depth closes the others. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave.functions import grammar as G
from sourceweave.functions.lexer import FILL, JOIN, code_lines, items_of, java, masked, nested
from sourceweave.functions.lines import contains_all, contains_any, extract, let, lines_of, non_empty, segments, strip
from sourceweave.sources.files import directory, language_of, skip_filter

#: What ``\\s`` matches.
SPACE = " \t\n\x0b\f\r"

_ENTRY = "struct<first:int,level:int,kind:string,name:string,sets:boolean,opened:boolean,decos:int,pk:string,pn:string>"
_SPAN = "struct<first:int,last:int,kind:string,name:string,decos:int,pk:string,pn:string>"

# State of the fold: open blocks, closed blocks, marks where the enclosing
# function changes, brace depth, last code line, decorators seen just above.
_START = (
    f"named_struct('stack', cast(array() as array<{_ENTRY}>), 'done', cast(array() as array<{_SPAN}>), "
    "'marks', cast(array() as array<struct<at:int,name:string>>), 'cur', 0, 'depth', 0, 'last', 0, 'decos', 0)"
)
_TOP = "element_at(concat(array(cast(null as {t})), {stack}), -1)"
_OWNER = "element_at(concat(array(cast(null as {t})), filter({stack}, e -> e.sets)), -1)"


def _entry(level: str, opened: str, stack: str) -> str:
    top = _TOP.format(t=_ENTRY, stack=stack)
    return (
        f"named_struct('first', l.no, 'level', {level}, 'kind', l.kind, 'name', l.name, 'sets', l.sets, 'opened', {opened}, "
        f"'decos', s.decos, 'pk', coalesce({top}.kind, ''), 'pn', coalesce({top}.name, ''))"
    )


def _closed(entries: str, last: str) -> str:
    return (
        f"transform({entries}, e -> named_struct('first', e.first, 'last', {last}, 'kind', e.kind, 'name', e.name, "
        "'decos', e.decos, 'pk', e.pk, 'pn', e.pn))"
    )


def _next_state(stack: str, done: str, at: str, depth: str) -> str:
    """New state once the open blocks are known (bound as ``v``)."""
    owner = _OWNER.format(t=_ENTRY, stack="v.stack")
    cur = f"coalesce({owner}.first, 0)"
    return (
        f"element_at(transform(array(named_struct('stack', {stack}, 'done', {done})), v -> named_struct('stack', v.stack, 'done', v.done, "
        f"'marks', case when {cur} <> s.cur then concat(s.marks, array(named_struct('at', {at}, 'name', coalesce({owner}.name, '')))) else s.marks end, "
        f"'cur', {cur}, 'depth', {depth}, 'last', l.no, 'decos', case when l.deco or (l.inside and s.decos > 0) then s.decos + 1 else 0 end)), 1)"
    )


# Indentation: a code line closes every block that starts at its indent or deeper.
_INDENT_STEP = _next_state(
    stack="case when l.kind <> '' then concat({k}, array({e})) else {k} end".format(
        k="filter(s.stack, e -> l.cont or l.level > e.level)",
        e=_entry("l.level", "true", "filter(s.stack, e -> l.cont or l.level > e.level)"),
    ),
    done="case when not l.cont and exists(s.stack, e -> l.level <= e.level) then concat(s.done, {c}) else s.done end".format(
        c=_closed("filter(s.stack, e -> l.level <= e.level)", "s.last")
    ),
    at="l.no",
    depth="0",
)
# Braces: a block closes on the line where the depth returns to its own level.
_OPEN = (
    "transform(case when l.kind <> '' then concat(s.stack, array({e})) else s.stack end, e -> named_struct('first', e.first, 'level', e.level, "
    "'kind', e.kind, 'name', e.name, 'sets', e.sets, 'opened', e.opened or s.depth + l.delta > e.level or (e.first = l.no and l.single), "
    "'decos', e.decos, 'pk', e.pk, 'pn', e.pn))"
).format(e=_entry("s.depth", "false", "s.stack"))
_BRACE_STEP = (
    "element_at(transform(array({open}), o -> {next}), 1)".format(
        open=_OPEN,
        next=_next_state(
            stack="filter(o, e -> not (e.opened and s.depth + l.delta <= e.level))",
            done="case when exists(o, e -> e.opened and s.depth + l.delta <= e.level) then concat(s.done, {c}) else s.done end".format(
                c=_closed("filter(o, e -> e.opened and s.depth + l.delta <= e.level)", "l.no")
            ),
            at="l.no + 1",
            depth="s.depth + l.delta",
        ).replace("'at', l.no + 1", "'at', case when l.kind <> '' and l.sets then l.no else l.no + 1 end"),
    )
)


def _declaration(line: Column, language: Column) -> Column:
    """First declaration on a line as ``struct<kind,name>``; null when there is none.

    A rule is tried only where no earlier one has matched and the line has the words it needs.
    """
    out = F.lit(None)
    for lang, rules in G.DECLARATIONS.items():
        tried = []
        for kind, p in rules:
            name = F.regexp_extract(line, p, 1)
            needs = G.RULE_GUARDS.get((lang, kind), [])
            tried.append(F.when(contains_all(line, needs) & (name != "") & ~name.isin(G.KEYWORDS), F.struct(F.lit(kind).alias("kind"), name.alias("name"))))
        out = F.when((language == lang) & contains_any(line, G.GUARDS[lang]), F.coalesce(*tried)).otherwise(out)
    return out


def _count_of(text: Column, mark: str) -> Column:
    return F.when(text.contains(mark), F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).otherwise(0)


def _line_info(code: Column, language: Column) -> Column:
    """Facts per code line the fold needs; blank lines are left out first."""
    numbered = F.transform(code, lambda x, i: F.struct((i + 1).alias("no"), x["text"].alias("text"), x["whole"].alias("whole"), x["inside"].alias("inside")))
    script = language.isin("javascript", "typescript")

    def info(row: Column) -> Column:
        x = row["text"]
        n_open, n_close = _count_of(x, "{"), _count_of(x, "}")

        def facts(v: Column) -> Column:
            kind = F.coalesce(v["d"]["kind"], F.lit(""))
            # asked for lines with a declaration only
            single = (kind != "") & (((v["open"] > 0) & (v["open"] <= v["close"])) | ((v["open"] == 0) & ((kind == "arrow") | row["whole"].rlike(r";\s*$"))))
            return F.struct(
                row["no"].alias("no"),
                (F.length(x) - F.length(F.ltrim(x, F.lit(SPACE)))).alias("level"),
                (row["inside"] | F.left(F.ltrim(x, F.lit(SPACE)), F.lit(1)).isin(")", "]", "}", FILL)).alias("cont"),
                kind.alias("kind"),
                F.coalesce(v["d"]["name"], F.lit("")).alias("name"),
                # in scripts only function declarations name the caller
                F.when(script, kind == "function").otherwise(kind.isin("function", "method")).alias("sets"),
                (v["open"] - v["close"]).alias("delta"),
                single.alias("single"),
                (row["whole"].contains("@") & row["whole"].rlike(java(G.DECORATOR))).alias("deco"),
                row["inside"].alias("inside"),
            )

        return let(F.struct(_declaration(row["whole"], language).alias("d"), n_open.alias("open"), n_close.alias("close")), facts)

    return F.transform(F.filter(numbered, lambda r: F.ltrim(r["text"], F.lit(SPACE)) != ""), info)


def scoped_files(files: DataFrame) -> DataFrame:
    """Files with ``lines``, masked ``code``, block ``spans`` and the ``owners`` ranges.

    ``spans`` is ``array<struct<first,last,kind,name,decos,pk,pn>>`` (``pk``/``pn``
    name the enclosing block); ``owners`` cuts the file into disjoint line
    ranges with the same enclosing function. ``masked`` is the text without strings
    and comments, ``code`` its lines.
    """
    src = files.withColumn("language", language_of(F.col("path"))).where("language is not null")
    src = src.select("project_id", "path", "language", "content", lines_of(F.col("content")).alias("lines"), masked().alias("masked"))
    src = src.withColumn("code", code_lines("masked"))
    src = src.withColumn("info", _line_info(F.col("code"), F.col("language")))
    fold = (
        f"case when language = 'python' then aggregate(info, {_START}, (s, l) -> {_INDENT_STEP}) "
        f"else aggregate(info, {_START}, (s, l) -> {_BRACE_STEP}) end"
    )
    out = src.withColumn("f", F.expr(fold)).withColumn(
        "spans", F.expr("concat(f.done, " + _closed("f.stack", "f.last") + ")")
    )
    return out.select(
        "project_id", "path", "language", "content", "lines", "masked", "code", "spans", segments(F.col("f.marks"), F.size("lines"), "").alias("owners")
    )


def _decorators(first: Column, count: Column) -> Column:
    """Texts of the decorator lines right above a block; one that runs over lines stays one."""
    both = F.arrays_zip(F.slice("lines", first - count, count).alias("line"), F.slice("code", first - count, count).alias("code"))
    text = F.array_join(F.transform(both, lambda b: F.concat(F.when(b["code"]["inside"], JOIN).otherwise("\n"), b["line"])), "")
    parts = F.filter(F.split(text, "\n"), lambda d: d != "")
    return F.transform(parts, lambda d: F.regexp_replace(strip(F.replace(d, F.lit(JOIN), F.lit("\n"))), "^@", ""))


def _text_of(lines: str, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def _code_of(first: Column, last: Column) -> Column:
    return F.array_join(F.transform(F.slice("code", first, last - first + 1), lambda c: c["text"]), "\n")


def block_spans(files: DataFrame) -> DataFrame:
    """Start and end line of every function, method and class."""
    rows = scoped_files(files).select("project_id", "path", "language", F.inline_outer("spans")).where("first is not null")
    return rows.select(
        "project_id", "path", "language", "kind", "name", F.col("first").alias("start_line"), F.col("last").alias("end_line"),
        F.col("pk").alias("parent_kind"), F.col("pn").alias("parent_name"),
    )


def _go_receiver(head: Column) -> Column:
    return extract(head, r"^func\s+\(\s*\w+\s+\*?(\w+)(?:\[[^()]*\])?\s*\)")


def _docstring(body: Column, code: Column, head: str) -> Column:
    """The string that a Python block begins with; comments before it are blank in ``code``."""
    rest = F.substr(body, F.length(F.regexp_extract(code, head, 0)) + 1)
    return F.coalesce(*[extract(rest, "^[rRuU]?" + quote) for quote in G.DOCSTRINGS], F.lit(""))


def extract_functions(files: DataFrame) -> DataFrame:
    """Functions and methods with extent, signature, docstring and decorators.

    Python: module-level functions and methods of classes (decorated ones
    included); other languages: every declaration. ``class_name`` is empty for
    plain functions.
    """
    rows = scoped_files(files).select("project_id", "path", "language", "lines", "code", F.explode_outer("spans").alias("s"))
    s = F.col("s")
    python = F.col("language") == "python"
    rows = rows.where((s["kind"] != "class") & (~python | (s["pk"].isin("", "class"))))
    rows = rows.select(
        "project_id", "path", "language", "s", _text_of("lines", s["first"], s["last"]).alias("body"), _code_of(s["first"], s["last"]).alias("code"),
        _decorators(s["first"], s["decos"]).alias("decorators"),
    )
    name, b, code = s["name"], F.col("body"), F.col("code")
    head = F.regexp_extract(code, r"^[^\n]*", 0)
    # the first bracket after the name is the parameter list (Go methods carry a receiver before it)
    before = F.length(F.regexp_extract(code, G.SIGNATURE, 1))
    inner = F.regexp_extract(code, G.SIGNATURE, 2)
    after = F.regexp_extract(code, G.SIGNATURE, 3)
    bare_arrow = extract(head, r"=\s*(?:async\s*)?(\w+)\s*=>")
    params = F.coalesce(bare_arrow, F.substr(b, before + 1, F.length(inner)))
    param_code = F.coalesce(bare_arrow, inner)
    lang = F.col("language")
    returns = (
        F.when(lang == "python", F.regexp_extract(after, r"^\s*->\s*([^:]+)", 1))
        .when(lang == "typescript", F.regexp_extract(after, r"^\s*:\s*([^{=;]+)", 1))
        .when(lang == "java", F.regexp_extract(head, r"([\w<>\[\],.?]+)\s+\w+\s*\(", 1))
        .when(lang == "go", F.regexp_extract(after, r"^\s*([^{]*)", 1))
        .otherwise("")
    )
    doc = _docstring(b, code, G.PY_HEAD)
    return rows.select(
        "project_id",
        "path",
        "language",
        name.alias("name"),
        F.when(lang == "go", F.coalesce(_go_receiver(head), F.lit("")))
        .otherwise(F.when(s["pk"] == "class", s["pn"]).otherwise(""))
        .alias("class_name"),
        s["first"].alias("start_line"),
        s["last"].alias("end_line"),
        params.alias("params"),
        param_code.alias("param_code"),
        strip(returns).alias("return_type"),
        F.when(lang == "python", doc).otherwise("").alias("docstring"),
        "decorators",
        head.rlike(r"\basync\b").alias("is_async"),
        F.when(lang == "go", _go_receiver(head).isNotNull()).otherwise(s["pk"] == "class").alias("is_method"),
        "body",
    )


def extract_parameters(functions: DataFrame) -> DataFrame:
    """One row per parameter: name, type and default."""
    pieces = F.expr(f"filter({items_of('param_code', 'params', G.ANGLED)}, p -> p rlike '\\\\w')")
    rows = functions.select(
        "project_id", "path", "language", F.col("name").alias("function"), "class_name", "start_line", F.posexplode_outer(pieces).alias("pos", "p")
    ).where("pos is not null")
    p, lang = F.col("p"), F.col("language")
    default = F.when(lang.isin("python", "javascript", "typescript"), F.regexp_extract(p, r"^[^=]*=\s*([\s\S]+)$", 1)).otherwise("")
    left = strip(F.regexp_extract(p, r"^([^=]*)", 1))
    typed = lang.isin("python", "typescript")
    name = (
        F.when(typed, F.regexp_extract(left, r"^([^:]*)", 1))
        .when(lang == "java", F.regexp_extract(left, r"(\w+)$", 1))
        .when(lang == "go", F.regexp_extract(left, r"^(\w+)", 1))
        .otherwise(left)
    )
    kind = (
        F.when(typed, F.regexp_extract(left, r"^[^:]*:\s*([\s\S]*)$", 1))
        .when(lang == "java", F.regexp_extract(left, r"^([\s\S]*)\s\w+$", 1))
        .when(lang == "go", F.regexp_extract(left, r"^\w+\s+([\s\S]*)$", 1))
        .otherwise("")
    )
    return rows.select(
        "project_id", "path", "function", "class_name", "start_line", (F.col("pos") + 1).alias("ordinal"),
        F.regexp_replace(strip(name), r"\?$", "").alias("name"), strip(kind).alias("type"), strip(default).alias("default_value"),
    )


def extract_classes(files: DataFrame) -> DataFrame:
    """Classes, interfaces and structs with bases, decorators and method count."""
    rows = scoped_files(files).select("project_id", "path", "language", "lines", "code", "spans", F.explode_outer("spans").alias("s"))
    s = F.col("s")
    rows = rows.where(s["kind"] == "class").select(
        "project_id",
        "path",
        "language",
        "s",
        F.get("code", s["first"] - 1)["whole"].alias("head"),
        _text_of("lines", s["first"], s["last"]).alias("body"),
        _code_of(s["first"], s["last"]).alias("code"),
        _decorators(s["first"], s["decos"]).alias("decorators"),
        F.size(
            F.filter("spans", lambda m: (m["kind"] != "class") & (m["pk"] == "class") & (m["pn"] == s["name"]) & m["first"].between(s["first"], s["last"]))
        ).alias("method_count"),
    )
    lang = F.col("language")
    # the type parameters of the class itself may hold the word extends
    head = F.regexp_replace("head", G.OWN_TYPES, "$1")
    python_bases = F.regexp_extract(head, G.PY_BASES, 1)
    other_bases = F.concat_ws(",", *[non_empty(F.regexp_extract(head, p, 1)) for p in G.BASES])
    rows = rows.withColumn("bases", F.when(lang == "python", python_bases).otherwise(other_bases))
    types = F.expr(items_of("bases", "bases", "language <> 'python'"))
    clean = F.filter(F.transform(types, lambda x: F.regexp_replace(x, r"\s+", " ")), lambda x: ~x.contains("="))
    doc = _docstring(F.col("body"), F.col("code"), G.PY_CLASS_HEAD)
    return rows.select(
        "project_id",
        "path",
        "language",
        s["name"].alias("name"),
        s["first"].alias("start_line"),
        s["last"].alias("end_line"),
        F.array_join(clean, ",").alias("base_classes"),
        F.when(lang == "python", doc).otherwise("").alias("docstring"),
        "decorators",
        "method_count",
        "body",
        "code",
    )


def extract_attributes(classes: DataFrame) -> DataFrame:
    """Members directly inside a class body: Python assignments, script and Java fields, fields of Go structs.

    ``value`` is the assigned value in Python and the declared type elsewhere; an
    embedded Go type is a field of its own name.
    """
    body, code = F.split("body", "\n", -1), F.split("code", "\n", -1)
    rows = classes.where(F.col("language").isin("python", "typescript", "java") | ((F.col("language") == "go") & F.col("code").rlike(r"^[^\n{]*\bstruct\b")))
    both = F.arrays_zip(F.slice(body, 2, F.size(body)).alias("line"), F.slice(code, 2, F.size(code)).alias("code"))
    rows = rows.select(
        "project_id", "path", "language", F.col("name").alias("class_name"), "start_line", F.posexplode(both).alias("pos", "l"),
        F.regexp_extract("code", r"^[^\n]*\n(?:\s*\n)*([ \t]+)", 1).alias("margin"),
    ).select("project_id", "path", "language", "class_name", "start_line", "pos", "l.line", F.col("l.code").alias("code"), "margin")
    line, code, lang = F.col("line"), F.col("code"), F.col("language")
    inner = code.startswith(F.col("margin")) & ~F.substr(code, F.length("margin") + 1).rlike(r"^\s")
    # a declaration may name several fields at once
    names = F.lit("")
    kind = F.lit("")
    for one, pattern in G.FIELDS.items():
        names = F.when(lang == one, F.regexp_extract(code, pattern, 1)).otherwise(names)
    for one, pattern in G.FIELD_VALUES.items():
        kind = F.when(lang == one, F.regexp_extract(code, pattern, 1)).otherwise(kind)
    kind = F.when(lang == "python", F.substr(line, F.length(F.regexp_extract(code, G.UP_TO_VALUE, 0)) + 1, F.length(kind))).otherwise(kind)
    rows = rows.where(inner).withColumn("names", names).withColumn("value", strip(kind)).where("names <> ''")
    found = F.transform(F.expr(items_of("names", "names")), lambda x: F.regexp_extract(x, r"(\w[\w.]*)", 1))
    found = F.when(lang.isin("java", "go"), found).otherwise(F.array("names"))
    rows = rows.withColumn("found", found).select("*", F.explode_outer("found").alias("name"))
    return rows.where("name <> ''").select(
        "project_id", "path", "class_name", "start_line",
        F.when(lang == "go", F.regexp_extract("name", r"(\w+)$", 1)).otherwise(F.col("name")).alias("name"), "value",
    )


def _found_imports() -> Column:
    """Imports of a file in the order of their places: ``array<struct<module, names, is_from_import>>``."""
    lang = F.col("language")

    def groups(text: str, pattern: str, *numbers: int) -> Column:
        """The groups of every match side by side: each is read once for the file, not once for a match."""
        return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), n).alias(f"g{n}") for n in numbers])

    def row(module: Column, names: Column, is_from: Column) -> Column:
        return F.struct(module.alias("module"), names.alias("names"), is_from.alias("is_from_import"))

    python = F.transform(
        groups("masked", G.PY_IMPORT, 1, 2, 3, 4), lambda m: row(F.concat(m["g2"], m["g3"]), F.concat(m["g1"], m["g4"]), m["g3"] != "")
    )
    script = F.transform(groups("content", G.SCRIPT_IMPORT, 1, 2), lambda m: row(m["g2"], m["g1"], F.lit(True)))
    java_imports = F.transform(F.regexp_extract_all("masked", F.lit(G.JAVA_IMPORT), 1), lambda m: row(m, F.lit(""), F.lit(False)))
    blocks = groups("content", G.GO_IMPORT, 1, 2)
    modules = F.flatten(F.transform(blocks, lambda m: F.when(m["g2"] != "", F.array(m["g2"])).otherwise(F.regexp_extract_all(m["g1"], F.lit('"([^"]+)"'), 1))))
    go = F.transform(modules, lambda m: row(m, F.lit(""), F.lit(False)))
    return F.when(lang == "python", python).when(lang.isin("javascript", "typescript"), script).when(lang == "java", java_imports).otherwise(go)


def extract_imports(files: DataFrame) -> DataFrame:
    """Import statements: module, imported names (``x as y`` keeps the alias), form."""
    rows = file_facts(files).select("project_id", "path", "language", F.posexplode_outer("imports").alias("pos", "m")).where("pos is not null")
    piece = F.when(F.col("language") == "python", r"([\w.*]+(?:\s+as\s+\w+)?)").otherwise(r"(\*\s+as\s+\w+|[\w$]+(?:\s+as\s+\w+)?)")
    names = F.transform(F.regexp_extract_all(F.col("m.names"), piece, F.lit(1)), lambda n: F.regexp_replace(n, r"\s+", " "))
    return rows.select(
        "project_id", "path", "language", (F.col("pos") + 1).alias("ordinal"), strip(F.col("m.module")).alias("module"), names.alias("names"),
        F.col("m.is_from_import").alias("is_from_import"),
    )


def _found_variables() -> Column:
    """Assigned names of a file: ``array<struct<line_no, name, type, value>>``."""
    lang = F.col("language")
    both = F.transform(
        F.arrays_zip(F.col("lines").alias("line"), F.col("code").alias("code")),
        lambda b, i: F.struct((i + 1).alias("no"), b["line"].alias("line"), b["code"]["text"].alias("code")),
    )

    def rows(pattern: str, other: str | None = None) -> Column:
        hit = F.filter(both, lambda b: b["code"].contains("=") & b["code"].rlike(pattern) & (~b["code"].rlike(other) if other else F.lit(True)))

        def row(b: Column) -> Column:
            at = F.length(F.regexp_extract(b["code"], pattern, 1)) + 1
            value = F.substr(b["line"], at, F.length(F.regexp_extract(b["code"], pattern, 4)))
            name, kind = (F.regexp_extract(b["code"], pattern, g) for g in (2, 3))
            return F.struct(b["no"].alias("line_no"), name.alias("name"), strip(kind).alias("type"), strip(value).alias("value"))

        return F.transform(hit, row)

    arrow = G.DECLARATIONS["javascript"][2][1]
    return F.when(lang == "python", rows(G.PY_VARIABLE)).when(lang.isin("javascript", "typescript"), rows(G.SCRIPT_VARIABLE, arrow))


def extract_variables(files: DataFrame) -> DataFrame:
    """Module-level assignments (Python) and bindings that are not functions (JS/TS)."""
    rows = file_facts(files).select("project_id", "path", "language", F.explode_outer("variables").alias("v")).where("v is not null")
    return rows.select("project_id", "path", "language", "v.line_no", "v.name", "v.type", "v.value")


def _with_calls(src: DataFrame, arguments: bool) -> DataFrame:
    """Adds ``calls``, an array of ``struct<line_no, caller, callee>`` in the order of their places; with the texts of their ``arguments`` where asked.

    What is looked up for every call is bound once for the file (``v``): the optimizer moves
    an expression that is used in one place there, even into the function of an array.
    ``placed`` has the same calls without their callers.
    """
    call = F.lit(java(G.CALL))
    src = src.withColumn(
        "heads",
        F.transform(F.filter("spans", lambda s: s["kind"].isin("function", "method")), lambda s: F.struct(s["first"].alias("first"), s["name"].alias("name"))),
    ).withColumn(
        "found",
        F.arrays_zip(F.split("masked", java(G.CALL), -1).alias("before"), F.regexp_extract_all("masked", call, 0).alias("text")),
    )
    if arguments:
        # a look-ahead consumes nothing, so the matches are those of the calls
        src = src.withColumn("inner", F.regexp_extract_all("masked", F.lit(java(G.CALL + rf"(?=({nested(4)}))")), 2))
    known = (
        f"f.callee in ({', '.join(repr(k) for k in G.KEYWORDS)}) or c.before rlike {G.sql(G.NOT_CALLED)} "
        f"or (s.last = 'func' and c.before rlike {G.sql(G.RECEIVER)}) "
        # Go types hold signatures, not calls
        "or (language = 'go' and exists(v.spans, x -> x.kind = 'class' and x.first < f.line and f.line < x.last))"
    )
    # the first call on a line that has the name of a function that starts there is its head
    declared = "f.line <> s.head and exists(v.heads, h -> h.first = f.line and h.name = f.callee)"
    placed = (
        r"named_struct('line', s.line + length(c.before) - length(replace(c.before, '\n', '')), "
        rf"'callee', rtrim({G.sql(SPACE)}, left(c.text, length(c.text) - 1)), 'at', s.at + length(c.before) + length(c.text))"
    )
    step = (
        f"element_at(transform(array({placed}), f -> "
        f"element_at(transform(array(named_struct('known', {known}, 'declared', {declared})), g -> named_struct("
        "'at', f.at, 'no', s.no + 1, "
        r"'line', f.line + length(c.text) - length(replace(c.text, '\n', '')), 'last', f.callee, 'head', case when not g.known and g.declared then f.line else s.head end, "
        "'out', case when g.known or g.declared then s.out else concat(s.out, array(named_struct('line_no', f.line, 'callee', f.callee, "
        "'at', f.at, 'no', s.no))) end)), 1)), 1)"
    )
    start = "named_struct('at', 1, 'no', 0, 'line', 1, 'last', '', 'head', 0, 'out', cast(array() as array<struct<line_no:int,callee:string,at:int,no:int>>))"

    def bound(names: str, text: str) -> Column:
        fields = ", ".join(f"'{n}', {n}" for n in names.split())
        return F.expr(f"element_at(transform(array(named_struct({fields})), v -> {text}), 1)")

    src = src.withColumn("placed", bound("heads spans found", f"aggregate(filter(v.found, c -> c.text is not null), {start}, (s, c) -> {step}, s -> s.out)"))
    owner = "coalesce(element_at(filter(v.owners, o -> o.first <= c.line_no and c.line_no < o.first + o.length), -1).name, '')"
    call = f"named_struct('line_no', c.line_no, 'caller', {owner}, 'callee', c.callee"
    if not arguments:
        return src.withColumn("calls", bound("owners", f"transform(placed, c -> {call}))")).drop("heads", "found")
    args = items_of("i", "substr(content, c.at, length(i))")
    calls = bound("owners inner", f"transform(placed, c -> {call}, 'arguments', element_at(transform(array(get(v.inner, c.no)), i -> {args}), 1)))")
    return src.withColumn("calls", calls).drop("heads", "found", "inner")


def file_facts(files: DataFrame, arguments: bool = True) -> DataFrame:
    """One row a file with all that is read from it, as arrays; what a query does not ask for is not computed.

    ``arguments=False`` leaves the argument texts of the calls out, which cost more than the calls.

    ``spans``, ``owners`` (see :func:`scoped_files`), ``imports``, ``variables``, ``calls``
    and ``error``, null where the brackets of the code close each other.
    """
    src = _with_calls(scoped_files(files), arguments)
    unclosed = [_count_of(F.col("masked"), a) != _count_of(F.col("masked"), b) for a, b in ("()", "[]", "{}")]
    error = F.when(unclosed[0] | unclosed[1] | unclosed[2], F.lit("unbalanced brackets"))
    return src.withColumns({"imports": _found_imports(), "variables": _found_variables(), "error": error})


def parse_errors(files: DataFrame) -> DataFrame:
    """Files whose code does not close its brackets; their other facts are kept all the same."""
    return file_facts(files).where("error is not null").select("project_id", "path", "language", "error")


def extract_calls(files: DataFrame, arguments: bool = True) -> DataFrame:
    """Call sites with the name of the enclosing function (empty at module level) and the argument texts.

    One scan of the masked text finds callee and line and, where asked, one by a look-ahead
    that consumes nothing the arguments of every call, nested ones included. Declarations,
    object construction and key words are no calls.
    """
    rows = file_facts(files, arguments).select("project_id", "path", "language", F.posexplode_outer("calls").alias("pos", "c")).where("pos is not null")
    rows = rows.select("project_id", "path", "language", F.col("pos").alias("ordinal"), "c.*")
    return rows.select("project_id", "path", "language", "line_no", "caller", "ordinal", "callee", *["arguments"] * arguments)


# --- roll-ups --------------------------------------------------------------------


def file_counts() -> dict[str, Column]:
    """Counts of one row of :func:`file_facts`."""
    kinds = F.col("spans")
    python = F.col("language") == "python"
    return {
        "files": F.lit(1),
        "functions": F.size(F.filter(kinds, lambda s: (s["kind"] != "class") & (~python | s["pk"].isin("", "class")))),
        "classes": F.size(F.filter(kinds, lambda s: s["kind"] == "class")),
        "imports": F.size("imports"),
        "variables": F.coalesce(F.when(F.col("variables").isNotNull(), F.size("variables")), F.lit(0)),
        "calls": F.size("placed"),
        "errors": F.col("error").isNotNull().cast("int"),
    }


def structure_summary(files: DataFrame) -> DataFrame:
    """Files, functions, classes, imports, variables, calls and files with errors of each project.

    Every file row carries its own counts (array sizes), so the corpus is read once
    and one small aggregation over the files is all that is shuffled.
    """
    sizes = file_counts()
    per_file = file_facts(skip_filter(files, "structure"), False).select("project_id", *[c.alias(name) for name, c in sizes.items()])
    return per_file.groupBy("project_id").agg(*[F.sum(name).alias(f"total_{name}") for name in sizes])


def by_language_directory(files: DataFrame) -> DataFrame:
    """File counts by language, by folder and per project from one grouping-sets pass."""
    kept = skip_filter(files, "structure").select(
        "project_id",
        language_of(F.col("path")).alias("language"),
        F.coalesce(non_empty(directory(F.col("path"))), F.lit("<root>")).alias("dir"),
    )
    sets = [["project_id", "language"], ["project_id", "dir"], ["project_id"]]
    grouped = kept.groupingSets([[F.col(c) for c in s] for s in sets], "project_id", "language", "dir").agg(
        F.grouping("language").alias("gl"), F.grouping("dir").alias("gd"), F.count("*").alias("files")
    )
    level = F.when(F.col("gl") == 0, "language").when(F.col("gd") == 0, "directory").otherwise("project")
    return grouped.select("project_id", level.alias("level"), F.coalesce("language", "dir", F.lit("")).alias("key"), "files")
