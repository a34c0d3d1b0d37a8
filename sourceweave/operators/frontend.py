"""Routes, user-interface actions and client API calls of front-end files.

Each operator is one narrow pass: a file row is split into its lines, every
line meets the rule list, and neighbouring lines are reached through the line
array the row already holds. Nothing is shuffled before the summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave.functions import rules as R
from sourceweave.functions.lines import (
    extract,
    first_extract,
    first_in,
    first_of,
    lines_of,
    non_empty,
    rule_matches,
    segments,
    strip,
)


def router_framework(content: Column) -> Column:
    low = F.lower(content)
    return (
        F.when(low.contains("react-router") | low.contains("reactrouter"), "react")
        .when(content.contains("createBrowserRouter") | content.contains("BrowserRouter"), "react")
        .when(low.contains("vue-router") | low.contains("createrouter"), "vue")
        .when(content.contains("next/router") | content.contains("useRouter"), "nextjs")
        .when(content.contains("next/navigation"), "nextjs")
        .otherwise("unknown")
    )


def route_name(identifier: Column) -> Column:
    """Identifier without Page/View/Component, a space before each capital."""
    bare = identifier
    for word in ("Page", "View", "Component"):
        bare = F.replace(bare, F.lit(word), F.lit(""))
    return F.coalesce(non_empty(strip(F.regexp_replace(bare, r"([A-Z])", " $1"))), identifier)


def extract_routes(files: DataFrame) -> DataFrame:
    """Declared routes of React, Vue and Next files."""
    src = files.withColumn("framework", router_framework(F.col("content")))
    by_line = (
        src.where(F.col("framework").isin("react", "vue"))
        .select("project_id", "path", "framework", F.posexplode_outer(lines_of(F.col("content"))).alias("pos", "line"))
        .withColumn(
            "found",
            F.when(F.col("framework") == "react", rule_matches("line", R.ROUTE_RULES["react"])).otherwise(
                rule_matches("line", R.ROUTE_RULES["vue"])
            ),
        )
        .select("project_id", "path", "framework", (F.col("pos") + 1).alias("line_no"), F.explode_outer("found").alias("m"))
        .where("m.rule is not null")
        .select(
            "project_id",
            "path",
            "framework",
            "line_no",
            F.col("m.kind").alias("rule"),
            F.col("m.a").alias("route_path"),
            F.col("m.b").alias("component"),
            route_name(F.coalesce(non_empty(F.col("m.b")), F.col("m.a"))).alias("name"),
        )
    )
    page = F.when(F.col("path").rlike(r"(^|/)pages/"), extract(F.col("path"), R.NEXT_PAGE))
    app = F.when(F.col("path").rlike(r"(^|/)app/"), extract(F.col("path"), R.NEXT_APP))
    page_route = F.when(page == "index", F.lit("/")).otherwise(F.concat(F.lit("/"), page))
    found = F.array(
        F.struct(F.lit("nextjs-pages").alias("rule"), page_route.alias("p"), page.alias("c"), page.alias("n")),
        F.struct(
            F.lit("nextjs-app").alias("rule"),
            F.concat(F.lit("/"), app).alias("p"),
            F.concat(app, F.lit("Page")).alias("c"),
            app.alias("n"),
        ),
    )
    by_path = (
        src.where(F.col("framework") == "nextjs")
        .select("project_id", "path", "framework", F.inline(F.filter(found, lambda m: m["n"].isNotNull())))
        .select(
            "project_id",
            "path",
            "framework",
            F.lit(0).alias("line_no"),
            "rule",
            F.col("p").alias("route_path"),
            F.col("c").alias("component"),
            F.col("n").alias("name"),
        )
    )
    return by_line.unionByName(by_path)


def route_tree(routes: DataFrame) -> DataFrame:
    """Parent path and depth of every route, and whether the file declares the parent.

    Roots are ``/`` and relative paths. Routes below a missing parent are kept.
    """
    path = F.col("route_path")
    is_root = (path == "/") | ~path.startswith("/")
    parent = F.when(~is_root, F.coalesce(non_empty(F.regexp_replace(path, r"/[^/]*$", "")), F.lit("/")))
    known = routes.select("project_id", "path", F.col("route_path").alias("parent_path"), F.lit(True).alias("found")).distinct()
    depth = F.when(is_root, 0).otherwise(F.size(F.split(path, "/")) - 1)
    return (
        routes.withColumn("parent_path", parent)
        .withColumn("depth", depth)
        .join(known, ["project_id", "path", "parent_path"], "left")
        .select(
            "project_id", "path", "line_no", "rule", "route_path", "parent_path", "depth",
            F.coalesce("found", F.lit(False)).alias("parent_declared"),
        )
    )


def action_name(handler: Column) -> Column:
    """Display name of a handler: first known verb inside it, else the bare handler."""
    low = F.lower(handler)
    table = F.expr("array(" + ", ".join(f"struct('{k}' as k, '{v}' as v)" for k, v in R.UI_NAMES.items()) + ")")
    known = first_of(F.filter(table, lambda e: F.contains(low, e["k"])))["v"]

    def without(*words: str) -> Column:
        out = handler
        for w in words:
            out = F.replace(out, F.lit(w), F.lit(""))
        return out

    return F.coalesce(
        known,
        F.when(handler.startswith("handle"), without("handle", "Handle"))
        .when(handler.startswith("on"), without("on", "On"))
        .otherwise(handler),
    )


def extract_ui_actions(files: DataFrame) -> DataFrame:
    """Clicks, submits, fetches, navigations and state hooks, one row per rule match."""
    rows = files.select("project_id", "path", F.posexplode_outer(lines_of(F.col("content"))).alias("pos", "line"))
    rows = rows.select(
        "project_id", "path", (F.col("pos") + 1).alias("line_no"), F.explode_outer(rule_matches("line", R.UI_RULES)).alias("m")
    ).where("m.rule is not null")
    a, b, kind = F.col("m.a"), F.col("m.b"), F.col("m.kind")
    target = F.when(kind == "state", F.coalesce(non_empty(a), b)).otherwise(a)
    call = F.concat_ws(" ", F.coalesce(non_empty(F.upper(b)), F.lit("GET")), a)
    description = F.lit(None).cast("string")
    for k, text in R.UI_DESCRIPTIONS.items():
        description = F.when(kind == k, F.concat(F.lit(text), call if k == "fetch" else target)).otherwise(description)
    return rows.select(
        "project_id",
        "path",
        "line_no",
        kind.alias("type"),
        F.col("m.rule").alias("rule"),
        F.when(kind == "navigation", F.lit(R.UI_NAVIGATION_NAME))
        .when(kind == "fetch", F.concat(action_name(a), F.lit(R.UI_FETCH_NAME)))
        .when(kind == "state", F.concat(target, F.lit(R.UI_STATE_NAME)))
        .otherwise(action_name(a))
        .alias("name"),
        F.when(kind == "navigation", F.concat(F.lit("navigate("), a, F.lit(")")))
        .when(kind == "fetch", call)
        .when(kind == "state", F.concat(F.lit("useState("), target, F.lit(")")))
        .otherwise(a)
        .alias("handler"),
        description.alias("description"),
        F.when(kind.isin("fetch", "navigation"), a).alias("param"),
    )


def ui_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("project_id", "path", "type").agg(F.count("*").alias("n"))


def normalize_api_path(path: Column) -> Column:
    clean = F.regexp_replace(F.btrim(path, F.lit("\"'")), r"\$\{[^}]+\}", ":param")
    clean = F.regexp_replace(clean, "`([^`]+)`", "$1")
    as_is = clean.startswith("${") | clean.startswith("`") | clean.startswith("/") | clean.startswith("http")
    return F.when(as_is, clean).otherwise(F.concat(F.lit("/"), clean))


def jquery_method(line: Column) -> Column:
    out = F.lit("GET")
    for verb in ("PATCH", "DELETE", "PUT", "POST"):
        hit = line.contains(f"$.{verb.lower()}") | (line.contains("$.ajax") & line.contains(verb))
        out = F.when(hit, verb).otherwise(out)
    return out


def request_params(line: Column) -> Column:
    """Names inside the params, query, data and body blocks of a line."""
    blocks = F.flatten(F.array(*[F.regexp_extract_all(line, F.lit(p), 1) for p in R.PARAM_BLOCKS]))
    return F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(\w+)\s*:"), 1)))


def base_url(content: Column) -> Column:
    """Last base-address constant of a file (later patterns win)."""
    every = F.flatten(F.array(*[F.regexp_extract_all(content, F.lit(p), 1) for p in R.BASE_URL_PATTERNS]))
    return F.try_element_at(every, F.lit(-1))


def extract_api_calls(files: DataFrame, dedupe: bool = True) -> DataFrame:
    """Client API calls with enclosing function, parameters and request body.

    A call text may match several rules; ``dedupe`` keeps the first rule per
    line and path, ``dedupe=False`` returns every match.
    """
    lines = F.col("lines")
    src = files.select("project_id", "path", base_url(F.col("content")).alias("base_url"), lines_of(F.col("content")).alias("lines"))
    named = F.transform(lines, lambda x, i: F.struct((i + 1).alias("at"), first_extract(x, R.CONTEXT_PATTERNS).alias("name")))
    marks = F.filter(named, lambda m: m["name"].isNotNull())
    # one row per stretch of lines with the same enclosing function
    parts = src.select(
        "project_id", "path", "base_url", "lines", F.explode_outer(segments(marks, F.size(lines), "anonymous")).alias("s")
    )
    rows = parts.select(
        "project_id", "path", "base_url", "lines", "s", F.posexplode(F.slice(lines, F.col("s.first"), F.col("s.length"))).alias("pos", "line")
    )
    found = F.transform(
        rule_matches("line", R.API_CALL_RULES),
        lambda m: F.struct(m["rule"].alias("rule"), m["kind"].alias("kind"), normalize_api_path(m["a"]).alias("api_path"), m["b"].alias("verb")),
    )
    hits = rows.select("project_id", "path", "base_url", "lines", "s", "pos", "line", found.alias("found")).where(F.size("found") > 0)
    kept = F.col("found")
    if dedupe:
        kept = F.filter(
            F.col("found"), lambda m, i: ~F.exists(F.slice(F.col("found"), F.lit(1), i), lambda o: o["api_path"] == m["api_path"])
        )
    line_no = F.col("s.first") + F.col("pos")
    calls = hits.select(
        "project_id",
        "path",
        "base_url",
        line_no.alias("line_no"),
        F.col("s.name").alias("function_name"),
        F.array_join(request_params(F.col("line")), ",").alias("params"),
        first_in(F.slice(lines, line_no, 10), R.BODY_LITERAL).alias("request_body"),
        jquery_method(F.col("line")).alias("jquery"),
        F.explode_outer(kept).alias("m"),
    )
    kind = F.col("m.kind")
    method = F.when(kind == "match", F.upper("m.verb")).when(kind == "jquery", F.col("jquery")).otherwise(kind)
    return calls.select(
        "project_id", "path", "line_no", F.col("m.rule").alias("rule"), method.alias("method"), F.col("m.api_path").alias("api_path"),
        "function_name", "params", "request_body", "base_url",
    )


def api_call_summary(calls: DataFrame) -> DataFrame:
    return calls.groupBy("project_id", "path", "method").agg(
        F.count("*").alias("calls"), F.countDistinct("api_path").alias("unique_paths")
    )


def endpoint_index(calls: DataFrame) -> DataFrame:
    """Calls grouped by ``METHOD path``."""
    return calls.groupBy("project_id", F.concat_ws(" ", "method", "api_path").alias("endpoint")).agg(
        F.count("*").alias("calls"), F.countDistinct("path").alias("files")
    )
