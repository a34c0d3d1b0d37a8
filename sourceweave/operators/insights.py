"""Feature mining over whole projects, the feature tree, and top-N insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.operators.endpoints import dedupe_endpoints, extract_endpoints
from sourceweave.operators.frontend import extract_api_calls, extract_routes, extract_ui_actions
from sourceweave.operators.infra import detect_features
from sourceweave.operators.models import extract_models, model_fields
from sourceweave.sources.files import file_name, file_role, skip_filter


def feature_mine(files: DataFrame) -> dict[str, DataFrame]:
    """The six feature tables of every project: front-end, back-end and shared files."""
    kept = skip_filter(files, "features").withColumn("role", file_role(F.col("path")))
    front, back = kept.where("role = 'frontend'").drop("role"), kept.where("role = 'backend'").drop("role")
    both = kept.where("role <> 'other'").drop("role")
    return {
        "routes": extract_routes(front),
        "ui_actions": extract_ui_actions(front),
        "api_calls": extract_api_calls(front),
        "endpoints": dedupe_endpoints(extract_endpoints(back)),
        "models": extract_models(back),
        "features": detect_features(both),
    }


def _key(*cols) -> Column:
    """Stable node id from the natural key of a node."""
    return F.md5(F.concat_ws("\u0001", *[c if isinstance(c, Column) else F.col(c) for c in cols]))


SECTIONS = {
    "routes": ("frontend", "route"),
    "pages": ("frontend", "page"),
    "api_calls": ("frontend", "api"),
    "apis": ("backend", "api"),
    "system": ("backend", "system"),
    "models": ("backend", "model"),
}


def feature_tree(mined: dict[str, DataFrame], projects: DataFrame) -> DataFrame:
    """Flat tree: two roots per project, six sections, their items and sub-items."""

    def section_id(name: str) -> Column:
        return _key("project_id", F.lit("section"), F.lit(name))

    def rows(df: DataFrame, section: str, type_: str, id_: Column, parent: Column, name: Column, path, line) -> DataFrame:
        return df.select(
            "project_id",
            id_.alias("node_id"),
            parent.alias("parent_id"),
            F.lit(SECTIONS[section][0]).alias("category"),
            F.lit(section).alias("section"),
            F.lit(type_).alias("type"),
            name.alias("name"),
            path.alias("path"),
            line.cast("int").alias("line_no"),
        )

    heads = F.array(
        *[
            F.struct(
                _key("project_id", F.lit("root"), F.lit(cat)).alias("node_id"),
                F.lit(None).cast("string").alias("parent_id"),
                F.lit(cat).alias("category"),
                F.lit("").alias("section"),
                F.lit("component").alias("type"),
                F.lit(cat).alias("name"),
            )
            for cat in ("frontend", "backend")
        ],
        *[
            F.struct(
                section_id(name).alias("node_id"),
                _key("project_id", F.lit("root"), F.lit(cat)).alias("parent_id"),
                F.lit(cat).alias("category"),
                F.lit(name).alias("section"),
                F.lit(type_).alias("type"),
                F.lit(name).alias("name"),
            )
            for name, (cat, type_) in SECTIONS.items()
        ],
    )
    out = projects.select("project_id", F.inline(heads)).select(
        "*", F.lit("").alias("path"), F.lit(0).alias("line_no")
    )
    path, line, name = F.col("path"), F.col("line_no"), F.col("name")
    page_id = _key("project_id", F.lit("page"), "path")
    page_name = file_name(path)
    for ext in (".tsx", ".ts", ".jsx", ".js"):
        page_name = F.replace(page_name, F.lit(ext), F.lit(""))
    verb = F.concat_ws(" ", "method", "api_path")
    routes, actions, calls = mined["routes"], mined["ui_actions"], mined["api_calls"]
    model_id = _key("project_id", F.lit("model"), "path", "line_no", "name")
    fields = model_fields(mined["models"])
    field_parent = _key("project_id", F.lit("model"), "path", "line_no", "model")
    parts = [
        rows(routes, "routes", "route", _key("project_id", F.lit("route"), "path", "line_no", "rule", "route_path"), section_id("routes"), name, path, line),
        rows(actions.select("project_id", "path").distinct(), "pages", "page", page_id, section_id("pages"), page_name, path, F.lit(0)),
        rows(actions, "pages", "function", _key("project_id", F.lit("function"), "path", "line_no", "rule", "handler"), page_id, name, path, line),
        rows(calls, "api_calls", "api", _key("project_id", F.lit("call"), "path", "line_no", "rule", verb), section_id("api_calls"), verb, path, line),
        rows(mined["endpoints"], "apis", "api", _key("project_id", F.lit("api"), verb), section_id("apis"), verb, path, line),
        rows(mined["features"], "system", "system", _key("project_id", F.lit("system"), "path", "line_no", "type"), section_id("system"), name, path, line),
        rows(mined["models"], "models", "model", model_id, section_id("models"), name, path, line),
        rows(fields, "models", "model", _key(field_parent, "ordinal"), field_parent, name, F.lit(""), F.lit(0)),
    ]
    for part in parts:
        out = out.unionByName(part)
    return out


def tree_counts(tree: DataFrame) -> DataFrame:
    """Descendants by type below each root; every row knows its root, so nothing recurses."""
    return tree.where(F.col("parent_id").isNotNull()).groupBy("project_id", "category", "type").agg(F.count("*").alias("n"))


def tree_find(tree: DataFrame, node_id: str | None = None, type_: str | None = None) -> DataFrame:
    out = tree
    if node_id is not None:
        out = out.where(F.col("node_id") == node_id)
    if type_ is not None:
        out = out.where(F.col("type") == type_)
    return out


def arch_modules(tree: DataFrame, limit: int = 10) -> DataFrame:
    """Leaf nodes of each side, the first ``limit`` of each in section, file and line order."""
    # one pass over the tree: each node arrives as itself and as its parent's child mark
    row = F.struct("project_id", "category", "section", "path", "line_no", "name", "type")
    marks = F.array(
        F.struct(F.col("node_id").alias("node_id"), F.when(F.col("parent_id").isNotNull(), row).alias("row"), F.lit(False).alias("is_parent")),
        F.struct(F.col("parent_id").alias("node_id"), F.lit(None).cast(tree.select(row.alias("r")).schema["r"].dataType).alias("row"), F.lit(True).alias("is_parent")),
    )
    nodes = tree.select(F.inline(marks)).where("node_id is not null").groupBy("node_id").agg(F.max("row").alias("row"), F.max("is_parent").alias("is_parent"))
    leaves = nodes.where("not is_parent and row is not null").select("node_id", "row.*")
    order = Window.partitionBy("project_id", "category").orderBy("section", "path", "line_no", "name", "node_id")
    return leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(
        "project_id", "category", "rank", "type", "name"
    )


# --- insights ------------------------------------------------------------------


def top_n(counts: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Rank ``(name, n)`` rows by count then name inside ``keys``; keeps the first ``n``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "name")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _files_of(*tables: DataFrame) -> DataFrame:
    out = None
    for t in tables:
        one = t.select("project_id", "path")
        out = one if out is None else out.unionByName(one)
    return out


def _tops(pairs: list[tuple[str, DataFrame, Column]], n: int) -> DataFrame:
    """Top-``n`` names of several lists: ``(project_id, list, rank, name, n)``."""
    out = None
    for label, df, name in pairs:
        counts = df.groupBy("project_id", F.lit(label).alias("list"), name.alias("name")).agg(F.count("*").alias("n"))
        out = counts if out is None else out.unionByName(counts)
    return top_n(out, n, ["project_id", "list"]).select("project_id", "list", "rank", "name", "n")


def _per_project(tables: dict[str, DataFrame], flags: dict[str, Column] | None = None) -> DataFrame:
    """Row counts per project and table in one aggregation over a tagged union."""
    out = None
    for label, df in tables.items():
        extra = {k: (c if label == k.split(".")[0] else F.lit(False)) for k, c in (flags or {}).items()}
        one = df.select("project_id", "path", F.lit(label).alias("src"), *[c.alias(k) for k, c in extra.items()])
        out = one if out is None else out.unionByName(one)
    return out


def frontend_insights(mined: dict[str, DataFrame]) -> DataFrame:
    """Counts and highlight codes per project."""
    tagged = _per_project(
        {"routes": mined["routes"], "ui_actions": mined["ui_actions"], "api_calls": mined["api_calls"]},
        {"ui_actions.state": F.col("type") == "state"},
    )
    sums = tagged.groupBy("project_id").agg(
        F.count_if(F.col("src") == "routes").alias("route_count"),
        F.count_if(F.col("src") == "ui_actions").alias("page_function_count"),
        F.count_if(F.col("src") == "api_calls").alias("api_call_count"),
        F.count_if(F.col("`ui_actions.state`")).alias("state_count"),
        F.countDistinct("path").alias("active_file_count"),
    )
    codes = [
        F.when(F.col("route_count") > 20, "many_routes"),
        F.when(F.col("state_count") > 30, "much_state"),
        F.when(F.col("api_call_count") > 40, "many_api_calls"),
    ]
    return sums.select(
        "project_id", "route_count", "page_function_count", "api_call_count", "active_file_count", _codes(codes)
    )


def _codes(codes: list[Column]) -> Column:
    text = F.concat_ws(",", *codes)
    return F.when(text == "", "clear").otherwise(text).alias("highlights")


def frontend_top(mined: dict[str, DataFrame], n: int = 6) -> DataFrame:
    files = _files_of(mined["routes"], mined["ui_actions"], mined["api_calls"])
    return _tops([("types", mined["ui_actions"], F.col("type")), ("files", files, F.col("path"))], n)


def sample_routes(mined: dict[str, DataFrame], n: int = 8) -> DataFrame:
    """First ``n`` route paths of each project in file, line and rule order."""
    order = Window.partitionBy("project_id").orderBy("path", "line_no", "rule", "route_path")
    ranked = mined["routes"].withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("project_id", "rank", "route_path")


def _top_text(counts: Column, n: int) -> Column:
    """``name:count`` of the ``n`` largest entries of a ``name -> count`` entry array."""
    ordered = F.array_sort(F.transform(counts, lambda e: F.struct((-e["n"]).alias("neg"), e["name"].alias("name"))))
    return F.array_join(F.transform(F.slice(ordered, 1, n), lambda e: F.concat_ws(":", e["name"], (-e["neg"]).cast("string"))), ",")


def _count_by(df: DataFrame, name: str, label: str) -> DataFrame:
    """Per file: entries ``(name, n)``; at most one entry per known name."""
    counts = df.groupBy("project_id", "path", F.col(name).alias("name")).agg(F.count("*").alias("n"))
    return counts.groupBy("project_id", "path").agg(F.collect_list(F.struct("name", "n")).alias(label), F.sum("n").alias(f"{label}_n"))


def _first_paths(df: DataFrame, column: str, n: int, label: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy("project_id", "path").orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    rows = F.array_sort(F.collect_list(F.struct("rank", column)))
    return ranked.groupBy("project_id", "path").agg(F.array_join(F.transform(rows, lambda r: r[column]), ",").alias(label))


def _full(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, ["project_id", "path"], "full_outer")
    return out


def frontend_file_insights(mined: dict[str, DataFrame]) -> DataFrame:
    """Per file: counts, top-3 action types, first 5 routes, highlight codes."""
    empty = F.array().cast("array<struct<name:string,n:bigint>>")
    routes = mined["routes"].groupBy("project_id", "path").agg(F.count("*").alias("routes_n"))
    calls = mined["api_calls"].groupBy("project_id", "path").agg(F.count("*").alias("calls_n"))
    acts = _count_by(mined["ui_actions"], "type", "acts")
    first = _first_paths(mined["routes"], "route_path", 5, "first_routes", ["line_no", "rule", "route_path"])
    j = _full(routes, acts, calls, first)
    types = F.coalesce("acts", empty)
    state = F.coalesce(F.try_element_at(F.map_from_entries(types), F.lit("state")), F.lit(0))
    r, c = F.coalesce("routes_n", F.lit(0)), F.coalesce("calls_n", F.lit(0))
    return j.select(
        "project_id",
        "path",
        r.alias("route_count"),
        F.coalesce("acts_n", F.lit(0)).alias("page_function_count"),
        c.alias("api_call_count"),
        _top_text(types, 3).alias("top_types"),
        F.coalesce("first_routes", F.lit("")).alias("sample_routes"),
        _codes([F.when(r >= 3, "many_routes"), F.when(state >= 4, "much_state"), F.when(c >= 4, "many_api_calls")]),
    )


def path_group(path: Column) -> Column:
    """First path segment, ``root`` when there is none."""
    bare = F.btrim(path, F.lit("/"))
    return F.when(bare == "", "root").otherwise(F.split(bare, "/")[0])


def backend_insights(mined: dict[str, DataFrame]) -> DataFrame:
    tagged = _per_project(
        {"endpoints": mined["endpoints"], "models": mined["models"], "features": mined["features"]},
        {"endpoints.auth": F.col("auth_required"), "features.middleware": F.col("type") == "middleware"},
    )
    sums = tagged.groupBy("project_id").agg(
        F.count_if(F.col("src") == "endpoints").alias("api_count"),
        F.count_if(F.col("src") == "models").alias("model_count"),
        F.count_if(F.col("src") == "features").alias("system_feature_count"),
        F.count_if(F.col("`endpoints.auth`")).alias("auth_api_count"),
        F.count_if(F.col("`features.middleware`")).alias("middleware"),
        F.countDistinct("path").alias("active_file_count"),
    )
    auth = F.col("auth_api_count")
    codes = [
        F.when(F.col("api_count") > 50, "many_apis"),
        F.when(F.col("model_count") > 20, "many_models"),
        F.when((auth > 0) & (auth < F.col("api_count") * 0.3), "low_auth"),
        F.when(F.col("middleware") > 8, "much_middleware"),
    ]
    return sums.select(
        "project_id", "api_count", "model_count", "system_feature_count", "auth_api_count", "active_file_count", _codes(codes)
    )


def backend_top(mined: dict[str, DataFrame], n: int = 6) -> DataFrame:
    files = _files_of(mined["endpoints"], mined["models"], mined["features"])
    return _tops(
        [
            ("methods", mined["endpoints"], F.upper("method")),
            ("groups", mined["endpoints"], path_group(F.col("api_path"))),
            ("features", mined["features"], F.col("type")),
            ("files", files, F.col("path")),
        ],
        n,
    )


def backend_file_insights(mined: dict[str, DataFrame]) -> DataFrame:
    empty = F.array().cast("array<struct<name:string,n:bigint>>")
    auth = mined["endpoints"].groupBy("project_id", "path").agg(F.count_if("auth_required").alias("auth_n"))
    apis = _count_by(mined["endpoints"], "method", "apis")
    models = mined["models"].groupBy("project_id", "path").agg(F.count("*").alias("models_n"))
    feats = _count_by(mined["features"], "type", "feats")
    first = _first_paths(mined["endpoints"], "api_path", 5, "first_paths", ["line_no", "method", "api_path"])
    j = _full(apis, auth, models, feats, first)
    a, m = F.coalesce("apis_n", F.lit(0)), F.coalesce("models_n", F.lit(0))
    f, au = F.coalesce("feats_n", F.lit(0)), F.coalesce("auth_n", F.lit(0))
    return j.select(
        "project_id",
        "path",
        a.alias("api_count"),
        m.alias("model_count"),
        f.alias("system_feature_count"),
        au.alias("auth_api_count"),
        _top_text(F.coalesce("apis", empty), 3).alias("top_methods"),
        _top_text(F.coalesce("feats", empty), 3).alias("top_features"),
        F.coalesce("first_paths", F.lit("")).alias("sample_paths"),
        _codes(
            [
                F.when(a >= 6, "many_apis"),
                F.when(m >= 3, "many_models"),
                F.when(f >= 5, "many_features"),
                F.when((au > 0) & (au < a * 0.3), "low_auth"),
            ]
        ),
    )
