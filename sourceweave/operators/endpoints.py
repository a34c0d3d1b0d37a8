"""Server endpoints of FastAPI, Flask, Express and Spring files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.functions import rules as R
from sourceweave.functions.lines import (
    contains_any,
    extract,
    first_extract,
    first_in,
    first_of,
    let,
    lines_of,
    non_empty,
    rule_matches,
    strip,
    title_case,
)


def backend_framework(content: Column) -> Column:
    low = F.lower(content)
    return (
        F.when(low.contains("fastapi") | content.contains("APIRouter"), "fastapi")
        .when(low.contains("flask") | content.contains("@app.route"), "flask")
        .when(low.contains("express") | content.contains("app.get") | content.contains("router.get"), "express")
        .when(contains_any(content, ["@RestController", "@Controller", "@GetMapping"]), "spring")
        .otherwise("unknown")
    )


def _after(n: int) -> Column:
    return F.slice("lines", F.col("line_no") + 1, n)


def _before(n: int) -> Column:
    """The declaration line and those above it, nearest first; the first line of a file is not looked at."""
    lo = F.greatest(F.col("line_no") - n, F.lit(0)) + 2
    return F.reverse(F.slice("lines", lo, F.greatest(F.col("line_no") - lo + 1, F.lit(0))))


def handler_name() -> Column:
    fw = F.col("framework")
    arrow = r"(?:async\s+)?\([^)]*\)\s*=>"
    script = first_of(
        F.filter(
            F.transform(
                _after(5),
                lambda x: F.coalesce(extract(x, r"(?:async\s+)?function\s+(\w+)"), F.when(x.rlike(arrow), "arrow_function")),
            ),
            lambda x: x.isNotNull(),
        )
    )
    return F.coalesce(
        F.when(fw.isin("fastapi", "flask"), first_in(_after(10), r"def\s+(\w+)"))
        .when(fw == "express", script)
        .otherwise(first_in(_after(5), r"public\s+\w+\s+(\w+)\s*\(")),
        F.lit("anonymous"),
    )


def endpoint_doc() -> Column:
    """Docstring below (Python) or comment above (Express, Spring) the declaration."""
    window = F.transform(_after(11), lambda x: strip(x))

    def text(i: Column) -> Column:
        body = F.btrim(F.btrim(F.get(window, i), F.lit('"')), F.lit("'"))
        return F.coalesce(non_empty(body), F.get(window, i + 1))

    quoted = F.filter(
        F.transform(F.sequence(F.lit(0), F.least(F.lit(9), F.size(window) - 1)), lambda i: F.when(F.get(window, i).rlike("^(\"\"\"|''')"), text(i))),
        lambda t: t.isNotNull(),
    )
    doc = F.when(F.size(window) > 0, first_of(quoted))
    script = first_of(F.filter(F.transform(_before(5), lambda x: strip(x)), lambda x: x.rlike(r"^(//|\*|/\*)")))
    script = (
        F.when(script.startswith("//"), strip(F.substr(script, F.lit(3))))
        .when(script.startswith("*"), strip(F.substr(script, F.lit(2))))
        .otherwise(strip(F.btrim(F.substr(script, F.lit(3)), F.lit("*/"))))
    )
    java = first_of(
        F.filter(F.transform(_before(10), lambda x: strip(x)), lambda x: (x.startswith("*") & ~x.startswith("*/")) | x.startswith("/**"))
    )
    java = F.when(java.startswith("*"), strip(F.substr(java, F.lit(2)))).otherwise(
        strip(F.btrim(F.substr(java, F.lit(4)), F.lit("*/")))
    )
    fw = F.col("framework")
    return F.coalesce(F.when(fw.isin("fastapi", "flask"), doc).when(fw == "express", script).otherwise(java), F.lit(""))


def endpoint_params() -> Column:
    """``name:kind:required`` of the typed parameters in the next 15 lines."""
    typed = r"(\w+):\s*(?:str|int|float)"
    default = r"(\w+):\s*(?:Optional\[)?(\w+)(?:\])?\s*=\s*(.+)"
    per_line = F.transform(
        _after(15),
        lambda x: F.array_compact(
            F.array(
                F.concat(extract(x, typed), F.lit(":path:true")),
                F.concat(extract(x, default), F.lit(":query:"), (~x.contains("Optional")).cast("string")),
            )
        ),
    )
    return F.array_join(F.flatten(per_line), ",")


def extract_endpoints(files: DataFrame) -> DataFrame:
    """One row per declared endpoint (and per method for Flask)."""
    content = F.col("content")
    src = files.select(
        "project_id",
        "path",
        backend_framework(content).alias("framework"),
        F.coalesce(first_extract(content, R.ROUTER_PREFIXES), F.lit("")).alias("prefix"),
        lines_of(content).alias("lines"),
    ).where("framework <> 'unknown'")
    found = F.lit(None)
    for fw, rule in reversed(R.ENDPOINT_RULES.items()):
        found = F.when(F.col("framework") == fw, rule_matches("line", [rule])).otherwise(found)
    rows = src.select("project_id", "path", "framework", "prefix", "lines", F.posexplode_outer("lines").alias("pos", "line"))
    hits = rows.select(
        "project_id", "path", "framework", "prefix", "lines", (F.col("pos") + 1).alias("line_no"), "line", F.explode_outer(found).alias("m")
    ).where("m.rule is not null")
    fw, a, b = F.col("framework"), F.col("m.a"), F.col("m.b")
    prefixed = (fw == "fastapi") & (F.col("prefix") != "") & ~a.startswith(F.col("prefix"))
    spring = F.create_map(*[F.lit(x) for pair in R.SPRING_METHODS.items() for x in pair])
    flask_methods = F.regexp_extract_all(b, F.lit(r"""["'](\w+)["']"""), 1)
    methods = (
        F.when(fw == "flask", F.when(F.size(flask_methods) == 0, F.array(F.lit("GET"))).otherwise(flask_methods))
        .when(fw == "spring", F.array(F.try_element_at(spring, b)))
        .otherwise(F.array(b))
    )
    python, fastapi = fw.isin("fastapi", "flask"), fw == "fastapi"
    return hits.select(
        "project_id",
        "path",
        "framework",
        "line_no",
        F.explode_outer(methods).alias("verb"),
        F.when(prefixed, F.concat("prefix", a)).otherwise(a).alias("api_path"),
        handler_name().alias("handler"),
        endpoint_doc().alias("description"),
        (python & F.exists(_after(15), lambda x: contains_any(x, R.AUTH_INDICATORS))).alias("auth_required"),
        F.when(fastapi, endpoint_params()).otherwise("").alias("params"),
        F.when(fastapi, first_in(_after(15), r"(?:data|body|request):\s*(\w+)")).alias("request_body"),
        F.when(fastapi, extract(F.col("line"), r"response_model\s*=\s*(\w+)")).alias("response_model"),
        F.when(
            fastapi,
            F.array_join(
                F.regexp_extract_all(F.regexp_extract("line", r"tags\s*=\s*\[([^\]]+)\]", 1), F.lit(r"""["']([^"']+)["']"""), 1), ","
            ),
        )
        .otherwise("")
        .alias("tags"),
    ).select(
        "project_id", "path", "framework", "line_no", F.upper("verb").alias("method"), "api_path", "handler", "description",
        "auth_required", "params", "request_body", "response_model", "tags",
    )


def dedupe_endpoints(endpoints: DataFrame) -> DataFrame:
    """First endpoint per project, method and path in (file, line) order.

    ``min_by`` is combined map-side, so a path declared very often still sends
    one row per task.
    """
    keys = ["project_id", "method", "api_path"]
    rest = [c for c in endpoints.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct("path", "line_no"))
    return endpoints.groupBy(*keys).agg(first.alias("e")).select(*keys, "e.*")


def endpoint_summary(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("project_id", "method").agg(
        F.count("*").alias("endpoints"),
        F.count_if("auth_required").alias("auth_required"),
        F.count_if(~F.col("auth_required")).alias("auth_optional"),
        F.countDistinct("api_path").alias("paths"),
    )


def api_module(path: Column) -> Column:
    """Title-cased first path part (two parts below ``api``, ``v1``, ``v2``); ``Default`` for one part."""
    return let(
        F.split(F.btrim(path, F.lit("/")), "/"),
        lambda p: F.when(F.size(p) <= 1, F.lit("Default"))
        .when(p[0].isin(R.API_VERSION_PARTS), F.concat_ws(" ", title_case(p[0]), title_case(p[1])))
        .otherwise(title_case(p[0])),
    )


def endpoints_by_module(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("project_id", api_module(F.col("api_path")).alias("module")).agg(
        F.count("*").alias("endpoints"), F.countDistinct("method").alias("methods")
    )


def api_candidate_files(files: DataFrame, max_files: int | None = None, max_chars: int | None = None) -> DataFrame:
    """API-like files by folder and name; where asked the first ``max_files`` per project, larger ones left out."""
    path = F.col("path")
    exts = "|".join(R.API_CANDIDATE_EXTENSIONS)
    words = "|".join(R.API_CANDIDATE_WORDS)
    dirs = "|".join(R.API_CANDIDATE_DIRS)
    named = path.rlike(rf"(^|/)[^/]*({words})[^/]*\.({exts})$")
    placed = path.rlike(rf"^({dirs})/") | ~path.contains("/")
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("path"))
    picked = files.where(named & placed).withColumn("rank", rank)
    picked = picked if max_files is None else picked.where(F.col("rank") <= max_files)
    return picked if max_chars is None else picked.where(F.length("content") <= max_chars)
