"""Call graphs and module dependency graphs as vertex and edge tables.

Edges are joined on their end points; no step collects the neighbours of a
vertex. Iterative operators cut their lineage with a reliable checkpoint once
per round and stop when a round adds nothing.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.functions.lines import non_empty, strip
from sourceweave.operators.symbols import file_counts, file_facts
from sourceweave.session import both_sided, cut_lineage
from sourceweave.sources.files import file_name, manifest_scan, skip_filter

# --- fixed values --------------------------------------------------------------------
PACKAGE_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
PYPROJECT_IGNORED = ["python", "setuptools", "wheel"]
#: Rows of one task in a join of prefixes, and names of a project whose prefixes are merged.
PREFIX_ROWS, BUNDLE = 250_000, 256
ROOT_MODULES = ["__init__.py", "__init__.ts", "__init__.js"]

# --- call graph ----------------------------------------------------------------------


def call_nodes(functions: DataFrame) -> DataFrame:
    """One node per function ``path:name`` or method ``path:Class.name`` (last definition in a file wins)."""
    full = F.when(F.col("class_name") != "", F.concat_ws(".", "class_name", "name")).otherwise(F.col("name"))
    rows = functions.select(
        "project_id",
        F.concat_ws(":", "path", full).alias("id"),
        "name",
        full.alias("full_name"),
        "path",
        F.col("start_line").alias("line"),
        F.when(F.col("class_name") != "", "method").otherwise("function").alias("type"),
        "class_name",
    )
    last = F.max_by(F.struct("name", "full_name", "path", "line", "type", "class_name"), "line")
    return rows.groupBy("project_id", "id").agg(last.alias("n")).select("project_id", "id", "n.*")


def call_edges(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls resolved to nodes: ``(project_id, src, dst, path, line)``.

    Caller: same-file node with that simple name (earliest line), else the
    project-wide definition. Callee: project-wide definition of the text as
    written. Where a name is defined more than once the greatest path wins.
    Calls at module level and unresolved calls are dropped.
    """
    local = nodes.groupBy("project_id", "path", F.col("name").alias("caller")).agg(F.min_by("id", F.struct("line", "id")).alias("local_id"))
    # a definition is known by its full name: ``f`` or ``Class.f``
    known = nodes.groupBy("project_id", "full_name").agg(F.max_by("id", F.struct("path", "line")).alias("known_id"))
    rows = calls.where((F.col("caller") != "") & ~F.col("callee").startswith("."))
    # the caller and callee names repeat a lot; resolve each distinct pair once per file
    pairs = rows.select("project_id", "path", "caller", "callee").distinct()
    resolved = (
        pairs.join(both_sided(known.select("project_id", F.col("full_name").alias("callee"), F.col("known_id").alias("dst"))), ["project_id", "callee"])
        .join(both_sided(local), ["project_id", "path", "caller"], "left")
        .join(both_sided(known.select("project_id", F.col("full_name").alias("caller"), "known_id")), ["project_id", "caller"], "left")
        .select("project_id", "path", "caller", "callee", F.coalesce("local_id", "known_id").alias("src"), "dst")
        .where("src is not null")
    )
    return rows.join(both_sided(resolved), ["project_id", "path", "caller", "callee"]).select("project_id", "src", "dst", "path", F.col("line_no").alias("line"))


def _without(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    touched = edges.select("project_id", F.col(end).alias("id")).distinct()
    return nodes.join(both_sided(touched), ["project_id", "id"], "left_anti").select("project_id", "id")


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes nobody calls."""
    return _without(nodes, edges, "dst")


def leaf_functions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that call nothing."""
    return _without(nodes, edges, "src")


def neighbours(edges: DataFrame, ids: DataFrame, direction: str = "callees") -> DataFrame:
    """Distinct callees (or callers) of the given node ids."""
    here, there = ("src", "dst") if direction == "callees" else ("dst", "src")
    rows = edges.select("project_id", F.col(here).alias("id"), F.col(there).alias("other"))
    return rows.join(both_sided(ids.select("project_id", "id").distinct()), ["project_id", "id"], "left_semi").distinct()


def call_chain(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """Callers and callees of each seed with their smallest hop (0 = direct), all or up to ``depth`` hops.

    The frontier holds only nodes not seen before, so the rows joined per round
    shrink as the neighbourhood is exhausted.
    """
    unique = edges.select("project_id", "src", "dst").distinct()
    both = unique.select("project_id", F.lit("callees").alias("direction"), F.col("src").alias("at"), F.col("dst").alias("next")).unionByName(
        unique.select("project_id", F.lit("callers").alias("direction"), F.col("dst").alias("at"), F.col("src").alias("next"))
    )
    both = cut_lineage(both)
    start = seeds.select("project_id", F.col("id").alias("seed"), F.explode(F.array(F.lit("callers"), F.lit("callees"))).alias("direction"))
    keys = ["project_id", "seed", "direction"]
    frontier = start.withColumn("at", F.col("seed"))
    seen = None
    for hop in count() if depth is None else range(depth):
        step = frontier.join(both_sided(both), ["project_id", "direction", "at"]).select(*keys, F.col("next").alias("at")).distinct()
        if seen is not None:
            step = step.join(both_sided(seen.select(*keys, "at")), [*keys, "at"], "left_anti")
        frontier = cut_lineage(step)
        found = frontier.withColumn("hop", F.lit(hop))
        seen = found if seen is None else seen.unionByName(found)
        if frontier.isEmpty():
            break
    return seen.select("project_id", "seed", "direction", F.col("at").alias("id"), "hop")


def call_graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, entry points and leaves per project in one aggregation."""
    both = F.array(
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("node"), F.lit(1).alias("called"), F.lit(0).alias("calls")),
        F.struct(F.col("src").alias("id"), F.lit(0).alias("node"), F.lit(0).alias("called"), F.lit(1).alias("calls")),
    )
    ends = nodes.select("project_id", "id", F.lit(1).alias("node"), F.lit(0).alias("called"), F.lit(0).alias("calls")).unionByName(
        edges.select("project_id", F.inline(both))
    )
    per_id = ends.groupBy("project_id", "id").agg(F.max("node").alias("node"), F.sum("called").alias("called"), F.sum("calls").alias("calls"))
    return per_id.groupBy("project_id").agg(
        F.sum("node").alias("total_nodes"),
        F.sum("calls").alias("total_edges"),
        F.count_if((F.col("node") == 1) & (F.col("called") == 0)).alias("entry_points"),
        F.count_if((F.col("node") == 1) & (F.col("calls") == 0)).alias("leaf_functions"),
    )


def graph_export_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("project_id", "id", F.col("full_name").alias("label"), "path", "line", "type", "class_name")


def graph_export_edges(edges: DataFrame) -> DataFrame:
    """Edges with a stable id from their end points and line (independent of row order)."""
    key = F.concat_ws("\u0001", "src", "dst", "path", F.col("line").cast("string"))
    numbered = Window.partitionBy("project_id", "src", "dst", "path", "line").orderBy("src")
    return edges.select(
        "project_id", F.concat(F.lit("e"), F.md5(key), F.lit("-"), F.row_number().over(numbered).cast("string")).alias("edge_id"), "src", "dst", "path", "line"
    )


# --- module graph ---------------------------------------------------------------------


def module_name(path: Column, rooted: bool = True) -> Column:
    """Dotted module of a project-relative path; without a root the stem (or the folder for index files)."""
    name = file_name(path)
    if not rooted:
        stem = F.regexp_replace(name, r"\.[^.]*$", "")
        parent = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
        return F.when(stem.isin("__init__", "index"), parent).otherwise(stem)
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.replace(F.when(name.isin(ROOT_MODULES), folder).otherwise(bare), F.lit("/"), F.lit("."))


def normalize_import(module: Column) -> Column:
    """Import target: leading dots and slashes dropped; ``@scope/pkg`` kept, else the first path part."""
    bare = F.ltrim(F.ltrim(module, F.lit(".")), F.lit("/"))
    scoped = F.regexp_extract(bare, r"^(@[^/]*/[^/]*)", 1)
    return F.when(scoped != "", scoped).otherwise(F.split(bare, "/")[0])


def module_table(files: DataFrame) -> DataFrame:
    return files.select("project_id", module_name(F.col("path")).alias("module"), "path")


def _dotted_prefixes(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def _char_prefixes(name: Column) -> Column:
    n = F.length(name)
    full = F.transform(F.sequence(F.lit(0), n), lambda i: F.substr(name, F.lit(1), i))
    return full


def classify_imports(targets: DataFrame, modules: DataFrame, boundary: bool = False) -> DataFrame:
    """Is each ``(project_id, target)`` internal: equal to a module, or one a prefix of the other.

    Both prefix tests become equi joins on exploded prefixes, so no pairs are
    formed. ``boundary`` compares whole dotted parts instead of characters.
    Prefixes that the names of a bundle share are one row of it, and every join has
    so many tasks that none gets more than about ``PREFIX_ROWS`` rows.
    """
    prefixes = _dotted_prefixes if boundary else _char_prefixes
    names = cut_lineage(modules.select("project_id", "module").distinct())
    wanted = cut_lineage(targets.select("project_id", "target").distinct())
    sources = {"module": names, "target": wanted}
    rows, bundles = {}, {}
    for name, df in sources.items():
        per = df.groupBy("project_id").agg(F.count(name).alias("n"), F.sum(F.length(name) + 1).alias("p"))
        most, total = per.agg(F.max("n"), F.sum("p")).first()
        rows[name] = total or 0
        number = F.pmod(F.xxhash64(name), F.lit(max(1, -(-(most or 0) // BUNDLE)))).alias("bundle")
        bundles[name] = df.groupBy("project_id", number).agg(F.collect_list(name).alias("names"))

    def cut(name: str) -> DataFrame:
        shared = F.array_distinct(F.flatten(F.transform("names", prefixes)))
        return bundles[name].select("project_id", "bundle", F.explode_outer(shared).alias("prefix"))

    def tasks(most: int) -> int:
        return max(names.sparkSession.sparkContext.defaultParallelism, -(-most // PREFIX_ROWS))

    def met(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
        by = [tasks(most), "project_id", "prefix"]
        return left.repartition(*by).join(both_sided(right.repartition(*by)), ["project_id", "prefix"], "left_semi")

    # some module starts with the target
    above = met(wanted.withColumnRenamed("target", "prefix"), cut("module"), rows["module"]).withColumnRenamed("prefix", "target")
    # the target starts with some module
    found = met(cut("target"), names.withColumnRenamed("module", "prefix"), rows["target"])
    found = found.groupBy("project_id", "bundle").agg(F.collect_list("prefix").alias("found"))
    below = bundles["target"].join(both_sided(found), ["project_id", "bundle"])
    below = below.select("project_id", F.explode_outer(F.filter("names", lambda x: F.arrays_overlap(prefixes(x), F.col("found")))).alias("target"))
    no, yes = F.lit(False).alias("is_internal"), F.lit(True).alias("is_internal")
    every = wanted.select("project_id", "target", no)
    for some in (above, below.where("target is not null")):
        every = every.unionByName(some.select("project_id", "target", yes))
    every = every.repartition(tasks(rows["target"]), "project_id", "target")
    return every.groupBy("project_id", "target").agg(F.max("is_internal").alias("is_internal"))


def dependency_edges(files: DataFrame, imports: DataFrame, boundary: bool = False) -> DataFrame:
    """One edge per import statement: source module, target, imported names, internal or external."""
    rows = imports.select(
        "project_id",
        module_name(F.col("path")).alias("src"),
        normalize_import(F.col("module")).alias("dst"),
        F.array_join("names", ",").alias("names"),
        "path",
        "ordinal",
    )
    kinds = classify_imports(rows.select("project_id", F.col("dst").alias("target")), module_table(files), boundary)
    kinds = kinds.select("project_id", F.col("target").alias("dst"), "is_internal")
    return rows.join(both_sided(kinds), ["project_id", "dst"]).select(
        "project_id", "src", "dst", "names", "path", "ordinal", (~F.col("is_internal")).alias("is_external")
    )


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """Declared dependencies: ``(project_id, path, kind, name, version)``."""
    src = manifest_scan(files)
    text, kind = F.col("content"), F.col("kind")
    lines = F.transform(F.split(text, r"\r?\n", -1), lambda x: strip(x))

    def dep(name: Column, version: Column) -> Column:
        return F.struct(strip(name).alias("name"), F.coalesce(strip(version), F.lit("")).alias("version"))

    sections = F.from_json(text, ", ".join(f"{s} map<string,string>" for s in PACKAGE_SECTIONS))
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.concat(*[F.coalesce(F.map_entries(sections[s]), none) for s in PACKAGE_SECTIONS])
    package = F.transform(entries, lambda e: dep(e["key"], e["value"]))
    req = r"^([A-Za-z0-9_.\-]+)(.*)$"
    requirements = F.transform(
        F.filter(lines, lambda x: x.rlike(req) & ~x.startswith("-r") & ~x.startswith("--requirement")),
        lambda x: dep(F.regexp_extract(x, req, 1), F.regexp_extract(x, req, 2)),
    )
    quoted = r'"([A-Za-z0-9_.\-]+)(?:\[[^\]]+\])?(\s*[<>=!~].*?)?"'
    versions = F.regexp_extract_all(text, F.lit(quoted), 2)
    pyproject = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(quoted), 1), lambda n, i: dep(n, F.get(versions, i))),
        lambda d: ~F.lower(d["name"]).isin(PYPROJECT_IGNORED),
    )
    # one-line form and the lines of a ``require ( … )`` block
    go_line = r"^require\s+([^\s(]+)(?:\s+(\S+))?"
    single = F.transform(F.filter(lines, lambda x: x.rlike(go_line)), lambda x: dep(F.regexp_extract(x, go_line, 1), F.regexp_extract(x, go_line, 2)))
    block = F.split(F.regexp_extract(text, r"(?s)require\s*\((.*?)\)", 1), r"\n")
    go_item = r"^\s*([^\s/][^\s]*)\s+(v\S+)"
    go = F.concat(
        single, F.transform(F.filter(block, lambda x: x.rlike(go_item)), lambda x: dep(F.regexp_extract(x, go_item, 1), F.regexp_extract(x, go_item, 2)))
    )
    tag = r"(?s)<{0}>\s*(.*?)\s*</{0}>"
    pom = F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1),
            lambda d: dep(
                F.when(
                    F.regexp_extract(d, tag.format("artifactId"), 1) != "",
                    F.concat_ws(":", non_empty(F.regexp_extract(d, tag.format("groupId"), 1)), F.regexp_extract(d, tag.format("artifactId"), 1)),
                ),
                F.regexp_extract(d, tag.format("version"), 1),
            ),
        ),
        lambda d: d["name"].isNotNull(),
    )
    found = (
        F.when(kind == "package.json", package)
        .when(kind == "requirements.txt", requirements)
        .when(kind == "pyproject.toml", pyproject)
        .when(kind == "go.mod", go)
        .otherwise(pom)
    )
    rows = src.select("project_id", "path", "kind", F.posexplode_outer(found).alias("pos", "d")).where("d.name <> ''")
    return rows.select("project_id", "path", "kind", (F.col("pos") + 1).alias("ordinal"), F.col("d.name").alias("name"), F.col("d.version").alias("version"))


def merge_versions(declared: DataFrame) -> DataFrame:
    """First non-empty version per normalised name, in path and line order."""
    order = F.when(F.col("version") != "", F.struct("path", "ordinal"))
    rows = declared.select("project_id", normalize_import(F.col("name")).alias("name"), "version", "path", "ordinal").where("name <> ''")
    return rows.groupBy("project_id", "name").agg(F.coalesce(F.min_by("version", order), F.lit("")).alias("version"))


def external_modules(edges: DataFrame, declared: DataFrame, files: DataFrame, boundary: bool = False) -> DataFrame:
    """External modules imported or declared, with version (empty when unknown)."""
    merged = merge_versions(declared)
    kinds = classify_imports(merged.select("project_id", F.col("name").alias("target")), module_table(files), boundary)
    outside = kinds.where("not is_internal").select("project_id", F.col("target").alias("name"))
    wanted = merged.join(both_sided(outside), ["project_id", "name"], "left_semi")
    imported = edges.where("is_external").select("project_id", F.col("dst").alias("name")).distinct().withColumn("imported", F.lit(True))
    return imported.join(wanted, ["project_id", "name"], "full_outer").select(
        "project_id", "name", F.coalesce("version", F.lit("")).alias("version"), F.coalesce("imported", F.lit(False)).alias("imported")
    )


def dependency_stats(files: DataFrame, edges: DataFrame, externals: DataFrame) -> DataFrame:
    tagged = (
        module_table(files).select("project_id", F.lit("m").alias("k"), "module").distinct().select("project_id", "k")
        .unionByName(edges.select("project_id", F.when(F.col("is_external"), "xe").otherwise("ie").alias("k")))
        .unionByName(externals.select("project_id", F.lit("x").alias("k")))
    )
    return tagged.groupBy("project_id").agg(
        F.count_if(F.col("k") == "m").alias("internal_modules"),
        F.count_if(F.col("k") == "x").alias("external_modules"),
        F.count_if(F.col("k") == "ie").alias("internal_edges"),
        F.count_if(F.col("k") == "xe").alias("external_edges"),
    )


def degree_ranking(edges: DataFrame, end: str, limit: int = 10) -> DataFrame:
    """Modules with the most internal imports: ``end='dst'`` most depended on, ``'src'`` most dependent."""
    counts = edges.where("not is_external").groupBy("project_id", F.col(end).alias("module")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("project_id").orderBy(F.desc("n"), "module")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("project_id", "rank", "module", "n")


def dependency_tree(edges: DataFrame) -> DataFrame:
    """Distinct imports per module as parent-key rows (internal and external)."""
    return edges.select("project_id", F.col("src").alias("module"), F.col("dst").alias("import"), "is_external").distinct()


def dependency_counts(edges: DataFrame) -> DataFrame:
    """Distinct import counts per module, grouped over the distinct pairs."""
    return (
        dependency_tree(edges)
        .groupBy("project_id", "module")
        .agg(
            F.count("*").alias("imports_count"),
            F.count_if(~F.col("is_external")).alias("internal_imports"),
            F.count_if("is_external").alias("external_imports"),
        )
    )


def importers(edges: DataFrame, externals: DataFrame) -> DataFrame:
    """External modules with version and number of distinct importing modules."""
    pairs = edges.where("is_external").select("project_id", F.col("dst").alias("name"), "src").distinct()
    used = pairs.groupBy("project_id", "name").agg(F.count("*").alias("imported_by_count"))
    return externals.join(both_sided(used), ["project_id", "name"], "left").select(
        "project_id", "name", "version", F.coalesce("imported_by_count", F.lit(0)).alias("imported_by_count")
    )


# --- cycles and depth --------------------------------------------------------------------


def internal_pairs(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ``(project_id, src, dst)`` between modules that exist; self imports left out."""
    names = module_table(files).select("project_id", F.col("module").alias("dst")).distinct()
    pairs = edges.where("not is_external").select("project_id", "src", "dst").distinct()
    return pairs.join(both_sided(names), ["project_id", "dst"], "left_semi").where("src <> dst")


def _cyclic_core(pairs: DataFrame) -> DataFrame:
    """Remove vertices without in- or out-edges until none is left; what stays lies on or between cycles."""
    current, size = cut_lineage(pairs), None
    while True:
        size, before = current.count(), size
        if size == before or size == 0:
            return current
        out = current.select("project_id", F.col("src").alias("dst")).distinct()
        into = current.select("project_id", F.col("dst").alias("src")).distinct()
        current = cut_lineage(current.join(both_sided(out), ["project_id", "dst"], "left_semi").join(both_sided(into), ["project_id", "src"], "left_semi"))


def witness_cycles(pairs: DataFrame) -> DataFrame:
    """``(project_id, component, cycle, length)``: a shortest cycle through each strong component's smallest module.

    Components of any size and cycles of any length are covered. From the owner
    a frontier walks the component's edges, keeping for each module the first
    path that meets it, until it comes back.
    """
    of = cut_lineage(strong_components(pairs))
    a = of.select("project_id", F.col("module").alias("src"), "component")
    b = of.select("project_id", F.col("module").alias("dst"), F.col("component").alias("other"))
    inside = pairs.join(both_sided(a), ["project_id", "src"]).join(both_sided(b), ["project_id", "dst"]).where("component = other")
    inside = cut_lineage(inside.select("project_id", "component", "src", "dst"))
    frontier = of.where("module = component").select("project_id", "component", F.col("module").alias("at"), F.array("module").alias("path"))
    seen, found = None, None
    while True:
        step = frontier.join(both_sided(inside.withColumnRenamed("src", "at")), ["project_id", "component", "at"])
        step = step.groupBy("project_id", "component", F.col("dst").alias("at")).agg(F.min("path").alias("path"))
        step = step.select("project_id", "component", "at", F.array_append("path", F.col("at")).alias("path"))
        if seen is not None:
            step = step.join(both_sided(seen), ["project_id", "component", "at"], "left_anti")
        step = cut_lineage(step)
        if step.isEmpty():
            break
        closed = step.where("at = component")
        found = closed if found is None else found.unionByName(closed)
        keys = step.select("project_id", "component", "at")
        seen = keys if seen is None else seen.unionByName(keys)
        # components whose cycle is closed are done
        frontier = step.join(both_sided(closed.select("project_id", "component")), ["project_id", "component"], "left_anti")
    rows = of.limit(0).select("project_id", "component", F.array("module").alias("path")) if found is None else found
    return rows.select("project_id", "component", F.array_join("path", " -> ").alias("cycle"), (F.size("path") - 1).alias("length"))


def circular_dependencies(pairs: DataFrame, max_length: int) -> DataFrame:
    """Every elementary cycle of at most ``max_length`` modules, rotated to start at its smallest module.

    Paths only grow through modules greater than their start, so each cycle is
    found once. ``strong_components`` and ``witness_cycles`` cover all lengths.
    """
    core = _cyclic_core(pairs)
    paths = core.where("src < dst").select("project_id", F.col("src").alias("start"), F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    found = None
    for length in range(2, max_length + 1):
        step = core.select("project_id", F.col("src").alias("at"), F.col("dst").alias("next"))
        grown = paths.join(both_sided(step), ["project_id", "at"])
        closed = grown.where(F.col("next") == F.col("start")).select(
            "project_id", F.array_join(F.array_append("path", F.col("start")), " -> ").alias("cycle"), F.lit(length).alias("length")
        )
        found = closed if found is None else found.unionByName(closed)
        if length < max_length:
            paths = cut_lineage(
                grown.where((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next"))).select(
                    "project_id", "start", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("at")
                )
            )
    return found


def _spread_labels(labels: DataFrame, pairs: DataFrame, start: str, end: str) -> DataFrame:
    """Smallest label that reaches each vertex along ``start -> end``, to the fixed point."""
    while True:
        moved = pairs.join(both_sided(labels.select("project_id", F.col("v").alias(start), "label")), ["project_id", start]).select(
            "project_id", F.col(end).alias("v"), "label"
        )
        best = moved.groupBy("project_id", "v").agg(F.min("label").alias("better"))
        joined = labels.join(both_sided(best), ["project_id", "v"], "left")
        changed = F.coalesce(F.col("better") < F.col("label"), F.lit(False))
        joined = cut_lineage(joined.select("project_id", "v", F.least("label", F.coalesce("better", "label")).alias("label"), changed.alias("changed")))
        labels = joined.select("project_id", "v", "label")
        if joined.where("changed").isEmpty():
            return labels


def strong_components(pairs: DataFrame) -> DataFrame:
    """``(project_id, module, component)`` of every module on a cycle of any length.

    Each round spreads the smallest label forwards, then confirms it backwards
    inside the same label; vertices that both reach and are reached by the
    label's owner form one component and leave the graph.
    """
    rest = _cyclic_core(pairs)
    done = None
    while not rest.isEmpty():
        vertices = rest.select("project_id", F.col("src").alias("v")).unionByName(rest.select("project_id", F.col("dst").alias("v"))).distinct()
        colour = _spread_labels(vertices.withColumn("label", F.col("v")), rest, "src", "dst")
        c = colour.select("project_id", F.col("v").alias("src"), F.col("label").alias("src_label"))
        d = colour.select("project_id", F.col("v").alias("dst"), F.col("label").alias("dst_label"))
        inside = cut_lineage(
            rest.join(both_sided(c), ["project_id", "src"]).join(both_sided(d), ["project_id", "dst"]).where("src_label = dst_label").select("project_id", "src", "dst", F.col("src_label").alias("label"))
        )
        # walk backwards from each label's owner over edges of one colour
        reached = cut_lineage(colour.where("v = label"))
        frontier = reached
        while not frontier.isEmpty():
            step = inside.join(both_sided(frontier.select("project_id", F.col("v").alias("dst"), "label")), ["project_id", "dst", "label"])
            step = step.select("project_id", F.col("src").alias("v"), "label").distinct().join(both_sided(reached), ["project_id", "v", "label"], "left_anti")
            frontier = cut_lineage(step)
            reached = cut_lineage(reached.unionByName(frontier))
        done = reached if done is None else done.unionByName(reached)
        gone = reached.select("project_id", "v")
        rest = rest.join(both_sided(gone.withColumnRenamed("v", "src")), ["project_id", "src"], "left_anti").join(
            both_sided(gone.withColumnRenamed("v", "dst")), ["project_id", "dst"], "left_anti"
        )
        rest = _cyclic_core(rest)
    if done is None:
        return pairs.select("project_id", F.col("src").alias("module"), F.col("src").alias("component")).limit(0)
    size = done.groupBy("project_id", "label").agg(F.count("*").alias("n"))
    return done.join(both_sided(size.where("n > 1")), ["project_id", "label"]).select("project_id", F.col("v").alias("module"), F.col("label").alias("component"))


def dependency_depth(pairs: DataFrame, modules: DataFrame) -> DataFrame:
    """Longest import chain below every module; a cycle counts as one step.

    Modules of one strong component share a vertex, which leaves an acyclic
    graph; levels then spread upwards until nothing changes.
    """
    scc = cut_lineage(strong_components(pairs))
    owner = scc.select("project_id", F.col("module").alias("m"), "component")
    a = pairs.join(both_sided(owner.withColumnRenamed("m", "src").withColumnRenamed("component", "sc")), ["project_id", "src"], "left")
    b = a.join(both_sided(owner.withColumnRenamed("m", "dst").withColumnRenamed("component", "dc")), ["project_id", "dst"], "left")
    dag = b.select("project_id", F.coalesce("sc", "src").alias("src"), F.coalesce("dc", "dst").alias("dst")).where("src <> dst").distinct()
    dag = cut_lineage(dag)
    vertices = (
        modules.select("project_id", F.col("module").alias("m")).distinct().join(both_sided(owner), ["project_id", "m"], "left").select("project_id", "m", F.coalesce("component", "m").alias("v"), F.col("component").isNotNull().alias("in_cycle"))
    )
    levels = cut_lineage(vertices.select("project_id", "v").distinct().withColumn("level", F.lit(0)))
    frontier = levels
    while not frontier.isEmpty():
        raised = dag.join(both_sided(frontier.select("project_id", F.col("v").alias("dst"), "level")), ["project_id", "dst"]).groupBy("project_id", F.col("src").alias("v")).agg((F.max("level") + 1).alias("up"))
        joined = cut_lineage(levels.join(both_sided(raised), ["project_id", "v"], "left").withColumn("better", F.coalesce(F.col("up") > F.col("level"), F.lit(False))))
        levels = joined.select("project_id", "v", F.greatest("level", F.coalesce("up", "level")).alias("level"))
        frontier = joined.where("better").select("project_id", "v", F.col("up").alias("level"))
    return vertices.join(both_sided(levels), ["project_id", "v"]).select("project_id", F.col("m").alias("module"), F.col("level").alias("depth"), "in_cycle")


def project_graph_summary(files: DataFrame) -> DataFrame:
    """One row per project: files, functions, classes, modules and edges.

    The texts are read once; what is kept of a file are its counts and its import targets.
    """
    counts = {name: c for name, c in file_counts().items() if name in ("files", "functions", "classes")}
    targets = F.transform("imports", lambda m: strip(m["module"]))
    facts = file_facts(skip_filter(files, "structure"), arguments=False)
    kept = cut_lineage(facts.select("project_id", "path", *[c.alias(name) for name, c in counts.items()], targets.alias("targets")))
    shape = kept.groupBy("project_id").agg(*[F.sum(name).alias(name) for name in counts])
    modules = module_table(kept).select("project_id", "module").distinct().groupBy("project_id").agg(F.count("*").alias("modules"))
    imports = kept.select("project_id", "path", F.posexplode_outer("targets").alias("ordinal", "module")).where("ordinal is not null")
    edges = dependency_edges(kept, imports.withColumn("names", F.array().cast("array<string>")))
    links = edges.groupBy("project_id").agg(
        F.count_if(~F.col("is_external")).alias("internal_edges"), F.count_if("is_external").alias("external_edges")
    )
    out = shape.join(modules, "project_id", "left").join(links, "project_id", "left")
    return out.select("project_id", "files", "functions", "classes", "modules", F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"), F.coalesce("external_edges", F.lit(0)).alias("external_edges"))
