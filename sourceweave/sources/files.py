"""Scanning, filtering and classifying source files (``files(project_id, path, content)``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourceweave.session import cut_lineage

# --- fixed values: the rules the results depend on --------------------------

SKIP_DIRS = {
    "structure": [
        "node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".nuxt",
        "coverage", ".pytest_cache", ".mypy_cache", "egg-info",
    ],
    "count": [".git", ".github", "node_modules", "__pycache__", ".venv", "venv", "dist", "build"],
    "features": [
        ".git", ".github", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next",
        ".nuxt", "coverage", ".pytest_cache", "migrations", "docs",
    ],
    "index": ["node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next"],
    "manifest": [
        ".git", "node_modules", "dist", "build", "__pycache__", ".venv", "venv", "target", "out", "coverage",
    ],
    "tree": [
        ".git", ".github", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".idea",
        ".vscode", "target", "bin", "obj",
    ],
}
BINARY_EXTENSIONS = [
    "pyc", "pyo", "pyd", "so", "dll", "dylib", "exe", "bin", "jpg", "jpeg", "png", "gif", "ico", "svg",
    "woff", "woff2", "ttf", "eot", "mp3", "mp4", "avi", "mov", "zip", "tar", "gz", "rar", "7z", "pdf",
    "doc", "docx", "xls", "xlsx", "ppt", "pptx", "lock", "sum",
]
GENERATED_SUFFIXES = [".min.js", ".min.css", ".map", ".lock", ".log"]
LANGUAGE_EXTENSIONS = {
    "python": ["py"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx", "mts", "cts"],
    "java": ["java"],
    "go": ["go"],
}
FRONTEND_EXTENSIONS = ["tsx", "ts", "jsx", "js", "vue", "svelte"]
BACKEND_EXTENSIONS = ["py", "java", "go", "rs", "rb", "php", "cs"]
COUNTED_EXTENSIONS = ["py", "js", "ts", "tsx", "jsx", "java", "go", "rs", "vue"]
INDEXED_EXTENSIONS = ["py", "js", "ts", "tsx", "jsx", "java", "go"]
TREE_EXTENSIONS = [
    "py", "js", "ts", "tsx", "jsx", "java", "go", "rs", "vue", "md", "json", "yaml", "yml", "toml",
]
README_NAMES = ["README.md", "README.rst", "README.txt", "README", "readme.md"]
SOURCE_HOSTS = [("github.com", "github"), ("gitlab.com", "gitlab"), ("gitee.com", "gitee")]

# --- path expressions ---------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    """Parent folder, empty at the project root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def suffix(path: Column) -> Column:
    """Last suffix without the dot; empty for none and for dot files."""
    return F.regexp_extract(file_name(path), r"[^.].*\.([^.]+)$", 1)


def language_of(path: Column) -> Column:
    """Language by extension, case-insensitive; null when unsupported."""
    pairs = [F.lit(x) for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts for x in (e, lang)]
    return F.try_element_at(F.create_map(*pairs), F.lower(suffix(path)))


def file_role(path: Column) -> Column:
    ext = suffix(path)
    return (
        F.when(ext.isin(FRONTEND_EXTENSIONS), "frontend")
        .when(ext.isin(BACKEND_EXTENSIONS), "backend")
        .otherwise("other")
    )


# --- operators ------------------------------------------------------------------


def scan_files(spark: SparkSession, root: str, glob: str = "*", project_depth: int = 1) -> DataFrame:
    """Read a directory tree of text files; undecodable bytes are replaced.

    ``root`` may be any file system Spark reads. The first ``project_depth``
    path levels below it name the project. Files of any size are read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    rel = F.split(F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", ""), rf"^\Q{base}\E/", ""), "/")
    n = F.size(rel)
    return raw.select(
        F.array_join(F.slice(rel, 1, project_depth), "/").alias("project_id"),
        F.array_join(F.slice(rel, F.lit(project_depth + 1), n - project_depth), "/").alias("path"),
        F.decode("content", "UTF-8").alias("content"),
    )


def skip_filter(files: DataFrame, profile: str, max_bytes: int | None = None) -> DataFrame:
    """Drop files the given analysis ignores.

    ``structure`` and ``index`` also drop hidden names, ``structure`` further
    drops binary and unsupported files, ``features`` drops generated suffixes.
    All tests look at the path; content is only touched for ``max_bytes``, which
    drops larger files where it is given.
    """
    path = F.col("path")
    parts = F.split(path, "/")
    dirs = parts if profile in ("features", "count") else F.split(directory(path), "/")
    keep = ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS[profile]]))
    if profile in ("structure", "index"):
        keep &= ~path.rlike(r"(^|/)\.")
    if profile == "structure":
        keep &= ~F.lower(suffix(path)).isin(BINARY_EXTENSIONS)
        keep &= language_of(path).isNotNull()
    if max_bytes is not None:
        keep &= F.octet_length("content") <= max_bytes
    if profile == "features":
        for end in GENERATED_SUFFIXES:
            keep &= ~path.endswith(end)
    return files.where(keep)


def flatten_single_root(files: DataFrame) -> DataFrame:
    """Drop the first path level of projects whose files all share one folder.

    One small aggregate per project (map-side combined) is joined back, so a
    huge project is never gathered in one task.
    """
    root = F.when(F.col("path").contains("/"), F.split("path", "/")[0])
    roots = files.groupBy("project_id").agg(
        F.min(root).alias("root_lo"),
        F.max(root).alias("root_hi"),
        F.max(root.isNull()).alias("has_top_file"),
    )
    single = roots.where("root_lo = root_hi and not has_top_file").select("project_id", "root_lo")
    # One row per project: adaptive execution sends it to the files where it is small.
    return files.join(single, "project_id", "left").select(
        "project_id",
        F.when(F.col("root_lo").isNotNull(), F.regexp_replace("path", r"^[^/]*/", ""))
        .otherwise(F.col("path"))
        .alias("path"),
        "content",
    )


def source_type(url: Column) -> Column:
    out = F.lit("git")
    for host, kind in reversed(SOURCE_HOSTS):
        out = F.when(url.contains(host), kind).otherwise(out)
    return out


def repo_name(url: Column) -> Column:
    """Last path part of the address without ``.git``."""
    return F.replace(F.regexp_extract(F.rtrim(url, F.lit("/")), r"([^/]*)$", 1), F.lit(".git"), F.lit(""))


def safe_name(name: Column) -> Column:
    """Name usable as a folder: illegal characters replaced, trimmed, at most 50 long."""
    clean = F.substring(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*]', "_")), 1, 50)
    return F.when(clean == "", "project").otherwise(clean)


def assign_directories(projects: DataFrame, parts: int = 64, hot: int = 10_000) -> DataFrame:
    """``projects(id, url)`` -> source type, repository name and a unique folder.

    The first project of a name, by id, gets the name itself; the others get
    ``_1``, ``_2`` …, leaving out numbers whose folder is another project's plain
    name. A hot name is ranked in ``parts`` ranges of about equal size, cut at
    quantiles of its ids, and shifted by the counts of the ranges before.
    """
    named = projects.select(
        "id",
        "url",
        source_type(F.col("url")).alias("source_type"),
        safe_name(repo_name(F.col("url"))).alias("base"),
    )
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = named.groupBy("base").agg(F.percentile_approx("id", steps, 1000).alias("cuts"), F.count("*").alias("n"))
    cuts = cut_lineage(cuts.where(F.col("n") > hot).select("base", "cuts"))
    cell = F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("id"))))
    cells = named.join(cuts, "base", "left").withColumn("cell", cell).drop("cuts")
    before = F.sum("n").over(Window.partitionBy("base").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = cells.groupBy("base", "cell").agg(F.count("*").alias("n"))
    offsets = counts.select("base", "cell", F.coalesce(before, F.lit(0)).alias("shift"))
    rank = F.row_number().over(Window.partitionBy("base", "cell").orderBy("id")) - 1
    ranked = cells.withColumn("rank", rank).join(offsets, ["base", "cell"]).withColumn("number", F.col("rank") + F.col("shift"))
    # A plain name like foo_2 takes that number from the projects named foo.
    plain = counts.select("base").distinct().withColumn("tail", F.regexp_extract("base", r"^(?s)(.*)_([1-9]\d{0,17})$", 2))
    plain = plain.where("tail <> ''").select(
        F.expr("substring(base, 1, length(base) - length(tail) - 1)").alias("base"), F.col("tail").cast("long").alias("number")
    )
    sizes = counts.groupBy("base").agg(F.sum("n").alias("total"))
    # Of t taken numbers in order, the k-th moves every number from taken - k on.
    taken = plain.join(sizes.where("total > 1"), "base").groupBy("base").agg(F.array_sort(F.collect_set("number")).alias("taken"))
    free = ranked.join(taken, "base", "left").withColumn(
        "number",
        F.when(F.col("number") == 0, F.lit(0)).otherwise(
            F.aggregate(F.coalesce("taken", F.array().cast("array<bigint>")), F.col("number").cast("long"), lambda n, t: n + (t <= n).cast("long"))
        ),
    )
    return free.select(
        "id",
        "source_type",
        F.col("base").alias("name"),
        F.when(F.col("number") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("number").cast("string"))).alias("folder"),
    )


def write_table(df: DataFrame, path: str, partition_by: str = "project_id", mode: str = "overwrite") -> None:
    """Write an analysis output partitioned by project.

    Each task writes what it holds, so a huge project is written by many tasks;
    dynamic overwrite replaces only the projects present in ``df``.
    """
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


# --- inventory ------------------------------------------------------------------


def line_count(content: Column, mode: str = "iterator") -> Column:
    """Lines of a text.

    ``iterator`` counts what iterating a file yields (``a\\n`` is one line);
    ``newline`` counts newlines plus one (``a\\n`` is two lines).
    """
    newlines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    if mode == "newline":
        return newlines + 1
    return newlines + F.when((content == "") | content.endswith("\n"), 0).otherwise(1)


def explode_lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line with 1-based ``line_no`` and the ``indent`` width."""
    rows = files.select(*["project_id", "path", *keep], F.posexplode_outer(F.split("content", "\n", -1)).alias("pos", "line"))
    return rows.select(
        "project_id",
        "path",
        *keep,
        (F.col("pos") + 1).alias("line_no"),
        "line",
        (F.length("line") - F.length(F.regexp_replace("line", r"^\s+", ""))).alias("indent"),
    )


def manifest_kind(path: Column) -> Column:
    """Which dependency manifest a file is, by its lower-cased name; null for others."""
    name = F.lower(file_name(path))
    return (
        F.when(name.isin("package.json", "pyproject.toml", "go.mod", "pom.xml"), name)
        .when(name.startswith("requirements") & name.endswith(".txt"), "requirements.txt")
    )


def manifest_scan(files: DataFrame) -> DataFrame:
    kept = skip_filter(files, "manifest").withColumn("kind", manifest_kind(F.col("path")))
    return kept.where(F.col("kind").isNotNull())


def count_files_lines(files: DataFrame) -> DataFrame:
    kept = skip_filter(files, "count").where(suffix(F.col("path")).isin(COUNTED_EXTENSIONS))
    return kept.groupBy("project_id").agg(
        F.count("*").alias("file_count"), F.sum(line_count(F.col("content"))).alias("line_count")
    )


def directory_rollup(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Files and lines below every folder, where asked up to ``max_depth`` levels."""
    kept = skip_filter(files, "tree").where(
        ~F.col("path").rlike(r"(^|/)\.") & suffix(F.col("path")).isin(TREE_EXTENSIONS)
    )
    parts = F.split(directory(F.col("path")), "/")
    depth = F.when(F.col("path").contains("/"), F.size(parts)).otherwise(0)
    depth = depth if max_depth is None else F.least(depth, F.lit(max_depth))
    levels = F.transform(F.sequence(F.lit(0), depth), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = kept.select("project_id", F.explode_outer(levels).alias("dir"), line_count(F.col("content")).alias("n"))
    return rows.groupBy("project_id", "dir").agg(F.count("*").alias("files"), F.sum("n").alias("lines"))


def file_tree_listing(files: DataFrame, max_depth: int | None = None, limit: int | None = None) -> DataFrame:
    """Directory listing in reading order: folders first, then names; where asked to a depth or the first entries."""
    kept = skip_filter(files, "tree").where(
        ~F.col("path").rlike(r"(^|/)\.") & suffix(F.col("path")).isin(TREE_EXTENSIONS)
    )
    parts = F.split("path", "/")
    n = F.size(parts)
    entries = F.transform(
        F.sequence(F.lit(1), n if max_depth is None else F.least(n, F.lit(max_depth + 1))),
        lambda i: F.struct(
            F.array_join(F.slice(parts, 1, i), "/").alias("entry"),
            i.alias("depth"),
            (i < n).alias("is_dir"),
            # folders sort before files at each level
            F.array_join(
                F.transform(F.slice(parts, 1, i), lambda p, j: F.concat(F.when(j + 1 < n, "0").otherwise("1"), F.lower(p))),
                "\u0001",
            ).alias("sort_key"),
        ),
    )
    rows = kept.select("project_id", F.explode_outer(entries).alias("e")).select("project_id", "e.*").distinct()
    order = Window.partitionBy("project_id").orderBy("sort_key", "entry")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    return ranked.select("project_id", "rank", "entry", "depth", "is_dir")


def readme_pick(files: DataFrame, limit: int | None = None) -> DataFrame:
    """First existing README of each project, where asked cut at ``limit`` characters."""
    ordinal = F.array_position(F.array(*[F.lit(n) for n in README_NAMES]), F.col("path"))
    picked = (
        files.withColumn("ordinal", ordinal)
        .where("ordinal > 0")
        .groupBy("project_id")
        .agg(F.min_by("path", "ordinal").alias("path"), F.min_by("content", "ordinal").alias("content"))
    )
    text = F.col("content")
    if limit is not None:
        text = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n... (truncated)"))).otherwise(text)
    return picked.select("project_id", "path", text.alias("readme"))
