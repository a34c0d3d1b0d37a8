"""Queries over the files of the corpus and over documents taken as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceweave.operators import snapshots as sn
from sourceweave.plans.registry import plan
from sourceweave.plans.sqltext import CORPUS, DOCS, LINES, SUFFIX, in_list, parts_overlap
from sourceweave.session import scratch_folder
from sourceweave.sources import files as fs
from sourceweave.sources.corpus import corpus
from sourceweave.sources.tables import doc_files, table

HIDDEN = r"regexp_matches(path, '(^|/)\.')"
DIRS = r"string_split(regexp_replace(path, '/?[^/]*$', ''), '/')"
PARTS = "string_split(path, '/')"
LANG = "case " + " ".join(
    f"when lower({SUFFIX}) in ({in_list(e)}) then '{lang}'" for lang, e in fs.LANGUAGE_EXTENSIONS.items()
) + " end"
NEWLINES = "(length(content) - length(replace(content, chr(10), '')))"
ITER_LINES = f"({NEWLINES} + case when content = '' or right(content, 1) = chr(10) then 0 else 1 end)"


def keep_sql(profile: str) -> str:
    dirs = PARTS if profile in ("features", "count") else DIRS
    tests = [f"not {parts_overlap(dirs, fs.SKIP_DIRS[profile])}"]
    if profile in ("structure", "index"):
        tests.append(f"not {HIDDEN}")
    if profile == "structure":
        tests += [f"lower({SUFFIX}) not in ({in_list(fs.BINARY_EXTENSIONS)})", f"({LANG}) is not null"]
    if profile == "features":
        tests += [f"not ends_with(path, '{s}')" for s in fs.GENERATED_SUFFIXES]
    return " and ".join(tests)


def _skip(profile: str):
    @plan(f"skip_filter_{profile}", f"with {DOCS} select project_id, path from docs where {keep_sql(profile)}")
    def run(spark, sf):
        return fs.skip_filter(doc_files(spark, sf), profile).select("project_id", "path")


for _p in fs.SKIP_DIRS:
    _skip(_p)


@plan(
    "language_of",
    f"with {DOCS} select project_id, path, coalesce({LANG}, 'unsupported') as language from docs",
)
def language_of(spark, sf):
    lang = F.coalesce(fs.language_of(F.col("path")), F.lit("unsupported"))
    return doc_files(spark, sf).select("project_id", "path", lang.alias("language"))


@plan(
    "file_role",
    f"with {CORPUS} select project_id, path, case when {SUFFIX} in ({in_list(fs.FRONTEND_EXTENSIONS)}) then "
    f"'frontend' when {SUFFIX} in ({in_list(fs.BACKEND_EXTENSIONS)}) then 'backend' else 'other' end as role from corpus",
)
def file_role(spark, sf):
    return corpus(spark, sf).select("project_id", "path", fs.file_role(F.col("path")).alias("role"))


@plan(
    "explode_lines",
    f"with {DOCS}, {LINES.format(src='docs')} select project_id, path, cast(line_no as int) as line_no, "
    r"length(line) - length(regexp_replace(line, '^\s+', '')) as indent, md5(line) as line_md5 from lines",
)
def explode_lines(spark, sf):
    rows = fs.explode_lines(doc_files(spark, sf))
    return rows.select("project_id", "path", "line_no", "indent", F.md5("line").alias("line_md5"))


MANIFEST_NAME = "lower(regexp_extract(path, '([^/]*)$', 1))"
MANIFEST_KIND = (
    f"case when {MANIFEST_NAME} in ('package.json', 'pyproject.toml', 'go.mod', 'pom.xml') then {MANIFEST_NAME} "
    f"when {MANIFEST_NAME} like 'requirements%.txt' then 'requirements.txt' end"
)


@plan(
    "manifest_scan",
    f"with {CORPUS} select project_id, path, {MANIFEST_KIND} as kind, length(content) as chars from corpus "
    f"where {keep_sql('manifest')} and ({MANIFEST_KIND}) is not null",
)
def manifest_scan(spark, sf):
    rows = fs.manifest_scan(corpus(spark, sf))
    return rows.select("project_id", "path", "kind", F.length("content").alias("chars"))


# Projects are the customers here: all files of one in five share a folder.
ROOTED = (
    "select concat('c', cast(o_custkey as string)) as project_id, concat(case when o_custkey % 5 < 3 then 'root/' "
    "when o_orderkey % 3 = 0 then '' else 'src/' end, o_orderpriority, '/', cast(o_orderkey as string), '.py') as path, "
    "o_orderstatus as content from orders"
)


@plan(
    "flatten_single_root",
    f"with f as ({ROOTED}), r as (select project_id, count(distinct case when path like '%/%' then split_part(path, '/', 1) "
    "else concat('/', path) end) as n, bool_or(path not like '%/%') as top from f group by 1) "
    "select f.project_id, case when n = 1 and not top then substr(path, strpos(path, '/') + 1) else path end as path "
    "from f join r on f.project_id = r.project_id",
)
def flatten_single_root(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("rooted_orders")
    files = spark.sql(ROOTED.replace("from orders", "from rooted_orders"))
    return fs.flatten_single_root(files).select("project_id", "path")


@plan(
    "repo_directories",
    "with u as (select page_id as id, case when page_id % 4 = 0 then concat('https://github.com/o/', split_part(url, '/', 4), "
    "'.git') when page_id % 4 = 1 then concat('https://gitlab.com/o/', split_part(url, '/', 4), '/') else url end as url from pages), "
    "n as (select id, case when url like '%github.com%' then 'github' when url like '%gitlab.com%' then 'gitlab' when url like "
    "'%gitee.com%' then 'gitee' else 'git' end as source_type, replace(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1), '.git', '') as raw from u), "
    r"""s as (select id, source_type, left(trim(regexp_replace(raw, '[<>:"/\\|?*]', '_', 'g')), 50) as raw from n), """
    "b as (select id, source_type, case when raw = '' then 'project' else raw end as name from s), "
    "k as (select *, row_number() over (partition by name order by id) - 1 as i from b) "
    "select id, source_type, name, case when i = 0 then name else concat(name, '_', cast(i as string)) end as folder from k",
)
def repo_directories(spark, sf):
    part = F.split("url", "/")[3]
    url = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://github.com/o/"), part, F.lit(".git")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://gitlab.com/o/"), part, F.lit("/")))
        .otherwise(F.col("url"))
    )
    return fs.assign_directories(table(spark, sf, "pages").select(F.col("page_id").alias("id"), url.alias("url")))


@plan(
    "count_files_lines",
    f"with {DOCS} select project_id, count(*) as file_count, cast(sum({ITER_LINES}) as bigint) as line_count from docs where "
    f"{keep_sql('count')} and {SUFFIX} in ({in_list(fs.COUNTED_EXTENSIONS)}) group by 1",
)
def count_files_lines(spark, sf):
    return fs.count_files_lines(doc_files(spark, sf))


@plan(
    "snapshot_stats",
    f"with {DOCS} select project_id, count(*) as file_count, cast(sum({NEWLINES} + 1) as bigint) as line_count from docs where "
    f"{keep_sql('features')} group by 1",
)
def snapshot_stats(spark, sf):
    return sn.snapshot_stats(doc_files(spark, sf))


TREE_OK = f"{keep_sql('tree')} and not {HIDDEN} and {SUFFIX} in ({in_list(fs.TREE_EXTENSIONS)})"


@plan(
    "directory_rollup",
    f"with {CORPUS}, t as (select *, {PARTS} as parts from corpus where {TREE_OK}), "
    f"e as (select project_id, unnest(range(0, len(parts))) as d, parts, {ITER_LINES} as n from t) "
    "select project_id, array_to_string(parts[1:d], '/') as dir, count(*) as files, cast(sum(n) as bigint) as lines from e group by 1, 2",
)
def directory_rollup(spark, sf):
    return fs.directory_rollup(corpus(spark, sf))


@plan(
    "file_tree_listing",
    f"with {CORPUS}, t as (select project_id, {PARTS} as parts from corpus where {TREE_OK}), "
    "e as (select project_id, parts, unnest(range(1, len(parts) + 1)) as d from t), "
    "k as (select distinct project_id, array_to_string(parts[1:d], '/') as entry, d as depth, d < len(parts) as is_dir, "
    "array_to_string(list_transform(range(1, d + 1), lambda j: concat(case when j < len(parts) then '0' else '1' end, lower(parts[j]))), chr(1)) as sk from e), "
    "r as (select *, row_number() over (partition by project_id order by sk, entry) as rank from k) "
    "select project_id, rank, entry, depth, is_dir from r",
)
def file_tree_listing(spark, sf):
    return fs.file_tree_listing(corpus(spark, sf))


README_NAME = (
    "case doc_id % 7 when 0 then 'README.md' when 1 then 'README.rst' when 2 then 'README' when 3 then 'readme.md' when 4 then 'README.txt' "
    "else concat('docs/', cast(doc_id % 7 as string), '/README.md') end"
)


@plan(
    "readme_pick",
    f"with f as (select concat(source, '/', cast(doc_id // 7 as string)) as project_id, {README_NAME} as path, text as readme from documents), "
    "r as (select *, row_number() over (partition by project_id order by list_position(['README.md', 'README.rst', 'README.txt', 'README', 'readme.md'], path)) as k "
    "from f where path not like 'docs/%') select project_id, path, readme from r where k = 1",
)
def readme_pick(spark, sf):
    pid = F.expr("concat(source, '/', cast(doc_id div 7 as string))")
    docs = table(spark, sf, "documents")
    return fs.readme_pick(docs.select(pid.alias("project_id"), F.expr(README_NAME).alias("path"), F.col("text").alias("content")))


# --- hashes and snapshots: the stored snapshot is an earlier state of the same files

STORED = (
    "select project_id, case when length(content) % 11 = 0 then concat('gone/', path) else path end as path, "
    "case when length(content) % 5 = 0 then concat(content, 'x') else content end as content from docs where length(content) % 7 <> 0"
)
HASHES = (
    f"{DOCS}, stored_files as ({STORED}), cur as (select project_id, path, sha256(content) as sha256 from docs where {keep_sql('index')}), "
    f"old as (select project_id, path, sha256(content) as sha256 from stored_files where {keep_sql('index')})"
)
CHANGES = (
    f"{HASHES}, changes as (select coalesce(o.project_id, c.project_id) as project_id, coalesce(o.path, c.path) as path, "
    "o.sha256 as old_hash, c.sha256 as new_hash, case when o.sha256 is null then 'added' when c.sha256 is null then 'deleted' "
    "else 'modified' end as change_type from old o full join cur c on o.project_id = c.project_id and o.path = c.path "
    "where o.sha256 is distinct from c.sha256)"
)


def _stored(spark, sf):
    files = doc_files(spark, sf)
    n = F.length("content")
    return files.where(n % 7 != 0).select(
        "project_id",
        F.when(n % 11 == 0, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(n % 5 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"),
    )


def _changes(spark, sf):
    return sn.detect_changes(sn.content_hashes(_stored(spark, sf)), sn.content_hashes(doc_files(spark, sf)))


@plan("content_hash", f"with {DOCS} select project_id, path, sha256(content) as sha256 from docs where {keep_sql('index')}")
def content_hash(spark, sf):
    return sn.content_hashes(doc_files(spark, sf))


@plan("detect_changes", f"with {CHANGES} select project_id, path, old_hash, new_hash, change_type from changes")
def detect_changes(spark, sf):
    return _changes(spark, sf).select("project_id", "path", "old_hash", "new_hash", "change_type")


@plan(
    "changeset_summary",
    f"with {CHANGES} select project_id, count(*) filter (change_type = 'added') as added, count(*) filter (change_type = 'modified') "
    "as modified, count(*) filter (change_type = 'deleted') as deleted, count(*) as total_changes from changes group by 1",
)
def changeset_summary(spark, sf):
    return sn.changeset_summary(_changes(spark, sf))


@plan(
    "has_changed",
    f"with {HASHES} select c.project_id, c.path, o.sha256 is distinct from c.sha256 as has_changed from cur c "
    "left join old o on o.project_id = c.project_id and o.path = c.path",
)
def has_changed(spark, sf):
    return sn.has_changed(sn.content_hashes(doc_files(spark, sf)), sn.content_hashes(_stored(spark, sf)))


@plan(
    "mark_processed",
    f"with {HASHES}, u as (select *, 1 as scanned_at from old union all select *, 2 as scanned_at from cur), "
    "r as (select *, row_number() over (partition by project_id, path order by scanned_at desc) as k from u) "
    "select project_id, path, sha256, scanned_at from r where k = 1",
)
def mark_processed(spark, sf):
    old = sn.content_hashes(_stored(spark, sf)).withColumn("scanned_at", F.lit(1))
    new = sn.content_hashes(doc_files(spark, sf)).withColumn("scanned_at", F.lit(2))
    return sn.latest_wins(old, new, ["project_id", "path"], "scanned_at")


@plan(
    "index_stats",
    f"with {HASHES}, u as (select project_id, path, max(s) as scanned_at from (select project_id, path, 1 as s from old union all "
    "select project_id, path, 2 from cur) group by 1, 2) select project_id, count(*) as tracked_files, max(scanned_at) as last_scan from u group by 1",
)
def index_stats(spark, sf):
    return sn.index_stats(mark_processed(spark, sf))


# Three upserts: all files, Python files of some projects, and hashes without metadata.
METADATA = (
    "u as (select project_id, path, sha256(content) as sha256, 'first' as metadata, 1 as processed_at from docs union all "
    "select project_id, path, sha256(concat(content, 'x')), concat('py ', path), 2 from docs where path like '%.py' and project_id like 'src1%' union all "
    "select project_id, path, sha256(concat(content, 'y')), null, 3 from docs where project_id = 'src3')"
)


def _metadata_table(spark, sf):
    files = doc_files(spark, sf)
    folder = scratch_folder(spark)
    for at, (where, tail, note) in enumerate(
        [("true", "", "'first'"), ("path like '%.py' and project_id like 'src1%'", "x", "concat('py ', path)"), ("project_id = 'src3'", "y", "cast(null as string)")], 1
    ):
        rows = files.where(where).select(
            "project_id", "path", F.sha2(F.concat("content", F.lit(tail)), 256).alias("sha256"), F.expr(note).alias("metadata"), F.lit(at).alias("processed_at")
        )
        sn.upsert_metadata(folder, rows)
    return folder


@plan(
    "upsert_metadata",
    f"with {DOCS}, {METADATA} select project_id, path, arg_max(sha256, processed_at) as sha256, arg_max(metadata, processed_at) filter (metadata is not null) as metadata, "
    "max(processed_at)::bigint as processed_at from u group by 1, 2",
)
def upsert_metadata(spark, sf):
    return sn.stored_metadata(spark, _metadata_table(spark, sf))


@plan(
    "lookup_metadata",
    f"with {DOCS}, {METADATA}, m as (select project_id, path, arg_max(metadata, processed_at) filter (metadata is not null) as metadata from u group by 1, 2), "
    "p as (select project_id, path from docs where project_id like 'src1%' union all select distinct project_id, 'unknown.py' from docs) "
    "select p.project_id, p.path, metadata from p left join m on m.project_id = p.project_id and m.path = p.path",
)
def lookup_metadata(spark, sf):
    files = doc_files(spark, sf).select("project_id", "path")
    unknown = files.select("project_id", F.lit("unknown.py").alias("path")).distinct()
    return sn.lookup_metadata(files.where("project_id like 'src1%'").unionByName(unknown), _metadata_table(spark, sf))


# Orders act as the version rows of their customer.
VERSIONS = (
    "select concat('c', cast(o_custkey as string)) as project_id, o_orderkey as version_id, o_orderdate as created_at, "
    "cast(floor(o_totalprice) as bigint) % 977 as file_count, cast(floor(o_totalprice) as bigint) as line_count from orders"
)


def _versions(spark, sf):
    price = F.floor("o_totalprice").cast("bigint")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("project_id"),
        F.col("o_orderkey").alias("version_id"),
        F.col("o_orderdate").alias("created_at"),
        (price % 977).alias("file_count"),
        price.alias("line_count"),
    )


@plan("list_versions", f"select * from ({VERSIONS}) order by project_id, created_at desc, version_id")
def list_versions(spark, sf):
    return sn.list_versions(_versions(spark, sf))


@plan(
    "compare_versions",
    f"with v as ({VERSIONS}), p as (select project_id, min(version_id) as v1, max(version_id) as v2 from v group by 1) "
    "select p.project_id, v1, v2, b.file_count - a.file_count as file_count_diff, b.line_count - a.line_count as line_count_diff, "
    "case when b.file_count > a.file_count then 'files_added' when b.file_count < a.file_count then 'files_removed' else 'none' end as change, "
    "abs(b.file_count - a.file_count) as change_count from p join v a on a.version_id = v1 join v b on b.version_id = v2",
)
def compare_versions(spark, sf):
    versions = _versions(spark, sf)
    pairs = versions.groupBy("project_id").agg(F.min("version_id").alias("v1"), F.max("version_id").alias("v2"))
    return sn.compare_versions(pairs, versions)


STATUS_LINE = (
    "select concat('s', cast(l_suppkey as string)) as project_id, concat(case l_returnflag when 'A' then 'A' when 'N' then 'M' "
    "else case when l_linestatus = 'F' then 'D' else 'R100' end end, chr(9), 'src/', cast(l_orderkey as string), '/', "
    "cast(l_linenumber as string), '.py') as line from lineitem"
)


@plan(
    "git_diff_rollup",
    f"with d as ({STATUS_LINE}) select project_id, count(*) filter (line like 'A' || chr(9) || '%') as added, count(*) filter "
    "(line like 'M' || chr(9) || '%') as modified, count(*) filter (line like 'D' || chr(9) || '%') as deleted, "
    "count(*) filter (substr(line, 2, 1) = chr(9)) as total_changes from d group by 1 having count(*) filter (substr(line, 2, 1) = chr(9)) > 0",
)
def git_diff_rollup(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("status_lines")
    lines = spark.sql(STATUS_LINE.replace("from lineitem", "from status_lines"))
    return sn.changeset_summary(sn.parse_name_status(lines))


COMMIT_LINE = (
    "select concat('c', cast(o_custkey as string)) as project_id, concat(md5(cast(o_orderkey as string)), '|fix ', o_orderpriority, "
    "case when o_orderkey % 9 = 0 then '' else '|dev' end, case when o_orderkey % 4 = 0 then '|a|b' else '|x' end) as line from orders"
)


@plan(
    "git_commit_log",
    f"with d as (select project_id, line, string_split(line, '|') as p from ({COMMIT_LINE})) select project_id, p[1] as hash, p[2] as message, "
    "p[3] as author, array_to_string(p[4:], '|') as date from d where len(p) >= 4",
)
def git_commit_log(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("commit_lines")
    return sn.parse_commit_log(spark.sql(COMMIT_LINE.replace("from orders", "from commit_lines")))


# Events act as the progress messages of their user.
STAGE_SQL = (
    "case event_type when 'view' then 'scanning' when 'click' then 'parsing' when 'signup' then 'indexing' "
    "when 'purchase' then 'completed' else 'error' end"
)


def progress_events(events):
    return events.select(
        F.col("user_id").alias("project_id"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        F.expr(STAGE_SQL).alias("stage"),
        F.get_json_object("props", "$.k").cast("int").alias("current"),
        F.floor("value").cast("int").alias("total"),
    )


PROGRESS_SQL = (
    f"with e as (select user_id as project_id, ts, event_id, {STAGE_SQL} as stage, cast(props->>'$.k' as int) as cur, "
    "cast(floor(value) as int) as total from events), r as (select *, row_number() over (partition by project_id order by ts desc, "
    "event_id desc) as k from e) select project_id, stage, case when total <= 0 then 0 else cast(least(100, floor(cur / total * 100)) as int) end as "
    "percentage, stage = 'completed' as is_complete, stage = 'error' as has_error from r where k = 1"
)


@plan("latest_progress", PROGRESS_SQL)
def latest_progress(spark, sf):
    return sn.latest_progress(progress_events(table(spark, sf, "events")))


@plan(
    "scan_files",
    f"with {CORPUS} select project_id, cast(sum(length(content) + 1) as bigint) as chars, cast(sum({NEWLINES} + 1) as bigint) as lines from corpus group by 1",
)
def scan_files(spark, sf):
    """The corpus written as a folder of text files per project, then scanned as raw files."""
    root = f"{scratch_folder(spark)}/tree"
    corpus(spark, sf).select("project_id", "content").write.partitionBy("project_id").text(root)
    scanned = fs.scan_files(spark, root, "*.txt", project_depth=1)
    project = F.regexp_extract("project_id", "^project_id=(.*)$", 1)
    newlines = fs.line_count(F.col("content"), "newline") - 1
    return scanned.groupBy(project.alias("project_id")).agg(
        F.sum(F.length("content")).alias("chars"), F.sum(newlines).alias("lines")
    )


@plan("sink_tables", f"with {DOCS} select project_id, path, sha256(content) as sha256 from docs where {keep_sql('index')}")
def sink_tables(spark, sf):
    """Hashes written as a project-partitioned table, one project rewritten, read back."""
    target = f"{scratch_folder(spark)}/hashes"
    hashes = sn.content_hashes(doc_files(spark, sf))
    fs.write_table(hashes, target)
    fs.write_table(hashes.where("project_id = 'src1'"), target)
    return spark.read.parquet(target).select("project_id", "path", "sha256")
