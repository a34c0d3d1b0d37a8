"""Content hashes, incremental change detection, versions and progress."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourceweave.sources.files import line_count, skip_filter


def content_hashes(files: DataFrame, profile: str | None = "index") -> DataFrame:
    """sha256 of the bytes of every tracked file."""
    kept = skip_filter(files, profile) if profile else files
    return kept.select("project_id", "path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def detect_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Added, modified and deleted files between two hash tables.

    The join key ``(project_id, path)`` is unique per file, so one huge project
    still spreads over all partitions.
    """
    old, new = stored.withColumnRenamed("sha256", "old_hash"), current.withColumnRenamed("sha256", "new_hash")
    kind = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    )
    joined = old.join(new, ["project_id", "path"], "full_outer").withColumn("change_type", kind)
    return joined.where(F.col("change_type").isNotNull())


def changeset_summary(changes: DataFrame) -> DataFrame:
    def hits(kind: str) -> Column:
        return F.count_if(F.col("change_type") == kind).alias(kind)

    return changes.groupBy("project_id").agg(
        hits("added"), hits("modified"), hits("deleted"), F.count("*").alias("total_changes")
    )


def has_changed(probe: DataFrame, stored: DataFrame) -> DataFrame:
    """Per probed file: does its content differ from the stored hash (unknown files count as changed)."""
    known = stored.withColumnRenamed("sha256", "stored_hash")
    return probe.join(known, ["project_id", "path"], "left").select(
        "project_id",
        "path",
        (~F.col("sha256").eqNullSafe(F.col("stored_hash"))).alias("has_changed"),
    )


def latest_wins(current: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert on plain tables: the newest row per key.

    ``max_by`` is combined map-side, so a key with very many updates sends one
    row per map task.
    """
    rest = [c for c in current.columns if c not in keys]
    both = current.unionByName(updates)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


#: Buckets of a metadata table; an upsert rewrites those that it touches.
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("project_id"), F.lit(BUCKETS)).cast("int")


def _committed(spark: SparkSession, folder: str) -> dict[int, int]:
    """Committed version of every bucket, at most ``BUCKETS`` rows; none where nothing was committed yet."""
    try:
        committed = spark.read.schema("bucket int, version int").parquet(f"{folder}/manifest")
    except AnalysisException:
        return {}
    return {r["bucket"]: r["version"] for r in committed.groupBy("bucket").agg(F.max("version").alias("version")).collect()}


def _buckets(spark: SparkSession, folder: str, versions: dict[int, int], like: StructType) -> DataFrame:
    paths = [f"{folder}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(like).parquet(*paths) if paths else spark.createDataFrame([], like)


_METADATA = "project_id string, path string, sha256 string, metadata string, processed_at long"


def upsert_metadata(folder: str, updates: DataFrame) -> None:
    """Set hash and metadata of files in the table below ``folder``.

    ``updates(project_id, path, sha256, metadata, processed_at)``: the latest row of a
    file gives its hash, the latest row with metadata gives that, so a row without any
    leaves the stored one. Buckets of the touched projects are written as a new version
    next to the old ones; the manifest, written last, makes them visible, so a job that
    dies before leaves the table as it was. One writer at a time.
    """
    spark = updates.sparkSession
    schema = StructType.fromDDL(_METADATA)
    rows = updates.selectExpr("project_id", "path", "sha256", "metadata", "cast(processed_at as long) as processed_at").withColumn("bucket", _bucket())
    touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    if not touched:
        return
    versions = _committed(spark, folder)
    version = max(versions.values(), default=0) + 1
    current = _buckets(spark, folder, {b: v for b, v in versions.items() if b in touched}, schema).withColumn("bucket", _bucket())
    merged = current.unionByName(rows).groupBy("bucket", "project_id", "path").agg(
        F.max_by("sha256", "processed_at").alias("sha256"),
        F.expr("max_by(metadata, processed_at) filter (where metadata is not null)").alias("metadata"),
        F.max("processed_at").alias("processed_at"),
    )
    merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={version}")  # of a job that died, if any
    spark.createDataFrame([(b, version) for b in touched], "bucket int, version int").coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def stored_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The committed state of a metadata table."""
    return _buckets(spark, folder, _committed(spark, folder), StructType.fromDDL(_METADATA))


def lookup_metadata(probe: DataFrame, folder: str) -> DataFrame:
    """Metadata of the probed files, null where none is stored; only their projects' buckets are read."""
    spark = probe.sparkSession
    asked = {r["bucket"] for r in probe.select(_bucket().alias("bucket")).distinct().collect()}
    versions = {b: v for b, v in _committed(spark, folder).items() if b in asked}
    known = _buckets(spark, folder, versions, StructType.fromDDL(_METADATA)).select("project_id", "path", "metadata")
    return probe.select("project_id", "path").join(known, ["project_id", "path"], "left")


def index_stats(tracked: DataFrame) -> DataFrame:
    return tracked.groupBy("project_id").agg(
        F.count("*").alias("tracked_files"), F.max("scanned_at").alias("last_scan")
    )


def snapshot_stats(files: DataFrame) -> DataFrame:
    """File and line count of a version; lines are newlines plus one."""
    kept = skip_filter(files, "features")
    return kept.groupBy("project_id").agg(
        F.count("*").alias("file_count"), F.sum(line_count(F.col("content"), "newline")).alias("line_count")
    )


def list_versions(versions: DataFrame, project_id: str | None = None) -> DataFrame:
    """Versions newest first (of one project, or of every project)."""
    rows = versions if project_id is None else versions.where(F.col("project_id") == project_id)
    return rows.orderBy("project_id", F.desc("created_at"), "version_id")


def compare_versions(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """Count differences for ``pairs(project_id, v1, v2)``; both must belong to the project."""
    def side(n: int) -> DataFrame:
        return versions.select(
            "project_id",
            F.col("version_id").alias(f"v{n}"),
            F.col("file_count").alias(f"files_{n}"),
            F.col("line_count").alias(f"lines_{n}"),
        )

    both = pairs.join(side(1), ["project_id", "v1"]).join(side(2), ["project_id", "v2"])
    diff = F.col("files_2") - F.col("files_1")
    return both.select(
        "project_id",
        "v1",
        "v2",
        diff.alias("file_count_diff"),
        (F.col("lines_2") - F.col("lines_1")).alias("line_count_diff"),
        F.when(diff > 0, "files_added").when(diff < 0, "files_removed").otherwise("none").alias("change"),
        F.abs(diff).alias("change_count"),
    )


def parse_name_status(lines: DataFrame) -> DataFrame:
    """``lines(project_id, line)`` of ``STATUS<tab>path`` -> one row per A/M/D change."""
    parts = F.split("line", "\t", 2)
    kind = F.when(parts[0] == "A", "added").when(parts[0] == "M", "modified").when(parts[0] == "D", "deleted")
    rows = lines.where(F.col("line") != "").select("project_id", kind.alias("change_type"), parts[1].alias("path"))
    return rows.where(F.col("change_type").isNotNull())


def parse_commit_log(lines: DataFrame) -> DataFrame:
    """``hash|message|author|date`` lines; shorter lines are dropped."""
    parts = F.split("line", r"\|", 4)
    return lines.where(F.size(parts) >= 4).select(
        "project_id",
        parts[0].alias("hash"),
        parts[1].alias("message"),
        parts[2].alias("author"),
        parts[3].alias("date"),
    )


def percentage(current: Column, total: Column) -> Column:
    return F.when(total <= 0, 0).otherwise(F.least(F.lit(100), F.floor(current / total * 100).cast("int")))


def latest_progress(events: DataFrame) -> DataFrame:
    """Current stage of each project from ``events(project_id, ts, seq, stage, current, total)``."""
    last = events.groupBy("project_id").agg(
        F.max_by(F.struct("stage", "current", "total", "ts"), F.struct("ts", "seq")).alias("p")
    )
    return last.select(
        "project_id",
        F.col("p.stage").alias("stage"),
        percentage(F.col("p.current"), F.col("p.total")).alias("percentage"),
        (F.col("p.stage") == "completed").alias("is_complete"),
        (F.col("p.stage") == "error").alias("has_error"),
    )


def newest_first(df: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    """First ``n`` rows per key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
