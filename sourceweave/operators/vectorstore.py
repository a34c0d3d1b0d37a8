"""A stored vector index: versions by part, committed by a manifest, replaced file by file.

Below the store's folder lie ``data/version=v/part=p`` and ``manifest``. A part
holds the projects of one hash value. An update embeds the changed files only,
writes the touched parts as a new version next to the old one, and names them in
the manifest last; a job that dies before leaves the store as it was.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourceweave.functions import vectors as V
from sourceweave.operators.retrieval import CHUNK_LINES, CHUNK_TOKENS, chunk_lines
from sourceweave.operators.snapshots import detect_changes
from sourceweave.session import bound_batches, cut_lineage

#: Parts of a new store; an existing one keeps its own number.
PARTS = 64
_ROWS = (
    "id string, project_id string, file_path string, start_line int, end_line int, content string, embedding array<float>, sha256 string"
)
_MANIFEST = "part int, version int, filled boolean, parts int, state string"


def _manifest(spark: SparkSession, folder: str) -> tuple[dict[int, int], int, int, str | None]:
    """Version of every part, the last version, the number of parts, and the state of the source then."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException:
        return {}, 0, 0, None
    latest = rows.groupBy("part").agg(F.max(F.struct("version", "filled", "parts", "state")).alias("r")).select("part", "r.*").collect()
    if not latest:
        return {}, 0, 0, None
    last = max(latest, key=lambda r: r["version"])
    return {r["part"]: r["version"] for r in latest if r["filled"]}, last["version"], last["parts"], last["state"]


def _part(project: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(project), F.lit(parts)).cast("int")


def _read(spark: SparkSession, folder: str, versions: dict[int, int]) -> DataFrame:
    schema = StructType.fromDDL(_ROWS)
    paths = [f"{folder}/data/version={v}/part={p}" for p, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def table_state(spark: SparkSession, path: str) -> str:
    """Tells versions of a table's files apart: names, sizes and times of change, without their content."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = listed.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("s"))
    return one.select(F.concat_ws("-", "n", "s").alias("state")).first()["state"]


def store_state(spark: SparkSession, folder: str) -> str | None:
    """The ``state`` that the last update gave; null where there was none."""
    return _manifest(spark, folder)[3]


def store_versions(spark: SparkSession, folder: str) -> dict[int, int]:
    """The committed version of every part."""
    return _manifest(spark, folder)[0]


def update_store(
    folder: str, files: DataFrame, state: str = "", max_tokens: int = CHUNK_TOKENS, max_lines: int = CHUNK_LINES, parts: int = PARTS
) -> None:
    """Make the store below ``folder`` hold the chunks of exactly ``files(project_id, path, content)``.

    New and modified files are chunked and embedded, rows of modified and missing files
    leave, all others are kept as they are; parts without a change are not written. Null
    content counts as empty. A file that is given twice is kept once, with its greatest
    content. Other columns are not read. ``state`` is remembered with the version, so
    that a caller can tell whether its source has changed since. One writer at a time.
    """
    spark = files.sparkSession
    bound_batches(spark)
    versions, last, known, _ = _manifest(spark, folder)
    parts, version = known or parts, last + 1
    narrow = files.select("project_id", "path", F.coalesce("content", F.lit("")).alias("content")).where("project_id is not null and path is not null")
    hashed = narrow.select("project_id", "path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    current = hashed.groupBy("project_id", "path").agg(F.max("sha256").alias("sha256"))
    stored = _read(spark, folder, versions).select("project_id", F.col("file_path").alias("path"), "sha256").distinct()
    changes = cut_lineage(detect_changes(stored, current).withColumn("part", _part(F.col("project_id"), parts)))
    touched = {r["part"] for r in changes.select("part").distinct().collect()}  # at most `parts` rows
    filled = set()
    if touched:
        coming = changes.where("new_hash is not null").select("project_id", "path", F.col("new_hash").alias("sha256"))
        wide = narrow.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).join(coming, ["project_id", "path", "sha256"], "left_semi")
        # Files given twice meet by their key, which also spreads a hot project; the texts move no further before they are embedded.
        chunks = chunk_lines(wide.dropDuplicates(["project_id", "path", "sha256"]), max_tokens, max_lines, "sha256")
        new = chunks.select(
            F.concat_ws(":", "project_id", "chunk_id").alias("id"),
            "project_id",
            F.col("path").alias("file_path"),
            F.col("start_line").cast("int").alias("start_line"),
            F.col("end_line").cast("int").alias("end_line"),
            "content",
            V.hash_embed(F.col("content")).alias("embedding"),
            "sha256",
        )
        old = _read(spark, folder, {p: v for p, v in versions.items() if p in touched})
        kept = old.join(changes.select("project_id", F.col("path").alias("file_path")), ["project_id", "file_path"], "left_anti")
        rows = kept.select(new.columns).unionByName(new).withColumn("part", _part(F.col("project_id"), parts))
        # A hot project's part is cut into several files; small parts get one.
        path = f"{folder}/data/version={version}"
        rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(path)
        written = spark.read.schema(StructType.fromDDL(f"{_ROWS}, part int")).parquet(path)
        filled = {r["part"] for r in written.select("part").distinct().collect()}
    lines = [(p, version, p in filled, parts, state) for p in sorted(touched)] or [(None, version, False, parts, state)]
    spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def read_store(spark: SparkSession, folder: str, project_id: str | None = None, state: str | None = None) -> DataFrame | None:
    """The committed rows, of one project from its part only; None where ``state`` is given and the store has another."""
    versions, _, parts, found = _manifest(spark, folder)
    if state is not None and state != found:
        return None
    if project_id is None:
        return _read(spark, folder, versions).drop("sha256")
    part = spark.range(1).select(_part(F.lit(project_id), parts)).first()[0] if parts else None
    rows = _read(spark, folder, {p: v for p, v in versions.items() if p == part})
    return rows.where(F.col("project_id") == project_id).drop("sha256")
