"""Session defaults, lineage cutting and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "sourceweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; cluster settings win over defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable ``checkpoint()`` into the folder the cluster names.

    Iterative operators call this once per round. The folder comes from
    ``spark.checkpoint.dir``; only a local session without that setting, as in
    tests, gets a fresh scratch folder of its own.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def both_sided(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are dealt out by key, none is gathered by the driver.

    Before a query runs, texts written by expressions and checkpoints of them count as
    some bytes a row, so that a table of any size would be taken for a small one and sent
    to all tasks through the driver.
    """
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set up if it is not yet."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for written intermediate tables, below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


#: Key rows of one task, from which wide values are computed.
DEALT_ROWS = 4_096


def dealt(keys: DataFrame, *columns: str) -> DataFrame:
    """Narrow key rows dealt to all cores before wide values are computed from them; more rows get more tasks, not larger ones."""
    tasks = max(keys.sparkSession.sparkContext.defaultParallelism, -(-keys.count() // DEALT_ROWS))
    return keys.repartition(tasks, *[F.col(c) for c in columns])


#: Most bytes and rows of the Arrow batches that hold whole texts; either bound alone leaves batches large.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


def bound_batches(spark: SparkSession) -> None:
    """Keep a worker's share of whole texts small, however long they are; smaller settings stay."""
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))
