"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.session import BATCH_BYTES, bound_batches, scratch_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, large_rows: int = 0) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts the lineage.

    ``large_rows`` is the number of rows of a row group, each with pages of its own, for rows
    of megabytes: Parquet looks at the size of pages and row groups after 100 rows only, and
    whole pages go through buffers outside the heap.
    """
    path = scratch_folder(df.sparkSession)
    names = {"parquet.block.row.count.limit": large_rows, "parquet.page.row.count.limit": 1, "parquet.page.size.row.check.min": 1}
    df.write.options(**names if large_rows else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs in here go as it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def smallest_hashes(df: DataFrame, size: int, n: int, *by: str) -> DataFrame:
    """About the ``n`` rows of ``df`` with the smallest hash of its first column of ``by``, in that order.

    ``size`` is the number of rows. A threshold on the hash comes before the sort, so
    all tasks together hand on about twice as many rows, and not each of them ``n``.
    """
    share = 2 * n / max(size, 1)
    few = df if share >= 1 else df.filter(F.xxhash64(by[0]) < F.lit(int(share * 2**64) - 2**63))
    return few.orderBy(F.xxhash64(by[0]), *by[1:]).limit(n)


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text column, empty for null."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


#: What this worker holds for the stage it works on.
_held: dict = {}


def kept(make: Callable, *args):
    """``make(*args)``, made once for all tasks of a stage that a worker runs; for use below ``trimmed``."""
    if (make, args) not in _held:
        _held[make, args] = make(*args)
    return _held[make, args]


def _begin() -> None:
    """Drop what is held for another stage."""
    context = TaskContext.get()
    stage = context and context.stageId()
    if _held.get("stage") != stage:
        _held.clear()
        _held["stage"] = stage


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` on Arrow batches that hands its memory back at the end of a task.

    A worker outlives its tasks and its heap does not shrink by itself, so what one stage
    took at its peak would stay beside what the next one takes. What ``kept`` made for
    one stage goes when a task of another begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows from an iterator of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


class Rows:
    """Tuples gathered into Arrow batches of bounded bytes; columns as in ``"name type, ..."``."""

    def __init__(self, ddl: str):
        self.schema = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))])
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, size: int = 0) -> bool:
        """Keep one row; true once a batch is due."""
        self.rows.append(row)
        self.size += size + 64
        return self.size >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(self.schema)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)
