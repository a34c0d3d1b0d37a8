"""Exact duplicates by an extendible-hash index on shared files.

1. *Entries.* Every task folds the equal texts that it meets into one entry (count,
   largest id), so that a group of copies costs one entry a task. Rows and entries go
   to a table in the shared folder, where a lost executor takes nothing with it.
2. *Directory.* Slots of hash prefixes are loaded with the bytes of their entries. A
   bucket above its capacity splits; where it has used all bits of the directory, the
   directory doubles, up to ``2 ** LIMIT`` slots of one byte, which is all that the
   driver holds. What no split can part, a hot text or two, gets a chain of pages.
3. *Owners.* A range of buckets (a range of keys) belongs to a task, which reads its
   entries in key order and keeps the texts of the key at hand as a chain; an entry
   joins the link whose bytes are equal, so hash collisions stay apart. The survivors
   of chained pages meet once more by key.
4. *Rows* find their group through their entry, which has no more rows than a task.

Texts are compared after lower-casing A-Z only; null counts as empty. Of a group the
row with the largest id stays (a null id is below all; of equal ids one row stays).
Empty tables give no rows, repeated rows are members like any other, further columns
of any name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import Rows, bound_batches, parallelism, written

#: Most bits of the directory, and bytes of a bucket before it splits (more only where the directory is at its most).
LIMIT, CAPACITY = 18, 64 << 20
#: Bytes of texts that a task folds before it writes its entries.
HELD = 16 << 20

_ENTRY = "row long, entry long, doc_id long, sha binary, key long, text binary, n long, top long, top_row long"
_LINK = "entry long, head long, key long, text binary, n long, top long, top_row long"


def _better(a: tuple, b: tuple) -> tuple:
    """The ``(id, row)`` that stays: larger id, null below all, then the earlier row."""
    if a[0] == b[0]:
        return min(a, b, key=lambda x: x[1])
    return a if b[0] is None or (a[0] is not None and a[0] > b[0]) else b


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A record for every row and one for every entry of this task."""
    import xxhash

    base = TaskContext.get().partitionId() << 40
    row = entry = base
    held: dict[int, list] = {}
    size = 0
    out = Rows(_ENTRY)

    def flush():
        for key, chain in held.items():
            for text, number, n, top in chain:
                if out.add((None, number, None, None, key, text, n, *top), len(text)):
                    yield out.batch()
        held.clear()

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            text = (text or b"").lower()  # of bytes: A-Z only
            key = xxhash.xxh64_intdigest(text) - (1 << 63)
            chain = held.setdefault(key, [])
            for link in chain:
                if link[0] == text:
                    link[2], link[3] = link[2] + 1, _better(link[3], (doc_id, row))
                    break
            else:
                link = [text, entry, 1, (doc_id, row)]
                chain.append(link)
                entry += 1
                size += len(text) + 200
            if out.add((row, link[1], doc_id, hashlib.sha256(text).digest(), None, None, None, None, None), 32):
                yield out.batch()
            row += 1
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()
    yield out.batch()


def _chains(paged: bool):
    """Walks entries in key order; every entry leaves with the head of its link and the link's sums.

    On a page the sums are not final: there only the head carries them, with key and text.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, chain = Rows(_LINK), None, []

        def close():
            for text, members, n, top in chain:
                for k, number in enumerate(members):
                    if not at[1]:
                        full = out.add((number, members[0], None, None, n, *top), 0)
                    elif k:
                        full = out.add((number, members[0], None, None, None, None, None), 0)
                    else:
                        full = out.add((number, number, at[-1], text, n, *top), len(text))
                    if full:
                        yield out.batch()

        for batch in batches:
            columns = {f: batch.column(i).to_pylist() for i, f in enumerate(batch.schema.names)}
            places = zip(columns["bucket"], columns["pages"], columns["page"], strict=True) if paged else [(0, 0, 0)] * batch.num_rows
            rows = zip(places, columns["key"], columns["entry"], columns["text"], columns["n"], columns["top"], columns["top_row"], strict=True)
            for (bucket, pages, page), key, entry, text, n, top, top_row in rows:
                if at != (bucket, pages > 1, page, key):
                    yield from close()
                    at, chain = (bucket, pages > 1, page, key), []
                for link in chain:
                    if link[0] == text:
                        link[1].append(entry)
                        link[2], link[3] = link[2] + n, _better(link[3], (top, top_row))
                        break
                else:
                    chain.append([text, [entry], n, (top, top_row)])
        yield from close()
        yield out.batch()

    return walk


def directory(loads: dict[int, int], capacity: int, limit: int = LIMIT) -> tuple[int, np.ndarray, np.ndarray]:
    """Global depth, and for each slot of the directory the local depth and the pages of its bucket.

    ``loads`` has the bytes of each hash prefix of ``limit`` bits. Splits run from one
    bucket until all fit or their bits are used up.
    """
    sums = np.zeros(1 << limit, np.int64)
    for slot, load in loads.items():
        sums[slot] = load
    depth, local = 0, np.zeros(1, np.uint8)
    while True:
        load = sums.reshape(1 << depth, -1).sum(1)
        # a bucket of less than the global depth has several slots: sum over its own prefix
        split = local == depth
        over = split & (load > capacity)
        if depth == limit or not over.any():
            break
        depth, local = depth + 1, np.repeat(local + over, 2).astype(np.uint8)  # the directory doubles, overfull buckets split
    pages = np.where((local == depth) & (load > capacity), -(-load // capacity), 1).astype(np.int32)
    return depth, local, pages


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table of row and entry records."""
    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(narrow.mapInArrow(_fold, _ENTRY))


def resolve(entries: DataFrame, capacity: int = CAPACITY, limit: int = LIMIT) -> DataFrame:
    """``entry, group_size, keep_id, keep_row`` for every entry of the index."""
    spark = entries.sparkSession
    cells = (
        entries.groupBy(F.shiftrightunsigned("key", 64 - limit).alias("slot"))
        .agg(F.sum(F.octet_length("text") + F.lit(64)).alias("load")).collect()
    )  # at most 2 ** limit rows
    loads = {r.slot: r.load for r in cells}
    capacity = max(capacity, sum(loads.values()) >> max(limit - 2, 0))
    depth, local, pages = directory(loads, capacity, limit)

    def place(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            slot = (key.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(key), np.int64)
            first = slot >> (depth - local[slot]) << (depth - local[slot])
            page = batch.column(1).to_numpy() % pages[slot]
            added = [pa.array(first.astype(np.int32)), pa.array(pages[slot]), pa.array(page.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*added, *batch.columns], names=["bucket", "pages", "page", *batch.schema.names])

    fields = "key long, entry long, text binary, n long, top long, top_row long"
    read = entries.select("key", "entry", "text", "n", "top", "top_row")
    placed = read.mapInArrow(place, f"bucket int, pages int, page int, {fields}")
    owned = placed.repartitionByRange(parallelism(spark), "bucket", "page").sortWithinPartitions("bucket", "page", "key")
    links = owned.mapInArrow(_chains(True), _LINK)
    final = [F.col("n").alias("group_size"), F.col("top").alias("keep_id"), F.col("top_row").alias("keep_row")]
    if pages.max() == 1:
        return links.select("entry", *final)
    links = written(links)
    heads = links.filter("key is not null").select("key", "entry", "text", "n", "top", "top_row")
    met = heads.repartition("key").sortWithinPartitions("key").mapInArrow(_chains(False), _LINK).select(F.col("entry").alias("head"), *final)
    on_pages = links.filter("key is not null or n is null").select("entry", "head")
    return links.filter("key is null and n is not null").select("entry", *final).unionByName(
        on_pages.join(met, "head").select("entry", "group_size", "keep_id", "keep_row")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    ``capacity`` is the bytes of a bucket; it decides how the work is cut, not the result.
    """
    index = build_index(docs, id_col, text_col)
    groups = resolve(index.filter("key is not null"), capacity)
    rows = index.filter("row is not null").select("row", "entry", "doc_id", "sha")
    return rows.join(groups, "entry").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE = f"""
with n as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from n window w as (partition by t)
"""
