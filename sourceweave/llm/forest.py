"""Approximate nearest neighbours with a hash-prefix forest.

Every tree gives a vector a string of 62 random-hyperplane bits and keeps the
strings as a sorted array, cut into blocks. A query first descends: in every tree
it looks at the entries next to its own string, those with the longest common
prefixes. The k-th best score among them tells how deep prefixes may be asked for
without missing neighbours of at least that score too often; then the query
ascends to that depth in all trees at once and looks at every vector that shares
the prefix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceweave.llm.common import parallelism, smallest_hashes, written

TREES, BITS, SEED = 24, 62, 11
#: Neighbours on each side of a query's string that the descent looks at.
BESIDE = 48
#: Chance to meet a neighbour as near as the k-th found so far, which sets the depth.
TARGET = 0.97
#: Vectors of a block, and vectors that means and fences are taken from (a hash sample).
BLOCK, SAMPLE = 4096, 4096


def _kind(df: DataFrame, vector: str) -> str:
    return "<f4" if df.schema[vector].dataType == T.ArrayType(T.FloatType(), df.schema[vector].dataType.containsNull) else "<f8"


def usable_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, x``: the rows that take part, ``x`` as little-endian doubles, or floats where the input has floats."""
    kind = _kind(df, vector)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, xs = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not v or any(c is None for c in v):
                    continue
                x = np.array(v, kind)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    xs.append(x.tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.binary())], ["id", "x"])

    return df.select(F.col(key).cast("long"), F.col(vector)).mapInArrow(pack, "id long, x binary")


class Forest:
    """Planes, centre and fences: what every task must know of the index."""

    def __init__(self, sample: np.ndarray, blocks: int, longest: float, kind: str):
        self.kind = kind
        self.longest = longest  # of all vectors: makes inner products angles
        self.centre = np.append(sample.mean(axis=0), 0.0) if len(sample) else None
        dims = sample.shape[1] + 1
        self.planes = np.random.default_rng(SEED).standard_normal((TREES, dims, BITS))
        keys = self.keys(sample) if len(sample) else np.zeros((TREES, 0), np.int64)
        cut = [keys.shape[1] * b // blocks for b in range(1, blocks)]
        self.fences = np.sort(keys, axis=1)[:, cut]
        self.pieces = np.ones((TREES, self.fences.shape[1] + 1), np.int64)

    def cut(self, counts: dict[tuple[int, int], int], most: int) -> None:
        """Cuts the blocks of over twice ``most`` vectors, whose keys may all be equal, into pieces by id."""
        for (tree, block), n in counts.items():
            if n > 2 * most:
                self.pieces[tree, block] = -(-n // most)

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """One more component gives all vectors the same norm; queries get none."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(axis=1)))
        return np.column_stack([x, more])

    def keys(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        y = self.lifted(x, query) - self.centre
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        return np.stack([(y @ p > 0) @ weights for p in self.planes])

    def depth(self, x: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The deepest common prefix at which a neighbour of score ``kth`` is met with chance TARGET."""
        q, c = self.lifted(x, query=True), self.centre
        # A centred point is taken to have the mean's typical norm and inner product with it.
        other = math.sqrt(max(1e-12, self.longest**2 - float(c @ c)))
        norm = np.linalg.norm(q - c, axis=1)
        cosine = np.clip((kth - q @ c) / np.maximum(norm * other, 1e-12), -0.99, 0.999999)
        same_bit = 1 - np.arccos(cosine) / math.pi
        each = 1 - (1 - TARGET) ** (1 / TREES)
        return np.clip(np.floor(math.log(each) / np.log(same_bit)), 0, BITS).astype(np.int64)


_POSTED = "tree int, block int, piece int, kind int, id long, key long, low long, high long, x binary"
_NAMES = [c.split()[0] for c in _POSTED.split(", ")]


def _posts(tree, block, piece, kind, ids, key, low, high, xs) -> pa.RecordBatch:
    kinds = [pa.int32()] * 4 + [pa.int64()] * 4
    columns = [pa.array(np.asarray(c), t) for c, t in zip((tree, block, piece, kind, ids, key, low, high), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(xs, pa.binary())], _NAMES)


def _matrix(column, kind: str) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64) if raw else np.zeros((0, 0))


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Well spread non-negative numbers of the ids."""
    x = ids.astype(np.uint64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(33)).astype(np.int64)


def _block_sizes(given):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = given.value
        sizes = np.zeros(f.pieces.shape, np.int64)
        for b in batches:
            keys = f.keys(_matrix(b.column("x"), f.kind)) if b.num_rows else np.zeros((TREES, 0), np.int64)
            for t in range(TREES):
                sizes[t] += np.bincount(np.searchsorted(f.fences[t], keys[t], "right"), minlength=sizes.shape[1])
        tree, block = np.nonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(block, pa.int32()), pa.array(sizes[tree, block])], ["tree", "block", "n"])

    return count


def _index_rows(given):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = given.value
        for b in batches:
            xs, ids = b.column("x").to_pylist(), b.column("id").to_numpy()
            keys = f.keys(_matrix(b.column("x"), f.kind))
            zero, mixed = np.zeros(len(ids), np.int64), _mixed(ids)
            for t in range(TREES):
                block = np.searchsorted(f.fences[t], keys[t], "right")
                yield _posts(zero + t, block, mixed % f.pieces[t][block], zero, ids, keys[t], zero, zero, xs)

    return place


def _query_rows(given, deep: bool):
    """Queries for the blocks beside their string (descent), or below their prefix (``deep``: with ``kth``)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = given.value
        last = f.fences.shape[1]
        for b in batches:
            xs, ids, x = b.column("x").to_pylist(), b.column("id").to_numpy(), _matrix(b.column("x"), f.kind)
            keys = f.keys(x, query=True)
            if deep:
                shift = BITS - f.depth(x, b.column("kth").to_numpy())
            for t in range(TREES):
                key = keys[t]
                if deep:
                    low = key >> shift << shift
                    high = low + (np.int64(1) << shift) - 1
                    first, to = np.searchsorted(f.fences[t], low, "right"), np.searchsorted(f.fences[t], high, "right")
                else:
                    low, high = key, key
                    at = np.searchsorted(f.fences[t], key, "right")
                    first, to = np.maximum(at - 1, 0), np.minimum(at + 1, last)
                n = to - first + 1
                take = np.repeat(np.arange(len(ids)), n)
                block = np.concatenate([np.arange(a, z + 1) for a, z in zip(first, to, strict=True)]) if len(ids) else take
                # A query goes to every piece of its blocks.
                each = f.pieces[t][block]
                piece = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                take, block = np.repeat(take, each), np.repeat(block, each)
                for k in range(0, len(take), 8192):
                    i = take[k : k + 8192]
                    yield _posts(np.full(len(i), t), block[k : k + 8192], piece[k : k + 8192], np.ones(len(i)), ids[i], key[i], low[i], high[i], [xs[j] for j in i])

    return place


def _search(k: int, deep: bool, kind_: str):
    """Rows come by tree, block and piece, vectors before queries: a piece is held, queries stream past it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for b in batches:
            tree, num, piece, kind = (b.column(c).to_numpy() for c in ("tree", "block", "piece", "kind"))
            changed = np.flatnonzero((np.diff(tree) != 0) | (np.diff(num) != 0) | (np.diff(piece) != 0) | (np.diff(kind) != 0)) + 1
            for a, z in zip([0, *changed], [*changed, len(tree)], strict=True):
                if a == z:
                    continue
                if (tree[a], num[a], piece[a]) != at:
                    at, parts, block = (tree[a], num[a], piece[a]), [], None
                part = b.slice(a, z - a)
                if kind[a] == 0:
                    parts.append(part)
                    continue
                if block is None:
                    if not parts:
                        continue
                    keys = np.concatenate([p.column("key").to_numpy() for p in parts])
                    order = np.argsort(keys, kind="stable")
                    ids = np.concatenate([p.column("id").to_numpy() for p in parts])[order]
                    block, parts = (keys[order], ids, np.concatenate([_matrix(p.column("x"), kind_) for p in parts])[order]), []
                for s in range(0, len(part), 512):
                    yield found(part.slice(s, 512), *block)

    def found(part: pa.RecordBatch, keys: np.ndarray, ids: np.ndarray, xs: np.ndarray) -> pa.RecordBatch:
        query, q = part.column("id").to_numpy(), _matrix(part.column("x"), kind_)
        low = np.searchsorted(keys, part.column("low").to_numpy(), "left")
        high = np.searchsorted(keys, part.column("high").to_numpy(), "right")
        if not deep:
            low, high = low - BESIDE, high + BESIDE
        score = q @ xs.T
        place = np.arange(len(keys))
        score[(place < low[:, None]) | (place >= high[:, None])] = -np.inf
        n = min(k, len(keys))
        top = np.argpartition(-score, n - 1, axis=1)[:, :n]
        value = np.take_along_axis(score, top, axis=1)
        ok = np.isfinite(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.broadcast_to(query[:, None], top.shape)[ok]), pa.array(ids[top][ok]), pa.array(value[ok])], ["query_id", "id", "score"]
        )

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors found with the largest inner products.

    ``queries`` has the columns of ``vectors``; a query is no candidate of its
    own. Scores are exact double sums over the given vectors, ties go to the
    smaller id. Rows whose vector or id is null, that are zero or hold a null or
    non-finite component take no part, and vectors must have one length. Equal
    vectors are indexed once; of their ids the ``k + 1`` smallest can be among
    the nearest, and no more are looked at. Where fewer than ``k`` candidates exist, all
    are returned.
    """
    spark, kind = vectors.sparkSession, _kind(vectors, vector)
    out = "query_id long, rank int, vec_id long, score double"
    by_id = Window.partitionBy("x").orderBy("id")
    ranked = usable_vectors(vectors, key, vector).distinct().withColumn("_r", F.row_number().over(by_id)).filter(F.col("_r") <= k + 1)
    copies = written(ranked.withColumn("copy_of", F.min("id").over(Window.partitionBy("x"))).select("id", "x", "copy_of"))
    index = copies.filter("id = copy_of").select("id", "x")
    size = index.count()
    if not size:
        return spark.createDataFrame([], out)
    sample = smallest_hashes(index, size, SAMPLE, "id", "id").collect()
    points = np.stack([np.frombuffer(r[1], kind).astype(np.float64) for r in sample])

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.linalg.norm(_matrix(b.column(0), kind), axis=1).max())])], ["n"])

    longest = index.select("x").mapInArrow(norms, "n double").agg(F.max("n")).first()[0]
    blocks = -(-size // BLOCK)
    forest = Forest(points, min(blocks, len(points)), longest, kind)
    sizes = index.select("x").mapInArrow(_block_sizes(spark.sparkContext.broadcast(forest)), "tree int, block int, n long")
    forest.cut({(r[0], r[1]): r[2] for r in sizes.groupBy("tree", "block").agg(F.sum("n")).collect()}, BLOCK)
    given = spark.sparkContext.broadcast(forest)
    posted = index.mapInArrow(_index_rows(given), _POSTED)
    parts = max(parallelism(spark), min(int(forest.pieces.sum()), 8 * parallelism(spark)))

    def scored(asking: DataFrame, deep: bool) -> DataFrame:
        both = posted.unionAll(asking.mapInArrow(_query_rows(given, deep), _POSTED))
        both = both.repartition(parts, "tree", "block", "piece").sortWithinPartitions("tree", "block", "piece", "kind")
        found = both.mapInArrow(_search(k + 1, deep, kind), "query_id long, id long, score double")
        return found.groupBy("query_id", "id").agg(F.max("score").alias("score"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def top(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)

    # Equal queries are asked once, for one more vector, as each leaves itself out at the end.
    asked = written(usable_vectors(queries, key, vector).distinct())
    once = written(asked.groupBy("x").agg(F.min("id").alias("id")).select("id", "x"))
    near = top(scored(once, False), k + 1).groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    asking = once.join(written(near), F.col("id") == F.col("query_id"), "left").select(
        "id", "x", F.when(F.col("n") > k, F.col("kth")).otherwise(F.lit(float("-inf"))).alias("kth")
    )
    hits = top(scored(asking, True), k + 1).select("query_id", F.col("id").alias("copy_of"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                value = (_matrix(b.column("q"), kind) * _matrix(b.column("x"), kind)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("_once"), b.column("id"), pa.array(value)], ["_once", "id", "score"])

    q = once.select(F.col("id").alias("_once"), F.col("x").alias("q"))
    pairs = hits.withColumnRenamed("query_id", "_once").join(q, "_once").join(copies, "copy_of").select("_once", "q", "id", "x")
    sums = pairs.mapInArrow(score, "_once long, id long, score double")
    askers = asked.join(once.withColumnRenamed("id", "_once"), "x").select(F.col("id").alias("query_id"), "_once")
    each = askers.join(sums, "_once").filter("id != query_id")
    return top(each, k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
