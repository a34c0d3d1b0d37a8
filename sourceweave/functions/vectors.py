"""Vector expressions and the Arrow helpers that score and embed inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ----------------------------------------------------------------
EMBEDDING_DIM = 384
COSINE_EPSILON = 1e-8

#: Characters hashed per numpy block, so a task's working set stays small.
BLOCK_CHARS = 2_000_000

#: Queries scored at once against an Arrow batch, and values of the pairs that are scored exactly at once.
QUERY_BLOCK, EXACT_VALUES = 1024, 1 << 20


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(COSINE_EPSILON))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams of the lower-cased text padded with one space on both sides."""
    chars = F.split(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), "")

    def grams(c: Column) -> Column:
        last = F.size(c) - n
        return F.when(
            last >= 0,
            F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat(*[F.get(c, i + j) for j in range(n)])),
        ).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(chars), grams), 1)


def _hash_sums(texts: list[str], dim: int) -> np.ndarray:
    """Signed 3-gram counts by hashed index for a block of texts."""
    out = np.zeros((len(texts), dim))
    codes, rows = [], []
    for row, text in enumerate(texts):
        cp = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        if len(cp) >= 3:
            codes.append((cp[:-2] << np.uint64(42)) | (cp[1:-1] << np.uint64(21)) | cp[2:])
            rows.append(np.full(len(cp) - 2, row))
    if not codes:
        return out
    distinct, where = np.unique(np.concatenate(codes), return_inverse=True)
    index, sign = np.empty(len(distinct), np.int64), np.empty(len(distinct))
    for i, code in enumerate(distinct.tolist()):
        gram = (chr(code >> 42) + chr((code >> 21) & 0x1FFFFF) + chr(code & 0x1FFFFF)).encode("utf-8", "surrogatepass")
        index[i] = int.from_bytes(hashlib.md5(gram).digest()[:4], "little") % dim
        sign[i] = 1 if hashlib.sha1(gram).digest()[0] % 2 == 0 else -1
    flat = np.concatenate(rows) * dim + index[where]
    return np.bincount(flat, weights=sign[where], minlength=out.size).reshape(out.shape)


def _blocks(series: pd.Series, dim: int) -> Iterator[np.ndarray]:
    """Signed counts of the texts of an Arrow batch, some million characters at a time."""
    texts, start, size = series.fillna("").tolist(), 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= BLOCK_CHARS or end == len(texts):
            yield _hash_sums(texts[start:end], dim)
            start, size = end, 0


def hash_sums(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Signed hashed 3-gram counts as ``array<int>`` (the vector before normalising).

    Each distinct 3-gram of a block is hashed once; counting is vectorised.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(series: pd.Series) -> pd.Series:
        return pd.Series([row for block in _blocks(series, dim) for row in block.astype(np.int32)])

    return run(text)


def hash_embed(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """L2-normalised hashed 3-gram vector as ``array<float>``; a zero vector stays zero."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(series: pd.Series) -> pd.Series:
        rows = []
        for block in _blocks(series, dim):
            norm = np.linalg.norm(block, axis=1, keepdims=True)
            rows.extend((block / np.where(norm > 0, norm, 1.0)).astype(np.float32))
        return pd.Series(rows)

    return run(text)


# --- top-k scoring ------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _keep_best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Best ``k`` rows per query by score, then id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.r_[True, q[1:] != q[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = np.arange(len(q)) - start < k
    return q[keep], ids[keep], scores[keep]


def score_block(ids: np.ndarray, vecs: np.ndarray, queries: np.ndarray, k: int, query_block: int = 256):
    """Top-``k`` vectors of a block for every query: ``(query position, id, score)`` arrays."""
    out = []
    norms = np.linalg.norm(vecs, axis=1)
    for lo in range(0, len(queries), query_block):
        part = queries[lo : lo + query_block]
        scores = np.round(vecs @ part.T / (np.outer(norms, np.linalg.norm(part, axis=1)) + COSINE_EPSILON), 9)
        if len(vecs) > k:
            limit = np.partition(scores, len(vecs) - k, axis=0)[len(vecs) - k]
            hit = scores >= limit
        else:
            hit = np.ones_like(scores, dtype=bool)
        row, col = np.nonzero(hit)
        out.append(_keep_best(col + lo, ids[row], scores[row, col], k))
    return [np.concatenate(x) for x in zip(*out)]


def _units(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Norms, rows of length one in single precision, and the rows that these cannot stand for."""
    norms = np.linalg.norm(vecs, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        units = (vecs / np.where(norms > 0, norms, 1.0)[:, None]).astype(np.float32)
    # COSINE_EPSILON is felt by short vectors
    return norms, units, ~((norms == 0) | ((norms >= 0.1) & np.isfinite(norms)))


def _near(ids: np.ndarray, vecs: np.ndarray, queries: np.ndarray, measured: tuple, floor: np.ndarray, k: int, block: int):
    """``(query position, id, score)`` of a batch, of all pairs whose score may reach ``floor``, the ``k``-th best so far.

    Scores in single precision, which are off by less than ``slack``, rule the other pairs
    out. Queries without a floor, and those that many vectors come near to, are scored densely.
    """
    (norms, units, odd), (q_norms, q_units, q_odd) = _units(vecs), measured
    slack = vecs.shape[1] * 2.0**-23 + 2e-6
    out, scored = [], max(EXACT_VALUES // max(vecs.shape[1], 1), 1)
    for lo in range(0, len(queries), block):
        part = slice(lo, lo + block)
        dense = q_odd[part] | np.isneginf(floor[part]) | odd.any()
        if not dense.all():
            limit = np.where(dense, np.inf, floor[part] - slack).astype(np.float32)
            row, col = np.divmod(np.flatnonzero(units @ q_units[part].T >= limit), len(dense))
            dense |= np.bincount(col, minlength=len(dense)) > 8 * k + 32
            row, col = row[~dense[col]], col[~dense[col]] + lo
            for at in range(0, len(row), scored):
                r, c = row[at : at + scored], col[at : at + scored]
                scores = np.round(np.einsum("ij,ij->i", vecs[r], queries[c]) / (norms[r] * q_norms[c] + COSINE_EPSILON), 9)
                hit = scores >= floor[c]
                out.append((c[hit], ids[r[hit]], scores[hit]))
        if dense.any():
            some = np.flatnonzero(dense) + lo
            q, found, scores = score_block(ids, vecs, queries[some], k)
            out.append((some[q], found, scores))
    return [np.concatenate(x) for x in zip(*out)] if out else None


def topk_batches(
    batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, queries: np.ndarray, k: int, schema: pa.Schema, block: int = QUERY_BLOCK
):
    """Running top-``k`` per query over the Arrow batches of one task, ``block`` queries at a time."""
    queries, best = queries.astype(np.float64), None
    measured, floor = _units(queries), np.full(len(queries), -np.inf)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        found = _near(ids, _matrix(batch.column(1)), queries, measured, floor, k, min(block, QUERY_BLOCK))
        if found is None or not len(found[0]):
            continue
        changed = np.zeros(len(queries), bool)
        changed[found[0]] = True
        kept = [x[:0] for x in found] if best is None else best
        again = changed[kept[0]]
        merged = _keep_best(*[np.concatenate((x[again], y)) for x, y in zip(kept, found)], k)
        best = [np.concatenate((x[~again], y)) for x, y in zip(kept, merged)]
        q, _, scores = merged
        last = np.r_[q[1:] != q[:-1], True] & (np.bincount(q)[q] == k)
        floor[q[last]] = scores[last]
    if best is not None:
        q, ids, scores = best
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[q], schema.field(0).type), pa.array(ids, schema.field(1).type), pa.array(scores, pa.float64())], schema=schema
        )


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of the second column as bytes of their values, which reach the driver faster than lists."""
    for batch in batches:
        kind = batch.schema.field(1).type.value_type.to_pandas_dtype()
        rows = [row.tobytes() for row in _matrix(batch.column(1)).astype(kind)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["query_id", "q"])
