"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed byte n-grams. Every language
has several centroids, found by clustering the vectors of its sample; a text gets
the language of the centroid with the largest cosine. A text whose best cosine
lies far below what the sample shows for its length is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sourceweave.llm.common import trimmed, written

#: Labelled documents of a language that a model is fitted on: a bounded hash sample.
SAMPLE = 400
#: Languages that a model may hold; with ``DIMS * CENTROIDS`` it bounds the broadcast.
LANGUAGES = 512
DIMS, CENTROIDS, ROUNDS = 8192, 4, 10
#: Rejected below this part of the lowest cosine in the sample at this length or less,
#: if the sample holds so many texts of this length or less; shorter texts are never too far.
SLACK, ENOUGH = 0.5, 100
_SLICE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of the lower-cased bytes; not letters are spaces."""
    data = _FOLD[np.frombuffer(f" {text} ".lower().encode("utf-8", "replace"), np.uint8)]
    counts = np.zeros(DIMS, np.float32)
    for at in range(0, max(1, len(data) - 2), _SLICE):
        b = data[at : at + _SLICE + 2].astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(257) + b[2:]
        n = min(_SLICE, len(two))
        for grams, seed in ((b[:n], 0x9E3779B1), (two[:n], 0x85EBCA6B), (three[:n], 0xC2B2AE35)):
            counts += np.bincount(((grams + np.uint32(1)) * np.uint32(seed)) >> np.uint32(19), minlength=DIMS)
    return counts


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def _length_class(chars: int) -> int:
    return int(chars).bit_length()


@dataclass
class Model:
    languages: list[str]  #: of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  #: least accepted cosine by length class

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """``language, score, rejected``; ``und`` for null, for no letter, and without a learned language."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        for k in range(0, len(known), 256):
            part = known[k : k + 256]
            cosine = _vectors(np.stack([ngram_counts(texts[i]) for i in part]), self.idf) @ self.centroids.T
            best = cosine.argmax(axis=1)
            for i, row, j in zip(part, cosine, best, strict=True):
                score = float(min(1.0, max(0.0, row[j])))
                out[i] = (self.languages[j], score, score < self.floor[_length_class(len(texts[i]))])
        return out


def _clusters(x: np.ndarray) -> np.ndarray:
    """Spherical k-means, started from the mean's nearest row and then the rows farthest away."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(CENTROIDS, len(x)):
        nearest = (x @ x[chosen].T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        chosen.append(int(nearest.argmin()))
    centres = x[chosen]
    for _ in range(ROUNDS):
        of = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([x[of == c].sum(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from at most ``SAMPLE`` labelled texts of each language.

    Rows with a null key, text or language take no part. Counting, IDF and
    clustering run in tasks; the driver gets the languages, the IDF and the
    centroids. More than ``LANGUAGES`` languages are an error.
    """
    spark = labelled.sparkSession
    usable = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    usable = usable.select(F.xxhash64(key).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    by_hash = Window.partitionBy("lang").orderBy("h")
    last = usable.select("lang", "h").withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= SAMPLE)
    lasts = last.groupBy("lang").agg(F.max("h").alias("last")).limit(LANGUAGES + 1).collect()
    if len(lasts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not lasts:
        return Model([], np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros(64))
    lasts_df = spark.createDataFrame([tuple(r) for r in lasts], "lang string, last long")
    tied = Window.partitionBy("lang").orderBy("h", F.crc32(F.encode("text", "UTF-8")), "text")
    sample = usable.join(F.broadcast(lasts_df), "lang").filter("h <= last")
    sample = sample.withColumn("k", F.row_number().over(tied)).filter(F.col("k") <= SAMPLE).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            counts = [ngram_counts(t).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), pa.array(counts, pa.binary()), pa.array([_length_class(len(t)) for t in texts], pa.int32())],
                ["lang", "counts", "length_class"],
            )

    counted = written(sample.mapInArrow(trimmed(count), "lang string, counts binary, length_class int"))

    def seen_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS), 0
        for b in batches:
            for c in b.column("counts"):
                total += np.frombuffer(c.as_py(), np.float32) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"seen": [total.tobytes()], "n": pa.array([n], pa.int64())})

    parts = counted.select("counts").mapInArrow(trimmed(seen_in), "seen binary, n long").collect()
    total, n = sum(np.frombuffer(p[0]) for p in parts), sum(p[1] for p in parts)
    idf = np.log((1 + n) / (1 + total)).astype(np.float32) + np.float32(1)

    def cluster(group: pa.Table) -> pa.Table:
        x = _vectors(np.stack([np.frombuffer(c.as_py(), np.float32) for c in group["counts"]]), idf)
        centres = _clusters(x)
        lowest, classes = np.ones((2, 64)), group["length_class"].to_numpy()
        np.minimum.at(lowest[0], classes, (x @ centres.T).max(axis=1))
        lowest[1] = np.bincount(classes, minlength=64)
        columns = [[group["lang"][0].as_py()] * len(centres), [c.astype(np.float32).tobytes() for c in centres], [lowest.tobytes()] * len(centres)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["lang", "centroid", "lowest"])

    found = counted.groupBy("lang").applyInArrow(cluster, "lang string, centroid binary, lowest binary").collect()
    found.sort(key=lambda r: (r[0], bytes(r[1])))
    by_language = np.stack([np.frombuffer(b).reshape(2, 64) for b in {r[0]: bytes(r[2]) for r in found}.values()])
    enough = by_language[:, 1].sum(axis=0).cumsum() >= ENOUGH
    floor = np.where(enough, np.minimum.accumulate(by_language[:, 0].min(axis=0)) * SLACK, 0.0)
    return Model([r[0] for r in found], np.stack([np.frombuffer(r[1], np.float32) for r in found]), idf, floor)


def training_rows(documents: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id's text not divisible by 5."""
    return documents.filter(F.expr("crc32(cast(doc_id as string)) % 5 != 0"))


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with ``lang_pred, score, rejected``, from whole texts.

    ``score`` is the best cosine. Null texts and texts without a letter are
    ``und``, score 0, rejected. Rows stay where they are, repeated ones too;
    columns named like the results are replaced.
    """
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    names = [c for c in (keep or df.columns) if c not in dict(added)]
    out = T.StructType([*[df.schema[c] for c in names], *[T.StructField(n, t) for n, t in added]])
    schema = to_arrow_schema(out)
    given = df.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in ((w, i) for w in batches for i in range(0, w.num_rows, 512)):
            b = whole.slice(at, 512)
            found = given.value.predict(b.column("_text").to_pylist())
            columns = [b.column(c).cast(schema.field(c).type) for c in names]
            columns += [pa.array(c, schema.field(n).type) for (n, _), c in zip(added, zip(*found, strict=True), strict=True)] if found else []
            if found:
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    quoted = [F.col(f"`{c}`") for c in names]
    return df.select(*quoted, F.col(text).alias("_text")).mapInArrow(trimmed(predict), out)
