"""Token counts by a map-side lookup in two tiers.

A pre-token is a word with the white space before it; no vocabulary piece runs
across the start of one, so a text's tokens are the sum over its pre-tokens.
Tier one is a broadcast table of frequent pre-tokens and their lengths; what it
lacks is encoded once by the library and kept in the worker's own cache. Nothing
is shuffled but the counts of the documents themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that the frequent pre-tokens are counted in, and the entries of the table.
SAMPLE_DOCS, ENTRIES = 1000, 65_536
#: Entries of a worker's cache before it starts again from the table; longer pre-tokens are not kept.
CACHE, LONGEST = 300_000, 48
_RUNS = re.compile(r" *[^ ]+| +\Z")


class Lengths(dict):
    """Tokens of a pre-token, given without the one space before it."""

    def __init__(self, path: str, frequent: dict[str, int]):
        import sentencepiece

        super().__init__(frequent)
        self.frequent = frequent
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.last_space = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode(word))
        if len(word) <= LONGEST and "\n" not in word:
            if len(self) >= CACHE:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n

    def additive(self) -> bool:
        """True if a text's count is the sum over its pre-tokens under this model."""
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        keeps_space = len(self.model.encode("a  b")) != len(self.model.encode("a b")) and self.model.encode("a") == self.model.encode("b a")[-1:]
        return keeps_space and not any("▁" in p.lstrip("▁") for p in pieces)

    def of_text(self, text: str) -> int:
        if "▁" in text:  # the model's own sign for a space
            return len(self.model.encode(text))
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return sum(self.last_space if w == " " else self[w[1:]] for w in _RUNS.findall(" " + text)) if text else 0
        return sum(map(self.__getitem__, text.split(" ")))


def frequent_pretokens(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> Broadcast:
    """The table: the commonest pre-tokens of a hash sample of ``SAMPLE_DOCS`` documents.

    It only speeds counting up; counts never depend on it. Each task sends its
    commonest ``ENTRIES // 32`` pre-tokens of the sample.
    """
    position = F.xxhash64(key)
    last = documents.select(position.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(w for w in t.split(" ") if len(w) <= LONGEST and "\n" not in w)
        top = seen.most_common(ENTRIES // 32)
        yield pa.RecordBatch.from_pydict({"word": [w for w, _ in top], "n": pa.array([n for _, n in top], pa.int64())})

    spark, seen = documents.sparkSession, Counter()
    if last is not None:
        sample = documents.filter((position <= last) & F.col(text).isNotNull()).select(F.col(text).alias("text"))
        counts = sample.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        seen.update({r[0]: r[1] for r in counts.orderBy(F.desc("n"), "word").limit(ENTRIES).collect()})
    lengths = Lengths(path, {})
    return spark.sparkContext.broadcast({w: lengths[w] for w, _ in seen.most_common(ENTRIES)})


def count_tokens(documents: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    Counts equal the library's for the whole text, without begin or end tokens.
    Null and empty texts have no bytes and no tokens. Repeated rows are counted
    one by one; a pre-token of any length goes to the library whole. Other
    columns are not read.
    """
    frequent = frequent_pretokens(documents, path, key, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(path, frequent.value)
        of_text = lengths.of_text if lengths.additive() else lambda t: len(lengths.model.encode(t))
        for b in batches:
            n = pa.array((of_text(t or "") for t in (x.as_py() for x in b.column("text"))), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    narrow = documents.select(
        F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    )
    kind = dict(narrow.dtypes)["doc_id"]
    counted = narrow.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
