"""Best-fit packing in bulk-synchronous rounds.

Documents longer than half a sequence open one each; the room they leave is a gap.
In a round, the unplaced documents and the gaps are range-sorted by size, largest
first, and every range is swept: a gap goes on a stack, a document takes the gap
on top, which is the smallest that fits. Documents that find no gap in their own
range take what the ranges before it left over; conflicts are settled by rank, so
no gap is given twice. The gaps shrink and the next round begins. When a round
places few documents, new empty sequences are opened for the rest.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import batches_of, kept, parallelism, trimmed, written

#: Words of one of the two generations that a worker keeps the ids of, and the longest word it keeps.
CACHE, LONGEST = 200_000, 40
#: Letters that normalising leaves letters, lower-cased one by one; a word of them; a sign beyond their range; a mark after one.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
LATIN, NOT_LATIN = re.compile(f"[{LETTERS}]+"), re.compile(r"[^\x00-įı-ſ]")
MARK = re.compile(rf"[!-&(-/:;=?@\[-`{{}}~](?<=[{LETTERS}].)")
#: A round that places a smaller part of its documents opens new sequences.
FEW = 0.1
#: Rows of a range in a round's sort.
RANGE_ROWS = 20_000
_SWEPT = "what int, row long, sequence_id long, room long, size long, part int, rank long"
_PLACED, _DOCUMENT, _GAP, _USED = range(4)


def _byte_signs() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for signs from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


class Ids(dict):
    """The ids of a word as little-endian 32-bit numbers.

    The vocabulary's pre-tokenizer drops white space and never joins letters with
    other characters, so a blank between a Latin letter and a mark changes no id. A
    text of Latin signs is lower-cased whole, as normalising does, unless it may hold a
    control token, which is met before that. So the forms of a word are kept once. A
    Latin word is one pre-token and goes to the library's model without the steps before it.
    """

    signs = _byte_signs()

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        library = Tokenizer.from_file(path)
        self.encode, self.model = library.encode, library.model
        self.older: dict[str, bytes] = {}
        self.four = [i.to_bytes(4, "little") for i in range(library.get_vocab_size())]
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.made(word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                # words that are met again come back from the older generation, rare ones go with it
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def made(self, word: str) -> bytes:
        """The ids by the library."""
        if len(word) <= LONGEST and (word.isalpha() if word.isascii() else LATIN.fullmatch(word)):
            signs = word.lower()
            if not signs.isascii():
                signs = signs.encode().decode("latin-1").translate(self.signs)
            return b"".join([self.four[x.id] for x in self.model.tokenize(signs)])
        return b"".join([self.four[i] for i in self.encode(word, add_special_tokens=False).ids])

    @staticmethod
    def spaced(text: str) -> str:
        """The text with blanks around its words."""
        if "<|" not in text and (text.isascii() or not NOT_LATIN.search(text)):
            text = text.lower()
        return MARK.sub(r" \g<0>", text).replace("\n", " ")

    def of_text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.spaced(text).split(" ")))

    def of_texts(self, texts: list[str]) -> Iterator[bytes]:
        """``of_text`` of each text of a batch; a word that the batch repeats is looked up once."""
        words = pc.split_pattern(pa.array([self.spaced(t) for t in texts], pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array([self[w] for w in distinct], pa.large_binary()).take(coded.indices)
        _, starts, data = ids.buffers()
        ends = np.frombuffer(starts, np.int64)[words.offsets.to_numpy()].tolist() if starts else [0]
        data = memoryview(data or b"")
        for first, last in zip(ends[:-1], ends[1:], strict=True):
            yield bytes(data[first:last])


def tokenised_pieces(documents: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, piece, start, length, ids_crc32``: the ids of each text and a final 1, cut at ``limit``.

    ``row`` numbers the pieces, unique and in no order.
    """
    kind = dict(documents.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, row = kept(Ids, path), TaskContext.get().partitionId() << 33
        for b in batches:
            held: list[list] = [[] for _ in range(6)]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, found in zip(b.column(0).to_pylist(), ids.of_texts(texts), strict=True):
                data = found + b"\x01\x00\x00\x00"
                for piece, at in enumerate(range(0, len(data), 4 * limit)):
                    part = data[at : at + 4 * limit]
                    for column, v in zip(held, (row, doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
                    row += 1
            kinds = [pa.int64(), b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(held, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(trimmed(cut), f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come largest first, gaps before documents of their size."""
    part = TaskContext.get().partitionId()

    def rows():
        stack: list[list[int]] = []
        lost = 0
        for b in batches:
            for size, kind, row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if kind == 0:
                    stack.append([row, size])
                elif not stack:
                    yield _DOCUMENT, row, None, None, size, part, lost
                    lost += 1
                else:
                    gap = stack[-1]
                    yield _PLACED, row, gap[0], gap[1], size, part, None
                    gap[1] -= size
                    if gap[1] < size:
                        stack.pop()
                        yield _USED, None, gap[0], gap[1], None, part, None
        for rank, (row, room) in enumerate(reversed(stack)):
            yield _GAP, None, row, room, None, part, rank

    kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int64()]
    names = [x.split()[0] for x in _SWEPT.split(", ")]
    return batches_of(rows(), pa.schema(list(zip(names, kinds, strict=True))), 8192)


def _across(counts: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """``part, first, last, gap_part, shift``: left-over documents take the left-over gaps of earlier ranges.

    The document of rank r in ``[first, last)`` takes the gap of rank ``r + shift``.
    ``counts`` has two numbers for each range.
    """
    out, stack = [], []
    for part in sorted({p for p, _ in counts}):
        need, at = counts.get((part, _DOCUMENT), 0), 0
        while at < need and stack:
            gap_part, first, n = stack[-1]
            take = min(n, need - at)
            out.append((part, at, at + take, gap_part, first - at))
            at += take
            stack[-1] = (gap_part, first + take, n - take)
            if n == take:
                stack.pop()
        if gaps := counts.get((part, _GAP), 0):
            stack.append((part, 0, gaps))
    return out


def best_fit(items: DataFrame, limit: int) -> DataFrame:
    """``row, sequence_id, offset`` for ``items(row, length)``, lengths from 1 to ``limit``.

    The driver sees two counts of each range in each round and no rows. Equal
    lengths are told apart by row, so a length that many documents share spreads
    over ranges. Every round's result is written to the shared folder.
    """
    spark = items.sparkSession
    most = parallelism(spark)
    large = items.filter(F.col("length") * 2 > limit)
    placed = [large.select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    documents = items.filter(F.col("length") * 2 <= limit).select("row", F.col("length").alias("size"))
    gaps = large.filter(F.col("length") < limit).select(F.col("row").alias("sequence_id"), (limit - F.col("length")).alias("room"))
    left = items.agg(F.count_if(F.col("length") * 2 <= limit), F.count(F.lit(1))).first()
    waiting, rows, opened = left[0], left[1], 0
    while waiting:
        ranges = max(1, min(most, rows // RANGE_ROWS))
        both = documents.select("size", F.lit(1).alias("kind"), "row").unionAll(
            gaps.select(F.col("room").alias("size"), F.lit(0).alias("kind"), F.col("sequence_id").alias("row"))
        )
        order = [F.desc("size"), F.col("kind"), F.col("row")]
        swept = written(both.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(trimmed(_sweep), _SWEPT))
        found = {
            (r[0], r[1]): (r[2], r[3] or 0) for r in swept.groupBy("part", "what").agg(F.count(F.lit(1)), F.sum("size")).collect()
        }
        pairs = _across({k: n for k, (n, _) in found.items() if k[1] in (_DOCUMENT, _GAP)})
        local = swept.filter(F.col("what") == _PLACED)
        placed.append(local.select("row", "sequence_id", (limit - F.col("room")).alias("offset")))
        lost = swept.filter(F.col("what") == _DOCUMENT).select("row", "size", "part", "rank")
        spare = swept.filter(F.col("what") == _GAP).select("sequence_id", "room", "part", "rank")
        used = swept.filter(F.col("what") == _USED).select("sequence_id", "room")
        across = sum(p[2] - p[1] for p in pairs)
        if pairs:
            # At most two pieces for each range; a range's documents are served in the order of their ranks.
            pieces = F.broadcast(spark.createDataFrame(pairs, "part int, first long, last long, gap_part int, shift long"))
            served = {p[0]: p[2] for p in pairs}
            until = F.element_at(F.lit([served.get(i, 0) for i in range(max(served) + 1)]), F.least(F.col("part"), F.lit(max(served))) + 1)
            until = F.when(F.col("part") <= max(served), until).otherwise(0)
            crossing = lost.filter(F.col("rank") < until).alias("d").join(pieces.alias("p"), F.expr("d.part = p.part and d.rank >= p.first and d.rank < p.last"))
            crossing = crossing.select("row", "size", F.col("gap_part").alias("part"), (F.col("rank") + F.col("shift")).alias("rank"))
            lost = lost.filter(F.col("rank") >= until)
            joined = written(spare.join(crossing, ["part", "rank"], "left"))
            placed.append(joined.filter(F.col("row").isNotNull()).select("row", "sequence_id", (limit - F.col("room")).alias("offset")))
            spare = joined.select("sequence_id", (F.col("room") - F.coalesce("size", F.lit(0))).alias("room"))
        documents, gaps = lost.select("row", "size"), spare.select("sequence_id", "room").unionAll(used).filter("room > 0")
        without = sum(n for (_, what), (n, _) in found.items() if what == _DOCUMENT)
        tokens = sum(s for (_, what), (_, s) in found.items() if what == _DOCUMENT)
        before, waiting = waiting, without - across
        rows = waiting + sum(n for (_, what), (n, _) in found.items() if what in (_GAP, _USED))
        if waiting and before - waiting <= FEW * before:
            fresh = max(1, -(-tokens * waiting // (without * limit)))
            ids = spark.range(opened + 1, opened + 1 + fresh).select((-F.col("id")).alias("sequence_id"))
            gaps = gaps.unionAll(ids.select("sequence_id", F.lit(limit).cast("long").alias("room")))
            opened, rows = opened + fresh, rows + fresh
    out = placed[0]
    for p in placed[1:]:
        out = out.unionAll(p)
    return out


def pack(documents: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents with their sequence and place.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null text
    counts as empty: one piece that holds the final id alone. Repeated documents
    are packed one by one; no document is dropped. Sequences that a document
    opened carry a number from 0, empty ones a negative number.
    """
    pieces = written(tokenised_pieces(documents, path, limit, key, text))
    return pieces.join(best_fit(pieces.select("row", "length"), limit), "row").drop("row")
